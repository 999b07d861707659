"""Usage shares, their normalisation and the weighted utilization score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.exprs import clip, held, safe_divide, zero
from weekgrain.functions.order_stats import melt, quantiles, with_rank
from weekgrain.keys import KEYS, Keys, settled

# fixed values: summed column -> name of the team total
TEAM_TOTALS = {"targets": "team_targets", "receptions": "team_receptions", "rushing_attempts": "team_rush_attempts",
               "snap_count": "team_snaps", "air_yards": "team_air_yards", "redzone_targets": "team_redzone_targets",
               "passing_attempts": "team_pass_attempts"}


def with_team_totals(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Share denominators per team-week: aggregate with map-side combine, then join the small result back.

    A window over (team, week) would gather a large team in one task.
    """
    totals = panel.groupBy(*keys.team_week).agg(*[F.sum(c).alias(t) for c, t in TEAM_TOTALS.items()])
    return panel.join(totals, keys.team_week, "left")


def high_value_touch_rate(panel: DataFrame) -> DataFrame:
    n = zero("rush_inside_10") + zero("targets_15_plus")
    return panel.withColumn("high_value_touch_rate", held(safe_divide(n, zero("rushing_attempts") + zero("targets")) * 100, 0.0, 100.0))


def components(panel: DataFrame) -> DataFrame:
    """Component percentages for all positions in one projection. Needs team totals and the high-value rate."""
    c, pos = F.col, F.col("position")
    pct = lambda n, d: safe_divide(n, d) * 100
    qb_plays = c("passing_attempts") + c("rushing_attempts")
    tds = lambda *cols: sum((zero(x) for x in cols), F.lit(0))
    # a projection of their own, so that the columns below read the two shares instead of repeating them
    panel = panel.withColumns({"_snap": pct(c("snap_count"), c("team_snaps")), "_target": pct(c("targets"), c("team_targets"))})
    snap, target = c("_snap"), c("_target")
    return panel.withColumns({
        "snap_share_pct": F.when(pos != "QB", snap),
        "target_share_pct": F.when(pos != "QB", target),
        "rush_share_pct": F.when(pos == "RB", pct(c("rushing_attempts"), c("team_rush_attempts")))
        .when(pos == "QB", pct(c("rushing_attempts"), c("rushing_attempts") + 5)),
        "redzone_share_pct": F.when(pos == "RB", held(tds("rushing_tds", "receiving_tds") * 10.0, 0.0, 100.0)),
        "touch_share_pct": F.when(pos == "RB", pct(c("rushing_attempts") + c("receptions"), c("team_rush_attempts") + c("team_receptions"))),
        "air_yards_share_pct": F.when(pos.isin("WR", "TE"), pct(c("air_yards"), c("team_air_yards"))),
        "redzone_targets_pct": F.when(pos.isin("WR", "TE"), held(safe_divide(c("redzone_targets"), c("team_redzone_targets")), 0.0, 1.0) * 100),
        "route_participation_pct": F.when(pos == "WR", held(snap * 0.8, 0.0, 100.0)),
        "inline_rate_pct": F.when(pos == "TE", held(100 - safe_divide(snap, target + 1) * 10, 0.0, 100.0)),
        "dropback_rate_pct": F.when(pos == "QB", pct(c("passing_attempts"), qb_plays)),
        "redzone_opp_pct": F.when(pos == "QB", held(tds("passing_tds", "rushing_tds") * 12.0, 0.0, 100.0)),
        "play_volume_pct": F.when(pos == "QB", held(qb_plays / 50.0 * 100, 0.0, 100.0)),
    }).drop("_snap", "_target")


COMPONENTS = sorted({col for cols in C.COMPONENT_COLUMNS.values() for col in cols.values()})


def fit_bounds(train: DataFrame, columns: Sequence[str] = COMPONENTS, low: float = 0.01, high: float = 0.99,
               minimum: int = 10, keys: Keys = KEYS) -> DataFrame:
    """Rows (position, component, lo, hi, n) from train rows: exact percentiles, one ladder for all components."""
    long = melt(train, [keys.group], columns)
    fitted = quantiles(long, [keys.group, "component"], "value", {"lo": low, "hi": high}).where(F.col("n") >= minimum)
    return settled(fitted)  # a fit is done once; applying it must not run it again


def save_bounds(bounds: DataFrame, path: str, seasons: Sequence[int]) -> None:
    bounds.withColumn("train_seasons", F.array(*[F.lit(int(s)) for s in sorted(seasons)])).write.mode("overwrite").parquet(path)


def load_bounds(spark, path: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """Reads fitted bounds; refuses them when they were fitted on other seasons."""
    df = spark.read.parquet(path)
    if seasons is not None:
        want = F.array(*[F.lit(int(s)) for s in sorted(seasons)])
        if not df.where(F.col("train_seasons") != want).isEmpty():
            raise ValueError("bounds were fitted on other seasons")
    return df.drop("train_seasons")


def _as_map(bounds: DataFrame, keys: Keys) -> DataFrame:
    """Bounds as one row per position; positions x components is a fixed small number."""
    pair = F.struct("component", F.struct("lo", "hi"))
    return bounds.groupBy(keys.group).agg(F.map_from_entries(F.collect_list(pair)).alias("_bounds"))


def normalize_fitted(df: DataFrame, bounds: DataFrame, columns: Sequence[str], suffix: str = "_norm", keys: Keys = KEYS) -> DataFrame:
    """0..100 position of each value between the fitted bounds of its group; plain clipping where the bounds coincide."""
    out = df.join(_as_map(bounds, keys), keys.group, "left")

    def norm(c: str) -> Column:
        b = F.col("_bounds")[c]
        x, lo, hi = F.col(c), b["lo"], b["hi"]
        return F.when(hi > lo, clip((x - lo) / (hi - lo) * 100, 0.0, 100.0)).when(b.isNotNull(), clip(x, 0.0, 100.0))

    return out.withColumns({f"{c}{suffix}": norm(c) for c in columns}).drop("_bounds")


def normalize_by_rank(df: DataFrame, column: str, groups: Sequence[str], out: str) -> DataFrame:
    """0..100 percent rank inside the group (average ties, nulls last) for unfitted use."""
    return with_rank(df, list(groups), column, out, "pct").withColumn(out, F.col(out) * 100)


def weighted_score(df: DataFrame, weights: Mapping[str, Mapping[str, float]] = C.UTILIZATION_WEIGHTS, suffix: str = "_norm",
                   out: str = "utilization_score", keys: Keys = KEYS) -> DataFrame:
    """Sum of weight times normalised component per position, held to 0..100."""
    score = None
    for p, w in weights.items():
        total = sum((F.coalesce(F.col(f"{C.COMPONENT_COLUMNS[p][k]}{suffix}"), F.lit(0.0)) * float(v) for k, v in w.items()), F.lit(0.0))
        cond = F.col(keys.group) == p
        score = F.when(cond, total) if score is None else score.when(cond, total)
    return df.withColumn(out, clip(score, 0.0, 100.0))


def utilization(panel: DataFrame, bounds: DataFrame, weights: Mapping = C.UTILIZATION_WEIGHTS, keys: Keys = KEYS) -> DataFrame:
    """Shares, fitted normalisation and score in one pass."""
    parts = components(high_value_touch_rate(with_team_totals(panel, keys)))
    return weighted_score(normalize_fitted(parts, bounds, COMPONENTS, keys=keys), weights, keys=keys)


def with_expected_points(df: DataFrame) -> DataFrame:
    """Receiving opportunity rating, points expected from volume, and the difference to actual points."""
    pos = F.col("position")
    # fixed values: points per target, carry and pass attempt
    per_target, per_carry, per_pass = 1.5, 0.7, 0.35
    expected = (F.when(pos == "RB", zero("rushing_attempts") * per_carry + zero("targets") * per_target)
                .when(pos == "WR", zero("targets") * per_target).when(pos == "TE", zero("targets") * (per_target * 0.9))
                .when(pos == "QB", zero("passing_attempts") * per_pass + zero("rushing_attempts") * (per_carry * 1.2)).otherwise(0.0))
    wopr = 1.5 * F.col("target_share_pct") / 100 + 0.7 * F.col("air_yards_share_pct") / 100
    return df.withColumns({"wopr": F.coalesce(wopr, F.lit(0.0)), "expected_fp": expected}).withColumns({
        "wopr_normalized": clip(F.col("wopr") * 100 / 2.2, 0.0, 100.0),
        "fp_over_expected": F.col("fantasy_points") - F.col("expected_fp")})

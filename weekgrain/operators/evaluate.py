"""Accuracy, calibration, baselines, drift and tests.

Metrics are sums, so any grouping is one aggregate with map-side combine. Order
statistics and rank statistics read the value ladder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import erfc, exp, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.exprs import at_least, lookup
from weekgrain.functions.order_stats import first_rows, quantiles, value_ladder, with_ranks
from weekgrain.functions.windows import prior_mean
from weekgrain.keys import KEYS, Keys, settled

ACTUAL, PRED = "fantasy_points", "predicted_points"


# --- regression metrics ---------------------------------------------------------------------
def metric_columns(a: Column, p: Column) -> dict[str, Column]:
    """Aggregates of one group: every metric from sums over rows that have both values."""
    both = a.isNotNull() & p.isNotNull()
    a, p = F.when(both, a), F.when(both, p)
    e = a - p
    n, sst = F.count(e), F.var_pop(a) * F.count(e)
    spread = F.stddev_pop(a) * F.stddev_pop(p)  # corr() itself fails on a constant column
    within = {f"within_{k}_pct": F.avg((F.abs(e) <= k).cast("int")) * 100 for k in (3, 5, 7, 10)}
    return {
        "n": n, "rmse": F.sqrt(F.sum(e * e) / n), "mae": F.avg(F.abs(e)), "r2": F.when(sst > 0, 1 - F.sum(e * e) / sst),
        "correlation": F.when(spread > 0, F.covar_pop(a, p) / spread), "mape_floor3": F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(3.0))) * 100,
        "mape_nonzero": F.avg(F.when(a != 0, F.abs(e / a))) * 100, "mean_error": F.avg(-e), "std_error": F.stddev_samp(-e),
        "avg_actual": F.avg(a), "avg_predicted": F.avg(p), "std_actual": F.stddev_samp(a), "std_predicted": F.stddev_samp(p)} | within


def regression_metrics(df: DataFrame, groups: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    return df.groupBy(*groups).agg(*[c.alias(k) for k, c in metric_columns(F.col(actual), F.col(pred)).items()])


def direction_accuracy(df: DataFrame, groups: Sequence[str], actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """Share of rows on the same side of the group's mean actual."""
    mean = df.groupBy(*groups).agg(F.avg(actual).alias("_mean"))
    joined = df.join(mean, list(groups))
    same = (F.col(pred) > F.col("_mean")) == (F.col(actual) > F.col("_mean"))
    return joined.groupBy(*groups).agg((F.avg(same.cast("int")) * 100).alias("directional_accuracy_pct"))


def error_quantiles(df: DataFrame, groups: Sequence[str], actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    return quantiles(df.withColumn("_err", F.abs(F.col(actual) - F.col(pred))), list(groups), "_err", {"median_error": 0.5, "p90_error": 0.9, "p95_error": 0.95})


def tier(x: Column) -> Column:
    """Elite 18..100, strong 12..18, flex 7..12, else waiver."""
    return F.when((x >= 18) & (x < 100), "elite").when((x >= 12) & (x < 18), "strong").when((x >= 7) & (x < 12), "flex").otherwise("waiver")


def tier_accuracy(df: DataFrame, groups: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg((tier(F.col(actual)) == tier(F.col(pred))).cast("int")).alias("tier_accuracy"))


def boom_bust_columns(a: Column, p: Column, boom: float = 20.0, bust: float = 5.0) -> dict[str, Column]:
    out = {}
    for name, t, q in (("boom", a >= boom, p >= boom), ("bust", a < bust, p < bust)):
        tp, pp, ap = F.sum((t & q).cast("int")), F.sum(q.cast("int")), F.sum(t.cast("int"))
        prec, rec = F.when(pp > 0, tp / pp).otherwise(0.0), tp / ap
        out |= {f"{name}_prevalence": F.avg(t.cast("int")), f"{name}_precision": F.when(ap > 0, prec), f"{name}_recall": F.when(ap > 0, rec),
                f"{name}_f1": F.when(ap > 0, F.when(tp > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0))}
    return out


def boom_bust(df: DataFrame, groups: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED, boom: float = 20.0, bust: float = 5.0) -> DataFrame:
    return df.groupBy(*groups).agg(*[c.alias(k) for k, c in boom_bust_columns(F.col(actual), F.col(pred), boom, bust).items()])


# --- rank statistics -----------------------------------------------------------------------------
def spearman(df: DataFrame, groups: Sequence[str], actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """Correlation of average ranks inside each group."""
    g = list(groups)
    ok = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull()).select(*g, actual, pred)
    r = with_ranks(ok, [(g, actual, "_ra", "average", True), (g, pred, "_rp", "average", True)])
    return r.groupBy(*g).agg(F.corr("_ra", "_rp").alias("spearman_rho"), F.count(F.lit(1)).alias("n"))


def spearman_top(df: DataFrame, groups: Sequence[str], top: int = 50, actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS) -> DataFrame:
    """Spearman over the rows with the largest predictions of each group (at most ``top``, so plain windows do)."""
    g = list(groups)
    best = first_rows(df, g, [F.round(pred, 9).desc(), *[F.col(k) for k in keys.grain]], top)
    avg_rank = lambda c: (F.rank().over(Window.partitionBy(*g).orderBy(F.round(c, 9)))
                          + (F.count(F.lit(1)).over(Window.partitionBy(*g, F.round(c, 9))) - 1) / 2.0)
    r = best.withColumns({"_ra": avg_rank(actual), "_rp": avg_rank(pred)})
    return r.groupBy(*g).agg(F.corr("_ra", "_rp").alias("spearman_rho"), F.count(F.lit(1)).alias("n"))


# fixed values: replacement points in the value-accuracy test
VOR_REPLACEMENT = {"QB": 12.0, "RB": 10.0, "WR": 10.0, "TE": 8.0}


def vor_accuracy(df: DataFrame, groups: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS) -> DataFrame:
    """Rank correlation of predicted and actual value over replacement."""
    base = lookup(F.col(keys.group), VOR_REPLACEMENT, 10.0)
    shifted = df.withColumns({"_va": F.col(actual) - base, "_vp": F.col(pred) - base})
    return spearman(shifted, groups, "_va", "_vp").withColumnRenamed("spearman_rho", "vor_rank_correlation")


def interval_calibration(df: DataFrame, std: str, groups: Sequence[str] = (), levels: Sequence[float] = (0.50, 0.80, 0.90, 0.95),
                         actual: str = ACTUAL, pred: str = PRED, minimum: int = 20) -> DataFrame:
    """Coverage, error and width of normal intervals at several levels."""
    z = F.array(*[F.struct(F.lit(x).alias("nominal"), F.lit(NormalDist().inv_cdf(0.5 + x / 2)).alias("z")) for x in levels])
    ok = df.where((F.col(std) > 0) & F.col(actual).isNotNull() & F.col(pred).isNotNull()).withColumn("_l", F.explode(z))
    inside = F.abs(F.col(actual) - F.col(pred)) <= F.col("_l.z") * F.col(std)
    out = ok.groupBy(*groups, F.col("_l.nominal").alias("nominal")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("actual_coverage"), F.avg(2 * F.col("_l.z") * F.col(std)).alias("mean_interval_width"))
    err = F.abs(F.col("actual_coverage") - F.col("nominal"))
    return out.where(F.col("n") >= minimum).withColumns({"calibration_error": err, "passed": (err < 0.10).cast("int")})


def top_hits(df: DataFrame, groups: Sequence[str], tops: Sequence[int] = (5, 10, 20), actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS) -> DataFrame:
    """Share of the actual top n that was predicted top n, per group, averaged by the caller."""
    g, k = list(groups), max(tops)
    by = lambda c, out: first_rows(df.select(*g, keys.entity, c), g, [F.round(c, 9).desc(), F.col(keys.entity)], k).select(*g, keys.entity, F.col("_pos").alias(out))
    both = by(pred, "_pp").join(by(actual, "_pa"), [*g, keys.entity])
    hits = both.groupBy(*g).agg(*[F.sum(((F.col("_pp") <= n) & (F.col("_pa") <= n)).cast("int")).alias(f"_h{n}") for n in tops])
    size = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    return size.join(hits, g, "left").select(*g, "n", *[F.when(F.col("n") >= n, F.coalesce(F.col(f"_h{n}"), F.lit(0)) / float(n) * 100).alias(f"top_{n}_hit_rate") for n in tops])


def top_performers(df: DataFrame, n: int = 10, actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Totals of the n best of each position (and ``by``, for instance the season) with the rank the predictions gave them."""
    inside = [*by, keys.group]
    totals = df.groupBy(*inside, keys.entity, "name").agg(F.sum(actual).alias("actual_total"), F.sum(pred).alias("predicted_total"))
    r = with_ranks(totals, [(inside, "actual_total", "actual_rank", "average", False), (inside, "predicted_total", "pred_rank", "average", False)])
    return first_rows(r, inside, [F.col("actual_rank"), F.col(keys.entity)], n).drop("_pos")


def biggest_misses(df: DataFrame, n: int = 10, actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS) -> DataFrame:
    err = F.round(F.col(actual) - F.col(pred), 9)
    return df.withColumn("error", err).orderBy(F.abs("error").desc(), *keys.grain).limit(n)


# --- baselines -----------------------------------------------------------------------------------------
def with_baselines(panel: DataFrame, value: str = ACTUAL, keys: Keys = KEYS) -> DataFrame:
    """Trailing 3 and 5, rolling 4, season to date, persistence, prior-season average, and the (labelled) position-week mean."""
    w = keys.entity_window()
    seasons = panel.groupBy(keys.entity, (F.col(keys.season) + 1).alias(keys.season)).agg(F.avg(value).alias("baseline_prior_season"))
    weekly = panel.groupBy(*keys.period, keys.group).agg(F.avg(value).alias("oracle_position_week"))
    out = panel.withColumns({
        "baseline_trailing_3": prior_mean(value, w, 3), "baseline_trailing_5": prior_mean(value, w, 5), "baseline_rolling_4": prior_mean(value, w, 4),
        "baseline_season_avg": prior_mean(value, keys.entity_season_window()), "baseline_persistence": F.lag(value).over(w)})
    return out.join(seasons, [keys.entity, keys.season], "left").join(weekly, [*keys.period, keys.group])


BASELINES = ["baseline_trailing_3", "baseline_trailing_5", "baseline_rolling_4", "baseline_season_avg", "baseline_persistence", "baseline_prior_season"]


def compare_with(df: DataFrame, others: Sequence[str], groups: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED, minimum: int = 20) -> DataFrame:
    """Model against each other column on the rows where both exist: errors, improvement, 20 and 25 % gates."""
    stack = F.array(*[F.struct(F.lit(o).alias("baseline"), F.col(o).cast("double").alias("value")) for o in others])
    long = df.select(*groups, actual, pred, F.explode(stack).alias("_b")).where(F.col(actual).isNotNull() & F.col(pred).isNotNull() & F.col("_b.value").isNotNull())
    e, b = F.col(actual) - F.col(pred), F.col(actual) - F.col("_b.value")
    out = long.groupBy(*groups, F.col("_b.baseline").alias("baseline")).agg(
        F.count(F.lit(1)).alias("n_compared"), F.sqrt(F.avg(e * e)).alias("model_rmse"), F.avg(F.abs(e)).alias("model_mae"),
        F.sqrt(F.avg(b * b)).alias("baseline_rmse"), F.avg(F.abs(b)).alias("baseline_mae")).where(F.col("n_compared") >= minimum)
    gain = lambda m: F.when(F.col(f"baseline_{m}") > 0, (1 - F.col(f"model_{m}") / F.col(f"baseline_{m}")) * 100).otherwise(0.0)
    out = out.withColumns({"rmse_improvement_pct": gain("rmse"), "mae_improvement_pct": gain("mae")})
    return out.withColumns({"beats": (F.col("model_rmse") < F.col("baseline_rmse")).cast("int"), "beats_by_20_pct": (F.col("rmse_improvement_pct") >= 20).cast("int"),
                            "beats_by_25_pct": (F.col("rmse_improvement_pct") >= 25).cast("int")})


def baseline_verdict(compared: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Strongest baseline and whether all gates are passed."""
    return compared.groupBy(*groups).agg(
        F.min("beats_by_20_pct").alias("beats_all_by_20_pct"), F.min("beats_by_25_pct").alias("beats_all_by_25_pct"),
        F.min_by("baseline", "baseline_rmse").alias("strongest_baseline"), F.min("baseline_rmse").alias("strongest_rmse"),
        F.max("model_rmse").alias("model_rmse")).withColumn("beats_strongest", (F.col("model_rmse") < F.col("strongest_rmse")).cast("int"))


# --- intervals -----------------------------------------------------------------------------------------------
def widen_factor(n: Column) -> Column:
    return at_least(n, [(200, 1.0), (50, 1.05), (20, 1.10)], 1.20)


def earlier_half(df: DataFrame, actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS) -> DataFrame:
    """Errors (group, _e) of each position's earlier half of known rows, at least ten, in the order of period and entity.

    Counts per (position, period) tell how many rows each period still gives; rows are ranked only where a period gives some and keeps others.
    """
    known = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull()).select(keys.group, *keys.grain, (F.col(actual) - F.col(pred)).alias("_e"))
    by_group = Window.partitionBy(keys.group)
    counts = known.groupBy(keys.group, *keys.period).agg(F.count(F.lit(1)).alias("_n"))
    total, upto = F.sum("_n").over(by_group), F.sum("_n").over(by_group.orderBy(*keys.period))
    take = F.greatest(F.floor(total / 2), F.least(total, F.lit(10)))
    room = counts.withColumn("_room", take - (upto - F.col("_n"))).where(F.col("_room") > 0)
    rows = settled(known.join(room, [keys.group, *keys.period]))
    border = with_ranks(rows.where(F.col("_room") < F.col("_n")), [([keys.group], keys.entity, "_rn", "min", True)])
    return rows.where(F.col("_room") >= F.col("_n")).select(keys.group, "_e").unionByName(border.where(F.col("_rn") <= F.col("_room")).select(keys.group, "_e"))


def conformal_intervals(df: DataFrame, confidence: float = 0.8, actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS) -> DataFrame:
    """Bands from the residuals of each position's earlier half, widened for few rows, never below zero."""
    q = quantiles(earlier_half(df, actual, pred, keys), [keys.group], "_e", {"_lo": (1 - confidence) / 2, "_hi": 1 - (1 - confidence) / 2})
    q = q.select(keys.group, (F.col("_lo") * widen_factor(F.col("n"))).alias("_lo"), (F.col("_hi") * widen_factor(F.col("n"))).alias("_hi"))
    out = df.join(q, keys.group, "left")
    return out.withColumns({"ci_lower": F.greatest(F.col(pred) + F.col("_lo"), F.lit(0.0)), "ci_upper": F.col(pred) + F.col("_hi")}).drop("_lo", "_hi")


def evaluation_matrix(df: DataFrame, groups: Sequence[str], baseline: str | None = None, expert: str | None = None, actual: str = ACTUAL,
                      pred: str = PRED, minimum: int = 10) -> DataFrame:
    """One row per group: errors, tier accuracy, boom and bust F1, and gains over a baseline and an expert, in one aggregate."""
    a, p = F.col(actual), F.col(pred)
    m = metric_columns(a, p)
    bb = boom_bust_columns(a, p)
    cols = {k: m[k] for k in ("n", "rmse", "mae", "r2", "within_7_pct", "within_10_pct")}
    cols |= {"tier_accuracy": F.avg((tier(a) == tier(p)).cast("int")), "boom_f1": F.coalesce(bb["boom_f1"], F.lit(0.0)), "bust_f1": F.coalesce(bb["bust_f1"], F.lit(0.0))}
    for name, other in (("baseline", baseline), ("expert", expert)):
        if other:
            cols[f"{name}_rmse"] = F.sqrt(F.avg(F.pow(a - F.col(other), 2)))
    out = df.groupBy(*groups).agg(*[c.alias(k) for k, c in cols.items()]).where(F.col("n") >= minimum)
    for name, other in (("baseline", baseline), ("expert", expert)):
        if other:
            out = out.withColumn(f"vs_{name}_pct", F.when(F.col(f"{name}_rmse") > 0, (1 - F.col("rmse") / F.col(f"{name}_rmse")) * 100).otherwise(0.0))
    return out


def score_range(a: Column) -> Column:
    """Right-closed bins of the actual score."""
    return F.when((a > 0) & (a <= 8), "Low (0-8)").when((a > 8) & (a <= 15), "Medium (8-15)").when((a > 15) & (a <= 25), "High (15-25)").when((a > 25) & (a <= 100), "Elite (25+)")


def error_profile(df: DataFrame, groups: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """Bias, spread, sample skewness and the shares of over-, under- and large misses."""
    e = F.col(pred) - F.col(actual)
    n = F.count(e)
    return df.groupBy(*groups).agg(
        n.alias("n"), F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"), (F.skewness(e) * F.sqrt(n * (n - 1.0)) / (n - 2)).alias("skewness"),
        (F.avg((e > 0).cast("int")) * 100).alias("over_predictions_pct"), (F.avg((e < 0).cast("int")) * 100).alias("under_predictions_pct"),
        (F.avg((F.abs(e) > 10).cast("int")) * 100).alias("large_misses_pct"), F.max(e).alias("worst_over_prediction"), F.min(e).alias("worst_under_prediction"))


# --- criteria ---------------------------------------------------------------------------------------------------
def success_criteria(metrics: DataFrame, horizon: str = "1w", keys: Keys = KEYS) -> DataFrame:
    """Pass marks of per-position metrics against the targets of a horizon."""
    target = lookup(F.col(keys.group), C.RMSE_TARGETS[horizon])
    ok = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return metrics.withColumns({
        "rmse_target": target, "rmse_pass": ok(F.col("rmse") <= target), "r2_pass": ok(F.col("r2") >= C.R2_TARGETS[horizon]),
        "mape_pass": ok(F.col("mape_floor3") < C.MAPE_TARGETS[horizon]), "within_7_pass": ok(F.col("within_7_pct") >= C.SUCCESS["within_7_pts_pct_min"]),
        "within_10_pass": ok(F.col("within_10_pct") >= C.SUCCESS["within_10_pts_pct_min"])})


def week_stability(df: DataFrame, keys: Keys = KEYS, actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """Mean and worst weekly RMSE of every season; stable when the worst is at most 20 % above the mean."""
    weekly = regression_metrics(df, keys.period, actual, pred)
    out = weekly.groupBy(keys.season).agg(F.avg("rmse").alias("avg_weekly_rmse"), F.max("rmse").alias("max_weekly_rmse"))
    worse = (F.col("max_weekly_rmse") / F.col("avg_weekly_rmse") - 1) * 100
    return out.withColumns({"max_degradation_pct": worse, "season_stability_ok": (worse <= C.SUCCESS["max_weekly_degradation_pct"]).cast("int")})


def across_seasons(metrics: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and population spread of per-season metrics."""
    return metrics.groupBy(*groups).agg(*[f(c).alias(f"{c}_{n}") for c in ("rmse", "mae", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count(F.lit(1)).alias("n_folds"))


def accuracy_dashboard(log: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Last season, last five weeks of the log: mean metrics by position and horizon."""
    top = log.agg(F.max(keys.season).alias("_s"), F.max(keys.week).alias("_w"))
    recent = log.join(F.broadcast(top)).where((F.col(keys.season) >= F.col("_s")) & (F.col(keys.week) >= F.col("_w") - 4))  # one row
    return recent.groupBy(keys.group, "horizon").agg(F.avg("mae").alias("avg_mae"), F.avg("rmse").alias("avg_rmse"), F.avg("r2").alias("avg_r2"),
                                                     F.avg("accuracy_pct").alias("avg_accuracy"), F.sum("n_predictions").alias("total_predictions"), F.count(F.lit(1)).alias("weeks_tracked"))


def training_requirements(panel: DataFrame, horizon: str = "1w", keys: Keys = KEYS) -> DataFrame:
    """Players per position and seasons against the minimum of a horizon."""
    seasons = panel.agg(F.countDistinct(keys.season).alias("n_seasons"))
    per = panel.groupBy(keys.group).agg(F.countDistinct(keys.entity).alias("n_players")).join(F.broadcast(seasons))  # one row
    need = lookup(F.col(keys.group), C.MIN_PLAYERS, 0)
    return per.withColumns({"players_ok": (F.col("n_players") >= need).cast("int"), "seasons_ok": (F.col("n_seasons") >= C.MIN_SEASONS[horizon]).cast("int")})


def outlier_report(df: DataFrame, columns: Sequence[str], sigma: float = 3.0) -> DataFrame:
    """(column, n_outliers, share) beyond sigma of the mean: one scan for the moments, one for the counts."""
    fit = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    j = df.join(F.broadcast(fit))  # one row
    cnt = j.agg(F.count(F.lit(1)).alias("_n"), *[F.sum((F.abs(F.col(c) - F.col(f"_m_{c}")) > sigma * F.col(f"_s_{c}")).cast("int")).alias(c) for c in columns])
    return cnt.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_outliers")) for c in columns])).alias("o")).select(
        "o.*", (F.col("o.n_outliers") / F.col("_n")).alias("share"))


def season_error_totals(df: DataFrame, top: int = 200, actual: str = ACTUAL, pred: str = PRED, keys: Keys = KEYS) -> DataFrame:
    """Predicted and actual totals per player and season; the report keeps the largest actual totals of each season."""
    t = df.groupBy(keys.season, keys.entity, "name", keys.group).agg(F.sum(pred).alias("predicted_total"), F.sum(actual).alias("actual_total"), F.count(F.lit(1)).alias("games"))
    t = t.withColumn("error", F.col("predicted_total") - F.col("actual_total"))
    return first_rows(t, [keys.season], [F.round("actual_total", 9).desc(), F.col(keys.entity)], top).drop("_pos")


# --- leaks ---------------------------------------------------------------------------------------------------------
def assert_no_future(train: DataFrame, test: DataFrame, keys: Keys = KEYS) -> None:
    """Raises when a training row is at or after the first test period."""
    at = F.struct(keys.season, keys.week)
    last, first = train.agg(F.max(at).alias("x")).first()["x"], test.agg(F.min(at).alias("x")).first()["x"]
    if last is not None and first is not None and tuple(last) >= tuple(first):
        raise ValueError(f"training reaches {tuple(last)}, test starts {tuple(first)}")


def shifted_check(df: DataFrame, columns: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """(column, share of first rows that are null): history features must be empty on an entity's first row."""
    first = df.groupBy(keys.entity).agg(*[F.min_by(F.struct(F.col(c).alias("v")), F.struct(keys.season, keys.week)).alias(c) for c in columns])
    one = first.agg(*[F.avg(F.col(f"{c}.v").isNull().cast("int")).alias(c) for c in columns])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("first_null_rate")) for c in columns])).alias("x")).select("x.*")
    return out.withColumn("shifted", (F.col("first_null_rate") >= 0.5).cast("int"))


def suspicious_correlations(df: DataFrame, columns: Sequence[str], target: str = ACTUAL, limit: float = 0.95) -> DataFrame:
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target)).alias(c) for c in columns])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("correlation")) for c in columns])).alias("x")).select("x.*")
    return out.withColumn("suspicious", (F.abs("correlation") > limit).cast("int"))


# --- drift ------------------------------------------------------------------------------------------------------------
def moment_drift(current: DataFrame, reference: DataFrame, column: str, groups: Sequence[str] = (), mean_limit: float = 0.25, std_limit: float = 0.5,
                 null_limit: float = 0.05) -> DataFrame:
    """Null rate, mean and spread against a reference, with flags."""
    g = list(groups)
    x = lambda df, p: df.groupBy(*g).agg(F.avg(F.col(column).isNull().cast("int")).alias(f"{p}_null_rate"), F.avg(column).alias(f"{p}_mean"), F.stddev_pop(column).alias(f"{p}_std"))
    a, b = x(current, "batch"), x(reference, "reference").drop("reference_null_rate")
    j = a.join(b, g) if g else a.join(F.broadcast(b))  # one row
    rel = lambda k: F.when(F.col(f"reference_{k}") > 0, F.abs(F.col(f"batch_{k}") - F.col(f"reference_{k}")) / F.col(f"reference_{k}"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return j.withColumns({"mean_drift": rel("mean"), "std_drift": rel("std")}).withColumns({
        "null_alert": flag(F.col("batch_null_rate") > null_limit), "mean_alert": flag(F.col("mean_drift") > mean_limit), "std_alert": flag(F.col("std_drift") > std_limit)})


def error_drift(current: DataFrame, reference: DataFrame, groups: Sequence[str] = (), limit: float = 0.25, min_rows: int = 5, actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """RMSE and MAE of a batch against the reference's RMSE, flagged where it grew by more than ``limit``.

    Rows count whose prediction and outcome are both known and finite; groups with fewer than ``min_rows`` of them are left out, a group
    that the reference does not hold (or holds without error) has no degradation.
    """
    g = list(groups)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < F.lit(float("inf")))
    known = lambda df: df.where(finite(actual) & finite(pred)).withColumn("_e", F.col(actual) - F.col(pred)).groupBy(*g)
    now = known(current).agg(F.count("_e").alias("n_rows"), F.sqrt(F.avg(F.pow("_e", F.lit(2)))).alias("rmse"), F.avg(F.abs("_e")).alias("mae")).where(F.col("n_rows") >= min_rows)
    past = known(reference).agg(F.sqrt(F.avg(F.pow("_e", F.lit(2)))).alias("reference_rmse"))
    j = now.join(past, g, "left") if g else now.join(F.broadcast(past))  # one row
    worse = F.when(F.col("reference_rmse") > 0, (F.col("rmse") - F.col("reference_rmse")) / F.col("reference_rmse"))
    return j.withColumn("degradation", worse).withColumn("rmse_alert", F.coalesce(F.col("degradation") > limit, F.lit(False)).cast("int"))


def r2_pivot(df: DataFrame, cells: Mapping[str, tuple[str, str]], groups: Sequence[str] = ("position",)) -> DataFrame:
    """One row per group and one R2 column per cell (a model and horizon), all from one aggregate. ``cells``: name -> (actual, prediction)."""
    out = []
    for name, (actual, pred) in cells.items():
        y, p = F.col(actual).cast("double"), F.col(pred).cast("double")
        both = y.isNotNull() & p.isNotNull()
        spread = F.var_pop(F.when(both, y))
        out.append(F.when(spread > 0, 1 - F.avg(F.when(both, F.pow(y - p, F.lit(2)))) / spread).alias(name))
    return df.groupBy(*groups).agg(*out)


def ks_p_value(d: Column, n: Column) -> Column:
    """Asymptotic two-sided p of a Kolmogorov-Smirnov distance with effective size n."""
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    s = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 6)), F.lit(0.0))
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def feature_drift(current: DataFrame, reference: DataFrame, columns: Sequence[str], ks_limit: float = 0.20, p_limit: float = 0.01) -> DataFrame:
    """Kolmogorov-Smirnov distance of every column: the largest gap of two cumulative counts on one pooled ladder."""
    from weekgrain.functions.order_stats import melt
    pooled = melt(current, [], columns).withColumn("_s", F.lit(1)).unionByName(melt(reference, [], columns).withColumn("_s", F.lit(0)))
    pooled = pooled.where(F.col("value").isNotNull() & ~F.isnan("value"))
    lad = value_ladder(pooled, ["component"], "value", parts={"cur": F.col("_s") == 1, "ref": F.col("_s") == 0})
    gap = F.abs((F.col("below_cur") + F.col("n_cur")) / F.col("total_cur") - (F.col("below_ref") + F.col("n_ref")) / F.col("total_ref"))
    out = lad.groupBy(F.col("component").alias("feature")).agg(F.max(gap).alias("ks_stat"), F.max("total_cur").alias("n_cur"), F.max("total_ref").alias("n_ref"))
    out = out.where((F.col("n_cur") >= 10) & (F.col("n_ref") >= 10)).withColumn("p_value", ks_p_value(F.col("ks_stat"), F.col("n_cur") * F.col("n_ref") / (F.col("n_cur") + F.col("n_ref"))))
    return out.withColumn("drifted", ((F.col("ks_stat") > ks_limit) & (F.col("p_value") < p_limit)).cast("int"))


def mean_shift(current: DataFrame, reference: DataFrame, columns: Sequence[str], threshold: float = 2.0) -> DataFrame:
    """Distance of means in reference standard deviations."""
    cur = current.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns])
    ref = reference.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    both = cur.join(F.broadcast(ref))  # one row each
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.abs(F.col(f"_a_{c}") - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias("z")) for c in columns])
    return both.select(F.explode(rows).alias("r")).select("r.*").withColumn("drifted", (F.col("z") > threshold).cast("int"))


def run_drift(log: DataFrame, groups: Sequence[str], order: str, limit_pct: float = 20.0) -> DataFrame:
    """RMSE of every run against the run before it (one row per run)."""
    w = Window.partitionBy(*groups).orderBy(order)
    out = log.withColumn("previous_rmse", F.lag("rmse").over(w))
    out = out.withColumn("pct_change", F.when(F.col("previous_rmse") > 0, (F.col("rmse") / F.col("previous_rmse") - 1) * 100))
    return out.withColumn("drift_detected", F.coalesce(F.col("pct_change") > limit_pct, F.lit(False)).cast("int"))


def ranking_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve of a score for a 0/1 label, exact with ties, from one ladder."""
    lad = value_ladder(df.where(F.col(score).isNotNull()), [], score, parts={"pos": F.col(label) == 1, "neg": F.col(label) == 0})
    won = F.sum(F.col("n_pos") * (F.col("below_neg") + F.col("n_neg") / 2.0))
    return lad.agg((won / (F.max("total_pos") * F.max("total_neg"))).alias("auc"), F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"))


# --- comparing two models ------------------------------------------------------------------------------------------------
def signed_rank(df: DataFrame, first: str, second: str) -> DataFrame:
    """One-sided signed-rank test that the first error is larger: W+, z with tie correction, p by the normal approximation."""
    from weekgrain.functions.exprs import normal_cdf
    d = df.withColumn("_d", F.round(F.col(first) - F.col(second), 9)).where(F.col("_d") != 0).select("_d", F.abs("_d").alias("_a"))
    lad = value_ladder(d, [], "_a", parts={"plus": F.col("_d") > 0})
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    out = lad.agg(F.sum(F.col("n_plus") * rank).alias("w_plus"), F.sum("n").cast("double").alias("n"), F.sum(F.pow("n", 3) - F.col("n")).alias("_t"))
    n = F.col("n")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_t") / 2) / 24)
    return out.withColumn("z", z).withColumn("p_value", 1 - normal_cdf(F.col("z"))).drop("_t")


def shadow_compare(df: DataFrame, production: str, candidate: str, actual: str = ACTUAL, threshold_pct: float = 2.0, alpha: float = 0.05, keys: Keys = KEYS) -> DataFrame:
    """Mean weekly RMSE of two models, paired test, and the promotion rule."""
    rms = lambda c: F.sqrt(F.avg(F.pow(F.col(actual) - F.col(c), 2)))
    weekly = df.groupBy(*keys.period).agg(rms(production).alias("_p"), rms(candidate).alias("_c"))
    means = weekly.agg(F.avg("_p").alias("production_rmse_avg"), F.avg("_c").alias("candidate_rmse_avg"), F.count(F.lit(1)).alias("weeks_evaluated"))
    test = signed_rank(df.withColumns({"_ep": F.abs(F.col(actual) - F.col(production)), "_ec": F.abs(F.col(actual) - F.col(candidate))}), "_ep", "_ec")
    out = means.join(F.broadcast(test))  # one row each
    gain = (1 - F.col("candidate_rmse_avg") / F.col("production_rmse_avg")) * 100
    out = out.withColumns({"improvement_pct": gain, "is_significant": (F.col("p_value") < alpha).cast("int")})
    return out.withColumn("recommendation", F.when((F.col("improvement_pct") >= threshold_pct) & (F.col("is_significant") == 1), "PROMOTE").otherwise("ROLLBACK"))

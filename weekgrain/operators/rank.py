"""Ranking, replacement value and decisions.

Ranks over open-ended groups go through the value ladder; a plain window is used
only where a group is bounded (a roster, a lineup, a top-k).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.exprs import at_least, clip, lookup, normal_cdf, utilization_tier
from weekgrain.functions.order_stats import first_rows, quantiles, with_ranks
from weekgrain.keys import KEYS, Keys, settled

# fixed values: waiver-wire points and scarcity by position
REPLACEMENT = {"QB": 14.0, "RB": 7.0, "WR": 7.5, "TE": 5.0}
SCARCITY = {"QB": 0.8, "RB": 1.3, "WR": 1.0, "TE": 1.1}
# fixed values: n-th best player who counts as replacement
REPLACEMENT_RANK = {"QB": 12, "RB": 24, "WR": 30, "TE": 12}


def place(df: DataFrame, groups: list[str], order: list[Column], out: str) -> DataFrame:
    """1..n position in a total order (the order must identify rows)."""
    return places(df, order, {out: groups})


def places(df: DataFrame, order: list[Column], outs: Mapping[str, list[str]]) -> DataFrame:
    """Positions in the same total order inside several groupings at once."""
    keyed = df.withColumn("_ord", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))
    return with_ranks(keyed, [(groups, "_ord", out, "min", True) for out, groups in outs.items()]).drop("_ord")


def value_over_replacement(pred: DataFrame, points: str = "predicted_points", replacement: Mapping = REPLACEMENT,
                           scarcity: bool = True, keys: Keys = KEYS) -> DataFrame:
    """Points above the position's replacement level, weighted by scarcity, with overall and position ranks and a tier."""
    pos = F.col(keys.group)
    raw = F.col(points) - lookup(pos, replacement, 7.0)
    adj = raw * lookup(pos, SCARCITY, 1.0) if scarcity else raw
    df = pred.withColumns({"vor_raw": raw, "vor_adjusted": adj})
    df = with_ranks(df, [([], "vor_adjusted", "vor_rank", "min", False), ([keys.group], points, "position_rank", "min", False)])
    v = F.col("vor_adjusted")
    tier = (F.when(v > 20, "elite").when(v > 10, "starter").when(v > 5, "flex").when(v > 0, "depth").otherwise("below_replacement"))
    return df.withColumn("vor_tier", tier)


def value_over_nth(panel: DataFrame, season: int, min_games: int = 8, ranks: Mapping = REPLACEMENT_RANK, keys: Keys = KEYS) -> DataFrame:
    """Season points per game above the n-th best of the position (or its worst, when there are fewer)."""
    totals = season_totals(panel.where(F.col(keys.season) == season), keys).where(F.col("games_played") >= min_games)
    best = first_rows(totals.select(keys.group, "ppg", keys.entity), [keys.group], [F.col("ppg").desc(), F.col(keys.entity)], max(ranks.values()))
    n = lookup(F.col(keys.group), dict(ranks), 12)
    line = best.where(F.col("_pos") <= n).groupBy(keys.group).agg(F.min("ppg").alias("replacement_ppg"), F.count(F.lit(1)).alias("_have"))
    low = totals.groupBy(keys.group).agg(F.min("ppg").alias("_low"))
    line = line.join(low, keys.group).select(keys.group, F.when(F.col("_have") >= n, F.col("replacement_ppg")).otherwise(F.col("_low")).alias("replacement_ppg"))
    return totals.join(line, keys.group).withColumn("vor", F.col("ppg") - F.col("replacement_ppg"))


def season_totals(rows: DataFrame, keys: Keys = KEYS, extra: Mapping[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Totals per player (and per value of ``by``, for instance the season)."""
    fp = F.col("fantasy_points")
    return rows.groupBy(*by, keys.entity, "name", keys.team, keys.group).agg(
        F.sum(fp).alias("total_fp"), F.count(fp).alias("games_played"), F.avg(fp).alias("ppg"),
        F.coalesce(F.stddev_samp(fp), F.lit(0.0)).alias("fp_std"), *[c.alias(n) for n, c in (extra or {}).items()])


def start_sit(pred: DataFrame, points: str = "predicted_points", std: str = "predicted_std", threshold: float = 0.3,
              minimum: float = 5.0) -> DataFrame:
    """Start, sit or abstain by relative uncertainty, with boom (20+) and bust (under 5) chances."""
    p, s = F.col(points), F.col(std)
    cv = s / F.greatest(p, F.lit(1.0))
    df = pred.withColumn("coeff_of_variation", cv)
    conf = F.when(cv <= threshold, "high").when(cv <= threshold * 1.5, "medium").otherwise("low")
    safe = F.greatest(s, F.lit(0.01))
    df = df.withColumns({"confidence": conf, "boom_probability": 1.0 - normal_cdf((20.0 - p) / safe), "bust_probability": normal_cdf((5.0 - p) / safe)})
    return df.withColumn("recommendation", F.when(F.col("confidence") == "low", "uncertain").when(p >= minimum, "start").otherwise("sit"))


def decision_quality(decided: DataFrame, player: str, points: str = "predicted_points", actual: str = "fantasy_points") -> DataFrame:
    """One row of hit rates, abstention variance, differential and top-k precision."""
    a, rec = F.col(actual), F.col("recommendation")
    on = lambda r, x: F.when(rec == r, x)
    base = decided.agg(
        F.count(on("start", a)).alias("n_starts"), F.avg(on("start", (a >= 5).cast("int"))).alias("start_hit_rate"), F.avg(on("start", a)).alias("start_avg_points"),
        F.count(on("sit", a)).alias("n_sits"), F.avg(on("sit", (a < 10).cast("int"))).alias("sit_correct_rate"), F.avg(on("sit", a)).alias("sit_avg_points"),
        F.count(on("uncertain", a)).alias("n_uncertain"), F.avg(on("uncertain", a)).alias("uncertain_avg_points"),
        F.var_samp(on("uncertain", a)).alias("uncertain_variance"), F.var_samp(a).alias("_all_variance"))
    out = base.withColumns({"abstention_justified": (F.col("uncertain_variance") > F.col("_all_variance") * 1.2).cast("int"),
                            "start_vs_sit_differential": F.col("start_avg_points") - F.col("sit_avg_points")}).drop("_all_variance")
    for k in (10, 20):
        top = lambda c: decided.orderBy(F.col(c).desc(), player).limit(k).select(player)
        hit = top(points).join(top(actual), player, "left_semi").agg((F.count(F.lit(1)) / float(k)).alias(f"top_{k}_precision"))
        out = out.join(F.broadcast(hit))  # one row each
    return out


def waiver_priority(pred: DataFrame, rostered: DataFrame | None, points: str = "predicted_points", std: str = "predicted_std",
                    top: int = 50, keys: Keys = KEYS) -> DataFrame:
    """Unrostered players by 0.6 value over replacement + 0.4 upside; the report keeps the top ranks."""
    df = pred if rostered is None else pred.join(rostered, keys.entity, "left_anti")
    df = df.withColumns({"vor": F.col(points) - lookup(F.col(keys.group), REPLACEMENT, 7.0), "upside_score": F.col(points) + F.col(std)})
    df = df.withColumn("waiver_priority", 0.6 * F.col("vor") + 0.4 * F.col("upside_score"))
    # a top-50 report: the limit bounds what the rank window sees
    best = df.orderBy(F.round("waiver_priority", 9).desc(), keys.entity).limit(top)
    return best.withColumn("waiver_rank", F.rank().over(Window.orderBy(F.round("waiver_priority", 9).desc())).cast("long"))


# --- predictions as served --------------------------------------------------------------------------------
def cold_start(pred: DataFrame, games: str, points: str, std: str, n_weeks: int = 1, minimum: int = 4, keys: Keys = KEYS) -> DataFrame:
    """Players with too little history take the position's mean and a wide spread."""
    seasoned = pred.where(F.col(games) >= minimum).groupBy(keys.group).agg(F.avg(points).alias("_m"), F.stddev_samp(points).alias("_s"))
    df = pred.join(seasoned, keys.group, "left")
    fresh = F.col(games) < minimum
    wide = F.coalesce(F.greatest(F.col("_s") * 2, F.lit(3.0 * n_weeks)), F.lit(5.0 * n_weeks))
    return df.withColumns({points: F.when(fresh, F.coalesce("_m", F.lit(50.0))).otherwise(F.col(points)),
                           std: F.when(fresh, wide).otherwise(F.col(std))}).drop("_m", "_s")


def serve_ranks(pred: DataFrame, points: str, std: str, games: str, volatility: str, injury: str, n_weeks: int = 1, keys: Keys = KEYS) -> DataFrame:
    """Overall and position order, tier, per-game value and 80/95 % bands widened for rookies, volatile and hurt players."""
    line = quantiles(pred.withColumn("_one", F.lit(1)), ["_one"], volatility, {"_q75": 0.75}).select("_q75")
    df = pred.join(F.broadcast(line))  # one row
    fresh = F.coalesce(F.col(games), F.lit(0)) < 4
    wild = (F.coalesce(F.col(volatility), F.lit(0.0)) > F.col("_q75")) & (F.col("_q75") > 0) & ~fresh
    hurt = (F.coalesce(F.col(injury), F.lit(1.0)) < 0.7) & ~fresh
    factor = F.when(fresh, 1.5).otherwise(F.when(wild, 1.25).otherwise(1.0) * F.when(hurt, 1.4).otherwise(1.0))
    df = df.withColumn(std, F.coalesce(F.col(std), F.lit(5.0)) * factor).drop("_q75")
    p, s = F.col(points), F.col(std)
    df = df.withColumns({"predicted_ppg": p / n_weeks, "util_tier": utilization_tier(p)} | {
        f"prediction_ci{lvl}_{side}": v for lvl, z in ((80, 1.28), (95, 1.96))
        for side, v in (("lower", clip(p - z * s, 0.0)), ("upper", p + z * s))})
    return places(settled(df), [-F.round(p, 9), F.col(keys.entity)], {"overall_rank": [], "position_rank": [keys.group]})


# fixed values: plausible weekly points by position
WEEKLY_BOUNDS = {"QB": 65.0, "RB": 55.0, "WR": 55.0, "TE": 45.0}


def bounded_intervals(pred: DataFrame, q80: Column, q95: Column, n_weeks: int = 1, conv80: Column | None = None,
                      conv95: Column | None = None, points: str = "predicted_points", keys: Keys = KEYS) -> DataFrame:
    """Points held to plausible totals; conformal half-widths grow with n^0.4 and add conversion error in quadrature."""
    top = lookup(F.col(keys.group), WEEKLY_BOUNDS, 60.0) * n_weeks
    grow = float(n_weeks) ** 0.4
    half = lambda q, c: F.sqrt(F.pow(q * grow, 2) + F.pow(c, 2)) if c is not None else q * grow
    raw = F.col(points)
    bands = {}
    for lvl, h in ((80, half(q80, conv80)), (95, half(q95, conv95))):
        bands[f"ci{lvl}_lower"], bands[f"ci{lvl}_upper"] = clip(raw - h, 0.0), raw + h
    return pred.withColumns(bands).withColumn(points, F.greatest(F.lit(0.0), F.least(F.col(points), top)))


def horizon_pivot(pred: DataFrame, horizons: Sequence[int], points: str = "predicted_points", keys: Keys = KEYS) -> DataFrame:
    """Long (player, n_weeks) predictions as one row per player with totals and per-game values."""
    wide = pred.groupBy(keys.entity, keys.group).pivot("n_weeks", list(horizons)).agg(F.max(points))
    return wide.select(keys.entity, keys.group, *[F.col(str(h)).alias(f"proj_{h}w") for h in horizons],
                       *[(F.col(str(h)) / h).alias(f"ppg_{h}w") for h in horizons])


def compare_players(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose name contains one of the given texts."""
    cond = F.lit(False)
    for n in names:
        cond = cond | F.lower("name").contains(n.lower())
    return rows.where(cond)


def prediction_table(pred: DataFrame, horizons: Sequence[int], residual_sd: Mapping[int, float], value: str = "util", keys: Keys = KEYS) -> DataFrame:
    """Clipped 0..100 predictions with +-1.96 residual bands per horizon, one row per player, and a tier of the first."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(value)))
    sd = lookup(F.col("n_weeks"), {h: float(s) for h, s in residual_sd.items()})
    held = pred.withColumns({"_v": v, "_h": 1.96 * sd})
    agg = []
    for h in horizons:
        on = lambda x: F.max(F.when(F.col("n_weeks") == h, x))
        agg += [on(F.col("_v")).alias(f"{value}_{h}w"), on(F.greatest(F.col("_v") - F.col("_h"), F.lit(0.0))).alias(f"{value}_{h}w_low"),
                on(F.least(F.col("_v") + F.col("_h"), F.lit(100.0))).alias(f"{value}_{h}w_high")]
    out = held.groupBy(keys.entity, keys.group).agg(*agg)
    x = F.col(f"{value}_{horizons[0]}w")
    # right-closed bins; exactly 0 falls outside them
    return out.withColumn("tier", F.when(x > 85, "elite").when(x > 70, "high").when(x > 50, "moderate").when(x > 0, "low"))


# --- matchups ----------------------------------------------------------------------------------------------
# fixed values: multiplier by player tier for defences of rising softness
MATCHUP_STEPS = [(5, "elite_defense"), (12, "tough"), (20, "average"), (27, "favorable")]
MATCHUP_FACTORS = {
    "elite": {"elite_defense": 0.92, "tough": 0.96, "average": 1.00, "favorable": 1.05, "smash_spot": 1.10},
    "high": {"elite_defense": 0.85, "tough": 0.92, "average": 1.00, "favorable": 1.08, "smash_spot": 1.15},
    "moderate": {"elite_defense": 0.75, "tough": 0.88, "average": 1.00, "favorable": 1.12, "smash_spot": 1.20},
    "low": {"elite_defense": 0.65, "tough": 0.80, "average": 1.00, "favorable": 1.15, "smash_spot": 1.25},
}
# fixed values: the same by quarter-like tiers of the defence's rank share
TIER_FACTORS = {
    "elite": {"elite": 0.95, "good": 1.00, "average": 1.05, "weak": 1.10},
    "high": {"elite": 0.85, "good": 0.95, "average": 1.00, "weak": 1.08},
    "moderate": {"elite": 0.75, "good": 0.85, "average": 1.00, "weak": 1.15},
    "low": {"elite": 0.70, "good": 0.80, "average": 0.95, "weak": 1.10},
}


def player_tier(score: Column) -> Column:
    return at_least(score, [(85, "elite"), (70, "high"), (50, "moderate")], "low")


def _matrix(row: Column, col: Column, table: Mapping) -> Column:
    return lookup(row, {r: lookup(col, c, 1.0) for r, c in table.items()}, 1.0)


def adjust_for_matchup(pred: DataFrame, score: str, hardness_rank: str) -> DataFrame:
    """Score times the factor of (player tier, defence difficulty); rank 1 is the hardest defence."""
    from weekgrain.functions.exprs import bracket
    diff = bracket(F.col(hardness_rank), MATCHUP_STEPS, "smash_spot")
    df = pred.withColumns({"player_tier": player_tier(F.col(score)), "matchup_difficulty": diff})
    f = _matrix(F.col("player_tier"), F.col("matchup_difficulty"), MATCHUP_FACTORS)
    df = df.withColumn("adjustment_factor", f).withColumn("adjusted", clip(F.col(score) * F.col("adjustment_factor"), 0.0, 100.0))
    return df.withColumn("adjustment_points", F.col("adjusted") - F.col(score))


def adjust_by_defense_tier(pred: DataFrame, score: str, hardness_rank: str, n_teams: str) -> DataFrame:
    share = F.col(hardness_rank) / F.col(n_teams)
    tier = F.when(share.isNull(), "average").when(share <= 0.15, "elite").when(share <= 0.35, "good").when(share <= 0.70, "average").otherwise("weak")
    df = pred.withColumns({"player_tier": player_tier(F.col(score)), "defense_tier": tier})
    df = df.withColumn("multiplier", _matrix(F.col("player_tier"), F.col("defense_tier"), TIER_FACTORS))
    rating = at_least(F.col("multiplier"), [(1.08, "SMASH SPOT"), (1.03, "FAVORABLE"), (0.97, "NEUTRAL"), (0.85, "TOUGH")], "AVOID")
    return df.withColumns({"adjusted": clip(F.col(score) * F.col("multiplier"), 0.0, 100.0), "matchup_rating": rating})


def matchup_extremes(pred: DataFrame, score: str, hardness_rank: str, n: int = 10, best: bool = True, keys: Keys = KEYS) -> DataFrame:
    """The n best (score + 2(32 - rank)) or worst (score - 2 rank) matchups."""
    m = F.col(score) + (32 - F.col(hardness_rank)) * 2 if best else F.col(score) - F.col(hardness_rank) * 2
    df = pred.withColumn("matchup_score", m)
    order = F.round("matchup_score", 9)
    return df.orderBy(order.desc() if best else order.asc(), keys.entity).limit(n)


# --- injuries ---------------------------------------------------------------------------------------------------
# fixed values: injury factors by status, type and position
STATUS_FACTOR = {"OUT": 0.0, "DOUBTFUL": 0.3, "QUESTIONABLE": 0.75, "PROBABLE": 0.90}
TYPE_FACTOR = {"hamstring": 0.80, "ankle": 0.85, "knee": 0.70, "shoulder": 0.90, "concussion": 0.75, "back": 0.80, "groin": 0.85,
               "foot": 0.75, "hand": 0.95, "wrist": 0.95, "finger": 0.98}
POSITION_FACTOR = {"QB": 1.0, "RB": 0.85, "WR": 0.90, "TE": 0.92}
RETURN_WEEKS = {"hamstring": (2, 4), "ankle": (1, 3), "knee": (3, 6), "shoulder": (1, 2), "concussion": (1, 2), "back": (2, 4),
                "groin": (1, 3), "foot": (2, 4), "hand": (1, 2), "wrist": (1, 3), "finger": (0, 1)}
# fixed values: second table, by normalised status and position
REPORT_FACTOR = {"OUT": 0.0, "DOUBTFUL": 0.15, "QUESTIONABLE": 0.75, "PROBABLE": 0.95, "HEALTHY": 1.0}
REPORT_RESILIENCE = {"QB": 1.2, "RB": 0.8, "WR": 1.0, "TE": 1.1}
# fixed values: third table, resilience softens the status factor
SOFT_FACTOR = {"OUT": 0.0, "DOUBTFUL": 0.25, "QUESTIONABLE": 0.85, "PROBABLE": 0.95, "HEALTHY": 1.0}
SOFT_RESILIENCE = {"QB": 0.90, "RB": 0.75, "WR": 0.85, "TE": 0.80}
# fixed values: impact score by status and type
IMPACT = {"OUT": 100.0, "DOUBTFUL": 75.0, "QUESTIONABLE": 40.0, "PROBABLE": 15.0}
SEVERITY = {"concussion": 1.3, "acl": 1.5, "achilles": 1.5, "hamstring": 1.2, "ankle": 1.1, "knee": 1.2, "shoulder": 1.1, "hand": 0.9, "illness": 0.8}
REPORT_WEIGHT = {"OUT": 5, "DOUBTFUL": 3, "QUESTIONABLE": 2, "PROBABLE": 1}


def adjust_for_injury(pred: DataFrame, score: str, status: str = "status", kind: str = "injury_type", keys: Keys = KEYS) -> DataFrame:
    """Score times status, type and position factors; confidence penalty; alert severity."""
    s = lookup(F.col(status), STATUS_FACTOR, 1.0)
    t = F.when(F.col(kind).isNull(), F.lit(1.0)).otherwise(lookup(F.lower(kind), TYPE_FACTOR, 0.85))
    f = s * t * lookup(F.col(keys.group), POSITION_FACTOR, 0.90)
    out = F.coalesce(F.col(status) == "OUT", F.lit(False))
    df = pred.withColumns({"injury_adjusted": F.when(out, F.lit(0.0)).otherwise(F.col(score) * f),
                           "confidence_penalty": F.when(out, F.lit(0.0)).otherwise((1 - f) * 50)})
    a = F.col("injury_adjusted")
    return df.withColumns({"injury_low": F.greatest(a - 10, F.lit(0.0)), "injury_high": F.least(a + 5, F.lit(100.0)),
                           "severity": lookup(F.col(status), {"OUT": "critical", "DOUBTFUL": "high", "QUESTIONABLE": "medium"}, "low")})


def report_status(raw: Column) -> Column:
    u = F.upper(raw)
    return (F.when(u.contains("OUT") | u.contains("IR"), "OUT").when(u.contains("DOUBT"), "DOUBTFUL")
            .when(u.contains("QUEST") | (u == "Q"), "QUESTIONABLE").when(u.contains("PROB"), "PROBABLE").otherwise("HEALTHY"))


def adjust_by_report(pred: DataFrame, score: str, status: str, keys: Keys = KEYS) -> DataFrame:
    df = pred.withColumn("injury_status", F.coalesce(report_status(F.col(status)), F.lit("HEALTHY")))
    m = F.greatest(F.lit(0.0), F.least(F.lit(1.2), lookup(F.col("injury_status"), REPORT_FACTOR, 1.0) * lookup(F.col(keys.group), REPORT_RESILIENCE, 1.0)))
    soft = lookup(F.col("injury_status"), SOFT_FACTOR, 1.0)
    res = lookup(F.col(keys.group), SOFT_RESILIENCE, 0.80)
    gentle = F.when(F.col("injury_status") == "OUT", F.lit(0.0)).otherwise(F.col(score) * (soft + (1 - soft) * (1 - res)))
    return df.withColumns({
        "injury_multiplier": m, "injury_adjusted_util": F.col(score) * m, "softened_util": gentle,
        "confidence_adjustment": F.when(F.col("injury_status").isin("QUESTIONABLE", "DOUBTFUL"), 0.7).otherwise(1.0),
        "injury_warning": (~F.col("injury_status").isin("HEALTHY", "PROBABLE")).cast("int")})


def injury_impact(injuries: DataFrame, status: str = "status", kind: str = "injury_type") -> DataFrame:
    """Impact 0..100 and weeks out; an open-ended soft-tissue absence counts as three weeks."""
    k = F.lower(F.coalesce(F.col(kind), F.lit("")))
    score = lookup(F.col(status), IMPACT, 20.0)
    for word, f in SEVERITY.items():
        score = score * F.when(k.contains(word), f).otherwise(1.0)
    weeks = (F.when(F.col(status) == "OUT", F.when(k.rlike("acl|achilles|season"), 18).when(k.rlike("hamstring|knee|ankle"), 3).otherwise(1))
             .when(F.col(status) == "DOUBTFUL", 1).otherwise(0))
    return injuries.withColumns({"impact_score": F.least(score, F.lit(100.0)), "estimated_weeks_out": weeks})


def return_timeline(kind: Column, severity: str = "typical") -> tuple[Column, Column, Column]:
    """(min, typical, max) weeks until the return."""
    k = F.lower(kind)
    lo = lookup(k, {t: float(v[0]) for t, v in RETURN_WEEKS.items()})
    typ = lookup(k, {t: float(v[1]) for t, v in RETURN_WEEKS.items()})
    typ, top = {"mild": (lo, lo + 1), "severe": (typ * 1.5, typ * 3), "typical": (typ, typ * 1.5)}[severity]
    whole = lambda x, default: F.coalesce(x.cast("int"), F.lit(default))
    return whole(lo, 1), whole(typ, 2), whole(top, 4)


def report_risk(injuries: DataFrame, status: str = "status", last_n: int = 52, keys: Keys = KEYS) -> DataFrame:
    """Severity-weighted risk 0..100 over a player's last reports.

    Reports of one week are merged into counts per weight first, so the ordered window sees weeks.
    The week in which the limit is crossed gives its most severe reports first.
    """
    weight = lookup(report_status(F.col(status)), REPORT_WEIGHT, 0)
    counts = (injuries.where(F.col(keys.entity).isNotNull()).withColumn("_w", weight)
              .groupBy(*keys.grain, "_w").agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(keys.entity).orderBy(F.col(keys.season).desc(), F.col(keys.week).desc(), F.col("_w").desc())
    run = counts.withColumn("_to", F.sum("_n").over(w))
    used = run.withColumn("_use", F.greatest(F.lit(0), F.least(F.col("_n"), last_n - (F.col("_to") - F.col("_n"))))).where(F.col("_use") > 0)
    out = used.groupBy(keys.entity).agg(F.least(F.sum(F.col("_w") * F.col("_use")) * 2, F.lit(100)).alias("risk_score"), F.sum("_use").alias("reports"))
    return out.withColumn("risk_level", at_least(F.col("risk_score"), [(70, "HIGH"), (40, "MODERATE")], "LOW"))


def recurrence_risk(injuries: DataFrame, since_season: int, keys: Keys = KEYS) -> DataFrame:
    """10 points per recent report, half again for a recurring type, scaled by position."""
    by_type = injuries.where(F.col(keys.entity).isNotNull()).groupBy(keys.entity, keys.group, "injury_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(keys.season) >= since_season).cast("int")).alias("recent"))
    agg = by_type.groupBy(keys.entity, keys.group).agg(F.sum("n").alias("n"), F.sum("recent").alias("recent_injuries"),
                                                      F.max((F.col("n") >= 2).cast("int")).alias("has_recurring"))
    base = F.col("recent_injuries") * 10 * F.when(F.col("has_recurring") == 1, 1.5).otherwise(1.0)
    score = F.least(base * lookup(F.col(keys.group), {"RB": 1.3, "WR": 1.1, "TE": 1.0, "QB": 0.8}, 1.0), F.lit(100.0))
    level = F.when(score < 20, "low").when(score < 50, "moderate").when(score < 75, "high").otherwise("very_high")
    return agg.withColumns({"risk_score": score, "risk_level": level, "confidence": F.when(F.col("n") >= 3, "high").otherwise("moderate")}).drop("n")


# --- lineups -------------------------------------------------------------------------------------------------------
# fixed values: starters by position and flexible places
LINEUP = {"QB": 1, "RB": 2, "WR": 2, "TE": 1}
FLEX = ("RB", "WR", "TE")


def objective(objective: str, projection: str = "projection", floor: str = "floor", ceiling: str = "ceiling", salary: str | None = None) -> Column:
    """Value maximised by a lineup: expected, floor or ceiling points, per 1,000 of salary where there is one."""
    x = F.col({"expected": projection, "floor": floor, "ceiling": ceiling}[objective])
    return x / F.col(salary) * 1000 if salary else x


def profile_projection(base: Column, floor: Column, ceiling: Column, consistency: Column, boom_range: Column, risk: float,
                       prefer_consistency: bool, boom: float) -> Column:
    """Blend of floor and ceiling by risk appetite, with consistency and boom preferences."""
    base = F.coalesce(base, F.lit(0.0))
    lo, hi = F.coalesce(floor, base * 0.7), F.coalesce(ceiling, base * 1.3)
    steady = F.coalesce(consistency, F.lit(50.0)) / 100 * 2 if prefer_consistency else F.lit(0.0)
    return lo * (1 - risk) + hi * risk + steady + F.coalesce(boom_range, F.lit(0.0)) * boom * 0.1


def best_lineups(players: DataFrame, roster: list[str], value: str, slots: Mapping[str, int] = LINEUP, flex: int = 1, keys: Keys = KEYS) -> DataFrame:
    """Greedy lineup of every roster: the best of each position, then the best of the rest as flex.

    Only the first (slots + flex) of a position can start, so each roster and position is cut to
    that many rows before anything is ordered across positions.
    """
    need = lookup(F.col(keys.group), dict(slots), 0)
    most = max(slots.values()) + flex
    cand = first_rows(players.where(F.col(keys.group).isin(list(slots))), [*roster, keys.group], [F.round(value, 9).desc(), F.col(keys.entity)], most)
    cand = cand.withColumn("_base", F.col("_pos") <= need).drop("_pos")
    start = cand.where("_base").withColumn("slot", F.col(keys.group))
    rest = first_rows(cand.where(~F.col("_base") & F.col(keys.group).isin(list(FLEX))), roster, [F.round(value, 9).desc(), F.col(keys.entity)], flex)
    return start.drop("_base").unionByName(rest.withColumn("slot", F.lit("FLEX")).drop("_base", "_pos"))


def lineup_appearances(lineups: DataFrame, roster: list[str], n_weeks: int, keys: Keys = KEYS) -> DataFrame:
    """How many of the playoff weeks each player starts; in all of them = stud."""
    out = lineups.groupBy(*roster, keys.entity).agg(F.countDistinct(keys.week).alias("starts"))
    return out.withColumn("role", F.when(F.col("starts") == n_weeks, "stud").otherwise("situational"))


def playoff_score(strategy: str, util: Column, low: Column, high: Column, games: Column) -> Column:
    """0.6 usual + 0.4 high (or low), discounted for missed games."""
    base = {"ceiling": util * 0.6 + high * 0.4, "floor": util * 0.6 + low * 0.4, "balanced": util}[strategy]
    return base * (0.7 + 0.3 * games / 17.0)


def trade_values(sides: DataFrame, projections: DataFrame, weeks_left: int, per_week: str = "avg_points", keys: Keys = KEYS) -> DataFrame:
    """Net rest-of-season value of every trade. ``sides``: (trade_id, side 'give'|'get', player)."""
    rows = sides.join(projections.select(keys.entity, per_week), keys.entity)
    total = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(per_week) * weeks_left)), F.lit(0.0))
    out = rows.groupBy("trade_id").agg(total("give").alias("giving_value"), total("get").alias("receiving_value"))
    g = F.col("net_gain")
    verdict = (F.when(g >= 15, "STRONG ACCEPT").when(g >= 5, "ACCEPT").when(g > 0, "NEUTRAL (Slight edge to you)")
               .when(g >= -5, "NEUTRAL (Slight edge to them)").when(g >= -15, "REJECT").otherwise("STRONG REJECT"))
    return out.withColumn("net_gain", F.col("receiving_value") - F.col("giving_value")).withColumn("verdict", verdict)


def trade_positions(sides: DataFrame, projections: DataFrame, per_week: str = "avg_points", keys: Keys = KEYS) -> DataFrame:
    """Change in depth and quality by position for every trade."""
    rows = sides.join(projections.select(keys.entity, keys.group, per_week), keys.entity)
    on = lambda s, x: F.when(F.col("side") == s, x)
    mean = lambda s: F.coalesce(F.avg(on(s, F.col(per_week))), F.lit(0.0))
    out = rows.groupBy("trade_id", keys.group).agg((F.count(on("get", F.lit(1))) - F.count(on("give", F.lit(1)))).alias("net_players"),
                                                   (mean("get") - mean("give")).alias("quality_change"))
    return out.withColumn("verdict", F.when(F.col("quality_change") > 0, "UPGRADE").otherwise("DOWNGRADE"))


# --- usage over seasons ---------------------------------------------------------------------------------------------------
def usage_rollup(panel: DataFrame, score: str, elite: float = 85.0, keys: Keys = KEYS) -> DataFrame:
    """Players, rows, mean and spread of a usage score, and its elite rows per hundred players, from one aggregate.

    Groups: (season, position, tier), (season, position), (position, tier), position, and all rows; a null key stands for all of its values.
    """
    s = F.col("_score")
    df = panel.select(keys.season, keys.group, keys.entity, F.col(score).cast("double").alias("_score")).where(s.isNotNull()).withColumn("tier", utilization_tier(s))
    every = [keys.season, keys.group, "tier"]
    sets = [every, every[:2], every[1:], every[1:2], []]
    players = F.count_distinct(keys.entity)
    out = df.groupingSets([[F.col(c) for c in g] for g in sets], *every).agg(
        players.alias("total_players"), F.count(s).alias("n_rows"), F.avg(s).alias("avg_util"), F.stddev_samp(s).alias("std_util"), F.count(F.when(s >= elite, 1)).alias("elite_count"))
    return out.withColumns({"elite_pct": F.round(F.col("elite_count") / F.col("total_players") * 100, 1), "samples_per_player": F.col("n_rows") / F.col("total_players")})


# --- looking back ------------------------------------------------------------------------------------------------------
# fixed values: score expected of a pick, by last round of the band
ROUND_EXPECTATION = [(2, {"QB": 85, "RB": 82, "WR": 80, "TE": 75}), (5, {"QB": 75, "RB": 72, "WR": 70, "TE": 65}),
                     (10, {"QB": 65, "RB": 60, "WR": 58, "TE": 55})]
ROUND_EXPECTATION_LATE = {"QB": 55, "RB": 50, "WR": 48, "TE": 45}


def pick_review(panel: DataFrame, score: str, draft_round: str, keys: Keys = KEYS) -> DataFrame:
    """Season average, elite, starter and low weeks, and value against the round's expectation, for every player-season."""
    x = F.col(score)
    out = panel.groupBy(keys.entity, "name", keys.group, keys.season).agg(
        F.avg(x).alias("avg_score"), F.count(F.lit(1)).alias("games_played"), F.sum((x >= 85).cast("int")).alias("weeks_as_elite"),
        F.sum((x >= 70).cast("int")).alias("weeks_as_starter"), F.sum((x < 20).cast("int")).alias("injury_weeks"), F.max(draft_round).alias("draft_round"))
    want = None
    for last, table in ROUND_EXPECTATION:
        v = lookup(F.col(keys.group), table)
        want = F.when(F.col("draft_round") <= last, v) if want is None else want.when(F.col("draft_round") <= last, v)
    out = out.withColumn("expected_value", want.otherwise(lookup(F.col(keys.group), ROUND_EXPECTATION_LATE)))
    out = out.withColumn("value_vs_round", F.col("avg_score") - F.col("expected_value"))
    return out.withColumn("verdict", at_least(F.col("value_vs_round"), [(10, "Excellent"), (5, "Good"), (-5, "Fair"), (-10, "Disappointing")], "Poor"))


def pick_alternatives(panel: DataFrame, score: str, n: int = 3, keys: Keys = KEYS) -> DataFrame:
    """For every position-season the n + 1 best averages: enough to give anyone n others."""
    avg = panel.groupBy(keys.group, keys.season, keys.entity).agg(F.avg(score).alias("avg_score"))
    return first_rows(avg, [keys.group, keys.season], [F.round("avg_score", 9).desc(), F.col(keys.entity)], n + 1).withColumnRenamed("_pos", "place")


def head_to_head(panel: DataFrame, first, second, season: int, score: str, weeks: Sequence[int] | None = None, keys: Keys = KEYS) -> DataFrame:
    """One row comparing two players of a season."""
    df = panel.where((F.col(keys.season) == season) & F.col(keys.entity).isin(first, second))
    if weeks:
        df = df.where(F.col(keys.week).isin(list(weeks)))
    side = lambda who, x: F.when(F.col(keys.entity) == who, x)
    out = df.agg(*[f.alias(n) for t, who in (("first", first), ("second", second)) for n, f in (
        (f"{t}_avg", F.avg(side(who, F.col(score)))), (f"{t}_games", F.count(side(who, F.lit(1)))), (f"{t}_total", F.sum(side(who, F.col(score)))),
        (f"{t}_elite_weeks", F.sum(side(who, (F.col(score) >= 85).cast("int")))))])
    diff = F.col("first_total") - F.col("second_total")
    return out.withColumns({"winner": F.when(F.col("first_avg") > F.col("second_avg"), F.lit(first)).otherwise(F.lit(second)),
                            "delta": F.abs(F.col("first_avg") - F.col("second_avg")), "total_diff": diff,
                            "verdict": F.when(diff > 50, "FIRST").when(diff < -50, "SECOND").otherwise("EVEN")})


# --- draft board -----------------------------------------------------------------------------------------------------------
def risk_scores(agg: DataFrame, keys: Keys = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """0..100 risk: volatility 30, variation 25, inconsistency 25, missed games 20, scaled inside the position (and ``by``)."""
    cols = ["vol_mean", "cv_mean", "consistency_mean", "games_played"]
    lim = agg.groupBy(*by, keys.group).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    df = agg.join(lim, [*by, keys.group])
    lo, hi = (lambda c: F.col(f"_lo_{c}")), (lambda c: F.col(f"_hi_{c}"))
    scaled = lambda c: (F.col(c) - lo(c)) / F.when(hi(c) > lo(c), hi(c) - lo(c)).otherwise(1.0)
    missing = lambda c: F.when(hi(c) > 0, 1 - F.col(c) / hi(c)).otherwise(0.0)
    score = scaled("vol_mean") * 30 + scaled("cv_mean") * 25 + missing("consistency_mean") * 25 + missing("games_played") * 20
    return df.withColumn("risk_score", clip(score, 0.0, 100.0)).drop(*[f"_{n}_{c}" for n in ("lo", "hi") for c in cols])


def draft_board(agg: DataFrame, projection: str | None = None, keys: Keys = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Draft order per position (and ``by``) with totals, per-game values and +-1.5 sd over 17 games."""
    order = F.coalesce(-F.round(F.col(projection or "ppg"), 9), F.lit(float("inf")))
    df = place(agg, [*by, keys.group], [order, F.col(keys.entity)], "adp")
    if projection:
        p, band = F.col(projection), 1.5 * F.col("fp_std") * 17.0 ** 0.5
        df = df.withColumns({"projection_points_per_game": p / 17, "projection_floor": F.when(F.col("fp_std") > 0, F.greatest(p - band, F.lit(0.0))),
                             "projection_ceiling": F.when(F.col("fp_std") > 0, p + band)})
    return df


def app_snapshot(features: DataFrame, projections: DataFrame, upcoming: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Feature table whose latest week carries the projections, plus upcoming rows that replace equal keys."""
    extra = [c for c in projections.columns if c != keys.entity]
    last = features.agg(F.max(F.struct(keys.season, keys.week)).alias("_at"))
    df = features.join(F.broadcast(last)).join(projections, keys.entity, "left")  # one row
    now = (F.col(keys.season) == F.col(f"_at.{keys.season}")) & (F.col(keys.week) == F.col(f"_at.{keys.week}"))
    df = df.withColumns({c: F.when(now, F.col(c)) for c in extra}).drop("_at")
    kept = df.join(upcoming.select(*keys.grain), keys.grain, "left_anti")
    return kept.unionByName(upcoming, allowMissingColumns=True)


# --- roster ----------------------------------------------------------------------------------------------------------------------
# fixed values: players a roster should hold; usage by depth
IDEAL = {"QB": 2, "RB": 4, "WR": 4, "TE": 2}
DEPTH_USAGE = {"QB": ([1.0], 0.05), "RB": ([0.55, 0.30, 0.10], 0.05), "WR": ([0.30, 0.25, 0.20, 0.15], 0.05), "TE": ([0.70, 0.20], 0.10)}


def roster_needs(rosters: DataFrame, roster: list[str], points: str = "projected_points", keys: Keys = KEYS) -> DataFrame:
    """Need or surplus of every roster and position against the ideal counts."""
    have = rosters.groupBy(*roster).agg(*[F.count(F.when(F.col(keys.group) == p, 1)).alias(f"n_{p}") for p in IDEAL],
                                        *[F.avg(F.when(F.col(keys.group) == p, F.col(points))).alias(f"avg_{p}") for p in IDEAL])
    rows = F.array(*[F.struct(F.lit(p).alias(keys.group), F.col(f"n_{p}").alias("current"), F.lit(k).alias("ideal"), F.col(f"avg_{p}").alias("avg_projected"))
                     for p, k in IDEAL.items()])
    out = have.select(*roster, F.explode(rows).alias("r")).select(*roster, "r.*")
    short = F.col("current") < F.col("ideal")
    return out.withColumns({"need": F.greatest(F.col("ideal") - F.col("current"), F.lit(0)), "surplus": F.greatest(F.col("current") - F.col("ideal"), F.lit(0)),
                            "priority": F.when(short, F.when(F.col("current") == 0, "High").otherwise("Medium"))})


def depth_chart(rosters: DataFrame, order: list[Column], keys: Keys = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Depth rank inside (team, position), or those of each ``by``, and the usage expected at that depth."""
    df = place(rosters, [*by, keys.team, keys.group], order, "depth_rank")
    r = F.col("depth_rank")
    use = lambda t: F.coalesce(F.get(F.array(*[F.lit(x) for x in t[0]]), (r - 1).cast("int")), F.lit(t[1]))
    return df.withColumn("expected_utilization", lookup(F.col(keys.group), {p: use(t) for p, t in DEPTH_USAGE.items()}, 0.0))

"""History features of a panel row. Everything looks strictly back.

Blocks that share the entity window are built from one spec, so a whole block
costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.exprs import clip, lookup, passer_rating, safe_divide, zero
from weekgrain.functions.order_stats import expanding_quantile, quantiles
from weekgrain.functions.windows import (UNB, gated, prior, prior_mean, prior_slope, prior_std, prior_sum,
                                         with_causal_stats, with_prior_ewm)
from weekgrain.keys import KEYS, Keys, settled

FP = "fantasy_points"


# --- ratios of the current row ------------------------------------------------------
# fixed values: ratios that exist where the feed has both columns: numerator, denominator, factor
OPTIONAL_RATIOS = {
    "deep_ball_pct": ("deep_pass_attempts", "passing_attempts", 100), "yac_per_carry": ("yards_after_contact", "rushing_attempts", 1),
    "broken_tackle_rate": ("broken_tackles", "rushing_attempts", 1), "yac_per_reception": ("yards_after_catch", "receptions", 1),
    "contested_catch_rate": ("contested_catches", "contested_targets", 1), "slot_pct": ("slot_snaps", "snap_count", 100),
    "route_participation_rate": ("routes_run", "snap_count", 1),
}


def optional_ratios(columns: Sequence[str], table) -> dict[str, Column]:
    return {out: safe_divide(F.col(n), F.col(d)) * k for out, (n, d, k) in table.items() if n in columns and d in columns}


def base_features(panel: DataFrame) -> DataFrame:
    """Efficiency and volume of the row itself; ratios of optional columns (:data:`OPTIONAL_RATIOS`) where the table has them."""
    c = F.col
    depth = {} if "average_depth_of_target" in panel.columns else {"average_depth_of_target": safe_divide(c("air_yards"), c("targets"))}
    optional = optional_ratios(panel.columns, OPTIONAL_RATIOS)
    out = panel.withColumns({
        "yards_per_carry": safe_divide(c("rushing_yards"), c("rushing_attempts")),
        "yards_per_target": safe_divide(c("receiving_yards"), c("targets")),
        "yards_per_reception": safe_divide(c("receiving_yards"), c("receptions")),
        "catch_rate": safe_divide(c("receptions"), c("targets")) * 100,
        "completion_pct": safe_divide(c("completions"), c("passing_attempts")) * 100,
        "yards_per_attempt": safe_divide(c("passing_yards"), c("passing_attempts")),
        "td_rate": safe_divide(c("passing_tds"), c("passing_attempts")) * 100,
        "int_rate": safe_divide(c("interceptions"), c("passing_attempts")) * 100,
        "total_touches": c("rushing_attempts") + c("receptions"),
        "total_yards": c("rushing_yards") + c("receiving_yards"),
        "total_tds": c("rushing_tds") + c("receiving_tds"),
        "opportunities": c("rushing_attempts") + c("targets"),
        "weighted_opportunities": c("rushing_attempts") * 2 + c("targets"),
        "air_yards_per_attempt": safe_divide(c("air_yards"), c("passing_attempts")),
        "td_int_ratio": safe_divide(c("passing_tds"), F.when(c("interceptions") == 0, 0.5).otherwise(c("interceptions"))),
        **depth, **optional,
        "is_home": (c("home_away") == "home").cast("int"),
        "season_week_pct": c("week") / 18.0,
    })
    return out.withColumn("yards_per_td", safe_divide(c("total_yards"), c("total_tds")))


def play_efficiency(weeks: DataFrame) -> DataFrame:
    """EPA and WPA per opportunity, where the play-derived columns are present."""
    c = F.col
    return weeks.withColumns({
        "pass_epa_per_play": safe_divide(c("pass_epa"), c("passing_attempts")),
        "rush_epa_per_play": safe_divide(c("rush_epa"), c("rushing_attempts")),
        "recv_epa_per_target": safe_divide(c("recv_epa"), c("targets")),
        "pass_wpa_per_play": safe_divide(c("pass_wpa"), c("passing_attempts")),
        "rush_wpa_per_play": safe_divide(c("rush_wpa"), c("rushing_attempts")),
        "recv_wpa_per_target": safe_divide(c("recv_wpa"), c("targets")),
        "third_down_target_rate": safe_divide(c("third_down_targets"), c("targets")),
        "short_yardage_touch_rate": safe_divide(c("short_yardage_rushes"), c("rushing_attempts")),
        "two_minute_target_rate": safe_divide(c("two_minute_targets"), c("targets")),
        "high_leverage_touch_rate": safe_divide(c("high_leverage_touches"), c("rushing_attempts") + c("targets")),
    })


# fixed values: ratios of one position that exist where the feed has both columns: position, numerator, denominator, factor
POSITION_RATIOS = {
    "rz_completion_pct": ("QB", "redzone_completions", "redzone_attempts", 100), "deep_pass_rate": ("QB", "deep_pass_attempts", "passing_attempts", 100),
    "deep_pass_accuracy": ("QB", "deep_pass_completions", "deep_pass_attempts", 100), "rz_carry_rate": ("RB", "redzone_carries", "rushing_attempts", 1),
    "outside_pct": ("WR", "outside_snaps", "snap_count", 100), "te_slot_pct": ("TE", "slot_snaps", "snap_count", 100),
}


def _position_optionals(columns: Sequence[str]) -> dict[str, Column]:
    """Columns of one position that need more than the core feed."""
    c, has = F.col, set(columns)
    only = lambda p, x: F.when(c("position") == p, x)
    out = {name: only(p, safe_divide(c(n), c(d)) * k) for name, (p, n, d, k) in POSITION_RATIOS.items() if {n, d} <= has}
    if "sacks" in has:
        dropbacks = c("passing_attempts") + c("sacks")
        out |= {"adj_pass_attempts": only("QB", dropbacks), "sack_rate": only("QB", safe_divide(c("sacks"), dropbacks) * 100)}
    if "time_in_pocket" in has:
        out["avg_time_in_pocket"] = only("QB", c("time_in_pocket"))
    if "total_touches_roll5_mean" in has:
        out["workload_trend"] = only("RB", c("total_touches") - c("total_touches_roll5_mean"))
    if "route_diversity_score" in has:
        out |= {"route_tree_diversity": only("WR", c("route_diversity_score")), "te_route_diversity": only("TE", c("route_diversity_score"))}
    if {"routes_run", "snap_count"} <= has:
        share = safe_divide(c("routes_run"), c("snap_count"))
        out |= {"te_route_participation": only("TE", share * 100), "te_inline_block_rate": only("TE", clip(1.0 - share, 0.0, 1.0) * 100)}
    elif "route_participation" in has:
        out["te_route_participation"] = only("TE", c("route_participation"))
    return out


def position_features(panel: DataFrame) -> DataFrame:
    """Ratios that exist for one position only (null elsewhere). Needs :func:`base_features`.

    Optional columns (sacks, pocket time, red-zone and deep passes, routes, alignment, ``total_touches_roll5_mean``) add their ratios or take the
    place of a proxy: goal-line carries of carries inside the ten, routes of snaps, measured yards after catch of receiving less air yards.
    """
    c, pos = F.col, F.col("position")
    has = panel.columns
    only = lambda p, x: F.when(pos == p, x)
    first = lambda *names: next(n for n in names if n in has)
    routes, goal_line = first("routes_run", "snap_count"), first("goal_line_carries", "rush_inside_10")
    after_catch = c("yards_after_catch").cast("double") if "yards_after_catch" in has else F.greatest(c("receiving_yards") - c("air_yards"), F.lit(0.0))
    proxy = safe_divide(c("receiving_yards"), c("targets")) * (1 - F.coalesce(c("catch_rate"), F.lit(0.0)) / 100)
    return panel.withColumns({
        **_position_optionals(has),
        "rush_pct_of_plays": only("QB", safe_divide(c("rushing_attempts"), c("passing_attempts") + c("rushing_attempts")) * 100),
        "yards_per_completion": only("QB", safe_divide(c("passing_yards"), c("completions"))),
        "receiving_pct": only("RB", safe_divide(c("receptions"), c("total_touches")) * 100),
        "td_per_touch": only("RB", safe_divide(c("total_tds"), c("total_touches"))),
        "goal_line_carry_rate": only("RB", safe_divide(c(goal_line), c("rushing_attempts"))),
        "rz_target_rate": F.when(pos.isin("RB", "WR"), safe_divide(c("redzone_targets"), c("targets"))),
        "yards_per_route": only("WR", safe_divide(c("receiving_yards"), c(routes))),
        "contested_proxy": only("WR", proxy),
        "yards_per_catch": only("WR", safe_divide(c("receiving_yards"), c("receptions"))),
        "seam_threat": only("TE", c("yards_per_target")),
        "te_contested_proxy": only("TE", proxy),
        "rz_specialist_score": only("TE", safe_divide(c("receiving_tds"), c("targets")) * 100),
        "te_rz_target_rate": only("TE", safe_divide(c("redzone_targets"), c("targets"))),
        "te_adot": only("TE", safe_divide(c("air_yards"), c("targets"))),
        "te_yac": only("TE", after_catch),
        "te_yards_per_route": only("TE", safe_divide(c("receiving_yards"), c(routes))),
    })


# fixed values: quarterback metrics that get a rolling-3 mean and a lag
QB_METRICS = ["completion_pct", "passer_rating", "td_rate_qb", "int_rate_qb", "yards_per_attempt", "air_yards_per_attempt", "rush_attempt_rate", "turnover_rate",
              "total_plays", "deep_ball_pct", "sack_rate", "rz_efficiency", "avg_time_in_pocket"]


def _qb_measured(columns: Sequence[str]) -> dict[str, Column]:
    """Deep ball, red zone, sacks and pocket time from the feed's columns, or league values and proxies where it lacks them."""
    c, has = F.col, set(columns)
    out = {}
    if "deep_pass_attempts" in has:
        out["deep_ball_pct"] = safe_divide(zero("deep_pass_attempts"), c("passing_attempts"))
    elif "passing_air_yards" in has:
        out["deep_ball_pct"] = F.when(c("air_yards_per_attempt") > 10, 0.15).otherwise(0.08)
    else:
        out["deep_ball_pct"] = F.lit(0.10)
    if "redzone_attempts" in has:
        out |= {"rz_attempts": zero("redzone_attempts").cast("double"), "rz_efficiency": safe_divide(c("passing_tds"), zero("redzone_attempts"))}
    else:
        out |= {"rz_attempts": F.bround(c("passing_attempts") * 0.12), "rz_efficiency": c("td_rate_qb") * 3.0}
    taken = next((n for n in ("sacks", "sacks_taken") if n in has), None)
    out["sack_rate"] = safe_divide(zero(taken), c("passing_attempts") + zero(taken)) if taken else F.lit(0.065)
    out["avg_time_in_pocket"] = F.coalesce(c("time_in_pocket").cast("double"), F.lit(2.6)) if "time_in_pocket" in has else F.when(c("is_mobile_qb") == 1, 2.4).otherwise(2.7)
    return out


def qb_features(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Quarterback rates, rushing, volume and turnovers, and of :data:`QB_METRICS` the prior rolling-3 mean and last value; quarterbacks only.

    ``total_yards`` and ``total_tds`` are passing plus rushing here. Without ``air_yards`` a depth of 0.6 yards per passing yard is assumed.
    """
    c = F.col
    plays = zero("passing_attempts") + zero("rushing_attempts")
    lost = zero("interceptions") + (zero("fumbles_lost") if "fumbles_lost" in panel.columns else F.lit(0))
    air = safe_divide(zero("air_yards"), c("passing_attempts")) if "air_yards" in panel.columns else safe_divide(c("passing_yards"), c("passing_attempts")) * 0.6
    qb = panel.where(F.col("position") == "QB").withColumns({
        "rush_yards_per_carry": safe_divide(c("rushing_yards"), c("rushing_attempts")),
        "rush_attempt_rate": safe_divide(c("rushing_attempts"), plays),
        "rush_td_rate": safe_divide(c("rushing_tds"), c("rushing_attempts")),
        "is_mobile_qb": F.coalesce(c("rushing_attempts") >= 4, F.lit(False)).cast("int"),
        "total_plays": (c("passing_attempts") + c("rushing_attempts")).cast("double"),
        "total_yards": c("passing_yards") + c("rushing_yards"),
        "total_tds": c("passing_tds") + c("rushing_tds"),
        "turnover_rate": safe_divide(lost, plays),
        "completion_pct": safe_divide(c("completions"), c("passing_attempts")),
        "yards_per_attempt": safe_divide(c("passing_yards"), c("passing_attempts")),
        "td_rate_qb": safe_divide(c("passing_tds"), c("passing_attempts")),
        "int_rate_qb": safe_divide(c("interceptions"), c("passing_attempts")),
        "air_yards_per_attempt": air,
        "passer_rating": passer_rating(c("completions"), c("passing_attempts"), c("passing_yards"), c("passing_tds"),
                                       c("interceptions")),
    })
    qb = qb.withColumns(_qb_measured(qb.columns))
    w = keys.entity_window()
    return qb.withColumns({f"{m}_roll3": prior_mean(m, w, 3) for m in QB_METRICS}
                          | {f"{m}_lag1": F.lag(m).over(w) for m in QB_METRICS})


# --- rolling, lag, trend --------------------------------------------------------------
def rolling_means(panel: DataFrame, columns: Sequence[str], windows: Sequence[int] = C.ROLLING_WINDOWS,
                  keys: Keys = KEYS) -> DataFrame:
    w = keys.entity_window()
    return panel.withColumns({f"{c}_roll{n}_mean": prior_mean(c, w, n) for n in windows for c in columns})


def rolling_stds(panel: DataFrame, columns: Sequence[str], windows: Sequence[int] = C.ROLLING_WINDOWS,
                 keys: Keys = KEYS) -> DataFrame:
    w = keys.entity_window()
    return panel.withColumns({f"{c}_roll{n}_std": prior_std(c, w, n) for n in windows for c in columns})


def ewm_means(panel: DataFrame, columns: Sequence[str], spans: Sequence[int] = C.EWM_SPANS, keys: Keys = KEYS) -> DataFrame:
    return with_prior_ewm(panel, columns, spans, keys)


def lags(panel: DataFrame, columns: Sequence[str], steps: Sequence[int] = C.LAG_WEEKS, keys: Keys = KEYS) -> DataFrame:
    w = keys.entity_window()
    return panel.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for k in steps for c in columns})


def trends(panel: DataFrame, columns: Sequence[str], windows: Sequence[int] = C.TREND_WINDOWS, keys: Keys = KEYS) -> DataFrame:
    w = keys.entity_window()
    numbered = panel.withColumn("_rn", F.row_number().over(w))
    return numbered.withColumns({f"{c}_trend{n}": prior_slope(c, w, F.col("_rn"), n) for c in columns for n in windows}).drop("_rn")


def week_over_week(panel: DataFrame, columns: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """Change between the two rows before the current one, absolute and relative, within one entity."""
    w = keys.entity_window()
    new = {}
    for c in columns:
        last, before = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
        new[f"{c}_wow_change"] = last - before
        new[f"{c}_wow_pct_change"] = F.when(before != 0, last / before - 1)
    return panel.withColumns(new)


def regression_to_mean(panel: DataFrame, column: str = FP, keys: Keys = KEYS) -> DataFrame:
    """Player EWM against the position's mean and spread over strictly earlier weeks."""
    ewm = with_prior_ewm(panel, [column], [8], keys)
    out = with_causal_stats(ewm, {column: "_pos"}, [keys.group], keys)
    dev = F.col(f"{column}_ewm8") - F.col("_pos_mean")
    return out.withColumns({
        "fp_deviation_from_pos_mean": dev,
        "fp_regression_to_mean_z": F.when(F.col("_pos_std").isNotNull(), dev / F.greatest("_pos_std", F.lit(1.0))),
    }).drop("_pos_mean", "_pos_std", "_pos_min", "_pos_max", "_pos_n", f"{column}_ewm8")


def season_to_date(panel: DataFrame, column: str = FP, keys: Keys = KEYS) -> DataFrame:
    """Mean of the season so far, and that mean as it stood one row earlier."""
    out = panel.withColumn("season_to_date_ppg", prior_mean(column, keys.entity_season_window()))
    return out.withColumn("prev_season_ppg", F.lag("season_to_date_ppg").over(keys.entity_window()))


def app_features(panel: DataFrame, windows: Sequence[int] = (3, 4, 5, 8), keys: Keys = KEYS) -> DataFrame:
    """The feature family the app snapshot carries: rolling, lag, trend, season average, playoff flags."""
    w = keys.entity_window()
    roll = {"fp": FP, "touches": "total_touches", "targets": "targets", "ypc": "yards_per_carry", "catch_rate": "catch_rate"}
    lag = {"fp": FP, "targets": "targets", "rush_att": "rushing_attempts"}
    out = panel.withColumns(
        {f"{n}_rolling_{k}": prior_mean(c, w, k) for k in windows for n, c in roll.items()}
        | {f"{n}_lag_{k}": F.lag(c, k).over(w) for k in C.LAG_WEEKS for n, c in lag.items()}
        | {"fp_season_avg": prior_mean(FP, keys.entity_season_window())})
    return season_labels(out.withColumn("fp_trend", F.col("fp_rolling_3") - F.col("fp_rolling_5")))


def season_labels(panel: DataFrame) -> DataFrame:
    wk = F.col("week")
    flag = lambda cond: cond.cast("int")
    return panel.withColumns({
        "is_playoff_week": flag(wk > 18), "is_wild_card": flag(wk == 19), "is_divisional_round": flag(wk == 20),
        "is_conference_championship": flag(wk == 21), "is_super_bowl": flag(wk == 22),
        "season_phase": F.when(wk <= 6, 0).when(wk <= 12, 1).when(wk <= 18, 2).otherwise(3),
        "week_normalized": F.least(wk, F.lit(18)) / 18.0,
        "is_late_season": flag(wk.between(15, 18)), "is_high_stakes": flag(wk >= 15),
    })


# --- opponents and matchups ------------------------------------------------------------
def opponent_zscores(panel: DataFrame, allowed: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Points the opponent gave up last week by position, and their causal z-scores."""
    cols = [f"{FP}_allowed_{p.lower()}" for p in C.POSITIONS]
    last = allowed.select(F.col("team").alias(keys.opponent), keys.season, (F.col(keys.week) + 1).alias(keys.week), *cols)
    out = panel.join(last, [keys.opponent, *keys.period], "left")
    out = with_causal_stats(out, {c: f"_{c}" for c in cols}, [], keys)
    z = lambda c: (F.col(c) - F.col(f"_{c}_mean")) / F.greatest(F.col(f"_{c}_std"), F.lit(1e-6))
    out = out.withColumns({f"{c}_zscore": F.when(F.col(f"_{c}_std").isNotNull(), z(c)) for c in cols})
    out = out.drop(*[f"_{c}_{s}" for c in cols for s in ("mean", "std", "min", "max", "n")])
    return out.withColumn("opp_fpts_allowed", lookup(F.col(keys.group), {p: F.col(f"{FP}_allowed_{p.lower()}") for p in C.POSITIONS}))


def team_rolling(team_week: DataFrame, columns: Sequence[str], n: int = 4, minimum: int = 2, keys: Keys = KEYS) -> DataFrame:
    """In-season rolling mean of a team's earlier weeks."""
    w = Window.partitionBy(keys.team, keys.season).orderBy(keys.week)
    return team_week.withColumns({f"inseason_{c}": prior_mean(c, w, n, minimum) for c in columns})


def _momentum(c: str, w) -> Column:
    """0.6 of the last four, 0.3 of the four before, 0.1 of the rest; missing frames add nothing."""
    recent, mid, early = C.MOMENTUM_WEIGHTS
    part = lambda a, b, k: F.coalesce(F.avg(c).over(w.rowsBetween(a, b)) * k, F.lit(0.0))
    total = part(-4, -1, recent) + part(-8, -5, mid) + part(UNB, -9, early)
    return F.when(F.count(F.lit(1)).over(prior(w)) > 0, total)


def _own_z(c: str, w) -> Column:
    """z of a value against the earlier values of its own partition; 0 when undefined."""
    mean, std, n = F.avg(c).over(prior(w)), F.stddev_samp(c).over(prior(w)), F.count(c).over(prior(w))
    return F.coalesce(F.when(n >= 2, (F.col(c) - mean) / F.greatest(std, F.lit(1e-6))), F.lit(0.0))


def team_momentum(team_week: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Offensive momentum per team-week on a 0..44 scale around 22."""
    w = Window.partitionBy(keys.team, keys.season).orderBy(keys.week)
    parts = C.MOMENTUM_PARTS
    out = team_week.withColumns({f"_m_{c}": _momentum(c, w) for c in parts})
    out = out.withColumns({f"_z_{c}": _own_z(f"_m_{c}", w) for c in parts})
    out = out.withColumn("_mom", sum((F.col(f"_z_{c}") * k for c, k in parts.items()), F.lit(0.0)))
    mean, std, n = F.avg("_mom").over(prior(w)), F.stddev_samp("_mom").over(prior(w)), F.count("_mom").over(prior(w))
    scaled = F.when(n >= 2, 22.0 + 8.0 * (F.col("_mom") - mean) / F.greatest(std, F.lit(1e-6)))
    out = out.withColumn("offensive_momentum_score", F.greatest(F.lit(0.0), F.least(F.lit(44.0), F.coalesce(scaled, F.lit(22.0)))))
    return out.drop("_mom", *[f"_{k}_{c}" for k in "mz" for c in parts])


def matchup_quality(panel: DataFrame, opp: str, script: str, pace: str, keys: Keys = KEYS) -> DataFrame:
    """Weighted causal z-scores of three context columns plus home field, min-max scaled on earlier weeks to 0..100."""
    parts = {opp: 0.35, script: 0.30, pace: 0.20}
    out = with_causal_stats(panel, {c: f"_{c}" for c in parts}, [], keys)
    total = F.col("is_home") * 0.15
    for c, k in parts.items():
        z = (F.col(c) - F.col(f"_{c}_mean")) / F.greatest(F.col(f"_{c}_std"), F.lit(0.1))
        total = total + F.coalesce(F.when(F.col(f"_{c}_std").isNotNull(), z), F.lit(0.0)) * k
    out = out.withColumn("matchup_raw", total)
    out = with_causal_stats(out, {"matchup_raw": "_q"}, [], keys)
    span = F.col("_q_max") - F.col("_q_min")
    scaled = F.when(span > 0, (F.col("matchup_raw") - F.col("_q_min")) / span * 100)
    out = out.withColumn("matchup_quality_indicator", clip(F.coalesce(scaled, F.lit(50.0)), 0.0, 100.0))
    made = [f"_{p}_{k}" for p in (*parts, "q") for k in ("n", "min", "max", "mean", "std")]
    return out.drop(*made, "matchup_raw")


# --- rest, teams, script -----------------------------------------------------------------
def rest_features(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    w = keys.entity_window()
    gap = F.col(keys.week) - F.lag(keys.week).over(w)
    days = F.greatest(F.coalesce(gap, F.lit(1)), F.lit(1)) * 7.0
    return panel.withColumns({
        "post_bye": F.coalesce((gap > 1).cast("int"), F.lit(0)), "days_since_last_game": days,
        "short_week": (days <= 4.0).cast("int"), "rest_advantage": clip(days - 7.0, -4.0, 7.0)})


def team_change_features(panel: DataFrame, pass_rate: str, recent_util: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Team and season changes, weeks since the last of either, and scheme fit."""
    w = keys.entity_window()
    last_team, last_season = F.lag(keys.team).over(w), F.lag(keys.season).over(w)
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    out = panel.withColumns({"team_changed": flag(F.col(keys.team) != last_team),
                             "new_season": flag(F.col(keys.season) != last_season)})
    out = out.withColumn("_stint", F.sum(F.greatest("team_changed", "new_season")).over(w.rowsBetween(UNB, 0)))
    stint = Window.partitionBy(keys.entity, "_stint").orderBy(keys.season, keys.week)
    delta = F.coalesce(F.col(pass_rate) - F.lag(pass_rate).over(w), F.lit(0.0))
    want = lookup(F.col(keys.group), C.PASS_PREFERENCE, C.PASS_PREFERENCE_DEFAULT)
    off = F.coalesce(clip(F.abs(F.col(pass_rate) - want) / 0.6, 0.0, 1.0), F.lit(0.5))
    out = out.withColumns({"weeks_on_team": F.row_number().over(stint), "team_pass_rate_delta": delta, "scheme_mismatch": off})
    moved = F.col("team_changed")
    util = F.coalesce(F.col(recent_util), F.lit(0.0)) if recent_util else F.lit(0.0)
    return out.withColumns({
        "team_change_pass_rate_delta": F.col("team_pass_rate_delta") * moved,
        "scheme_fit_score": 1.0 - F.col("scheme_mismatch"),
        "scheme_mismatch_on_change": F.col("scheme_mismatch") * moved,
        "team_change_recent_util": F.when(moved == 1, util).otherwise(F.lit(0.0)),
    }).drop("_stint")


# fixed values: margin -> garbage-time share
GARBAGE_BY_SCORE = [(24, 0.30), (17, 0.20), (10, 0.10)]
GARBAGE_BY_RESULT = [(28, 0.35), (21, 0.25), (14, 0.15), (7, 0.05)]


def _steps(x: Column, table) -> Column:
    out = None
    for edge, v in table:
        out = F.when(x >= edge, v) if out is None else out.when(x >= edge, v)
    return out.otherwise(0.0)


def garbage_from_plays(plays: DataFrame, player: str, keys: Keys = KEYS, by: str = "wp") -> DataFrame:
    """Share of a player-week's plays in garbage time, by win probability or by quarter and margin."""
    if by == "wp":
        late = (F.col("wp") < 0.10) | (F.col("wp") > 0.90)
    else:
        m = F.abs("score_differential")
        late = ((F.col("qtr") == 4) & (m >= 17)) | ((F.col("qtr") == 3) & (m >= 24))
    return plays.where(F.col(player).isNotNull()).groupBy(F.col(player).alias(keys.entity), *keys.period).agg(
        F.avg(F.coalesce(late, F.lit(False)).cast("int")).alias("garbage_time_pct"))


def with_game_script(df: DataFrame, margin: str | None = None, final: bool = False) -> DataFrame:
    """Script factor 0.5..1 from ``garbage_time_pct``, or from a game margin when the share is not there."""
    if margin is not None:
        df = df.withColumn("garbage_time_pct", _steps(F.abs(margin), GARBAGE_BY_RESULT if final else GARBAGE_BY_SCORE))
    g = F.col("garbage_time_pct")
    return df.withColumns({"game_script_factor": clip(1.0 - 0.5 * g, 0.5, 1.0), "competitive_snaps_pct": 1.0 - g})


def adjusted_shares(df: DataFrame) -> DataFrame:
    """``*_adj`` copies of utilization and share columns, discounted by the script factor."""
    cols = [c for c in df.columns if "utilization" in c.lower() or "share" in c.lower()]
    return df.withColumns({f"{c}_adj": F.col(c) * F.col("game_script_factor") for c in cols})


# --- requirement features ------------------------------------------------------------------
def boom_bust_rates(panel: DataFrame, windows: Sequence[int] = (4, 8), keys: Keys = KEYS,
                    thresholds: dict | None = None) -> DataFrame:
    """Share of recent rows above/below the position's lines. The first row of an entity counts as neither."""
    table = thresholds or C.BOOM_BUST
    w = keys.entity_window()
    line = lambda i: lookup(F.col(keys.group), {p: v[i] for p, v in table.items()}, C.BOOM_BUST_DEFAULT[i])
    last = F.lag(FP).over(w)
    out = panel.withColumns({"_boom": F.coalesce((last >= line(0)).cast("double"), F.lit(0.0)),
                             "_bust": F.coalesce((last < line(1)).cast("double"), F.lit(0.0))})
    return out.withColumns({f"{k}_rate_roll{n}": F.avg(f"_{k}").over(w.rowsBetween(-(n - 1), 0))
                            for n in windows for k in ("boom", "bust")}).drop("_boom", "_bust")


def experience_features(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Years since first appearance and the contract-year guess. A minimum over past rows is the minimum over all."""
    w = keys.entity_window().rowsBetween(UNB, 0)
    exp = F.col(keys.season) - F.min(keys.season).over(w)
    out = panel.withColumn("nfl_experience_years", exp)
    return out.withColumn("is_contract_year", F.col("nfl_experience_years").isin(3, 4, 7, 8).cast("int"))


def age_curve(panel: DataFrame, age: str = "age", keys: Keys = KEYS) -> DataFrame:
    at = lambda i: lookup(F.col(keys.group), {p: v[i] for p, v in C.AGE_CURVE.items()}, C.AGE_CURVE_DEFAULT[i])
    off = F.coalesce(F.col(age), F.lit(26)) - at(0)
    return panel.withColumn("age_curve", 1.0 - at(1) * off * off)


def usage_classes(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Role flags from rolling-4 means. Needs total_touches and snap_share."""
    w, pos = keys.entity_window(), F.col(keys.group)
    m = lambda c: prior_mean(c, w, 4)
    out = panel.withColumns({"_t": m("total_touches"), "_g": m("targets"), "_d": m("receiving_tds"),
                             "_s": m("snap_share"), "_r": m("receptions")})
    flag = lambda p, cond: F.coalesce((pos == p) & cond, F.lit(False)).cast("int")
    t, g, d, s, r = (F.col(f"_{k}") for k in "tgdsr")
    return out.withColumns({
        "is_workhorse_rb": flag("RB", t >= 15), "is_committee_rb": flag("RB", (t < 15) & (t >= 5)),
        "is_wr1": flag("WR", g >= 7), "is_wr2": flag("WR", (g >= 4) & (g < 7)), "is_wr3": flag("WR", (g < 4) & (g >= 1)),
        "is_rz_specialist_te": flag("TE", d >= 0.3), "is_three_down_back": flag("RB", (s >= 0.5) & (r >= 1.5)),
    }).drop(*[f"_{k}" for k in "tgdsr"])


def workload_features(panel: DataFrame, age: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Touches of the last 3 and 4 rows and the risk that they carry, by position and age.

    Without an age the age curve of the row stands in, if it has one. Rows with ``sacks`` also get the risk of the sacks of the last 4 rows.
    """
    w = keys.entity_window()
    three, four = (F.coalesce(prior_sum("total_touches", w, n), F.lit(0)) for n in (3, 4))
    out = panel.withColumns({"cumulative_workload_3w": three, "cumulative_workload_4w": four})
    four = F.col("cumulative_workload_4w")
    limit = lookup(F.col(keys.group), C.WORKLOAD_THRESHOLD)
    risk = F.when(limit.isNotNull(), clip(four / limit, 0.0, 1.0)).otherwise(four)
    years = F.lit(1.0)
    if age:
        years = clip(1.0 + 0.03 * clip(F.coalesce(F.col(age), F.lit(26)) - 27, -3), 0.9, 1.5)
    elif "age_curve" in panel.columns:
        years = F.coalesce(clip(2.0 - F.col("age_curve"), 0.9, 1.5), F.lit(1.0))
    if "sacks" in panel.columns:
        out = out.withColumn("qb_sack_injury_risk", clip(F.coalesce(prior_mean("sacks", w, 4), F.lit(0.0)) / 5.0, 0.0, 1.0))
    return out.withColumns({"workload_injury_risk": clip(risk * years, 0.0, 1.0),
                            "workload_injury_risk_raw": clip(four / 100.0, 0.0, 1.0)})


def return_from_absence(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Rows since the last missed week; the first three rows back are flagged and discounted."""
    w = keys.entity_window()
    gap = F.col(keys.week) - F.lag(keys.week).over(w)
    out = panel.withColumns({"_rn": F.row_number().over(w), "_gap": gap})
    out = out.withColumn("_last", F.max(F.when(F.col("_gap") > 1, F.col("_rn"))).over(w.rowsBetween(UNB, 0)))
    since = F.col("_rn") - F.col("_last")
    back = F.coalesce(since <= 2, F.lit(False))
    return out.withColumns({
        "games_since_injury": F.when(back, since.cast("double")).otherwise(F.lit(99.0)),
        "is_first_3_games_back": back.cast("int"),
        "return_from_injury_discount": F.when(back & (since == 0), 0.70).when(back & (since == 1), 0.85)
        .when(back, 0.95).otherwise(1.0)}).drop("_rn", "_gap", "_last")


def outlier_flags(panel: DataFrame, columns: Sequence[str], sigma: float = 3.0, injury_score: str | None = None,
                  keys: Keys = KEYS) -> DataFrame:
    """Rows beyond sigma of all earlier weeks (at least ten values), and low games of hurt players."""
    out = with_causal_stats(panel, {c: f"_{c}" for c in columns}, [], keys, min_mean=10, min_std=10)
    hit = low = F.lit(False)
    for c in columns:
        mean, std = F.col(f"_{c}_mean"), F.col(f"_{c}_std")
        hit = hit | F.coalesce(F.abs(F.col(c) - mean) > sigma * std, F.lit(False))
        if c == FP and injury_score:
            low = F.coalesce((F.col(c) < mean - 2 * std) & (F.coalesce(F.col(injury_score), F.lit(1.0)) < 0.7), F.lit(False))
    out = out.withColumns({"is_statistical_outlier": hit.cast("int"), "is_outlier_injury": low.cast("int")})
    return out.drop(*[f"_{c}_{s}" for c in columns for s in ("mean", "std", "min", "max", "n")])


# --- missing values -----------------------------------------------------------------------
def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its share of missing (null, NaN or infinite) values, in one scan."""
    bad = lambda c: _unusable(c).cast("int")
    one = df.agg(*[F.avg(bad(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in columns])
    return one.select(F.explode(pairs).alias("p")).select("p.column", "p.missing_rate")


def _unusable(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def fit_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, fill, missing_rate) from train rows: exact medians from one value ladder over all columns."""
    from weekgrain.functions.order_stats import melt
    clean = train.select(*[F.when(~_unusable(c), F.col(c)).alias(c) for c in columns])
    med = quantiles(melt(clean, [], columns), ["component"], "value", {"fill": 0.5})
    rates = missing_rates(train, columns).withColumnRenamed("column", "component")
    return settled(rates.join(med.select("component", "fill"), "component", "left").withColumn("fill", F.coalesce("fill", F.lit(0.0))))


def impute(df: DataFrame, medians: DataFrame, columns: Sequence[str], indicator_above: float = 0.02) -> DataFrame:
    """Fills unusable values with fitted medians and adds 0/1 ``_missing`` marks to history columns.

    ``medians`` has one row per column, so its map form is a single small row.
    """
    fills = medians.agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("fill", "missing_rate")))).alias("_fit"))
    out = df.join(F.broadcast(fills))  # exactly one row
    new = {}
    for c in columns:
        fit = F.col("_fit")[c]
        if any(tok in c for tok in ("_roll", "_lag", "_ewm", "_trend")):
            new[f"{c}_missing"] = (_unusable(c) & (fit["missing_rate"] > indicator_above)).cast("int")
        new[c] = F.when(_unusable(c), fit["fill"]).otherwise(F.col(c))
    return out.withColumns(new).drop("_fit")


# --- volatility and confidence --------------------------------------------------------------
def volatility(panel: DataFrame, min_games: int = 3, keys: Keys = KEYS) -> DataFrame:
    w = keys.entity_window()
    frame = prior(w)
    n = F.count(FP).over(frame)
    out = panel.withColumns({"_n": n, "_m": F.avg(FP).over(frame), "weekly_volatility": gated(F.stddev_samp(FP).over(frame), n, min_games),
                             "boom_bust_range": gated(F.max(FP).over(frame) - F.min(FP).over(frame), n, min_games)})
    cv = F.when((F.col("_n") >= min_games) & (F.col("_m") > 0), F.col("weekly_volatility") / F.col("_m")).otherwise(F.lit(0.0))
    out = out.withColumn("coefficient_of_variation", cv)
    return out.withColumn("consistency_score", 1 / (1 + F.col("coefficient_of_variation"))).drop("_n", "_m")


def rolling_volatility(panel: DataFrame, window: int = 4, keys: Keys = KEYS) -> DataFrame:
    w = keys.entity_window()
    out = panel.withColumns({"rolling_volatility": prior_std(FP, w, window), "_m": prior_mean(FP, w, window, 2)})
    return out.withColumn("rolling_consistency", F.when(F.col("_m") > 0, 1 / (1 + F.col("rolling_volatility") / F.col("_m"))).otherwise(F.lit(0.5))).drop("_m")


def confidence(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Confidence from games so far and consistency. Needs :func:`volatility`."""
    games = F.row_number().over(keys.entity_window()) - 1
    grown = 1 - F.exp(-games / 8.0)
    return panel.withColumn("confidence_score", clip(0.4 * grown + 0.3 * F.coalesce("consistency_score", F.lit(0.5)) + 0.3 * grown, 0.0, 1.0))


def risk_adjusted(panel: DataFrame, risk: float = 0.15, min_rows: int = 10, keys: Keys = KEYS) -> DataFrame:
    """Points discounted by volatility relative to the 95th percentile of all strictly earlier weeks."""
    cap = expanding_quantile(panel, keys.period, "weekly_volatility", 0.95, "_cap").where(F.col("n") >= min_rows)
    out = panel.join(cap.drop("n").withColumn("_cap", F.greatest("_cap", F.lit(0.1))), keys.period, "left")
    out = out.withColumn("normalized_volatility", clip(F.col("weekly_volatility") / F.col("_cap"), 0.0, 1.0))
    return out.withColumn("risk_adjusted_projection", F.col(FP) * (1 - risk * F.col("normalized_volatility"))).drop("_cap")


def interactions(panel: DataFrame, util_lag: str = "utilization_score_lag1") -> DataFrame:
    """Lagged usage times efficiency, volume times efficiency."""
    c = F.col
    return panel.withColumns({
        "util_x_ypc": c(util_lag) * c("yards_per_carry"), "util_x_ypt": c(util_lag) * c("yards_per_target"),
        "touches_x_ypc": c("total_touches") * c("yards_per_carry"),
        "opp_x_td_rate": c("opportunities") * safe_divide(c("total_tds"), c("opportunities"))})


def adjusted_interactions(panel: DataFrame, util_lag: str | None = None, form: str = "fp_rolling_3") -> DataFrame:
    """Points for the opponent's strength, form for the matchup, and matchup, age and consistency times usage. Terms whose columns are missing are left out."""
    c, has = F.col, set(panel.columns)
    terms = {
        "fp_opp_adjusted": ({FP, "opp_defense_strength"}, lambda: c(FP) / clip(c("opp_defense_strength"), 0.5, 1.5)),
        "fp_matchup_adjusted": ({form, "opp_matchup_score"}, lambda: c(form) * (1 + (c("opp_matchup_score") - 0.5) * 0.2)),
        "usage_matchup_interaction": ({util_lag, "opp_matchup_score"}, lambda: c(util_lag) * c("opp_matchup_score")),
        "age_usage_interaction": ({"age", util_lag}, lambda: c("age") * c(util_lag)),
        "consistency_matchup_interaction": ({"consistency_score", "opp_matchup_score"}, lambda: c("consistency_score") * c("opp_matchup_score")),
    }
    return panel.withColumns({name: make() for name, (need, make) in terms.items() if need <= has})

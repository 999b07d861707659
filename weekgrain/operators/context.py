"""Opponent, schedule, horizon, injury, age, rookie and market context."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions import exprs as X
from weekgrain.functions.exprs import at_least, clip, lookup, zero
from weekgrain.functions.order_stats import first_rows, with_rank
from weekgrain.functions.windows import UNB, causal_group_stats, prior, prior_mean
from weekgrain.keys import KEYS, Keys, settled

FP = "fantasy_points"


# --- defences ------------------------------------------------------------------------------
def defense_strength(panel: DataFrame, min_games: int = 4, keys: Keys = KEYS) -> DataFrame:
    """Points a defence allowed per row of a position, relative to the league, for use NEXT season."""
    gave = (panel.groupBy(F.col(keys.opponent).alias(keys.team), keys.season, keys.group)
            .agg(F.avg(FP).alias("pts_allowed_mean"), F.count(FP).alias("games")).where(F.col("games") >= min_games))
    league = panel.groupBy(keys.season, keys.group).agg(F.avg(FP).alias("league_avg"))
    out = gave.join(league, [keys.season, keys.group]).withColumn("_tie", F.round("pts_allowed_mean", 9))
    order = Window.partitionBy(keys.season, keys.group).orderBy(F.col("_tie").desc())  # one row per team
    ties = F.count(F.lit(1)).over(Window.partitionBy(keys.season, keys.group, "_tie"))
    return out.select(
        keys.team, (F.col(keys.season) + 1).alias(keys.season), keys.group, "pts_allowed_mean", "games",
        clip(F.col("pts_allowed_mean") / F.col("league_avg"), 0.5, 1.5).alias("defense_strength"),
        (F.rank().over(order) + (ties - 1) / 2.0).alias("defense_rank"))


def with_opponent_strength(panel: DataFrame, strength: DataFrame, keys: Keys = KEYS) -> DataFrame:
    s = strength.select(F.col(keys.team).alias(keys.opponent), keys.season, keys.group, F.col("defense_strength").alias("opp_defense_strength"))
    return (panel.join(s, [keys.opponent, keys.season, keys.group], "left")
            .withColumn("opp_defense_strength", F.coalesce("opp_defense_strength", F.lit(1.0))))


def schedule_strength(panel: DataFrame, n: int = 5, serving: bool = False, keys: Keys = KEYS) -> DataFrame:
    """Mean strength and easy games of n opponents: the last n while training, the next n while serving."""
    df = with_opponent_strength(panel, defense_strength(panel, keys=keys), keys)
    frame = keys.entity_season_window().rowsBetween(*((1, n) if serving else (-(n - 1), 0)))
    easy = F.sum((F.col("opp_defense_strength") > 1.1).cast("int")).over(frame)
    out = df.withColumns({f"sos_next_{n}": F.coalesce(F.avg("opp_defense_strength").over(frame), F.lit(1.0)),
                          f"favorable_matchups_next_{n}": F.coalesce(easy, F.lit(n // 2))})
    return with_rank(out, [*keys.period, keys.group], f"sos_next_{n}", f"sos_rank_next_{n}", "average", ascending=False)


def defense_vs_position(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Weekly points allowed per (defence, position): prior rolling-4, 0..1 score and rank."""
    allowed = panel.groupBy(F.col(keys.opponent).alias(keys.team), *keys.period, keys.group).agg(F.sum(FP).alias("points_allowed"))
    w = Window.partitionBy(keys.team, keys.group).orderBy(*keys.period)
    allowed = allowed.withColumn("defense_pts_allowed_roll4", prior_mean("points_allowed", w, 4))
    # the rolling mean already looks back, so bounds may include the row's own week
    lim = allowed.groupBy(keys.group, *keys.period).agg(F.min("defense_pts_allowed_roll4").alias("lo"), F.max("defense_pts_allowed_roll4").alias("hi"))
    run = Window.partitionBy(keys.group).orderBy(*keys.period).rowsBetween(UNB, 0)
    lim = lim.select(keys.group, *keys.period, F.min("lo").over(run).alias("_lo"), F.max("hi").over(run).alias("_hi"))
    out = allowed.join(lim, [keys.group, *keys.period]).withColumn("_tie", F.round("defense_pts_allowed_roll4", 9))
    span = F.col("_hi") - F.col("_lo")
    roll = F.col("defense_pts_allowed_roll4")
    one_per_team = Window.partitionBy(*keys.period, keys.group)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys.period, keys.group, "_tie"))
    rank = F.rank().over(one_per_team.orderBy(F.col("_tie").desc_nulls_last())) + (ties - 1) / 2.0
    return out.withColumns({"matchup_score": F.coalesce(F.when(span > 0, (roll - F.col("_lo")) / span), F.lit(0.5)),
                            "defense_rank": F.when(roll.isNotNull(), rank)}).drop("_lo", "_hi", "_tie")


# fixed values: points a defence is assumed to allow
ALLOWED_DEFAULT = {"QB": 18.0, "RB": 12.0, "WR": 12.0, "TE": 10.0}


def with_opponent_matchup(panel: DataFrame, rankings: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Last week's defence ranking of the row's opponent."""
    r = rankings.select(F.col(keys.team).alias(keys.opponent), keys.season, (F.col(keys.week) + 1).alias(keys.week), keys.group,
                        F.col("defense_rank").alias("_r"), F.col("matchup_score").alias("_s"), F.col("defense_pts_allowed_roll4").alias("_p"))
    out = panel.join(r, [keys.opponent, *keys.period, keys.group], "left")
    known = F.col("_r").isNotNull() & F.col("_s").isNotNull() & F.col("_p").isNotNull()
    return out.withColumns({
        "defense_data_available": known.cast("int"), "opp_defense_rank": F.coalesce("_r", F.lit(16.0)),
        "opp_matchup_score": F.coalesce("_s", F.lit(0.5)),
        "opp_pts_allowed": F.coalesce(F.col("_p"), lookup(F.col(keys.group), ALLOWED_DEFAULT, 12.0))}).drop("_r", "_s", "_p")


# --- several weeks ahead -----------------------------------------------------------------------
def expected_games(panel: DataFrame, n: int, injury_score: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Games expected in the next n weeks from earlier seasons' share of 17 games."""
    seasons = panel.groupBy(keys.entity, keys.season).agg((F.count(F.lit(1)) / 17.0).alias("_rate"))
    w = prior(Window.partitionBy(keys.entity).orderBy(keys.season))
    seasons = seasons.select(keys.entity, keys.season, F.avg("_rate").over(w).alias("games_rate"))
    out = panel.join(seasons, [keys.entity, keys.season], "left")
    rate = F.coalesce(F.col("games_rate"), lookup(F.col(keys.group), C.GAMES_RATE, C.GAMES_RATE_DEFAULT))
    if injury_score:
        rate = rate * F.col(injury_score)
    return out.withColumn("games_rate", rate).withColumn(f"expected_games_next_{n}", clip(F.col("games_rate") * n, 0.0, float(n)))


def multiweek_projection(panel: DataFrame, n: int, weekly: str, spread: str = "weekly_volatility", keys: Keys = KEYS) -> DataFrame:
    """Weekly projection shrunk to the position's earlier mean, times expected games, with floor and ceiling."""
    df = expected_games(panel.withColumn("weekly_projection", F.coalesce(F.col(weekly), F.col(FP))), n, keys=keys)
    pull = C.REGRESSION_FACTORS.get(n, 0.1 * log(n + 1))
    stats = causal_group_stats(df, {"weekly_projection": "_p"}, [keys.group], keys).select(keys.group, *keys.period, "_p_mean")
    df = df.join(stats, [keys.group, *keys.period], "left")
    mean = F.coalesce("_p_mean", "weekly_projection")
    games = F.col(f"expected_games_next_{n}")
    df = df.withColumn("weekly_regressed", F.col("weekly_projection") * (1 - pull) + mean * pull)
    var = F.pow(F.col(spread), 2) * games * (1 + (games - 1) * 0.3)
    df = df.withColumns({f"projection_{n}w": F.col("weekly_regressed") * games, f"variance_{n}w": var}).withColumn(f"std_{n}w", F.sqrt(f"variance_{n}w"))
    p, s = F.col(f"projection_{n}w"), F.col(f"std_{n}w")
    return df.withColumns({f"floor_{n}w": clip(p - 1.28 * s, 0.0), f"ceiling_{n}w": p + 1.28 * s}).drop("_p_mean")


def injury_outlook(panel: DataFrame, n: int, injured: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Chance of an injury over n weeks, missed games, and risk relative to the week's largest."""
    df = panel.withColumn("_touches", zero("rushing_attempts") + zero("targets"))
    mean = df.groupBy(*keys.period, keys.group).agg(F.avg("_touches").alias("_mean"))
    df = df.join(mean, [*keys.period, keys.group])
    use = clip((F.col("_touches") - F.col("_mean")) * C.USAGE_INJURY_FACTOR, -0.1, 0.2)
    now = F.col(injured) * 0.3 if injured else F.lit(0.0)
    p = clip(lookup(F.col(keys.group), C.BASE_INJURY_RATE) / 17 + use / 17 + now, 0.0, 0.5)
    df = df.withColumn("weekly_injury_prob", p).withColumns({
        f"injury_prob_next_{n}": 1 - F.pow(1 - F.col("weekly_injury_prob"), F.lit(n)),
        f"expected_missed_games_{n}": F.col("weekly_injury_prob") * n})
    top = df.groupBy(*keys.period).agg(F.max(f"injury_prob_next_{n}").alias("_top"))
    return (df.join(top, keys.period)
            .withColumn(f"injury_risk_score_{n}", F.when(F.col("_top") > 0, F.col(f"injury_prob_next_{n}") / F.col("_top")).otherwise(F.lit(0.0)))
            .drop("_touches", "_mean", "_top"))


def injury_history(panel: DataFrame, injuries: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """What was reported about a player strictly before the row's week.

    Reports are first reduced to one row per (player, week); the running sums then follow the
    player's calendar, so neither a much-reported player nor a long history multiplies rows.
    """
    mine = injuries.where(F.col(keys.entity).isNotNull())
    part = F.substring(F.lower("injury_type"), 1, 4)
    weekly = mine.groupBy(*keys.grain).agg(F.count(F.lit(1)).alias("_n"), F.sum("games_missed").alias("_m"), F.min(part).alias("_part"))
    by_part = mine.groupBy(*keys.grain, part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"))
    every = panel.select(*keys.grain).join(weekly.select(*keys.grain), keys.grain, "full_outer").join(weekly, keys.grain, "left")
    w = prior(keys.entity_window())
    every = every.select(
        *keys.grain, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("injury_history_count"), F.sum("_m").over(w).alias("_missed"),
        F.max(F.when(F.col("_n") > 0, F.struct(keys.season, keys.week))).over(w).alias("_last"))
    # reports in seasons before (season - 2): taken off the running count gives the last two seasons
    seasons = (mine.select(keys.entity, keys.season, F.lit(1).alias("_n")).unionByName(panel.select(keys.entity, keys.season, F.lit(0).alias("_n")))
               .groupBy(keys.entity, keys.season).agg(F.sum("_n").alias("_n")))
    before = Window.partitionBy(keys.entity).orderBy(keys.season).rangeBetween(Window.unboundedPreceding, -3)
    old = seasons.select(keys.entity, keys.season, F.sum("_n").over(before).alias("_old"))
    same = by_part.select(*keys.grain, "_part", "_k")
    here = weekly.select(*keys.grain, "_part")
    w2 = prior(Window.partitionBy(keys.entity, "_part").orderBy(*keys.period))
    same = same.withColumn("same_bodypart_injuries", F.coalesce(F.sum("_k").over(w2), F.lit(0))).join(here, [*keys.grain, "_part"], "left_semi")
    out = (panel.join(every.drop("_part"), keys.grain, "left").join(old, [keys.entity, keys.season], "left")
           .join(same.select(*keys.grain, "same_bodypart_injuries"), keys.grain, "left"))
    ds = F.col(keys.season) - F.col(f"_last.{keys.season}")
    dw = F.when(ds == 0, F.col(keys.week) - F.col(f"_last.{keys.week}")).otherwise(F.col(keys.week) + 17 - F.col(f"_last.{keys.week}"))
    out = out.withColumns({
        "injury_history_2yr": F.col("injury_history_count") - F.coalesce("_old", F.lit(0)),
        "same_bodypart_injuries": zero("same_bodypart_injuries"),
        "days_since_last_injury": F.when(F.col("_last").isNotNull(), F.greatest(ds * 365 + dw * 7, F.lit(0))).otherwise(F.lit(365)),
        "avg_games_missed": F.when(F.col("injury_history_count") > 0, F.col("_missed") / F.col("injury_history_count")).otherwise(F.lit(0.0))})
    out = out.withColumn("injury_prone_flag", (F.col("injury_history_2yr") >= 3).cast("int"))
    risk = (1.0 + F.col("injury_history_count") * 0.10 + F.col("same_bodypart_injuries") * 0.30 + F.col("injury_prone_flag") * 0.20
            + F.when(F.col("days_since_last_injury") < 60, 0.25).otherwise(0.0))
    return out.withColumn("injury_history_risk_multiplier", F.least(risk, F.lit(3.0))).drop("_last", "_missed", "_old")


def estimated_injury_history(rows: DataFrame, games: str = "games_played", keys: Keys = KEYS) -> DataFrame:
    """Injury history guessed from missed games, for rows without reports."""
    # fixed values: games of a healthy season
    missed = F.greatest(lookup(F.col(keys.group), {"QB": 16, "RB": 14, "WR": 15, "TE": 15}, 15) - F.col(games), F.lit(0))
    out = rows.withColumns({"_m": missed, "injury_history_count": (missed >= 4).cast("int"), "injury_prone_flag": (missed >= 8).cast("int")})
    return out.withColumns({
        "avg_games_missed": F.when(F.col("_m") >= 4, F.col("_m").cast("double")).otherwise(0.0),
        "injury_history_risk_multiplier": F.least(1.0 + F.col("injury_history_count") * 0.10 + F.col("injury_prone_flag") * 0.20, F.lit(3.0))}).drop("_m")


def _recovery(kind: Column, pick) -> Column:
    out = None
    for word, values in C.RECOVERY.items():
        if word != "unknown":
            hit = F.lower(kind).contains(word)
            out = F.when(hit, pick(values)) if out is None else out.when(hit, pick(values))
    return out.otherwise(pick(C.RECOVERY["unknown"]))


def recovery_features(rows: DataFrame, kind: str = "injury_type", since: str = "weeks_since_return", returning: str = "is_returning") -> DataFrame:
    """Expected share of normal output after an injury, by keyword and weeks since the return."""
    k = F.col(since)
    curve = _recovery(F.col(kind), lambda v: F.get(F.array(*[F.lit(x) for x in v[1]]), F.least(k, F.lit(3)).cast("int")))
    back = F.col(returning) == 1
    share = F.when(back, F.when(k < 0, F.lit(0.0)).otherwise(curve)).otherwise(F.lit(1.0))
    out = rows.withColumns({"recovery_performance_pct": share,
                            "typical_weeks_out": _recovery(F.col(kind), lambda v: F.lit(v[0])),
                            "reinjury_risk": F.when(back, _recovery(F.col(kind), lambda v: F.lit(v[2]))).otherwise(F.lit(0.0))})
    return out.withColumn("recovery_weeks_remaining", F.when(back, F.floor((1.0 - F.col("recovery_performance_pct")) * 4 + 1e-9).cast("int")).otherwise(F.lit(0)))


def discounted_for_recovery(points: Column, share: Column, reinjury: Column) -> Column:
    return points * share * (1 - reinjury * 0.5)


def injury_hazard(panel: DataFrame, age: str, injured: str, classifier_prob: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Prior injuries, season workload and the hazard built from them; blended 60/40 with a classifier when there is one."""
    w = keys.entity_window()
    df = panel.withColumn("weekly_workload", zero("rushing_attempts") + zero("targets"))
    df = df.withColumns({"season_workload": F.sum("weekly_workload").over(keys.entity_season_window().rowsBetween(UNB, 0)),
                         "prior_injuries": F.coalesce(F.sum(injured).over(prior(w)), F.lit(0))})
    c = F.col
    df = df.withColumns({
        "injury_prob_advanced": X.injury_probability(c(keys.group), c(age), c(keys.week), c("weekly_workload"), c("season_workload"), c("prior_injuries")),
        "injury_age_risk": X.age_risk(c(age)), "injury_workload_risk": X.workload_risk(c(keys.group), c("weekly_workload"), c("season_workload"))})
    mix = c("injury_prob_advanced") if classifier_prob is None else 0.6 * c(classifier_prob) + 0.4 * c("injury_prob_advanced")
    return df.withColumn("injury_prob_combined", mix).withColumn("injury_risk_level", X.risk_level(c("injury_prob_combined")))


# --- age and games -----------------------------------------------------------------------------
def age_features(rows: DataFrame, age: str = "age", keys: Keys = KEYS) -> DataFrame:
    a, p = F.col(age), F.col(keys.group)
    now, nxt = X.by_age(a, p, X.AGE_FACTOR), X.by_age(a + 1, p, X.AGE_FACTOR)
    lo = lookup(p, {k: v[0] for k, v in X.PRIME_AGES.items()}, 24)
    hi = lookup(p, {k: v[1] for k, v in X.PRIME_AGES.items()}, 30)
    return rows.withColumns({
        "age_factor": now, "age_expected_games": X.by_age(a, p, X.AGE_GAMES), "decline_rate": F.when(now > 0, (now - nxt) / now).otherwise(0.0),
        "years_from_peak": a - lookup(p, X.PEAK_AGE, 27), "is_in_prime": a.between(lo, hi).cast("int")})


# fixed values: games of a season by position (mean, spread)
GAMES_STATS = {"QB": (14.5, 3.5), "RB": (12.8, 4.2), "WR": (14.2, 3.8), "TE": (13.8, 3.9)}


def games_projection(panel: DataFrame, injury_score: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Season games from age (40 %), own history (40 %) and position (20 %). Needs :func:`age_features`."""
    w = keys.entity_window()
    df = panel.withColumn("_first", (F.row_number().over(keys.entity_season_window()) == 1).cast("int"))
    df = df.withColumns({"_games": F.row_number().over(w) - 1, "_seasons": F.sum("_first").over(w.rowsBetween(UNB, 0)) - 1})
    mean = lookup(F.col(keys.group), {k: v[0] for k, v in GAMES_STATS.items()}, GAMES_STATS["WR"][0])
    std = lookup(F.col(keys.group), {k: v[1] for k, v in GAMES_STATS.items()}, GAMES_STATS["WR"][1])
    hist = F.when(F.col("_seasons") > 0, clip(F.col("_games") / (F.col("_seasons") * 17.0), 0.0, 1.0)).otherwise(mean / 17)
    rate = 0.4 * F.col("age_expected_games") / 17 + 0.4 * hist + 0.2 * mean / 17
    if injury_score:
        rate = rate * F.col(injury_score)
    df = df.withColumns({"historical_gpg": hist, "projected_games_rate": rate}).withColumn("projected_games_season", clip(F.col("projected_games_rate") * 17, 1.0, 17.0))
    g = F.col("projected_games_season")
    return df.withColumns({"projected_games_floor": clip(g - std, 0.0, 17.0), "projected_games_ceiling": clip(g + std, 0.0, 17.0)}).drop("_first", "_games", "_seasons")


# --- rookies ----------------------------------------------------------------------------------------
# fixed values: archetype -> (points per game, games)
ARCHETYPES = {
    "QB": {"elite": (16.5, 15), "high": (12.0, 12), "mid": (6.0, 8), "low": (2.0, 3)},
    "RB": {"elite": (14.0, 15), "high": (10.0, 14), "mid": (6.0, 12), "low": (3.0, 8)},
    "WR": {"elite": (12.0, 16), "high": (9.0, 15), "mid": (5.5, 14), "low": (2.5, 10)},
    "TE": {"elite": (9.0, 15), "high": (6.0, 14), "mid": (3.5, 12), "low": (1.5, 8)},
}
# fixed values: draft tier -> (mean, spread, games)
DRAFT_TIER_STATS = {
    "QB": {"round_1_top10": (14.5, 5.0, 14), "round_1": (10.0, 5.5, 10), "round_2": (5.0, 4.0, 6), "round_3_plus": (2.0, 3.0, 3)},
    "RB": {"round_1_top10": (14.0, 4.5, 15), "round_1": (12.0, 4.0, 14), "round_2": (9.0, 4.0, 13), "round_3_plus": (5.0, 3.5, 10)},
    "WR": {"round_1_top10": (12.0, 4.0, 15), "round_1": (9.0, 4.0, 14), "round_2": (7.0, 3.5, 13), "round_3_plus": (4.0, 3.0, 11)},
    "TE": {"round_1_top10": (8.0, 3.5, 14), "round_1": (6.0, 3.0, 13), "round_2": (4.5, 2.5, 12), "round_3_plus": (2.5, 2.0, 10)},
}
# fixed values: (last pick of the band, breakout rate, bust rate)
PICK_BANDS = [(10, 0.35, 0.15), (32, 0.25, 0.25), (64, 0.15, 0.35), (100, 0.08, 0.45)]
PICK_BANDS_ABOVE = (0.03, 0.55)
BREAKOUT_FACTOR = {"RB": 1.3, "WR": 1.0, "TE": 0.7, "QB": 0.9}
BUST_FACTOR = {"TE": 1.3, "QB": 1.2, "WR": 1.0, "RB": 0.9}


def archetype(position: Column, rnd: Column, pick: Column) -> Column:
    ladder = lambda a, b, c: F.when(a, "elite").when(b, "high").when(c, "mid").otherwise("low")
    return (F.when(position == "QB", ladder(pick <= 5, rnd == 1, rnd <= 3))
            .when(position == "RB", ladder((rnd <= 2) & (pick <= 50), rnd <= 3, rnd <= 5))
            .when(position == "WR", ladder(pick <= 15, rnd <= 2, rnd <= 4))
            .otherwise(ladder(rnd == 1, rnd <= 3, rnd <= 5)))


def draft_tier(rnd: Column, pick: Column) -> Column:
    return (F.when((rnd == 1) & (pick <= 10), "round_1_top10").when(rnd == 1, "round_1").when(rnd == 2, "round_2").otherwise("round_3_plus"))


def _nested(position: Column, key: Column, table: dict, i: int) -> Column:
    return lookup(position, {p: lookup(key, {k: float(v[i]) for k, v in t.items()}) for p, t in table.items()},
                  lookup(key, {k: float(v[i]) for k, v in table["WR"].items()}))


def first_season_flag(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    first = F.min(keys.season).over(keys.entity_window().rowsBetween(UNB, 0))
    return panel.withColumn("is_rookie", (F.col(keys.season) == first).cast("int"))


def rookie_features(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Archetype projection of first-season players, fading out over ten weeks."""
    df = first_season_flag(panel, keys)
    rookie = F.col("is_rookie") == 1
    kind = F.when(rookie, archetype(F.col(keys.group), F.coalesce("draft_round", F.lit(5)), F.coalesce("draft_pick", F.lit(150)))).otherwise(F.lit("mid"))
    df = df.withColumn("rookie_archetype", kind)
    ppg, games = (F.when(rookie, _nested(F.col(keys.group), F.col("rookie_archetype"), ARCHETYPES, i)) for i in (0, 1))
    return df.withColumns({"rookie_projected_ppg": ppg, "rookie_projected_games": games, "rookie_projected_total": ppg * games,
                           "rookie_weight": F.when(rookie, F.greatest(F.lit(0.0), 1 - (F.col(keys.week) - 1) / 10.0)).otherwise(F.lit(0.0))})


def opportunity_scores(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """(team, position): twice the position's share of the team's points, at most 1."""
    pos = panel.groupBy(keys.team, keys.group).agg(F.sum(FP).alias("_p"))
    team = pos.groupBy(keys.team).agg(F.sum("_p").alias("_t"))
    return pos.join(team, keys.team).select(
        keys.team, keys.group, F.when(F.col("_t") > 0, F.least(F.col("_p") / F.col("_t") * 2, F.lit(1.0))).otherwise(F.lit(0.5)).alias("opportunity_score"))


def rookie_outlook(rookies: DataFrame, opportunity: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Draft value, breakout and bust chance, floor and ceiling per rookie (one row each)."""
    df = rookies.join(opportunity, [keys.team, keys.group], "left").withColumn("opportunity_score", F.coalesce("opportunity_score", F.lit(0.5)))
    pos, pick, opp = F.col(keys.group), F.col("draft_pick"), F.col("opportunity_score")
    band = lambda i: X.bracket(pick, [(b[0], b[i]) for b in PICK_BANDS], PICK_BANDS_ABOVE[i - 1])
    tier = draft_tier(F.col("draft_round"), pick)
    mean, std, games = (_nested(pos, tier, DRAFT_TIER_STATS, i) for i in range(3))
    ppg = mean * (0.8 + opp * 0.4)
    return df.withColumns({
        "rookie_draft_value": X.piecewise_linear(pick, X.DRAFT_CURVE),
        "rookie_breakout_prob": F.least(band(1) * lookup(pos, BREAKOUT_FACTOR, 1.0) * (0.7 + opp * 0.6), F.lit(0.6)),
        "rookie_bust_prob": F.least(band(2) * lookup(pos, BUST_FACTOR, 1.0), F.lit(0.7)),
        "rookie_projected_ppg": ppg, "rookie_projected_games": games,
        "rookie_floor_ppg": F.greatest(ppg - 1.5 * std, F.lit(0.0)), "rookie_ceiling_ppg": ppg + 1.5 * std})


# fixed values: combine metric weights, and (elite, good, average) lines; 40-yard dash and cone: lower is better
COMBINE_METRICS = ["forty", "bench", "vertical", "broad", "cone"]
COMBINE_WEIGHTS = {
    "RB": [0.30, 0.15, 0.25, 0.20, 0.10], "WR": [0.40, 0.05, 0.25, 0.20, 0.10],
    "TE": [0.20, 0.25, 0.20, 0.20, 0.15], "QB": [0.25, 0.10, 0.20, 0.25, 0.20],
}
COMBINE_LINES = {
    "RB": [(4.40, 4.50, 4.60), (24, 20, 16), (38, 35, 32), (124, 118, 112), (6.80, 7.00, 7.20)],
    "WR": [(4.35, 4.45, 4.55), (16, 12, 8), (40, 37, 34), (128, 122, 116), (6.70, 6.90, 7.10)],
    "TE": [(4.55, 4.65, 4.80), (24, 20, 16), (36, 33, 30), (120, 115, 108), (6.90, 7.10, 7.30)],
    "QB": [(4.55, 4.70, 4.85), (20, 16, 12), (34, 31, 28), (116, 110, 104), (6.90, 7.10, 7.30)],
}
LOWER_IS_BETTER = {"forty", "cone"}


def combine_scores(rows: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Weighted mean of the available metric percentiles, one decimal, with a grade.

    A metric is worth 90+ beyond the elite line, 70..90 and 50..70 between the lines, and falls to 10 below.
    The lines of the row's position are looked up first, so each metric is one short expression.
    """
    pos = F.col(keys.group)
    lines, parts = {}, {}
    for i, m in enumerate(COMBINE_METRICS):
        sign = -1.0 if m in LOWER_IS_BETTER else 1.0
        table = {p: F.array(*[F.lit(sign * float(v)) for v in COMBINE_LINES[p][i]], F.lit(COMBINE_WEIGHTS[p][i])) for p in COMBINE_LINES}
        lines[f"_l_{m}"] = lookup(pos, table, table["WR"])
        step = 10.0 if m in LOWER_IS_BETTER else 2.0
        v, (elite, good, avg) = F.col(m).cast("double") * sign, (F.col(f"_l_{m}")[k] for k in range(3))
        p = (F.when(v >= elite, 90 + (v - elite) * step).when(v >= good, 70 + (v - good) / (elite - good) * 20)
             .when(v >= avg, 50 + (v - avg) / (good - avg) * 20).otherwise(F.greatest(F.lit(10.0), 50 - (avg - v) * step)))
        parts[f"_p_{m}"] = F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), p)))
    df = rows.withColumns(lines).withColumns(parts)
    weight = lambda m: F.when(F.col(f"_p_{m}").isNotNull(), F.col(f"_l_{m}")[3]).otherwise(0.0)
    num = sum((F.coalesce(F.col(f"_p_{m}"), F.lit(0.0)) * weight(m) for m in COMBINE_METRICS), F.lit(0.0))
    den = sum((weight(m) for m in COMBINE_METRICS), F.lit(0.0))
    df = df.withColumn("_exact", F.when(den > 0, num / den).otherwise(F.lit(50.0)))
    grade = at_least(F.col("_exact"), [(85, "Elite"), (70, "Good"), (50, "Average")], "Below Average")
    return (df.withColumns({"combine_score": F.round(F.col("_exact") + 1e-9, 1), "athleticism_grade": grade})
            .drop("_exact", *[f"_{k}_{m}" for k in "lp" for m in COMBINE_METRICS]))


# bands of draft slots around a profile's own, from near to far: picks apart in the same round, picks apart in the rounds next to it (none: -1),
# and the similarity that a slot outside of the band can reach at most
SLOT_BANDS = [(10, -1, 0.7 * 0.78 + 0.3), (24, 14, 0.7 * 0.50 + 0.3)]
SLOT_PARTS = 32
MET_ROWS = 50_000  # pairs of a profile and a slot whose rows one task ranks, about


def _similar(profiles: list[str], met: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """Scores the rows of each met slot that can be among the k best: those of the k nearest combine scores on either side.

    They are dealt to ``parts`` tasks before they become rows of their own, which are far more.
    """
    below = F.size(F.filter("ladder", lambda e: e["combine_score"] <= F.col("combine_score")))
    start = F.greatest(below - k + 1, F.lit(1))
    near = met.withColumn("_c", F.slice("ladder", start, F.lit(2 * k))).drop("ladder")
    gap, rgap = F.abs(F.col("draft_pick") - F.col("h_pick")), F.abs(F.col("draft_round") - F.col("h_round"))
    draft = (F.when(rgap == 0, 1.0 - F.least(gap / 50.0, F.lit(0.5))).when(rgap == 1, 0.7 - F.least(gap / 75.0, F.lit(0.4)))
             .otherwise(F.greatest(F.lit(0.1), 0.5 - rgap * 0.15 - gap / 100.0)))
    near = near.withColumn("_d", draft * 0.7)
    body = lambda c: F.greatest(F.lit(0.0), 1 - F.abs(F.col("combine_score") - c) / 30.0)
    scored = near.withColumn("_c", F.transform("_c", lambda e: F.struct(F.round(F.col("_d") + body(e["combine_score"]) * 0.3, 9).alias("similarity"), e["rows"].alias("rows"))))
    # what k rows of its own slot are ahead of is left out before rows are made of it; ties stay
    worth = F.sort_array(F.flatten(F.transform("_c", lambda e: F.transform(e["rows"], lambda r: e["similarity"]))), asc=False)
    scored = scored.withColumn("_k", F.get(worth, F.lit(k - 1)))
    scored = scored.select(*profiles, F.filter("_c", lambda e: F.coalesce(e["similarity"] >= F.col("_k"), F.lit(True))).alias("_c"))
    if parts:
        scored = scored.repartition(parts, *profiles)
    scored = scored.withColumn("_c", F.explode("_c")).select(*profiles, "_c.similarity", F.explode("_c.rows").alias("_h"))
    return first_rows(scored.select(*profiles, "similarity", "_h.*"), profiles, [F.col("similarity").desc(), F.col("name"), F.col("season")], k)


def comparable_rookies(rookies: DataFrame, history: DataFrame, k: int = 5, keys: Keys = KEYS) -> DataFrame:
    """The k most similar historical rookies of each profile, and their points per game.

    Similarity is 0.7 draft slot + 0.3 combine score. A profile first meets the slots of a band around its own (:data:`SLOT_BANDS`), joined on position,
    round and pick. Once k rows of the band are worth more than any slot outside of it can be, they are the answer; the other profiles go on to the next
    band, and those that no band settles meet all slots of their position, dealt to ``SLOT_PARTS`` parts. Inside a slot only the k nearest combine scores
    on either side can win. Combine scores have one decimal (as :func:`combine_scores` gives them), so a slot holds at most 1,001.
    ``history``: position, draft_round, draft_pick, combine_score, name, season, ppg, games.
    """
    pos = keys.group
    slot = [pos, "draft_round", "draft_pick"]
    few = first_rows(history, [*slot, "combine_score"], [F.col("name"), F.col("season")], k)
    ladder = (few.groupBy(*slot, "combine_score").agg(F.sort_array(F.collect_list(F.struct("name", "season", "ppg", "games"))).alias("rows"))
              .groupBy(*slot).agg(F.sort_array(F.collect_list(F.struct("combine_score", "rows"))).alias("ladder")))
    ladder = settled(ladder.select(pos, F.col("draft_round").cast("int").alias("h_round"), F.col("draft_pick").cast("int").alias("h_pick"), "ladder"))
    profiles = [*slot, "combine_score"]
    left = settled(rookies.select(profiles).distinct())
    found = None
    for same, beside, bound in SLOT_BANDS:
        picks = lambda round_, n: F.transform(F.sequence(F.col("draft_pick").cast("int") - n, F.col("draft_pick").cast("int") + n), lambda p: F.struct(round_.cast("int").alias("h_round"), p.alias("h_pick")))
        own = F.col("draft_round")
        band = F.concat(picks(own, same), *[picks(own + d, beside) for d in (-1, 1) if beside >= 0])
        pairs = left.count() * (2 * same + 1 + 2 * max(2 * beside + 1, 0))
        met = left.withColumn("_slot", F.explode(band)).select(*profiles, "_slot.*").join(ladder, [pos, "h_round", "h_pick"])
        best = settled(_similar(profiles, met, k, 1 + pairs // MET_ROWS))
        # the k-th row comes last, so it tells whether all k are beyond the reach of other slots
        done = best.where((F.col("_pos") == k) & (F.col("similarity") > bound + 1e-9)).select(profiles)
        mine = best.join(done, profiles, "left_semi")
        found = mine if found is None else found.unionByName(mine)
        left = settled(left.join(done, profiles, "left_anti"))
    dealt = ladder.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SLOT_PARTS - 1))))
    met = left.withColumn("_part", F.pmod(F.xxhash64(*profiles), F.lit(SLOT_PARTS)).cast("int")).join(dealt, [pos, "_part"]).drop("_part")
    return found.unionByName(_similar(profiles, met, k))


def comparable_projection(comps: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Mean, best and worst points per game over the comparables that scored."""
    good = F.when(F.col("ppg") > 0, F.col("ppg"))
    return comps.groupBy(keys.group, "draft_round", "draft_pick", "combine_score").agg(
        F.avg(good).alias("ppg_from_comps"), F.avg(F.when(F.col("games") > 0, F.col("games"))).alias("games_from_comps"),
        F.max(good).alias("ceiling_from_comps"), F.min(good).alias("floor_from_comps"))


# --- draft market -------------------------------------------------------------------------------------
# fixed values: round in which the n-th ranked player of a position goes
ADP_ROUNDS = {
    "QB": [3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18],
    "RB": [1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13],
    "WR": [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13],
    "TE": [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17],
}
SCARCITY = {"QB": 0.7, "RB": 1.0, "WR": 0.9, "TE": 0.8}


def adp_round(rank: Column, position: Column) -> Column:
    """Round by rank; past the list one round for every three ranks, at most 20."""
    def pick(rounds):
        arr, n = F.array(*[F.lit(r) for r in rounds]), len(rounds)
        late = F.least(F.lit(rounds[-1]) + F.floor((rank - n) / 3), F.lit(20))
        return F.when(rank <= n, F.get(arr, (F.greatest(rank, F.lit(1)) - 1).cast("int"))).otherwise(late).cast("int")
    return lookup(position, {p: pick(r) for p, r in ADP_ROUNDS.items()}, pick(ADP_ROUNDS["WR"]))


def adp_features(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Form rank of the week against the rank of last season, as draft rounds and value."""
    df = panel.withColumn("_form", prior_mean(FP, keys.entity_season_window(), 3))
    group = [*keys.period, keys.group]
    df = with_rank(df, group, "_form", "_rank", "min", ascending=False)
    size = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    df = df.join(size, group).withColumn("position_rank", F.when(F.col("_form").isNotNull(), F.col("_rank")).otherwise(F.col("_size")))
    seasons = panel.groupBy(keys.entity, keys.season, keys.group).agg(F.avg(FP).alias("_m"))
    seasons = seasons.withColumn("_prev", F.lag("_m").over(Window.partitionBy(keys.entity).orderBy(keys.season)))
    known = with_rank(seasons.where(F.col("_prev").isNotNull()), [keys.season, keys.group], "_prev", "_season_rank", "min", ascending=False)
    df = df.join(known.select(keys.entity, keys.season, "_season_rank"), [keys.entity, keys.season], "left")
    first = F.first("position_rank").over(keys.entity_season_window().rowsBetween(UNB, Window.unboundedFollowing))
    df = df.withColumn("season_position_rank", F.coalesce(F.col("_season_rank"), first))
    pos = F.col(keys.group)
    df = df.withColumns({"estimated_adp_round": adp_round(F.col("season_position_rank"), pos), "projected_adp_round": adp_round(F.col("position_rank"), pos)})
    df = df.withColumn("adp_value_score", F.col("estimated_adp_round") - F.col("projected_adp_round"))
    df = df.withColumns({"adp_value_normalized": clip(F.col("adp_value_score") / 16.0, -1.0, 1.0), "positional_scarcity": lookup(pos, SCARCITY)})
    return df.withColumn("adjusted_adp_value", F.col("adp_value_normalized") * F.col("positional_scarcity")).drop("_form", "_rank", "_size", "_season_rank")


# --- next game ---------------------------------------------------------------------------------------
def recent_form_projection(weeks: DataFrame, weights: Sequence[float], home_boost: float, n_weeks: int = 1,
                           schedule: DataFrame | None = None, keys: Keys = KEYS) -> DataFrame:
    """Weighted mean of the last 4, last 8 and all games per entity, times a home factor, for n weeks.

    Kickers use weights (.5, .3, .2) and boost 1.03, defences (.45, .35, .2) and 1.05.
    """
    w = Window.partitionBy(keys.entity).orderBy(F.col(keys.season).desc(), F.col(keys.week).desc())
    df = weeks.withColumn("_rn", F.row_number().over(w))
    last = lambda n: F.avg(F.when(F.col("_rn") <= n, F.col(FP)))
    agg = df.groupBy(keys.entity).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(keys.team))).alias(keys.team), F.count(F.lit(1)).alias("games_played"),
        last(4).alias("_a"), last(8).alias("_b"), F.avg(FP).alias("_c"), F.stddev_pop(F.when(F.col("_rn") <= 8, F.col(FP))).alias("_sd"),
    ).where(F.col("games_played") >= 2)
    if schedule is not None:
        agg = agg.join(schedule, keys.team, "left")
    home = F.when(F.col("home_away") == "home", home_boost).otherwise(1.0) if schedule is not None else F.lit(1.0)
    a, b, c = weights
    return agg.withColumns({
        "predicted_points": (a * F.col("_a") + b * F.col("_b") + c * F.col("_c")) * home * n_weeks,
        "prediction_std": F.col("_sd") * float(n_weeks) ** 0.5}).drop("_a", "_b", "_c", "_sd")


def upcoming_rows(panel: DataFrame, season: int, week: int, games: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Latest row of each player, moved to the coming week with its opponent and side."""
    rest = [c for c in panel.columns if c not in (keys.entity, keys.season, keys.week, keys.opponent, "home_away")]
    latest = panel.groupBy(keys.entity).agg(F.max_by(F.struct(*rest), F.struct(keys.season, keys.week)).alias("_r"),
                                            F.max(F.struct(keys.season, keys.week)).alias("_at"))
    latest = latest.select(keys.entity, "_r.*", F.col(f"_at.{keys.season}").alias("last_season"), F.col(f"_at.{keys.week}").alias("last_week"))
    coming = games.where((F.col(keys.season) == season) & (F.col(keys.week) == week)).select(
        keys.team, keys.opponent, F.when(F.col("is_home") == 1, "home").otherwise("away").alias("home_away"))
    return latest.join(coming, keys.team, "left").withColumns({keys.season: F.lit(season), keys.week: F.lit(week)})


def team_power(team_week: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """0..100 rating of every team from last season's scoring margin and yards, keyed on the season it serves."""
    r = 50 + (F.avg("points_scored") - F.avg("points_allowed")) * 2 + (F.avg("total_yards") - 300) / 10
    return team_week.groupBy(keys.team, (F.col(keys.season) + 1).alias(keys.season)).agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), r)).alias("rating"))


def strength_of_schedule(games: DataFrame, power: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Mean opponent rating per team-season and its rank (1 = hardest)."""
    rated = weekly_difficulty(games, power, keys)
    out = rated.groupBy(keys.season, keys.team).agg(F.avg("opponent_rating").alias("sos_rating"), F.count(F.lit(1)).alias("num_games"))
    w = Window.partitionBy(keys.season).orderBy(F.col("sos_rating").desc(), keys.team)  # one row per team
    return out.withColumn("sos_rank", F.row_number().over(w))


def weekly_difficulty(games: DataFrame, power: DataFrame, keys: Keys = KEYS) -> DataFrame:
    opp = power.select(F.col(keys.team).alias(keys.opponent), keys.season, F.col("rating").alias("opponent_rating"))
    rated = games.join(opp, [keys.opponent, keys.season], "left").withColumn("opponent_rating", F.coalesce("opponent_rating", F.lit(50.0)))
    return rated.select(*keys.team_week, keys.opponent, "is_home", "opponent_rating",
                        (F.col("opponent_rating") + F.when(F.col("is_home") == 0, 5).otherwise(0)).alias("matchup_difficulty"))


def recent_subset_average(panel: DataFrame, teams: Sequence, season: int, week: int, column: str, keys: Keys = KEYS) -> DataFrame:
    """Mean of a column over the last three weeks for players of some teams, with a 10 % band and a tier."""
    rows = panel.where(F.col(keys.team).isin(list(teams)) & (F.col(keys.season) == season) & F.col(keys.week).between(week - 2, week))
    out = rows.groupBy(keys.entity, "name", keys.team, keys.group).agg(F.avg(column).alias(column))
    x = F.col(column)
    return out.withColumns({"low": x * 0.9, "high": x * 1.1, "tier": at_least(x, [(85, "elite"), (70, "high"), (50, "moderate")], "low")})

"""Joins that build and enrich the panel.

No join carries a blanket broadcast hint: adaptive execution turns a join into a
broadcast when the measured side is below the threshold, and splits skewed
partitions otherwise. Right sides are made unique on their key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrain.functions.exprs import availability, clip, implied_total, win_probability
from weekgrain.functions.windows import prior_mean
from weekgrain.keys import KEYS, Keys, unique_on
from weekgrain.operators.features import team_rolling


def training_panel(stats: DataFrame, players: DataFrame, usage: DataFrame, team_stats: DataFrame, allowed: DataFrame,
                   min_games: int = 4, keys: Keys = KEYS) -> DataFrame:
    """Stats with player, usage and same-week team columns, and the opponent's allowed points of LAST week."""
    last = allowed.select(F.col(keys.team).alias(keys.opponent), keys.season, (F.col(keys.week) + 1).alias(keys.week),
                          F.col(keys.week).alias("opp_defense_week"),
                          *[c for c in allowed.columns if c not in (keys.team, keys.season, keys.week)])
    out = (stats.join(players, keys.entity).join(usage, keys.grain, "left").join(team_stats, keys.team_week, "left")
           .join(last, [keys.opponent, *keys.period], "left"))
    return with_min_games(out, min_games, keys)


def assert_strictly_prior(df: DataFrame, column: str = "opp_defense_week", keys: Keys = KEYS) -> DataFrame:
    """Raises when a joined context week is not before the row's own week."""
    if not df.where(F.col(column) >= F.col(keys.week)).isEmpty():
        raise ValueError(f"{column} reaches into the row's own or a later week")
    return df


def with_min_games(df: DataFrame, k: int, keys: Keys = KEYS) -> DataFrame:
    """Rows of entities that have at least k rows."""
    enough = df.groupBy(keys.entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    return df.join(enough.select(keys.entity), keys.entity, "left_semi")


def player_history(stats: DataFrame, players: DataFrame, stints: DataFrame, player_id, keys: Keys = KEYS) -> DataFrame:
    """One player's rows with name and stint columns."""
    me = stats.where(F.col(keys.entity) == player_id)
    return me.join(players, keys.entity).join(stints.withColumnRenamed(keys.team, "stint_team"), [keys.entity, keys.season], "left")


def within_stint(panel: DataFrame, stints: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Stint team of each row: equal player and season, week inside [start_week, end_week]."""
    s = stints.withColumnRenamed(keys.team, "stint_team")
    cond = ((panel[keys.entity] == s[keys.entity]) & (panel[keys.season] == s[keys.season])
            & panel[keys.week].between(s["start_week"], s["end_week"]))
    return panel.join(s, cond, "left").select(panel["*"], s["stint_team"], s["start_week"], s["end_week"])


def stints_of(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """First and last week of each (player, season, team)."""
    return panel.groupBy(keys.entity, keys.season, keys.team).agg(
        F.min(keys.week).alias("start_week"), F.max(keys.week).alias("end_week"))


# --- team context ----------------------------------------------------------------------
def prior_season_context(panel: DataFrame, team_week: DataFrame, columns: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """Last season's team means, for the own team (``team_a_``) and the opponent (``team_b_``)."""
    means = team_week.groupBy(keys.team, (F.col(keys.season) + 1).alias(keys.season)).agg(*[F.avg(c).alias(c) for c in columns])
    own = means.select(keys.team, keys.season, *[F.col(c).alias(f"team_a_{c}") for c in columns])
    other = means.select(F.col(keys.team).alias(keys.opponent), keys.season, *[F.col(c).alias(f"team_b_{c}") for c in columns])
    return panel.join(own, [keys.team, keys.season], "left").join(other, [keys.opponent, keys.season], "left")


def blend_in_season(panel: DataFrame, team_week: DataFrame, columns: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """From week 5 on, 60 % in-season rolling-4 and 40 % last season; last season alone before."""
    now = team_rolling(team_week, columns, keys=keys).select(*keys.team_week, *[f"inseason_{c}" for c in columns])
    out = panel.join(now, keys.team_week, "left")
    ready = lambda c: F.col(f"inseason_{c}").isNotNull() & (F.col(keys.week) >= 5)
    return out.withColumns({
        f"team_a_{c}": F.when(ready(c), 0.6 * F.col(f"inseason_{c}") + 0.4 * F.col(f"team_a_{c}")).otherwise(F.col(f"team_a_{c}"))
        for c in columns}).drop(*[f"inseason_{c}" for c in columns])


# fixed values: neutral fill of missing team context
TEAM_DEFAULTS = {"points_scored": 22.0, "points_allowed": 22.0, "total_yards": 340.0, "passing_yards": 220.0,
                 "rushing_yards": 120.0, "turnovers": 1.5}


def matchup_edges(df: DataFrame) -> DataFrame:
    """Differences of own and opponent context, expected total and pass rate, neutral where unknown."""
    fill = {f"team_{s}_{c}": F.coalesce(F.col(f"team_{s}_{c}"), F.lit(v)) for s in "ab" for c, v in TEAM_DEFAULTS.items()
            if f"team_{s}_{c}" in df.columns}
    a, b = (lambda c: F.col(f"team_a_{c}")), (lambda c: F.col(f"team_b_{c}"))
    edges = {
        "matchup_scoring_edge": F.coalesce(a("points_scored") - b("points_allowed"), F.lit(0.0)),
        "matchup_yards_diff": F.coalesce(a("total_yards") - b("total_yards"), F.lit(0.0)),
        "matchup_pass_diff": F.coalesce(a("passing_yards") - b("passing_yards"), F.lit(0.0)),
        "matchup_rush_diff": F.coalesce(a("rushing_yards") - b("rushing_yards"), F.lit(0.0)),
        "expected_game_total": F.coalesce(a("points_scored") + b("points_scored"), F.lit(44.0)),
        "expected_point_diff": F.coalesce(a("points_scored") - b("points_allowed"), F.lit(0.0)),
    }
    return df.withColumns(edges).withColumns(fill)


# --- schedule -----------------------------------------------------------------------------
def team_games(schedule: DataFrame) -> DataFrame:
    """Each game as one row per team: side, opponent, signed spread, implied total, flags, weather."""
    prime = (F.coalesce(F.split("gametime", ":")[0].cast("int"), F.lit(0)) >= 20) | F.lower("weekday").isin("thursday", "monday")
    side = lambda team, opp, home, spread: F.struct(
        F.col(team).alias("team"), F.col(opp).alias("opponent"), F.lit(home).alias("is_home"), spread.alias("spread"))
    sides = F.array(side("home_team", "away_team", 1, F.col("spread_line")), side("away_team", "home_team", 0, -F.col("spread_line")))
    long = schedule.withColumn("_s", F.explode(sides))
    rows = long.select(
        "season", "week", "_s.team", "_s.opponent", "_s.is_home", "_s.spread", F.col("total_line").alias("game_total"),
        F.coalesce("div_game", F.lit(0)).cast("int").alias("is_divisional"), F.coalesce(prime, F.lit(False)).cast("int").alias("is_primetime"),
        "temp", "wind", "weather")
    one = unique_on(rows, ["season", "week", "team"], [-F.col("is_home"), F.col("opponent"), F.col("spread")])
    return one.withColumn("implied_team_total", implied_total(F.col("game_total"), F.col("spread")))


def with_lines(panel: DataFrame, games: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Betting context of the row's team; neutral values where no line is known."""
    cols = ["spread", "game_total", "implied_team_total", "is_divisional", "is_primetime"]
    out = panel.join(games.select(*keys.team_week, *cols), keys.team_week, "left")
    out = out.withColumns({"spread": F.coalesce("spread", F.lit(0.0)), "game_total": F.coalesce("game_total", F.lit(46.0)),
                           "implied_team_total": F.coalesce("implied_team_total", F.lit(23.0)),
                           "is_divisional": F.coalesce("is_divisional", F.lit(0)), "is_primetime": F.coalesce("is_primetime", F.lit(0))})
    return out.withColumns({"win_probability": win_probability(F.col("spread")), "is_favorite": (F.col("spread") < 0).cast("int"),
                            "blowout_risk": clip(F.abs("spread") / 20.0, 0.0, 0.5)})


def with_weather(panel: DataFrame, games: DataFrame, domes: Sequence, keys: Keys = KEYS) -> DataFrame:
    """Dome by home side, cold and rain flags, and a 0.3..1 weather score."""
    out = panel.join(games.select(*keys.team_week, "temp", "wind", "weather"), keys.team_week, "left")
    host = F.when(F.col("home_away") == "home", F.col(keys.team)).otherwise(F.col(keys.opponent))
    out = out.withColumn("is_dome", F.coalesce(host.isin(list(domes)), F.lit(False)).cast("int"))
    open_air = F.col("is_dome") == 0
    wk, temp, wind = F.col(keys.week), F.col("temp"), F.coalesce("wind", F.lit(0.0))
    season_risk = F.when(wk >= 14, 0.3).when(wk <= 4, 0.1).otherwise(0.05)
    cold = F.when(temp < 35, 0.15).when(temp < 45, 0.05).otherwise(0.0)
    windy = F.when(wind > 20, 0.15).when(wind > 10, 0.05).otherwise(0.0)
    outside = F.when(temp.isNotNull(), clip(1.0 - cold - windy, 0.3, 1.0)).otherwise(1.0 - season_risk)
    flag = lambda c: F.coalesce(c & open_air, F.lit(False)).cast("int")
    return out.withColumns({
        "is_outdoor": 1 - F.col("is_dome"), "is_cold_game": flag(temp < 35),
        "is_rain_game": flag(F.lower("weather").rlike("rain|shower|precip|snow|sleet")),
        "weather_score": F.when(open_air, outside).otherwise(F.lit(1.0))})


# --- rosters ------------------------------------------------------------------------------------
def season_teams(panel: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Last team of every player in every season."""
    return panel.groupBy(keys.entity, keys.season).agg(
        F.max_by(keys.team, keys.week).alias(keys.team), F.max_by("name", keys.week).alias("name"),
        F.max_by(keys.group, keys.week).alias(keys.group))


def roster_changes(rosters: DataFrame, previous: int, current: int, every_kind: bool = False, keys: Keys = KEYS) -> DataFrame:
    """Players whose team differs between two seasons; by default only moves from team to team."""
    side = lambda s, t: rosters.where(F.col(keys.season) == s).select(
        keys.entity, F.col("name").alias(f"{t}_name"), F.col(keys.group).alias(f"{t}_pos"), F.col(keys.team).alias(f"{t}_team"))
    both = side(previous, "previous").join(side(current, "current"), keys.entity, "full_outer")
    kind = (F.when(F.col("previous_team").isNull(), "New Player").when(F.col("current_team").isNull(), "Left League")
            .when(F.col("previous_team") != F.col("current_team"), "Team Change"))
    out = both.select(keys.entity, F.coalesce("previous_name", "current_name").alias("name"),
                      F.coalesce("previous_pos", "current_pos").alias(keys.group), "previous_team", "current_team", kind.alias("change_type"))
    return out.where(F.col("change_type").isNotNull() if every_kind else F.col("change_type") == "Team Change")


def with_current_team(rows: DataFrame, rosters: DataFrame, season: int | None = None, keys: Keys = KEYS) -> DataFrame:
    """Roster team of the season replaces the stored one; the team of the season after it is attached.

    Without a season every row meets the roster of the season that follows its own. ``rosters``: one row per (player, season).
    """
    at = F.col(keys.season) + 1 if season is None else F.lit(season)
    now = rosters.select(keys.entity, F.col(keys.season).alias("_at"), F.col(keys.team).alias("_now"))
    after = rosters.select(keys.entity, (F.col(keys.season) - 1).alias("_at"), F.col(keys.team).alias("team_next_season"))
    both = now.join(after, [keys.entity, "_at"], "full")
    return (rows.withColumn("_at", at).join(both, [keys.entity, "_at"], "left")
            .withColumn(keys.team, F.coalesce("_now", keys.team)).drop("_at", "_now"))


# --- injuries -------------------------------------------------------------------------------------
def name_key(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), r"\s+", " "))


def with_injury_status(panel: DataFrame, injuries: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Availability by player id and week, else by normalised name and week, else full availability."""
    score = availability(F.col("status"))
    by_id = (injuries.where(F.col(keys.entity).isNotNull()).groupBy(*keys.grain).agg(F.min(score).alias("_id_score")))
    by_name = (injuries.where(F.col("player_name").isNotNull()).groupBy(*keys.period, name_key("player_name").alias("_name"))
               .agg(F.min(score).alias("_name_score")))
    out = (panel.withColumn("_name", name_key("name")).join(by_id, keys.grain, "left")
           .join(by_name, [*keys.period, "_name"], "left"))
    s = F.coalesce("_id_score", "_name_score", F.lit(1.0))
    return out.withColumns({"injury_score": s, "is_injured": (s < 1.0).cast("int")}).drop("_name", "_id_score", "_name_score")


# --- draft and combine -----------------------------------------------------------------------------
def with_draft(panel: DataFrame, drafted: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Draft slot by exact name (latest entry), else by last name, else undrafted (round 8, pick 260)."""
    low = lambda c: F.trim(F.lower(c))
    slot = ["draft_round", "draft_pick"]
    by_name = unique_on(drafted.select(low("player_name").alias("_full"), "draft_season", *slot), ["_full"],
                        [-F.col("draft_season"), F.col("draft_pick")]).select("_full", *[F.col(c).alias(f"_x_{c}") for c in slot])
    last = lambda c: F.element_at(F.split(low(c), r"\s+"), -1)
    by_last = unique_on(drafted.select(last("player_name").alias("_last"), "draft_season", *slot, low("player_name").alias("_n")), ["_last"],
                        [-F.col("draft_season"), F.col("_n"), F.col("draft_pick")]).select("_last", *[F.col(c).alias(f"_y_{c}") for c in slot])
    out = (panel.withColumns({"_full": low("name"), "_last": F.when(F.length(last("name")) > 2, last("name"))})
           .join(by_name, "_full", "left").join(by_last, "_last", "left"))
    found = F.coalesce("_x_draft_pick", "_y_draft_pick")
    return out.withColumns({
        "draft_round": F.coalesce("_x_draft_round", "_y_draft_round", F.lit(8)), "draft_pick": F.coalesce(found, F.lit(260)),
        "is_undrafted": found.isNull().cast("int")}).drop("_full", "_last", *[f"_{k}_{c}" for k in "xy" for c in slot])


def with_combine(panel: DataFrame, scored: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Combine score by the last word of the name; the position's mean, then 50, where there is none."""
    last = lambda c: F.element_at(F.split(F.trim(F.lower(c)), r"\s+"), -1)
    one = unique_on(scored.select(last("player_name").alias("_last"), "combine_score", "athleticism_grade", "player_name"), ["_last"],
                    [F.col("player_name")]).drop("player_name")
    out = panel.withColumn("_last", last("name")).join(one, "_last", "left").drop("_last")
    means = out.groupBy(keys.group).agg(F.avg("combine_score").alias("_mean"))
    return (out.join(means, keys.group, "left")
            .withColumns({"combine_score": F.coalesce("combine_score", "_mean", F.lit(50.0)),
                          "athleticism_grade": F.coalesce("athleticism_grade", F.lit("Unknown"))}).drop("_mean"))


# --- predictions against outcomes ------------------------------------------------------------------------
def predictions_with_actuals(predictions: DataFrame, actuals: DataFrame, actual: str = "fantasy_points", keys: Keys = KEYS) -> DataFrame:
    return predictions.join(actuals.select(*keys.grain, actual), keys.grain)


def with_expert(predictions: DataFrame, experts: DataFrame) -> DataFrame:
    """Expert projection by upper-cased, trimmed name; the highest of several entries."""
    key = lambda c: F.upper(F.trim(F.col(c)))
    e = experts.groupBy(key("player_name").alias("_key")).agg(F.max(F.col("pts").cast("double")).alias("expert_pts"))
    return predictions.withColumn("_key", key("name")).join(e.where(F.col("expert_pts").isNotNull()), "_key").drop("_key")

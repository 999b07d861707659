"""From play-level records to weekly player and team rows.

Every function is one or two keyed aggregations with map-side combine; nothing
orders raw plays inside a group, so one very busy team or player is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.exprs import bracket, drive_points, fantasy_points, zero
from weekgrain.functions.windows import prior

PERIOD = ["season", "week"]


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _total(value: str | Column, cond: Column | None = None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    v = v if cond is None else F.when(cond, v)
    return F.coalesce(F.sum(v), F.lit(0))


def with_play_flags(plays: DataFrame) -> DataFrame:
    """Situation flags (0/1) and zero-filled value columns."""
    margin, qtr = F.abs(zero("score_differential")), F.coalesce("qtr", F.lit(4))
    late_close = (margin <= C.NEUTRAL_SCORE_DIFF) & (qtr >= 4)
    clock = F.coalesce("half_seconds_remaining", "game_seconds_remaining")
    return plays.withColumns({
        "epa": zero("epa"), "wpa": zero("wpa"),
        "is_neutral": _flag((margin <= C.NEUTRAL_SCORE_DIFF) & (qtr <= 3)),
        "is_short_yardage": _flag(F.col("ydstogo") <= C.SHORT_YARDAGE),
        "is_redzone": _flag(F.col("yardline_100") <= C.RED_ZONE),
        "is_goal_line": _flag(F.col("yardline_100") <= C.GOAL_LINE),
        "is_third_down": _flag(F.col("down") == 3),
        "is_two_minute": _flag(qtr.isin(2, 4) & (clock <= C.TWO_MINUTE_SECONDS)),
        "is_high_leverage": _flag(F.when(F.col("wp").isNotNull(), F.col("wp").between(0.2, 0.8)).otherwise(late_close)),
    })


def _role_keys(role: str) -> list[Column]:
    return [F.col("season"), F.col("week"), F.col(f"{role}_player_id").alias("player_id"),
            F.col(f"{role}_player_name").alias("name"), F.col("posteam").alias("team")]


def passing_by_week(flagged: DataFrame) -> DataFrame:
    plays = flagged.where((F.col("play_type") == "pass") & F.col("passer_player_id").isNotNull())
    return plays.groupBy(*_role_keys("passer")).agg(
        _total("passing_yards").alias("passing_yards"), _total("pass_touchdown").alias("passing_tds"),
        _total("interception").alias("interceptions"), _total("complete_pass").alias("completions"),
        F.count("play_id").alias("passing_attempts"),
        _total("epa").alias("pass_epa"), _total("wpa").alias("pass_wpa"), F.avg("success").alias("pass_success_rate"),
    ).withColumn("pass_plays", F.col("passing_attempts")).withColumn("position", F.lit("QB"))


def rushing_by_week(flagged: DataFrame) -> DataFrame:
    plays = flagged.where((F.col("play_type") == "run") & F.col("rusher_player_id").isNotNull())
    return plays.groupBy(*_role_keys("rusher")).agg(
        _total("rushing_yards").alias("rushing_yards"), _total("rush_touchdown").alias("rushing_tds"),
        F.count("play_id").alias("rushing_attempts"),
        _total(_flag(F.col("yardline_100") <= 10)).alias("rush_inside_10"),
        _total(_flag(F.col("yardline_100") <= 5)).alias("rush_inside_5"),
        _total("epa").alias("rush_epa"), _total("wpa").alias("rush_wpa"), F.avg("success").alias("rush_success_rate"),
        _total("is_neutral").alias("neutral_rushes"), _total("is_short_yardage").alias("short_yardage_rushes"),
        _total("is_goal_line").alias("goal_line_rushes"), _total("is_high_leverage").alias("high_leverage_rushes"),
    ).withColumn("rush_plays", F.col("rushing_attempts"))


def receiving_by_week(flagged: DataFrame) -> DataFrame:
    plays = flagged.where((F.col("play_type") == "pass") & F.col("receiver_player_id").isNotNull())
    return plays.groupBy(*_role_keys("receiver")).agg(
        _total("receiving_yards").alias("receiving_yards"), _total("complete_pass").alias("receptions"),
        _total("pass_touchdown").alias("receiving_tds"), F.count("play_id").alias("targets"),
        _total("air_yards").alias("air_yards"),
        _total(_flag(zero("air_yards") >= 15)).alias("targets_15_plus"),
        _total("epa").alias("recv_epa"), _total("wpa").alias("recv_wpa"), F.avg("success").alias("recv_success_rate"),
        _total("is_neutral").alias("neutral_targets"), _total("is_third_down").alias("third_down_targets"),
        _total("is_redzone").alias("redzone_targets"), _total("is_goal_line").alias("goal_line_targets"),
        _total("is_two_minute").alias("two_minute_targets"), _total("is_high_leverage").alias("high_leverage_targets"),
    ).withColumn("recv_targets", F.col("targets"))


def player_weeks(flagged: DataFrame) -> DataFrame:
    """All three roles of a player-week in ONE keyed aggregate.

    Each play is exploded into its (at most two) roles, so passing, rushing and
    receiving meet in the same shuffle instead of two outer joins.
    """
    is_pass, is_run = F.col("play_type") == "pass", F.col("play_type") == "run"

    def role(kind: str, who: str, cond: Column) -> Column:
        return F.when(cond & F.col(f"{who}_player_id").isNotNull(), F.struct(
            F.lit(kind).alias("role"), F.col(f"{who}_player_id").alias("player_id"),
            F.col(f"{who}_player_name").alias("name")))

    roles = F.filter(F.array(role("pass", "passer", is_pass), role("rush", "rusher", is_run),
                             role("recv", "receiver", is_pass)), lambda r: r.isNotNull())
    long = flagged.withColumn("_r", F.explode(roles))
    p, r, t = (F.col("_r.role") == k for k in ("pass", "rush", "recv"))

    def rate(cond):
        return F.coalesce(F.avg(F.when(cond, F.col("success"))), F.lit(0.0))

    return long.groupBy("season", "week", F.col("_r.player_id").alias("player_id"), F.col("_r.name").alias("name"),
                        F.col("posteam").alias("team")).agg(
        _total("passing_yards", p).alias("passing_yards"), _total("pass_touchdown", p).alias("passing_tds"),
        _total("interception", p).alias("interceptions"), _total("complete_pass", p).alias("completions"),
        _total(F.lit(1), p).alias("passing_attempts"),
        _total("rushing_yards", r).alias("rushing_yards"), _total("rush_touchdown", r).alias("rushing_tds"),
        _total(F.lit(1), r).alias("rushing_attempts"),
        _total("receiving_yards", t).alias("receiving_yards"), _total("pass_touchdown", t).alias("receiving_tds"),
        _total("complete_pass", t).alias("receptions"), _total(F.lit(1), t).alias("targets"),
        *[_total(v, c).alias(f"{n}_{v}") for v in ("epa", "wpa") for n, c in (("pass", p), ("rush", r), ("recv", t))],
        *[rate(c).alias(f"{n}_success_rate") for n, c in (("pass", p), ("rush", r), ("recv", t))],
        (_total("is_goal_line", r) + _total("is_goal_line", t)).alias("goal_line_touches"),
        (_total("is_high_leverage", r) + _total("is_high_leverage", t)).alias("high_leverage_touches"),
        _total("is_neutral", t).alias("neutral_targets"), _total("is_neutral", r).alias("neutral_rushes"),
        _total("is_third_down", t).alias("third_down_targets"),
        _total("is_short_yardage", r).alias("short_yardage_rushes"),
        _total("is_redzone", t).alias("redzone_targets"), _total("is_two_minute", t).alias("two_minute_targets"),
    )


def with_snaps(weeks: DataFrame, snaps: DataFrame) -> DataFrame:
    """Adds snap_count, team_snaps, snap_share and the snap feed's position (which wins over inference).

    ``snaps`` has (season, week, name, team, position, offense_snaps).
    """
    key = ["season", "week", "name", "team"]
    per_player = snaps.groupBy(*key).agg(F.max("position").alias("snap_position"),
                                         F.sum(zero("offense_snaps")).cast("int").alias("snap_count"))
    per_team = snaps.groupBy("season", "week", "team").agg(F.sum(zero("offense_snaps")).cast("int").alias("team_snaps"))
    both = per_player.join(per_team, ["season", "week", "team"])
    share = F.when(zero("team_snaps") > 0, zero("snap_count") / F.col("team_snaps")).otherwise(F.lit(0.0))
    return (weeks.join(both, key, "left")
            .withColumns({"snap_share": share, "snap_count": zero("snap_count"), "team_snaps": zero("team_snaps")}))


def with_position(weeks: DataFrame) -> DataFrame:
    """Position from the snap feed, else inferred from usage."""
    known = F.col("snap_position") if "snap_position" in weeks.columns else F.lit(None).cast("string")
    guess = (F.when(zero("passing_attempts") > 0, "QB")
             .when(zero("rushing_attempts") > zero("targets"), "RB").otherwise("WR"))
    return weeks.withColumn("position", F.coalesce(known, guess))


def fantasy_positions(weeks: DataFrame) -> DataFrame:
    """Keeps skill positions; full and half backs count as running backs."""
    p = F.col("position")
    return (weeks.where(p.isin("QB", "RB", "WR", "TE", "FB", "HB"))
            .withColumn("position", F.when(p.isin("FB", "HB"), "RB").otherwise(p)))


def weekly_from_plays(plays: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """Plays to scored, positioned weekly player rows."""
    weeks = player_weeks(with_play_flags(plays))
    weeks = with_position(with_snaps(weeks, snaps) if snaps is not None else weeks)
    return fantasy_positions(weeks.withColumn("fantasy_points", F.round(fantasy_points(weeks.columns), 1)))


# --- team weeks --------------------------------------------------------------------
def team_weeks(flagged: DataFrame) -> DataFrame:
    plays = flagged.where(F.col("posteam").isNotNull())
    is_pass, is_run = F.col("play_type") == "pass", F.col("play_type") == "run"
    real = (zero("qb_spike") != 1) & (zero("qb_kneel") != 1) & (F.col("is_neutral") == 1)
    agg = plays.groupBy("season", "week", F.col("posteam").alias("team")).agg(
        _total(_flag(real & is_pass)).alias("neutral_pass_plays"), _total(_flag(real & is_run)).alias("neutral_run_plays"),
        _total(_flag(is_pass)).alias("pass_attempts"), _total(_flag(is_run)).alias("rush_attempts"),
        _total("passing_yards").alias("passing_yards"), _total("rushing_yards").alias("rushing_yards"),
        (_total("interception") + _total("fumble_lost")).alias("turnovers"),
    )
    n = F.col("neutral_pass_plays") + F.col("neutral_run_plays")
    return agg.withColumns({
        "total_plays": F.col("pass_attempts") + F.col("rush_attempts"),
        "total_yards": F.col("passing_yards") + F.col("rushing_yards"),
        "neutral_pass_rate": F.when(n > 0, F.col("neutral_pass_plays") / n),
    })


def usual_opponent(plays: DataFrame) -> DataFrame:
    """Most frequent defending team per team-week; the smallest wins a tie."""
    counts = (plays.where(F.col("posteam").isNotNull() & F.col("defteam").isNotNull())
              .groupBy("season", "week", F.col("posteam").alias("team"), "defteam").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("season", "week", "team").agg(
        F.min_by("defteam", F.struct(-F.col("n"), F.col("defteam"))).alias("opponent"))


def league_neutral_pass_rate(team_week: DataFrame) -> DataFrame:
    """Season-to-date mean of the league's weekly rate, earlier weeks only: one row per (season, week)."""
    league = team_week.groupBy("season", "week").agg(
        F.sum("neutral_pass_plays").alias("p"), F.sum("neutral_run_plays").alias("r"))
    league = league.withColumn("rate", F.when(F.col("p") + F.col("r") > 0, F.col("p") / (F.col("p") + F.col("r"))))
    w = prior(Window.partitionBy("season").orderBy("week"))
    return league.select("season", "week", F.avg("rate").over(w).alias("neutral_pass_rate_lg"))


def with_pass_rate_over_expected(team_week: DataFrame) -> DataFrame:
    out = team_week.join(league_neutral_pass_rate(team_week), PERIOD, "left")
    lg = F.coalesce("neutral_pass_rate_lg", F.lit(C.LEAGUE_NEUTRAL_PASS_RATE))
    rate = F.coalesce(F.col("neutral_pass_rate"), lg)
    return out.withColumns({"neutral_pass_rate_lg": lg, "neutral_pass_rate": rate, "neutral_pass_rate_oe": rate - lg})


def drive_metrics(flagged: DataFrame) -> DataFrame:
    drives = (flagged.where(F.col("drive").isNotNull() & F.col("posteam").isNotNull())
              .groupBy("season", "week", F.col("posteam").alias("team"), "drive")
              .agg(F.sum("epa").alias("drive_epa"), F.max(drive_points(F.col("drive_result"))).alias("points")))
    good = ((F.col("drive_epa") > 0) | (F.col("points") > 0)).cast("int")
    return drives.groupBy("season", "week", "team").agg(
        F.count(F.lit(1)).alias("drive_count"), F.avg("drive_epa").alias("avg_drive_epa"),
        F.avg(good).alias("drive_success_rate"), F.avg("points").alias("points_per_drive"))


def pace(plays: DataFrame) -> DataFrame:
    """Mean seconds between a team's plays, each gap held to 0..90.

    Plays at one clock reading are merged first: their mutual gaps are 0, and a game
    clock has at most 3,600 readings, so the ordered window stays small however many
    plays share a game key.
    """
    ticks = plays.where(F.col("posteam").isNotNull()).groupBy(
        "season", "week", "game_id", F.col("posteam").alias("team"), F.col("game_seconds_remaining").alias("clock"),
    ).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("season", "week", "game_id", "team").orderBy(F.col("clock").desc())
    gap = F.lag("clock").over(w) - F.col("clock")
    ticks = ticks.withColumn("gap", F.greatest(F.lit(0), F.least(F.lit(90), gap))).withColumn("gap", F.when(gap.isNotNull(), F.col("gap")))
    gaps = F.sum(F.col("n") - 1) + F.count("gap")
    return ticks.groupBy("season", "week", "team").agg(
        F.when(gaps > 0, F.coalesce(F.sum("gap"), F.lit(0)) / gaps).alias("pace_sec_per_play"))


def team_report(plays: DataFrame) -> DataFrame:
    """All team-week blocks joined on (season, week, team)."""
    flagged = with_play_flags(plays)
    key = ["season", "week", "team"]
    return (with_pass_rate_over_expected(team_weeks(flagged)).join(usual_opponent(plays), key, "left")
            .join(drive_metrics(flagged), key, "left").join(pace(plays), key, "left"))


# --- from weekly rows ------------------------------------------------------------------
def team_totals(panel: DataFrame) -> DataFrame:
    """Team-week totals out of player rows."""
    return panel.groupBy("team", "season", "week").agg(
        F.min("opponent").alias("opponent"), F.min("home_away").alias("home_away"),
        F.sum("fantasy_points").alias("points_scored"),
        (F.sum("passing_yards") + F.sum("rushing_yards")).alias("total_yards"),
        F.sum("passing_yards").alias("passing_yards"), F.sum("rushing_yards").alias("rushing_yards"),
        F.sum("passing_attempts").alias("pass_attempts"), F.sum("rushing_attempts").alias("rush_attempts"),
        (F.sum("passing_attempts") + F.sum("rushing_attempts")).alias("total_plays"),
        F.sum("interceptions").alias("turnovers"),
        (F.sum("rushing_tds") + F.sum("receiving_tds")).alias("redzone_scores"))


def points_allowed_by_position(panel: DataFrame) -> DataFrame:
    """What each defence gave up to each position, one row per defence-week."""
    def gave(pos):
        return F.sum(F.when(F.col("position") == pos, F.col("fantasy_points")).otherwise(0.0)).alias(
            f"fantasy_points_allowed_{pos.lower()}")
    return (panel.where(F.col("opponent").isNotNull())
            .groupBy(F.col("opponent").alias("team"), "season", "week").agg(*[gave(p) for p in C.POSITIONS]))


# --- kickers and defences -----------------------------------------------------------------
def kicker_weeks(plays: DataFrame) -> DataFrame:
    """Field goals and extra points of a kicker-week in one aggregate, scored by distance."""
    fg, xp = F.col("play_type") == "field_goal", F.col("play_type") == "extra_point"
    made, good = fg & (F.col("field_goal_result") == "made"), xp & (F.col("extra_point_result") == "good")
    d = F.coalesce("kick_distance", F.lit(0.0))
    agg = plays.where((fg | xp) & F.col("kicker_player_id").isNotNull()).groupBy(*_role_keys("kicker")).agg(
        _total(_flag(made)).alias("fg_made"), _total(_flag(fg & ~made)).alias("fg_missed"),
        _total(_flag(made & (d <= 39))).alias("fg_0_39"), _total(_flag(made & (d >= 40) & (d <= 49))).alias("fg_40_49"),
        _total(_flag(made & (d >= 50))).alias("fg_50_plus"),
        _total(_flag(good)).alias("xp_made"), _total(_flag(xp & ~good)).alias("xp_missed"))
    score = sum((F.col(k) * v for k, v in C.KICKER_SCORING.items()), F.lit(0))
    return agg.withColumns({
        "fg_att": F.col("fg_made") + F.col("fg_missed"), "xp_att": F.col("xp_made") + F.col("xp_missed"),
        "fantasy_points": score.cast("double"), "position": F.lit("K")})


def defense_weeks(plays: DataFrame) -> DataFrame:
    """Team-defence weeks; return touchdowns are credited to the possessing team of the play."""
    side = plays.where(F.col("defteam").isNotNull())
    dst = side.groupBy(F.col("defteam").alias("team"), "season", "week").agg(
        _total("sack").alias("sacks"), _total("interception").alias("interceptions"),
        _total("fumble_lost").alias("fumble_recoveries"), _total("safety").alias("safeties"),
        _total(_flag((F.col("touchdown") == 1) & (F.col("td_team") == F.col("defteam")))).alias("defensive_tds"),
        _total(_flag(F.col("field_goal_result") == "blocked")).alias("blocked_kicks"),
        zero(F.max("posteam_score_post")).alias("points_allowed"))
    returns = (side.where(F.col("return_touchdown") == 1).groupBy(F.col("posteam").alias("team"), "season", "week")
               .agg(F.count(F.lit(1)).alias("special_teams_tds")))
    dst = dst.join(returns, ["team", "season", "week"], "left").withColumn("special_teams_tds", zero("special_teams_tds"))
    score = sum((F.col(k) * v for k, v in C.DEFENSE_SCORING.items()), F.lit(0))
    allowed = bracket(F.col("points_allowed"), C.POINTS_ALLOWED_BRACKETS, C.POINTS_ALLOWED_ABOVE)
    return dst.withColumns({
        "fantasy_points": (score + allowed).cast("double"), "position": F.lit("DST"),
        "player_id": F.concat(F.col("team").cast("string"), F.lit("_DST"))})

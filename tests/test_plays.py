"""Golden two-play feed and the merged player week."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrain.operators import plays as P

FIELDS = {"season": 2023, "week": 1, "game_id": 1, "play_id": 1, "qtr": 2, "down": 3, "play_type": "pass", "posteam": "A", "defteam": "B", "passer_player_id": "q",
          "passer_player_name": "Q", "rusher_player_id": None, "rusher_player_name": None, "receiver_player_id": "w", "receiver_player_name": "W", "kicker_player_id": None,
          "kicker_player_name": None, "passing_yards": 12.0, "receiving_yards": 12.0, "rushing_yards": None, "air_yards": 16.0, "complete_pass": 1, "pass_touchdown": 0,
          "rush_touchdown": 0, "interception": 0, "fumble_lost": 0, "sack": 0, "touchdown": 0, "return_touchdown": 0, "safety": 0, "td_team": None, "qb_spike": 0, "qb_kneel": 0,
          "epa": 2.0, "wpa": 0.05, "success": 1, "wp": 0.5, "score_differential": 3.0, "ydstogo": 8.0, "yardline_100": 45.0, "game_seconds_remaining": 1900,
          "half_seconds_remaining": 100, "drive": 1, "drive_result": "Touchdown", "field_goal_result": None, "extra_point_result": None, "kick_distance": None,
          "posteam_score_post": 7}
STRINGS = {"play_type", "posteam", "defteam", "td_team", "drive_result", "field_goal_result", "extra_point_result", "passer_player_id", "passer_player_name", "rusher_player_id",
           "rusher_player_name", "receiver_player_id", "receiver_player_name", "kicker_player_id", "kicker_player_name"}
DOUBLES = {"passing_yards", "receiving_yards", "rushing_yards", "air_yards", "epa", "wpa", "wp", "score_differential", "ydstogo", "yardline_100", "kick_distance"}
SCHEMA = T.StructType([T.StructField(k, T.StringType() if k in STRINGS else T.DoubleType() if k in DOUBLES else T.LongType()) for k in FIELDS])


def feed(spark, *plays):
    return spark.createDataFrame([tuple({**FIELDS, **p}.values()) for p in plays], SCHEMA)


RUN = {"play_id": 2, "play_type": "run", "passer_player_id": None, "receiver_player_id": None, "rusher_player_id": "q", "rusher_player_name": "Q", "passing_yards": None,
       "receiving_yards": None, "rushing_yards": 4.0, "air_yards": None, "complete_pass": 0, "epa": None, "success": None, "ydstogo": 2.0, "yardline_100": 4.0,
       "wp": None, "score_differential": -3.0, "qtr": 4, "down": 1, "game_seconds_remaining": 1870}


def test_pass_play_flags(spark):
    fl = P.with_play_flags(feed(spark, {}))
    p, r = P.passing_by_week(fl).first(), P.receiving_by_week(fl).first()
    assert (p.pass_epa, p.pass_plays, p.pass_wpa) == (2.0, 1, 0.05)
    assert (r.neutral_targets, r.third_down_targets, r.two_minute_targets, r.high_leverage_targets, r.targets_15_plus) == (1, 1, 1, 1, 1)


def test_missing_win_probability_falls_back_to_late_and_close(spark):
    r = P.rushing_by_week(P.with_play_flags(feed(spark, RUN))).first()
    assert (r.high_leverage_rushes, r.short_yardage_rushes, r.goal_line_rushes, r.neutral_rushes, r.rush_epa) == (1, 1, 1, 0, 0.0)
    assert r.rush_success_rate is None


def test_rushing_passer_is_one_row(spark):
    w = P.weekly_from_plays(feed(spark, {}, RUN)).where("player_id = 'q'").collect()
    assert len(w) == 1 and w[0].position == "QB"
    assert abs(w[0].fantasy_points - round(12 * 0.04 + 4 * 0.1, 1)) < 1e-9


def test_roles_equal_the_single_aggregates(spark):
    fl = P.with_play_flags(feed(spark, {}, RUN, {"play_id": 3, "receiver_player_id": "x", "receiver_player_name": "X", "complete_pass": 0}))
    m = {r.player_id: r for r in P.player_weeks(fl).collect()}
    assert m["q"].passing_attempts == P.passing_by_week(fl).first().passing_attempts == 2
    assert (m["x"].targets, m["x"].receptions, m["q"].rushing_attempts) == (1, 0, 1)


def test_snap_position_wins(spark):
    wk = P.player_weeks(P.with_play_flags(feed(spark, {}, RUN)))
    snaps = spark.createDataFrame([(2023, 1, "Q", "A", "FB", 30), (2023, 1, "Z", "A", "C", 70)], "season long, week long, name string, team string, position string, offense_snaps int")
    r = P.fantasy_positions(P.with_position(P.with_snaps(wk, snaps))).where("player_id='q'").first()
    assert (r.position, r.snap_share) == ("RB", 0.3)


def test_pace_merges_equal_clocks(spark):
    f = feed(spark, {"game_seconds_remaining": 1900}, {"game_seconds_remaining": 1900}, {"game_seconds_remaining": 1870}, {"game_seconds_remaining": 1500})
    assert abs(P.pace(f).first().pace_sec_per_play - (0 + 30 + 90) / 3) < 1e-9


def test_defense_scoring(spark):
    d = P.defense_weeks(feed(spark, {"sack": 1}, {"interception": 1, "touchdown": 1, "td_team": "B"}, {"posteam_score_post": 14})).first()
    assert (d.points_allowed, d.fantasy_points) == (14, 1 + 2 + 6 + 1)


def test_kicker_distances(spark):
    k = {"passer_player_id": None, "receiver_player_id": None, "play_type": "field_goal", "kicker_player_id": "k", "kicker_player_name": "K", "field_goal_result": "made"}
    f = feed(spark, {**k, "kick_distance": 39.0}, {**k, "kick_distance": 52.0}, {**k, "kick_distance": 45.0, "field_goal_result": "missed"},
             {**k, "play_type": "extra_point", "extra_point_result": "good", "field_goal_result": None})
    r = P.kicker_weeks(f).first()
    assert (r.fg_att, r.xp_att, r.fantasy_points) == (3, 1, 3 + 5 - 1 + 1)

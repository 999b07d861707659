"""Queries over play records: A01-A14, J03-J05, X15."""

from pyspark.sql import functions as F

from weekgrain.operators import plays as P
from weekgrain.plans.registry import query

NAME = "'P' || "


@query("A01_play_flags", needs="flagged", sql="""
SELECT season, "week", CAST(sum(is_neutral) AS BIGINT) AS neutral, CAST(sum(is_short_yardage) AS BIGINT) AS short_yardage,
 CAST(sum(is_redzone) AS BIGINT) AS redzone, CAST(sum(is_goal_line) AS BIGINT) AS goal_line,
 CAST(sum(is_third_down) AS BIGINT) AS third_down, CAST(sum(is_two_minute) AS BIGINT) AS two_minute,
 CAST(sum(is_high_leverage) AS BIGINT) AS high_leverage FROM flagged GROUP BY ALL""")
def _(t):
    names = ["neutral", "short_yardage", "redzone", "goal_line", "third_down", "two_minute", "high_leverage"]
    return P.with_play_flags(t.plays).groupBy("season", "week").agg(*[F.sum(f"is_{n}").alias(n) for n in names])


PASSING = """SELECT season, "week", passer_player_id AS player_id, 'P'||passer_player_id AS name, posteam AS team,
 coalesce(sum(passing_yards),0) AS passing_yards, CAST(sum(pass_touchdown) AS BIGINT) AS passing_tds,
 CAST(sum(interception) AS BIGINT) AS interceptions, CAST(sum(complete_pass) AS BIGINT) AS completions,
 count(*) AS passing_attempts, sum(epa0) AS pass_epa, sum(wpa) AS pass_wpa, avg(success) AS pass_success_rate,
 count(*) AS pass_plays, 'QB' AS "position"
 FROM flagged WHERE play_type='pass' AND passer_player_id IS NOT NULL GROUP BY ALL"""


@query("A02_passing_stats", PASSING, "passing_yards pass_epa pass_wpa pass_success_rate", "flagged")
def _(t):
    return P.passing_by_week(P.with_play_flags(t.plays))


RUSHING = """SELECT season, "week", rusher_player_id AS player_id, 'P'||rusher_player_id AS name, posteam AS team,
 coalesce(sum(rushing_yards),0) AS rushing_yards, CAST(sum(rush_touchdown) AS BIGINT) AS rushing_tds,
 count(*) AS rushing_attempts, count(*) FILTER (yardline_100<=10) AS rush_inside_10,
 count(*) FILTER (yardline_100<=5) AS rush_inside_5, sum(epa0) AS rush_epa, sum(wpa) AS rush_wpa,
 avg(success) AS rush_success_rate, CAST(sum(is_neutral) AS BIGINT) AS neutral_rushes,
 CAST(sum(is_short_yardage) AS BIGINT) AS short_yardage_rushes, CAST(sum(is_goal_line) AS BIGINT) AS goal_line_rushes,
 CAST(sum(is_high_leverage) AS BIGINT) AS high_leverage_rushes, count(*) AS rush_plays
 FROM flagged WHERE play_type='run' AND rusher_player_id IS NOT NULL GROUP BY ALL"""


@query("A03_rushing_stats", RUSHING, "rushing_yards rush_epa rush_wpa rush_success_rate", "flagged")
def _(t):
    return P.rushing_by_week(P.with_play_flags(t.plays))


RECEIVING = """SELECT season, "week", receiver_player_id AS player_id, 'P'||receiver_player_id AS name, posteam AS team,
 coalesce(sum(receiving_yards),0) AS receiving_yards, CAST(sum(complete_pass) AS BIGINT) AS receptions,
 CAST(sum(pass_touchdown) AS BIGINT) AS receiving_tds, count(*) AS targets, coalesce(sum(air_yards),0) AS air_yards,
 count(*) FILTER (coalesce(air_yards,0)>=15) AS targets_15_plus, sum(epa0) AS recv_epa, sum(wpa) AS recv_wpa,
 avg(success) AS recv_success_rate, CAST(sum(is_neutral) AS BIGINT) AS neutral_targets,
 CAST(sum(is_third_down) AS BIGINT) AS third_down_targets, CAST(sum(is_redzone) AS BIGINT) AS redzone_targets,
 CAST(sum(is_goal_line) AS BIGINT) AS goal_line_targets, CAST(sum(is_two_minute) AS BIGINT) AS two_minute_targets,
 CAST(sum(is_high_leverage) AS BIGINT) AS high_leverage_targets, count(*) AS recv_targets
 FROM flagged WHERE play_type='pass' AND receiver_player_id IS NOT NULL GROUP BY ALL"""


@query("A04_receiving_stats", RECEIVING, "receiving_yards air_yards recv_epa recv_wpa recv_success_rate", "flagged")
def _(t):
    return P.receiving_by_week(P.with_play_flags(t.plays))


SKILL = f"""WITH pa AS ({PASSING}), ru AS ({RUSHING}), re AS ({RECEIVING}),
k AS (SELECT season,"week",player_id,name,team FROM pa UNION SELECT season,"week",player_id,name,team FROM ru
 UNION SELECT season,"week",player_id,name,team FROM re),
merged AS (SELECT k.*, coalesce(pa.passing_yards,0) AS passing_yards, coalesce(passing_tds,0) AS passing_tds,
 coalesce(interceptions,0) AS interceptions, coalesce(completions,0) AS completions,
 coalesce(passing_attempts,0) AS passing_attempts, coalesce(rushing_yards,0) AS rushing_yards,
 coalesce(rushing_tds,0) AS rushing_tds, coalesce(rushing_attempts,0) AS rushing_attempts,
 coalesce(receiving_yards,0) AS receiving_yards, coalesce(receiving_tds,0) AS receiving_tds,
 coalesce(receptions,0) AS receptions, coalesce(targets,0) AS targets,
 coalesce(pass_epa,0) AS pass_epa, coalesce(rush_epa,0) AS rush_epa, coalesce(recv_epa,0) AS recv_epa,
 coalesce(pass_wpa,0) AS pass_wpa, coalesce(rush_wpa,0) AS rush_wpa, coalesce(recv_wpa,0) AS recv_wpa,
 coalesce(pass_success_rate,0) AS pass_success_rate, coalesce(rush_success_rate,0) AS rush_success_rate,
 coalesce(recv_success_rate,0) AS recv_success_rate,
 coalesce(goal_line_rushes,0)+coalesce(goal_line_targets,0) AS goal_line_touches,
 coalesce(high_leverage_rushes,0)+coalesce(high_leverage_targets,0) AS high_leverage_touches,
 coalesce(neutral_targets,0) AS neutral_targets, coalesce(neutral_rushes,0) AS neutral_rushes,
 coalesce(third_down_targets,0) AS third_down_targets, coalesce(short_yardage_rushes,0) AS short_yardage_rushes,
 coalesce(redzone_targets,0) AS redzone_targets, coalesce(two_minute_targets,0) AS two_minute_targets
 FROM k LEFT JOIN pa USING (season,"week",player_id,name,team) LEFT JOIN ru USING (season,"week",player_id,name,team)
 LEFT JOIN re USING (season,"week",player_id,name,team))"""
SKILL_FLOATS = ("passing_yards rushing_yards receiving_yards pass_epa rush_epa recv_epa pass_wpa rush_wpa recv_wpa "
                "pass_success_rate rush_success_rate recv_success_rate")


@query("J03_player_week_merge", SKILL + " SELECT * FROM merged", SKILL_FLOATS, "flagged")
def _(t):
    return P.player_weeks(P.with_play_flags(t.plays))


def _snaps(t):
    """Snap feed: one record per passer or rusher play, some teams missing."""
    pl = t.plays
    who = F.coalesce("passer_player_name", "rusher_player_name")
    return pl.where(who.isNotNull() & (F.col("posteam") % 9 != 0)).select(
        "season", "week", who.alias("name"), F.col("posteam").alias("team"),
        F.element_at(F.array(*[F.lit(x) for x in ("QB", "FB", "WR", "TE", "C")]), (F.col("posteam") % 5 + 1).cast("int")).alias("position"),
        F.col("down").alias("offense_snaps"))


SNAPS = """sn AS (SELECT season, "week", 'P'||coalesce(passer_player_id, rusher_player_id) AS name, posteam AS team,
 (['QB','FB','WR','TE','C'])[posteam%5+1] AS "position", down AS offense_snaps FROM plays
 WHERE coalesce(passer_player_id, rusher_player_id) IS NOT NULL AND posteam % 9 <> 0),
sp AS (SELECT season,"week",name,team,max("position") AS snap_position, CAST(sum(offense_snaps) AS INT) AS snap_count FROM sn GROUP BY ALL),
st AS (SELECT season,"week",team,CAST(sum(offense_snaps) AS INT) AS team_snaps FROM sn GROUP BY ALL),
wk AS (SELECT merged.*, snap_position, coalesce(snap_count,0) AS snap_count, coalesce(team_snaps,0) AS team_snaps
 FROM merged LEFT JOIN (sp JOIN st USING (season,"week",team)) USING (season,"week",name,team))"""


@query("J05_snap_share", SKILL + f""", {SNAPS} SELECT season,"week",player_id,name,team,snap_position,snap_count,team_snaps,
 CASE WHEN team_snaps>0 THEN snap_count/team_snaps ELSE 0.0 END AS snap_share FROM wk""", "snap_share", "flagged")
def _(t):
    return P.with_snaps(P.player_weeks(P.with_play_flags(t.plays)), _snaps(t)).select(
        "season", "week", "player_id", "name", "team", "snap_position", "snap_count", "team_snaps", "snap_share")


@query("A05_position_inference", SKILL + f""", {SNAPS}, po AS (SELECT *, coalesce(snap_position, CASE WHEN passing_attempts>0 THEN 'QB'
 WHEN rushing_attempts>targets THEN 'RB' ELSE 'WR' END) AS "position" FROM wk)
 SELECT "position", season, count(*) AS n, CAST(sum(targets) AS BIGINT) AS targets FROM po GROUP BY ALL""", "", "flagged")
def _(t):
    w = P.with_position(P.with_snaps(P.player_weeks(P.with_play_flags(t.plays)), _snaps(t)))
    return w.groupBy("position", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("targets").alias("targets"))


@query("F06_fantasy_positions", SKILL + f""", {SNAPS}, po AS (SELECT *, coalesce(snap_position, CASE WHEN passing_attempts>0 THEN 'QB'
 WHEN rushing_attempts>targets THEN 'RB' ELSE 'WR' END) AS p0,
 passing_yards*0.04+passing_tds*4-interceptions*2+rushing_yards*0.1+rushing_tds*6+receiving_yards*0.1+receiving_tds*6+receptions AS fp FROM wk)
 SELECT season,"week",player_id,name,team,CASE WHEN p0 IN ('FB','HB') THEN 'RB' ELSE p0 END AS "position",
 CAST(round(CAST(fp AS DOUBLE),1) AS DOUBLE) AS fantasy_points FROM po WHERE p0 IN ('QB','RB','WR','TE','FB','HB')""", "fantasy_points", "flagged")
def _(t):
    return P.weekly_from_plays(t.plays, _snaps(t)).select(
        "season", "week", "player_id", "name", "team", "position", "fantasy_points")


TEAM = """tw AS (SELECT season,"week",posteam AS team,
 CAST(sum(CAST(is_neutral=1 AND play_type='pass' AND qb_spike<>1 AND qb_kneel<>1 AS INT)) AS BIGINT) AS neutral_pass_plays,
 CAST(sum(CAST(is_neutral=1 AND play_type='run' AND qb_spike<>1 AND qb_kneel<>1 AS INT)) AS BIGINT) AS neutral_run_plays,
 count(*) FILTER (play_type='pass') AS pass_attempts, count(*) FILTER (play_type='run') AS rush_attempts,
 coalesce(sum(passing_yards),0) AS passing_yards, coalesce(sum(rushing_yards),0) AS rushing_yards,
 CAST(sum(interception)+sum(fumble_lost) AS BIGINT) AS turnovers FROM flagged GROUP BY ALL),
tr AS (SELECT *, pass_attempts+rush_attempts AS total_plays, passing_yards+rushing_yards AS total_yards,
 CASE WHEN neutral_pass_plays+neutral_run_plays>0 THEN neutral_pass_plays/(neutral_pass_plays+neutral_run_plays) END AS neutral_pass_rate FROM tw)"""


@query("A06_team_week_stats", f"WITH {TEAM} SELECT * FROM tr", "passing_yards rushing_yards total_yards neutral_pass_rate", "flagged")
def _(t):
    return P.team_weeks(P.with_play_flags(t.plays))


@query("A07_usual_opponent", """WITH c AS (SELECT season,"week",posteam AS team,defteam,count(*) AS n FROM plays GROUP BY ALL)
 SELECT season,"week",team,defteam AS opponent FROM (SELECT *, row_number() OVER (PARTITION BY season,"week",team ORDER BY n DESC, defteam) AS rn FROM c) WHERE rn=1""", "", "plays")
def _(t):
    return P.usual_opponent(t.plays)


@query("A08_pass_rate_over_expected", f"""WITH {TEAM}, lg AS (SELECT season,"week",sum(neutral_pass_plays) AS p,sum(neutral_run_plays) AS r FROM tw GROUP BY ALL),
 lr AS (SELECT season,"week",avg(CASE WHEN p+r>0 THEN p/(p+r) END) OVER (PARTITION BY season ORDER BY "week" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lgr FROM lg)
 SELECT season,"week",team,coalesce(lgr,0.56) AS neutral_pass_rate_lg, coalesce(neutral_pass_rate,lgr,0.56) AS neutral_pass_rate,
 coalesce(neutral_pass_rate,lgr,0.56)-coalesce(lgr,0.56) AS neutral_pass_rate_oe FROM tr LEFT JOIN lr USING (season,"week")""",
       "neutral_pass_rate_lg neutral_pass_rate neutral_pass_rate_oe", "flagged")
def _(t):
    return P.with_pass_rate_over_expected(P.team_weeks(P.with_play_flags(t.plays))).select(
        "season", "week", "team", "neutral_pass_rate_lg", "neutral_pass_rate", "neutral_pass_rate_oe")


@query("A09_drive_metrics", """WITH d AS (SELECT season,"week",posteam AS team,drive,sum(epa0) AS e,
 max(CASE WHEN lower(drive_result) LIKE '%touchdown%' THEN 7 WHEN lower(drive_result) LIKE '%field goal%' THEN 3 WHEN lower(drive_result) LIKE '%safety%' THEN 2 ELSE 0 END) AS p
 FROM flagged GROUP BY ALL)
 SELECT season,"week",team,count(*) AS drive_count,avg(e) AS avg_drive_epa,avg(CAST(round(e,9)>0 OR p>0 AS INT)) AS drive_success_rate,avg(p) AS points_per_drive FROM d GROUP BY ALL""",
       "avg_drive_epa drive_success_rate points_per_drive", "flagged")
def _(t):
    # the proxy's EPA values cancel to zero up to rounding, hence the fixed decimals before the sign test
    fl = P.with_play_flags(t.plays).withColumn("epa", F.round("epa", 6))
    return P.drive_metrics(fl)


@query("A10_pace", """WITH g AS (SELECT season,"week",posteam AS team,
 lag(game_seconds_remaining) OVER (PARTITION BY season,"week",game_id,posteam ORDER BY game_seconds_remaining DESC) - game_seconds_remaining AS gap FROM plays)
 SELECT season,"week",team,avg(CASE WHEN gap IS NULL THEN NULL WHEN gap<0 THEN 0 WHEN gap>90 THEN 90 ELSE gap END) AS pace_sec_per_play FROM g GROUP BY ALL""",
       "pace_sec_per_play", "plays")
def _(t):
    return P.pace(t.plays)


@query("A11_team_stats_from_players", """SELECT team,season,"week",min(opponent) AS opponent,min(home_away) AS home_away,sum(fantasy_points) AS points_scored,
 sum(passing_yards)+sum(rushing_yards) AS total_yards,sum(passing_yards) AS passing_yards,sum(rushing_yards) AS rushing_yards,
 CAST(sum(passing_attempts) AS BIGINT) AS pass_attempts,CAST(sum(rushing_attempts) AS BIGINT) AS rush_attempts,
 CAST(sum(passing_attempts)+sum(rushing_attempts) AS BIGINT) AS total_plays,CAST(sum(interceptions) AS BIGINT) AS turnovers,
 CAST(sum(rushing_tds)+sum(receiving_tds) AS BIGINT) AS redzone_scores FROM panel GROUP BY ALL""",
       "points_scored total_yards passing_yards rushing_yards")
def _(t):
    return P.team_totals(t.panel)


@query("A12_points_allowed_by_position", """SELECT opponent AS team,season,"week",
 coalesce(sum(fantasy_points) FILTER ("position"='QB'),0.0) AS fantasy_points_allowed_qb, coalesce(sum(fantasy_points) FILTER ("position"='RB'),0.0) AS fantasy_points_allowed_rb,
 coalesce(sum(fantasy_points) FILTER ("position"='WR'),0.0) AS fantasy_points_allowed_wr, coalesce(sum(fantasy_points) FILTER ("position"='TE'),0.0) AS fantasy_points_allowed_te
 FROM panel GROUP BY ALL""", "fantasy_points_allowed_qb fantasy_points_allowed_rb fantasy_points_allowed_wr fantasy_points_allowed_te")
def _(t):
    return P.points_allowed_by_position(t.panel)


KICK = """kk AS (SELECT season,"week",kicker_player_id AS player_id,'P'||kicker_player_id AS name,posteam AS team,
 count(*) FILTER (field_goal_result='made') AS fg_made, count(*) FILTER (play_type='field_goal' AND field_goal_result<>'made') AS fg_missed,
 count(*) FILTER (field_goal_result='made' AND kick_distance<=39) AS fg_0_39,
 count(*) FILTER (field_goal_result='made' AND kick_distance BETWEEN 40 AND 49) AS fg_40_49,
 count(*) FILTER (field_goal_result='made' AND kick_distance>=50) AS fg_50_plus,
 count(*) FILTER (extra_point_result='good') AS xp_made, count(*) FILTER (play_type='extra_point' AND extra_point_result<>'good') AS xp_missed
 FROM plays WHERE kicker_player_id IS NOT NULL GROUP BY ALL),
kw AS (SELECT *, fg_made+fg_missed AS fg_att, xp_made+xp_missed AS xp_att,
 CAST(fg_0_39*3+fg_40_49*4+fg_50_plus*5+xp_made-fg_missed-xp_missed AS DOUBLE) AS fantasy_points, 'K' AS "position" FROM kk)"""


@query("A13_kicker_weeks", f"WITH {KICK} SELECT * FROM kw", "fantasy_points", "plays")
def _(t):
    return P.kicker_weeks(t.plays)


@query("J04_field_goal_extra_point_merge", """WITH f AS (SELECT season,"week",kicker_player_id AS player_id,posteam AS team,count(*) AS fg_att FROM plays WHERE play_type='field_goal' GROUP BY ALL),
 x AS (SELECT season,"week",kicker_player_id AS player_id,posteam AS team,count(*) AS xp_att FROM plays WHERE play_type='extra_point' GROUP BY ALL)
 SELECT season,"week",player_id,team,coalesce(fg_att,0) AS fg_att,coalesce(xp_att,0) AS xp_att FROM f FULL JOIN x USING (season,"week",player_id,team)""", "", "plays")
def _(t):
    return P.kicker_weeks(t.plays).select("season", "week", "player_id", "team", "fg_att", "xp_att")


DEF = """dd AS (SELECT defteam AS team,season,"week",CAST(sum(sack) AS BIGINT) AS sacks,CAST(sum(interception) AS BIGINT) AS interceptions,
 CAST(sum(fumble_lost) AS BIGINT) AS fumble_recoveries,CAST(sum(safety) AS BIGINT) AS safeties,
 count(*) FILTER (touchdown=1 AND td_team=defteam) AS defensive_tds,count(*) FILTER (field_goal_result='blocked') AS blocked_kicks,
 max(posteam_score_post) AS points_allowed FROM plays GROUP BY ALL),
rr AS (SELECT posteam AS team,season,"week",count(*) AS st FROM plays WHERE return_touchdown=1 GROUP BY ALL),
dw AS (SELECT dd.*, coalesce(st,0) AS special_teams_tds, CAST(sacks+2*interceptions+2*fumble_recoveries+2*safeties+6*defensive_tds+6*coalesce(st,0)+2*blocked_kicks
 + CASE WHEN points_allowed<=0 THEN 10 WHEN points_allowed<=6 THEN 7 WHEN points_allowed<=13 THEN 4 WHEN points_allowed<=20 THEN 1
   WHEN points_allowed<=27 THEN 0 WHEN points_allowed<=34 THEN -1 ELSE -4 END AS DOUBLE) AS fantasy_points, 'DST' AS "position", team||'_DST' AS player_id
 FROM dd LEFT JOIN rr USING (team,season,"week"))"""


@query("A14_defense_weeks", f"WITH {DEF} SELECT * FROM dw", "fantasy_points", "plays")
def _(t):
    return P.defense_weeks(t.plays)


@query("X15_drive_points", """SELECT drive_result, CASE WHEN lower(drive_result) LIKE '%touchdown%' THEN 7 WHEN lower(drive_result) LIKE '%field goal%' THEN 3
 WHEN lower(drive_result) LIKE '%safety%' THEN 2 ELSE 0 END AS points, count(*) AS n FROM plays GROUP BY ALL""", "", "plays")
def _(t):
    from weekgrain.functions.exprs import drive_points
    return t.plays.groupBy("drive_result", drive_points(F.col("drive_result")).alias("points")).agg(F.count(F.lit(1)).alias("n"))

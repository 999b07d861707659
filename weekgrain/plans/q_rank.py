"""Queries over filters, rankings and decisions: F01-F10, K01-K18, A15-A23, X11, X12, X20, X21."""

from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions import exprs as X
from weekgrain.functions.order_stats import quantiles
from weekgrain.operators import context as CX
from weekgrain.operators import evaluate as E
from weekgrain.operators import features as W
from weekgrain.operators import filters as FL
from weekgrain.operators import rank as K
from weekgrain.operators import targets as TG
from weekgrain.plans.q_context import DVP, _rookie_history
from weekgrain.plans.q_features import ALLP, ID, PW, VOL, nxt, pre
from weekgrain.plans.registry import query

NOW = '(SELECT max(season*100+"week") FROM preds)'
LAST = f'lp AS (SELECT * FROM preds WHERE season*100+"week"={NOW})'


def _period():
    return F.col("season") * 100 + F.col("week")


def _last(t):
    """Predictions of the latest period that the data has."""
    p = t.predictions
    return p.join(F.broadcast(p.agg(F.max(_period()).alias("_now"))), _period() == F.col("_now")).drop("_now")


# --- filters ---------------------------------------------------------------------
@query("F01_filtered_read", 'SELECT player_id,season,"week",team,fantasy_points FROM panel WHERE season=1998 AND "position"=\'RB\' AND team IN (1,5,9)', "fantasy_points")
def _(t):
    return FL.where_given(t.panel, season=1998, position="RB", team=[1, 5, 9], week=None).select(*ID, "team", "fantasy_points")


@query("F01_team_schedule", 'SELECT season,"week",home_team,away_team FROM schedule WHERE season=1999 AND (home_team=4 OR away_team=4)', "", "schedule")
def _(t):
    return FL.team_schedule(t.schedule, 4, season=1999).select("season", "week", "home_team", "away_team")


@query("F02_schedule_without_scores", 'SELECT season,"week",home_team,away_team,spread_line FROM schedule', "spread_line", "schedule")
def _(t):
    s = t.schedule.withColumns({"home_score": F.lit(21), "away_pts": F.lit(3)}).select("season", "week", "home_team", "away_team", "spread_line", "home_score", "away_pts")
    return FL.without_scores(s)


@query("F03_leak_free_columns", f"SELECT season,\"week\",fantasy_points,avg(fantasy_points) OVER ({PW} {pre(3)}) AS fp_roll3,1.0 AS sos_next_5 FROM panel", "fantasy_points fp_roll3 sos_next_5")
def _(t):
    df = W.rolling_means(t.panel, ["fantasy_points"], [3]).select(
        *ID, "name", "fantasy_points", F.col("fantasy_points_roll3_mean").alias("fp_roll3"), F.lit(1.0).alias("sos_next_5"), F.lit(0).alias("target_1w"),
        F.lit(0).alias("predicted_points"), F.lit(0).alias("points_next_game"), F.lit(0).alias("baseline_x"), F.lit(0).alias("utilization_score"))
    return FL.drop_leaky(df)


@query("F05_active_players", """SELECT player_id,season,"week" FROM pz WHERE player_id IN (SELECT player_id FROM pz WHERE season IN (SELECT DISTINCT season FROM pz ORDER BY season DESC LIMIT 2))""".replace("pz", "(SELECT * FROM panel WHERE player_id%3<>0 OR season<1999)"))
def _(t):
    p = t.panel.where((F.col("player_id") % 3 != 0) | (F.col("season") < 1999))
    return FL.active_players(p, 2).select(*ID)


@query("F05_active_with_team", """WITH r AS (SELECT * FROM panel WHERE season IN (SELECT DISTINCT season FROM panel ORDER BY season DESC LIMIT 2)) SELECT player_id,count(*) AS games,max_by(team,season*100+"week") AS latest_team FROM r GROUP BY 1 HAVING count(*)>=22""")
def _(t):
    return FL.active_with_team(t.panel, 22, 2)


@query("F07_name_search", """SELECT player_id,season,"week",name FROM panel WHERE lower(name) LIKE '%number 1%'""")
def _(t):
    return FL.name_contains(t.panel, " NUMBER 1").select(*ID, "name")


@query("F08_prediction_view", """WITH pl AS (SELECT DISTINCT CAST(x AS VARCHAR) AS c FROM (SELECT home_team AS x FROM schedule WHERE season=2000 AND "week"=12 AND home_team%3=0 UNION ALL SELECT away_team FROM schedule WHERE season=2000 AND "week"=12 AND home_team%3=0)),
 two AS (SELECT player_id,team,predicted_points FROM preds WHERE season=2000 AND "week"=12 UNION ALL SELECT player_id,NULL,predicted_points FROM preds WHERE season=2000 AND "week"=12 AND player_id%2=0 UNION ALL SELECT player_id,team,predicted_points/2 FROM preds WHERE season=2000 AND "week"=12)
 SELECT player_id,team,predicted_points FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY predicted_points DESC NULLS LAST,team NULLS LAST) AS rn FROM two WHERE CAST(team AS VARCHAR) IN (SELECT c FROM pl)) WHERE rn=1""", "predicted_points", "preds schedule")
def _(t):
    p = t.predictions.where((F.col("season") == 2000) & (F.col("week") == 12)).select("player_id", "season", "week", "team", "predicted_points")
    two = p.unionByName(p.where(F.col("player_id") % 2 == 0).withColumn("team", F.lit(None).cast("int"))).unionByName(
        p.withColumn("predicted_points", F.col("predicted_points") / 2))
    games = t.schedule.where((F.col("season") == 2000) & (F.col("week") == 12) & (F.col("home_team") % 3 == 0))
    return FL.prediction_view(two, 2000, 12, FL.teams_playing(games), "predicted_points").select("player_id", "team", "predicted_points")


@query("F09_sample_profile", 'SELECT count(*) AS n_rows,count(DISTINCT season) AS n_seasons,23 AS n_features FROM panel')
def _(t):
    return FL.sample_profile(t.panel)


@query("F09_reproducible_sample")
def _(t):
    return FL.reproducible_sample(t.panel, 500, ID).select(*ID, "fantasy_points")


@query("F10_trending_lists", f"""WITH {LAST}, u AS (SELECT player_id,predicted_points*2 AS util,predicted_points*2+predicted_std AS util_high,CASE WHEN predicted_points*2>=70 THEN 'high' WHEN predicted_points*2>=50 THEN 'moderate' ELSE 'low' END AS tier FROM lp)
 SELECT * FROM (SELECT player_id,util,'hot' AS list FROM u WHERE util>=75 ORDER BY util DESC,player_id LIMIT 5) UNION ALL SELECT * FROM (SELECT player_id,util,'cold' FROM u WHERE util<60 AND tier IN ('moderate','low') ORDER BY util,player_id LIMIT 9)
 UNION ALL SELECT * FROM (SELECT player_id,util,'sleeper' FROM u WHERE util BETWEEN 60 AND 75 AND util_high>=80 ORDER BY util DESC,player_id LIMIT 3)
 UNION ALL SELECT player_id,util,'must_start' FROM u WHERE util>=85 AND player_id%5=0 UNION ALL SELECT player_id,util,'sit' FROM u WHERE util<50 AND player_id%5=0""", "util", "preds")
def _(t):
    u = _last(t).select("player_id", (F.col("predicted_points") * 2).alias("util"), (F.col("predicted_points") * 2 + F.col("predicted_std")).alias("util_high"))
    u = u.withColumn("tier", X.at_least(F.col("util"), [(70, "high"), (50, "moderate")], "low"))
    roster = t.raw("supplier").where(F.col("s_suppkey") % 5 == 0).select(F.col("s_suppkey").alias("player_id"))
    return FL.trending_lists(u, roster)


# --- value and decisions ---------------------------------------------------------------
REP = "CASE \"position\" WHEN 'QB' THEN 14.0 WHEN 'RB' THEN 7.0 WHEN 'WR' THEN 7.5 ELSE 5.0 END"
SCA = "CASE \"position\" WHEN 'QB' THEN 0.8 WHEN 'RB' THEN 1.3 WHEN 'WR' THEN 1.0 ELSE 1.1 END"


@query("K01_value_over_replacement", f"""WITH v AS (SELECT player_id,season,"week","position",predicted_points,predicted_points-{REP} AS vor_raw,(predicted_points-{REP})*{SCA} AS vor_adjusted FROM preds)
 SELECT *, rank() OVER (ORDER BY round(vor_adjusted,9) DESC) AS vor_rank,rank() OVER (PARTITION BY "position" ORDER BY round(predicted_points,9) DESC) AS position_rank,
 CASE WHEN vor_adjusted>20 THEN 'elite' WHEN vor_adjusted>10 THEN 'starter' WHEN vor_adjusted>5 THEN 'flex' WHEN vor_adjusted>0 THEN 'depth' ELSE 'below_replacement' END AS vor_tier FROM v""",
       "predicted_points vor_raw vor_adjusted", "preds")
def _(t):
    return K.value_over_replacement(t.predictions.select(*ID, "position", "predicted_points"))


@query("K02_value_over_nth", """WITH s AS (SELECT player_id,name,team,"position",sum(fantasy_points) AS total_fp,count(*) AS games_played,avg(fantasy_points) AS ppg,stddev_samp(fantasy_points) AS fp_std FROM panel WHERE season=2000 GROUP BY ALL HAVING count(*)>=8),
 r AS (SELECT *, row_number() OVER (PARTITION BY "position" ORDER BY ppg DESC,player_id) AS rn FROM s), n AS (SELECT "position",coalesce(min(ppg) FILTER (rn=CASE "position" WHEN 'QB' THEN 12 WHEN 'RB' THEN 24 WHEN 'WR' THEN 30 ELSE 12 END),min(ppg)) AS replacement_ppg FROM r GROUP BY ALL)
 SELECT s.*,replacement_ppg,ppg-replacement_ppg AS vor FROM s JOIN n USING ("position")""", "total_fp ppg fp_std replacement_ppg vor")
def _(t):
    return K.value_over_nth(t.panel, 2000)


@query("K03_start_sit", """WITH c AS (SELECT player_id,season,"week",predicted_points,predicted_std/greatest(predicted_points,1) AS coeff_of_variation FROM preds), d AS (SELECT *, CASE WHEN coeff_of_variation<=0.5 THEN 'high' WHEN coeff_of_variation<=0.75 THEN 'medium' ELSE 'low' END AS confidence FROM c)
 SELECT *, CASE WHEN confidence='low' THEN 'uncertain' WHEN predicted_points>=15 THEN 'start' ELSE 'sit' END AS recommendation FROM d""", "predicted_points coeff_of_variation", "preds")
def _(t):
    return K.start_sit(t.predictions, threshold=0.5, minimum=15.0).select(*ID, "predicted_points", "coeff_of_variation", "confidence", "recommendation")


NCDF = "1-exp(-z*z/2)*0.3989422804014327*(0.319381530*t-0.356563782*t*t+1.781477937*t*t*t-1.821255978*t*t*t*t+1.330274429*t*t*t*t*t)"


@query("X12_normal_tail", f"""WITH q AS (SELECT player_id,season,"week",CAST((20-predicted_points)/greatest(predicted_std,0.01) AS DOUBLE) AS z0 FROM preds), r AS (SELECT *, abs(z0) AS z,1/(1+CAST(0.2316419 AS DOUBLE)*abs(z0)) AS t FROM q)
 SELECT player_id,season,"week",1-CASE WHEN z0>=0 THEN {NCDF} ELSE 1-({NCDF}) END AS boom_probability FROM r""", "boom_probability", "preds")
def _(t):
    return K.start_sit(t.predictions).select(*ID, "boom_probability")


@query("K04_decision_quality", """WITH c AS (SELECT player_id*10000+season*100+"week" AS pid,fantasy_points,predicted_points,predicted_std/greatest(predicted_points,1) AS cv FROM preds), d AS (SELECT *, CASE WHEN cv>0.75 THEN 'uncertain' WHEN predicted_points>=15 THEN 'start' ELSE 'sit' END AS rec FROM c),
 tp AS (SELECT pid FROM d ORDER BY predicted_points DESC,pid LIMIT 20), ta AS (SELECT pid FROM d ORDER BY fantasy_points DESC,pid LIMIT 20), tp1 AS (SELECT pid FROM d ORDER BY predicted_points DESC,pid LIMIT 10), ta1 AS (SELECT pid FROM d ORDER BY fantasy_points DESC,pid LIMIT 10)
 SELECT count(*) FILTER (rec='start') AS n_starts,avg(CAST(fantasy_points>=5 AS INT)) FILTER (rec='start') AS start_hit_rate,avg(fantasy_points) FILTER (rec='start') AS start_avg_points,
 count(*) FILTER (rec='sit') AS n_sits,avg(CAST(fantasy_points<10 AS INT)) FILTER (rec='sit') AS sit_correct_rate,avg(fantasy_points) FILTER (rec='sit') AS sit_avg_points,
 count(*) FILTER (rec='uncertain') AS n_uncertain,avg(fantasy_points) FILTER (rec='uncertain') AS uncertain_avg_points,var_samp(fantasy_points) FILTER (rec='uncertain') AS uncertain_variance,
 CAST(var_samp(fantasy_points) FILTER (rec='uncertain')>var_samp(fantasy_points)*1.2 AS INT) AS abstention_justified,avg(fantasy_points) FILTER (rec='start')-avg(fantasy_points) FILTER (rec='sit') AS start_vs_sit_differential,
 (SELECT count(*) FROM tp1 WHERE pid IN (SELECT pid FROM ta1))/10.0 AS top_10_precision,(SELECT count(*) FROM tp WHERE pid IN (SELECT pid FROM ta))/20.0 AS top_20_precision FROM d""",
       "start_hit_rate start_avg_points sit_correct_rate sit_avg_points uncertain_avg_points uncertain_variance start_vs_sit_differential top_10_precision top_20_precision", "preds")
def _(t):
    p = t.predictions.withColumn("pid", F.col("player_id") * 10000 + F.col("season") * 100 + F.col("week"))
    p = p.withColumn("predicted_points", F.round("predicted_points", 9))
    return K.decision_quality(K.start_sit(p, threshold=0.5, minimum=15.0), "pid")


@query("K05_waiver_priority", f"""WITH {LAST}, w AS (SELECT player_id,"position",predicted_points,predicted_points-{REP} AS vor,predicted_points+predicted_std AS upside_score FROM lp WHERE player_id%4<>1), p AS (SELECT *, 0.6*vor+0.4*upside_score AS waiver_priority FROM w)
 SELECT * FROM (SELECT *, rank() OVER (ORDER BY round(waiver_priority,9) DESC) AS waiver_rank FROM p) ORDER BY round(waiver_priority,9) DESC,player_id LIMIT 50""", "predicted_points vor upside_score waiver_priority", "preds")
def _(t):
    rostered = t.raw("supplier").where(F.col("s_suppkey") % 4 == 1).select(F.col("s_suppkey").alias("player_id"))
    p = _last(t).select("player_id", "position", "predicted_points", "predicted_std")
    return K.waiver_priority(p, rostered).drop("predicted_std")


SERVE = f"""WITH {LAST}, g AS (SELECT player_id,"position",predicted_points,predicted_std,player_id%9 AS games,(player_id*7)%20/1.0 AS vol,CASE WHEN player_id%6=0 THEN 0.5 ELSE 1.0 END AS inj FROM lp),
 m AS (SELECT "position",avg(predicted_points) AS m,stddev_samp(predicted_points) AS s FROM g WHERE games>=4 GROUP BY ALL),
 cs AS (SELECT player_id,g."position",CASE WHEN games<4 THEN m ELSE predicted_points END AS predicted_points,CASE WHEN games<4 THEN greatest(s*2,3.0) ELSE predicted_std END AS predicted_std,games,vol,inj FROM g JOIN m ON m."position"=g."position")"""


@query("K06_cold_start", SERVE + " SELECT player_id,predicted_points,predicted_std FROM cs", "predicted_points predicted_std", "preds")
def _(t):
    return K.cold_start(_serving(t), "games", "predicted_points", "predicted_std").select("player_id", "predicted_points", "predicted_std")


def _serving(t):
    pid = F.col("player_id")
    return _last(t).select("player_id", "position", "predicted_points", "predicted_std", (pid % 9).alias("games"), ((pid * 7) % 20 / 1.0).alias("vol"),
                           F.when(pid % 6 == 0, 0.5).otherwise(1.0).alias("inj"))


@query("K06_serve_ranks", SERVE + """, q AS (SELECT quantile_cont(vol,0.75) AS q FROM cs), w AS (SELECT cs.*, predicted_std*CASE WHEN games<4 THEN 1.5 ELSE CASE WHEN vol>q THEN 1.25 ELSE 1.0 END*CASE WHEN inj<0.7 THEN 1.4 ELSE 1.0 END END AS sd FROM cs,q)
 SELECT player_id,"position",predicted_points,sd AS predicted_std,CASE WHEN predicted_points>=80 THEN 'Elite' WHEN predicted_points>=70 THEN 'Strong' WHEN predicted_points>=60 THEN 'Average' WHEN predicted_points>=50 THEN 'Below Average' ELSE 'Low' END AS util_tier,
 greatest(0,predicted_points-1.28*sd) AS prediction_ci80_lower,predicted_points+1.28*sd AS prediction_ci80_upper,greatest(0,predicted_points-1.96*sd) AS prediction_ci95_lower,predicted_points+1.96*sd AS prediction_ci95_upper,
 row_number() OVER (ORDER BY -round(predicted_points,9),player_id) AS overall_rank,row_number() OVER (PARTITION BY "position" ORDER BY -round(predicted_points,9),player_id) AS position_rank FROM w""",
       "predicted_points predicted_std prediction_ci80_lower prediction_ci80_upper prediction_ci95_lower prediction_ci95_upper", "preds")
def _(t):
    df = K.cold_start(_serving(t), "games", "predicted_points", "predicted_std")
    return K.serve_ranks(df, "predicted_points", "predicted_std", "games", "vol", "inj").drop("games", "vol", "inj", "predicted_ppg")


@query("K07_bounded_intervals", """SELECT player_id,season,"week",greatest(0,least(CASE "position" WHEN 'QB' THEN 65 WHEN 'TE' THEN 45 ELSE 55 END*4,predicted_points*4)) AS predicted_points,
 greatest(0,predicted_points*4-sqrt(pow(predicted_std*pow(4,0.4),2)+4)) AS ci80_lower,predicted_points*4+sqrt(pow(predicted_std*pow(4,0.4),2)+4) AS ci80_upper,greatest(0,predicted_points*4-2*predicted_std*pow(4,0.4)) AS ci95_lower,predicted_points*4+2*predicted_std*pow(4,0.4) AS ci95_upper FROM preds""",
       "predicted_points ci80_lower ci80_upper ci95_lower ci95_upper", "preds")
def _(t):
    p = t.predictions.withColumn("predicted_points", F.col("predicted_points") * 4)
    return K.bounded_intervals(p, F.col("predicted_std"), 2 * F.col("predicted_std"), 4, conv80=F.lit(2.0)).select(*ID, "predicted_points", "ci80_lower", "ci80_upper", "ci95_lower", "ci95_upper")


def _horizons(t, value):
    p = _last(t)
    parts = [p.select("player_id", "position", F.lit(h).alias("n_weeks"), (F.col("predicted_points") * h).alias(value)) for h in (1, 4, 8, 18)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("K08_horizon_pivot", f"WITH {LAST} SELECT player_id,\"position\"," + ",".join(f"predicted_points*{h} AS proj_{h}w,predicted_points*{h}/{h} AS ppg_{h}w" for h in (1, 4, 8, 18)) + " FROM lp",
       " ".join(f"proj_{h}w ppg_{h}w" for h in (1, 4, 8, 18)), "preds")
def _(t):
    return K.horizon_pivot(_horizons(t, "predicted_points"), (1, 4, 8, 18))


@query("K08_compare_players", f"""WITH {LAST} SELECT player_id,name,predicted_points FROM lp WHERE lower(name) LIKE '%number 12%' OR lower(name) LIKE '%number 7'||'%'""", "predicted_points", "preds")
def _(t):
    return K.compare_players(_last(t), ["Number 12", "number 7"]).select("player_id", "name", "predicted_points")


def clip100(x):
    return f"greatest(0,least(100,{x}))"


@query("K18_prediction_table", f"WITH {LAST} SELECT player_id,\"position\"," + ",".join(
    f"{clip100(f'predicted_points*{h}')} AS util_{h}w,greatest(0,{clip100(f'predicted_points*{h}')}-1.96*{s}) AS util_{h}w_low,least(100,{clip100(f'predicted_points*{h}')}+1.96*{s}) AS util_{h}w_high" for h, s in ((1, 4.0), (4, 6.0), (8, 8.0))) +
    ",CASE WHEN predicted_points>85 THEN 'elite' WHEN predicted_points>70 THEN 'high' WHEN predicted_points>50 THEN 'moderate' WHEN predicted_points>0 THEN 'low' END AS tier FROM lp",
       " ".join(f"util_{h}w util_{h}w_low util_{h}w_high" for h in (1, 4, 8)), "preds")
def _(t):
    return K.prediction_table(_horizons(t, "util"), (1, 4, 8), {1: 4.0, 4: 6.0, 8: 8.0, 18: 1.0})


# --- matchups ------------------------------------------------------------------------------
MU = f"""{DVP}, {LAST}, mu AS (SELECT lp.player_id,lp."position",lp.predicted_points*2 AS score,CAST(round(26-defense_rank) AS INT) AS hard FROM lp JOIN dvp ON dvp.team=lp.opponent AND dvp.season*100+dvp."week"=(SELECT max(season*100+"week") FROM dvp WHERE season*100+"week"<{NOW}) AND dvp."position"=lp."position")"""


def _matchups(t):
    d = CX.defense_vs_position(t.panel)
    before = d.join(F.broadcast(t.predictions.agg(F.max(_period()).alias("_now"))), _period() < F.col("_now")).agg(F.max(_period()).alias("_at"))
    d = d.join(F.broadcast(before), _period() == F.col("_at"))  # the last period before that of the predictions
    d = d.select(F.col("team").alias("opponent"), "position", F.round(26 - F.col("defense_rank")).cast("int").alias("hard"))
    return _last(t).join(d, ["opponent", "position"]).select("player_id", "position", (F.col("predicted_points") * 2).alias("score"), "hard")


def matrix(row, col, table):
    return f"CASE {row} " + " ".join(f"WHEN '{r}' THEN CASE {col} " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in cs.items()) + " END" for r, cs in table.items()) + " END"


PT = "CASE WHEN score>=85 THEN 'elite' WHEN score>=70 THEN 'high' WHEN score>=50 THEN 'moderate' ELSE 'low' END"


@query("K09_matchup_adjust", f"""WITH {MU}, ma AS (SELECT *, {PT} AS player_tier,CASE WHEN hard<=5 THEN 'elite_defense' WHEN hard<=12 THEN 'tough' WHEN hard<=20 THEN 'average' WHEN hard<=27 THEN 'favorable' ELSE 'smash_spot' END AS matchup_difficulty FROM mu),
 mb AS (SELECT *, CAST({matrix('player_tier', 'matchup_difficulty', K.MATCHUP_FACTORS)} AS DOUBLE) AS adjustment_factor FROM ma) SELECT *, {clip100('score*adjustment_factor')} AS adjusted,{clip100('score*adjustment_factor')}-score AS adjustment_points FROM mb""",
       "score adjustment_factor adjusted adjustment_points", "preds")
def _(t):
    return K.adjust_for_matchup(_matchups(t), "score", "hard")


@query("K09_defense_tier_adjust", f"""WITH {MU}, ma AS (SELECT *, 25 AS n_teams,{PT} AS player_tier,CASE WHEN hard/25<=0.15 THEN 'elite' WHEN hard/25<=0.35 THEN 'good' WHEN hard/25<=0.7 THEN 'average' ELSE 'weak' END AS defense_tier FROM mu),
 mb AS (SELECT *, CAST({matrix('player_tier', 'defense_tier', K.TIER_FACTORS)} AS DOUBLE) AS multiplier FROM ma) SELECT *, {clip100('score*multiplier')} AS adjusted,CASE WHEN multiplier>=1.08 THEN 'SMASH SPOT' WHEN multiplier>=1.03 THEN 'FAVORABLE' WHEN multiplier>=0.97 THEN 'NEUTRAL' WHEN multiplier>=0.85 THEN 'TOUGH' ELSE 'AVOID' END AS matchup_rating FROM mb""",
       "score multiplier adjusted", "preds")
def _(t):
    return K.adjust_by_defense_tier(_matchups(t).withColumn("n_teams", F.lit(25)), "score", "hard", "n_teams")


@query("K09_best_matchups", f"WITH {MU} SELECT *, score+(32-hard)*2 AS matchup_score FROM mu ORDER BY round(score+(32-hard)*2,9) DESC,player_id LIMIT 10", "score matchup_score", "preds")
def _(t):
    return K.matchup_extremes(_matchups(t), "score", "hard")


@query("K09_worst_matchups", f"WITH {MU} SELECT *, score-hard*2 AS matchup_score FROM mu ORDER BY round(score-hard*2,9),player_id LIMIT 10", "score matchup_score", "preds")
def _(t):
    return K.matchup_extremes(_matchups(t), "score", "hard", best=False)


# --- injuries ------------------------------------------------------------------------------------
INJ = """ip AS (SELECT player_id,"position",predicted_points*2 AS score,(['OUT','DOUBTFUL','QUESTIONABLE','PROBABLE','HEALTHY'])[player_id%5+1] AS status,(['hamstring','Knee','wrist','elbow',NULL])[player_id%5+1] AS injury_type FROM lp)"""


def _hurt(t):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("player_id") % 5 + 1).cast("int"))
    return _last(t).select("player_id", "position", (F.col("predicted_points") * 2).alias("score"), pick(["OUT", "DOUBTFUL", "QUESTIONABLE", "PROBABLE", "HEALTHY"]).alias("status"),
                           pick(["hamstring", "Knee", "wrist", "elbow", None]).alias("injury_type"))


@query("K10_injury_adjust", f"""WITH {LAST},{INJ}, f AS (SELECT *, CASE status WHEN 'OUT' THEN 0.0 WHEN 'DOUBTFUL' THEN 0.3 WHEN 'QUESTIONABLE' THEN 0.75 WHEN 'PROBABLE' THEN 0.9 ELSE 1.0 END*CASE WHEN injury_type IS NULL THEN 1.0 WHEN injury_type='hamstring' THEN 0.8 WHEN lower(injury_type)='knee' THEN 0.7 WHEN injury_type='wrist' THEN 0.95 ELSE 0.85 END
 *CASE "position" WHEN 'QB' THEN 1.0 WHEN 'RB' THEN 0.85 WHEN 'WR' THEN 0.9 ELSE 0.92 END AS f FROM ip), g AS (SELECT *, CASE WHEN status='OUT' THEN 0.0 ELSE score*f END AS injury_adjusted FROM f)
 SELECT * EXCLUDE (f), CAST(CASE WHEN status='OUT' THEN 0.0 ELSE (1-f)*50 END AS DOUBLE) AS confidence_penalty,greatest(0,injury_adjusted-10) AS injury_low,least(100,injury_adjusted+5) AS injury_high,CASE status WHEN 'OUT' THEN 'critical' WHEN 'DOUBTFUL' THEN 'high' WHEN 'QUESTIONABLE' THEN 'medium' ELSE 'low' END AS severity FROM g""",
       "score injury_adjusted confidence_penalty injury_low injury_high", "preds")
def _(t):
    return K.adjust_for_injury(_hurt(t), "score")


@query("K10_report_adjust", f"""WITH {LAST},{INJ}, m AS (SELECT player_id,"position",score,status AS injury_status,CAST(greatest(0,least(1.2,CASE status WHEN 'OUT' THEN 0.0 WHEN 'DOUBTFUL' THEN 0.15 WHEN 'QUESTIONABLE' THEN 0.75 WHEN 'PROBABLE' THEN 0.95 ELSE 1.0 END*CASE "position" WHEN 'QB' THEN 1.2 WHEN 'RB' THEN 0.8 WHEN 'WR' THEN 1.0 ELSE 1.1 END)) AS DOUBLE) AS injury_multiplier,
 CAST(CASE status WHEN 'OUT' THEN 0.0 WHEN 'DOUBTFUL' THEN 0.25 WHEN 'QUESTIONABLE' THEN 0.85 WHEN 'PROBABLE' THEN 0.95 ELSE 1.0 END AS DOUBLE) AS so,CAST(CASE "position" WHEN 'QB' THEN 0.9 WHEN 'RB' THEN 0.75 WHEN 'WR' THEN 0.85 ELSE 0.8 END AS DOUBLE) AS re FROM ip)
 SELECT player_id,"position",score,injury_status,injury_multiplier,score*injury_multiplier AS injury_adjusted_util,CASE WHEN injury_status='OUT' THEN 0.0 ELSE score*(so+(1-so)*(1-re)) END AS softened_util,CAST(CASE WHEN injury_status IN ('QUESTIONABLE','DOUBTFUL') THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence_adjustment,CAST(injury_status NOT IN ('HEALTHY','PROBABLE') AS INT) AS injury_warning FROM m""",
       "score injury_multiplier injury_adjusted_util softened_util confidence_adjustment", "preds")
def _(t):
    return K.adjust_by_report(_hurt(t), "score", "status").drop("status", "injury_type")


SEV = "*".join(f"CASE WHEN lower(injury_type) LIKE '%{w}%' THEN {f} ELSE 1.0 END" for w, f in K.SEVERITY.items())


@query("K10_injury_impact", f"""SELECT report_id,upper(status) AS status,injury_type,CAST(least(100,CAST(CASE upper(status) WHEN 'OUT' THEN 100 WHEN 'DOUBTFUL' THEN 75 WHEN 'QUESTIONABLE' THEN 40 WHEN 'PROBABLE' THEN 15 ELSE 20 END AS DOUBLE)*CAST({SEV} AS DOUBLE)) AS DOUBLE) AS impact_score,
 CASE WHEN upper(status)='OUT' THEN CASE WHEN regexp_matches(lower(injury_type),'acl|achilles|season') THEN 18 WHEN regexp_matches(lower(injury_type),'hamstring|knee|ankle') THEN 3 ELSE 1 END WHEN upper(status)='DOUBTFUL' THEN 1 ELSE 0 END AS estimated_weeks_out FROM injuries""", "report_id impact_score", "injuries")
def _(t):
    return K.injury_impact(t.injuries.select("report_id", F.upper("status").alias("status"), "injury_type"))


RS = "CASE WHEN upper(status) LIKE '%OUT%' OR upper(status) LIKE '%IR%' THEN 5 WHEN upper(status) LIKE '%DOUBT%' THEN 3 WHEN upper(status) LIKE '%QUEST%' THEN 2 WHEN upper(status) LIKE '%PROB%' THEN 1 ELSE 0 END"


@query("K10_report_risk", f"""WITH w AS (SELECT player_id,season,"week",{RS} AS w FROM injuries WHERE player_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC,"week" DESC,w DESC) AS rn FROM w), s AS (SELECT player_id,CAST(least(100,sum(w)*2) AS BIGINT) AS risk_score,count(*) AS reports FROM r WHERE rn<=12 GROUP BY ALL)
 SELECT *, CASE WHEN risk_score>=70 THEN 'HIGH' WHEN risk_score>=40 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM s""", "", "injuries")
def _(t):
    return K.report_risk(t.injuries, last_n=12)


@query("K10_recurrence_risk", """WITH b AS (SELECT player_id,"position",injury_type,count(*) AS n,CAST(sum(CAST(season>=2001 AS INT)) AS BIGINT) AS r FROM injuries WHERE player_id IS NOT NULL GROUP BY ALL), a AS (SELECT player_id,"position",sum(n) AS n,CAST(sum(r) AS BIGINT) AS recent_injuries,max(CAST(n>=2 AS INT)) AS has_recurring FROM b GROUP BY ALL),
 s AS (SELECT *, CAST(least(100,recent_injuries*10*CASE WHEN has_recurring=1 THEN 1.5 ELSE 1.0 END*CASE "position" WHEN 'RB' THEN 1.3 WHEN 'WR' THEN 1.1 WHEN 'TE' THEN 1.0 WHEN 'QB' THEN 0.8 ELSE 1.0 END) AS DOUBLE) AS risk_score FROM a)
 SELECT player_id,"position",recent_injuries,has_recurring,risk_score,CASE WHEN risk_score<20 THEN 'low' WHEN risk_score<50 THEN 'moderate' WHEN risk_score<75 THEN 'high' ELSE 'very_high' END AS risk_level,CASE WHEN n>=3 THEN 'high' ELSE 'moderate' END AS confidence FROM s""", "risk_score", "injuries")
def _(t):
    return K.recurrence_risk(t.injuries, 2001)


@query("K10_return_timeline", """SELECT DISTINCT injury_type,CASE lower(injury_type) WHEN 'ankle' THEN 1 WHEN 'knee' THEN 3 WHEN 'concussion' THEN 1 WHEN 'wrist' THEN 1 ELSE 1 END AS lo,CASE lower(injury_type) WHEN 'ankle' THEN 3 WHEN 'knee' THEN 6 WHEN 'concussion' THEN 2 WHEN 'wrist' THEN 3 ELSE 2 END AS typical,
 CASE lower(injury_type) WHEN 'ankle' THEN 4 WHEN 'knee' THEN 9 WHEN 'concussion' THEN 3 WHEN 'wrist' THEN 4 ELSE 4 END AS hi FROM injuries""", "", "injuries")
def _(t):
    lo, typ, hi = K.return_timeline(F.col("injury_type"))
    return t.injuries.select("injury_type", lo.alias("lo"), typ.alias("typical"), hi.alias("hi")).distinct()


# --- lineups and trades ----------------------------------------------------------------------------
LU = """lu AS (SELECT player_id%7 AS roster_id,season,"week",player_id,"position",predicted_points AS value FROM preds),
 r1 AS (SELECT *, row_number() OVER (PARTITION BY roster_id,season,"week","position" ORDER BY round(value,9) DESC,player_id) AS rn,CASE "position" WHEN 'QB' THEN 1 WHEN 'RB' THEN 2 WHEN 'WR' THEN 2 ELSE 1 END AS need FROM lu),
 fx AS (SELECT *, row_number() OVER (PARTITION BY roster_id,season,"week" ORDER BY round(value,9) DESC,player_id) AS fr FROM r1 WHERE rn>need AND "position" IN ('RB','WR','TE')),
 ln AS (SELECT roster_id,season,"week",player_id,"position",value,"position" AS slot FROM r1 WHERE rn<=need UNION ALL SELECT roster_id,season,"week",player_id,"position",value,'FLEX' FROM fx WHERE fr<=1)"""


def _lineups(t):
    p = t.predictions.select((F.col("player_id") % 7).alias("roster_id"), "season", "week", "player_id", "position", F.col("predicted_points").alias("value"))
    return K.best_lineups(p, ["roster_id", "season", "week"], "value")


@query("K11_lineups", f"WITH {LU} SELECT * FROM ln", "value", "preds")
def _(t):
    return _lineups(t)


@query("K11_profile_projection", f"""WITH {VOL} SELECT player_id,season,"week",fantasy_points*0.7*0.4+fantasy_points*1.3*0.6+coalesce(consistency_score*100,50)/100*2+coalesce(boom_bust_range,0)*0.5*0.1 AS adjusted_projection FROM vo""", "adjusted_projection")
def _(t):
    v = W.volatility(t.panel)
    none = F.lit(None).cast("double")
    return v.select(*ID, K.profile_projection(F.col("fantasy_points"), none, none, F.col("consistency_score") * 100, F.col("boom_bust_range"), 0.6, True, 0.5).alias("adjusted_projection"))


@query("K12_playoff_appearances", f"WITH {LU}, a AS (SELECT roster_id,season,player_id,count(DISTINCT \"week\") AS starts FROM ln WHERE \"week\">=10 GROUP BY ALL) SELECT *, CASE WHEN starts=3 THEN 'stud' ELSE 'situational' END AS role FROM a", "", "preds")
def _(t):
    return K.lineup_appearances(_lineups(t).where(F.col("week") >= 10), ["roster_id", "season"], 3)


@query("K12_strategy_scores", """SELECT player_id,season,"week",(u*0.6+(u+s)*0.4)*(0.7+0.3*12/17.0) AS ceiling_score,(u*0.6+greatest(u-s,0)*0.4)*(0.7+0.3*12/17.0) AS floor_score,u*(0.7+0.3*12/17.0) AS balanced_score FROM (SELECT *, predicted_points AS u,predicted_std AS s FROM preds)""",
       "ceiling_score floor_score balanced_score", "preds")
def _(t):
    u, s = F.col("predicted_points"), F.col("predicted_std")
    sc = lambda k: K.playoff_score(k, u, F.greatest(u - s, F.lit(0.0)), u + s, F.lit(12)).alias(f"{k}_score")
    return t.predictions.select(*ID, sc("ceiling"), sc("floor"), sc("balanced"))


TRADE = """pj AS (SELECT player_id,"position",avg(fantasy_points) AS avg_points FROM panel GROUP BY ALL), sd AS (SELECT DISTINCT o_custkey AS trade_id,CASE WHEN o_orderkey%2=0 THEN 'give' ELSE 'get' END AS side,o_orderkey%100 AS player_id FROM orders),
 tr AS (SELECT sd.*,"position",avg_points FROM sd JOIN pj USING (player_id))"""


def _trades(t):
    proj = t.panel.groupBy("player_id", "position").agg(F.avg("fantasy_points").alias("avg_points"))
    o = t.raw("orders")
    sides = o.select(F.col("o_custkey").alias("trade_id"), F.when(F.col("o_orderkey") % 2 == 0, "give").otherwise("get").alias("side"), (F.col("o_orderkey") % 100).alias("player_id")).distinct()
    return sides, proj


@query("K13_trade_values", f"""WITH {TRADE}, a AS (SELECT trade_id,coalesce(sum(avg_points*8) FILTER (side='give'),0) AS giving_value,coalesce(sum(avg_points*8) FILTER (side='get'),0) AS receiving_value FROM tr GROUP BY ALL), b AS (SELECT *, receiving_value-giving_value AS net_gain FROM a)
 SELECT *, CASE WHEN net_gain>=15 THEN 'STRONG ACCEPT' WHEN net_gain>=5 THEN 'ACCEPT' WHEN net_gain>0 THEN 'NEUTRAL (Slight edge to you)' WHEN net_gain>=-5 THEN 'NEUTRAL (Slight edge to them)' WHEN net_gain>=-15 THEN 'REJECT' ELSE 'STRONG REJECT' END AS verdict FROM b""", "giving_value receiving_value net_gain")
def _(t):
    return K.trade_values(*_trades(t), 8)


@query("K13_trade_positions", f"""WITH {TRADE}, a AS (SELECT trade_id,"position",count(*) FILTER (side='get')-count(*) FILTER (side='give') AS net_players,coalesce(avg(avg_points) FILTER (side='get'),0)-coalesce(avg(avg_points) FILTER (side='give'),0) AS quality_change FROM tr GROUP BY ALL)
 SELECT *, CASE WHEN quality_change>0 THEN 'UPGRADE' ELSE 'DOWNGRADE' END AS verdict FROM a""", "quality_change")
def _(t):
    return K.trade_positions(*_trades(t))


@query("K14_pick_review", """WITH s AS (SELECT panel.player_id,name,panel."position",season,avg(fantasy_points*3) AS avg_score,count(*) AS games_played,CAST(sum(CAST(fantasy_points*3>=85 AS INT)) AS BIGINT) AS weeks_as_elite,CAST(sum(CAST(fantasy_points*3>=70 AS INT)) AS BIGINT) AS weeks_as_starter,CAST(sum(CAST(fantasy_points*3<20 AS INT)) AS BIGINT) AS injury_weeks,max(draft_round*2-1) AS draft_round
  FROM panel JOIN drafted USING (player_id) GROUP BY ALL), e AS (SELECT *, CASE "position" WHEN 'QB' THEN CASE WHEN draft_round<=2 THEN 85 WHEN draft_round<=5 THEN 75 WHEN draft_round<=10 THEN 65 ELSE 55 END WHEN 'RB' THEN CASE WHEN draft_round<=2 THEN 82 WHEN draft_round<=5 THEN 72 WHEN draft_round<=10 THEN 60 ELSE 50 END
  WHEN 'WR' THEN CASE WHEN draft_round<=2 THEN 80 WHEN draft_round<=5 THEN 70 WHEN draft_round<=10 THEN 58 ELSE 48 END ELSE CASE WHEN draft_round<=2 THEN 75 WHEN draft_round<=5 THEN 65 WHEN draft_round<=10 THEN 55 ELSE 45 END END AS expected_value FROM s)
 SELECT *, avg_score-expected_value AS value_vs_round,CASE WHEN avg_score-expected_value>=10 THEN 'Excellent' WHEN avg_score-expected_value>=5 THEN 'Good' WHEN avg_score-expected_value>=-5 THEN 'Fair' WHEN avg_score-expected_value>=-10 THEN 'Disappointing' ELSE 'Poor' END AS verdict FROM e""", "avg_score value_vs_round", "panel drafted")
def _(t):
    p = t.panel.join(t.drafted.select("player_id", (F.col("draft_round") * 2 - 1).alias("draft_round")), "player_id").withColumn("score", F.col("fantasy_points") * 3)
    return K.pick_review(p, "score", "draft_round")


@query("K14_pick_alternatives", """WITH a AS (SELECT "position",season,player_id,avg(fantasy_points) AS avg_score FROM panel GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "position",season ORDER BY round(avg_score,9) DESC,player_id) AS place FROM a) WHERE place<=4""", "avg_score")
def _(t):
    return K.pick_alternatives(t.panel, "fantasy_points")


@query("K14_head_to_head", """WITH x AS (SELECT player_id,fantasy_points*3 AS s FROM panel WHERE season=1999 AND player_id IN (4,8)), a AS (SELECT avg(s) FILTER (player_id=4) AS first_avg,count(*) FILTER (player_id=4) AS first_games,sum(s) FILTER (player_id=4) AS first_total,CAST(sum(CAST(s>=85 AS INT)) FILTER (player_id=4) AS BIGINT) AS first_elite_weeks,
 avg(s) FILTER (player_id=8) AS second_avg,count(*) FILTER (player_id=8) AS second_games,sum(s) FILTER (player_id=8) AS second_total,CAST(sum(CAST(s>=85 AS INT)) FILTER (player_id=8) AS BIGINT) AS second_elite_weeks FROM x)
 SELECT *, CASE WHEN first_avg>second_avg THEN 4 ELSE 8 END AS winner,abs(first_avg-second_avg) AS delta,first_total-second_total AS total_diff,CASE WHEN first_total-second_total>50 THEN 'FIRST' WHEN first_total-second_total<-50 THEN 'SECOND' ELSE 'EVEN' END AS verdict FROM a""",
       "first_avg first_total second_avg second_total delta total_diff")
def _(t):
    p = t.panel.withColumn("score", F.col("fantasy_points") * 3)
    return K.head_to_head(p, 4, 8, 1999, "score")


BOARD = f"""{VOL}, sa AS (SELECT season,player_id,name,team,"position",sum(fantasy_points) AS total_fp,count(*) AS games_played,avg(fantasy_points) AS ppg,coalesce(stddev_samp(fantasy_points),0) AS fp_std,avg(weekly_volatility) AS vol_mean,avg(coefficient_of_variation) AS cv_mean,avg(consistency_score) AS consistency_mean FROM vo GROUP BY ALL)"""


def _season_agg(t):
    return K.season_totals(W.volatility(t.panel), by=["season"], extra={"vol_mean": F.avg("weekly_volatility"), "cv_mean": F.avg("coefficient_of_variation"), "consistency_mean": F.avg("consistency_score")})


@query("A15_season_totals", f"WITH {BOARD} SELECT * FROM sa", "total_fp ppg fp_std vol_mean cv_mean consistency_mean")
def _(t):
    return _season_agg(t)


@query("K15_risk_score", f"""WITH {BOARD}, w AS (SELECT *, (vol_mean-min(vol_mean) OVER p)/(max(vol_mean) OVER p-min(vol_mean) OVER p)*30+(cv_mean-min(cv_mean) OVER p)/(max(cv_mean) OVER p-min(cv_mean) OVER p)*25+(1-consistency_mean/max(consistency_mean) OVER p)*25+(1-games_played/max(games_played) OVER p)*20 AS r FROM sa WINDOW p AS (PARTITION BY season,"position"))
 SELECT player_id,season,CASE WHEN r IS NOT NULL THEN greatest(0,least(100,r)) END AS risk_score FROM w""", "risk_score")
def _(t):
    return K.risk_scores(_season_agg(t), by=["season"]).select("player_id", "season", "risk_score")


@query("K16_draft_board", f"""WITH {BOARD} SELECT player_id,season,"position",total_fp,row_number() OVER (PARTITION BY season,"position" ORDER BY -round(total_fp,9),player_id) AS adp,total_fp/17 AS projection_points_per_game,CASE WHEN fp_std>0 THEN greatest(0,total_fp-1.5*fp_std*sqrt(17.0)) END AS projection_floor,CASE WHEN fp_std>0 THEN total_fp+1.5*fp_std*sqrt(17.0) END AS projection_ceiling FROM sa""",
       "total_fp projection_points_per_game projection_floor projection_ceiling")
def _(t):
    return K.draft_board(_season_agg(t), "total_fp", by=["season"]).select("player_id", "season", "position", "total_fp", "adp", "projection_points_per_game", "projection_floor", "projection_ceiling")


@query("K17_app_snapshot", """WITH mx AS (SELECT max(season*100+"week") AS w FROM panel), pr AS (SELECT player_id,avg(fantasy_points) AS projection_1w FROM panel GROUP BY ALL), up AS (SELECT player_id,season,"week",projection_1w FROM panel JOIN mx ON season*100+"week"=w JOIN pr USING (player_id) WHERE home_away='home')
 SELECT f.player_id,f.season,f."week",fantasy_points,CASE WHEN f.season*100+f."week"=w THEN projection_1w END AS projection_1w FROM panel f CROSS JOIN mx LEFT JOIN pr USING (player_id) WHERE (f.player_id,f.season,f."week") NOT IN (SELECT player_id,season,"week" FROM up) UNION ALL SELECT player_id,season,"week",NULL,projection_1w FROM up""", "fantasy_points projection_1w")
def _(t):
    p = t.panel
    proj = p.groupBy("player_id").agg(F.avg("fantasy_points").alias("projection_1w"))
    now = p.join(F.broadcast(p.agg(F.max(_period()).alias("_now"))), _period() == F.col("_now")).where(F.col("home_away") == "home")  # one row
    return K.app_snapshot(p.select(*ID, "fantasy_points"), proj, now.select(*ID).join(proj, "player_id"))


# --- remaining aggregates ------------------------------------------------------------------------------
@query("A16_team_share_totals", """SELECT player_id,season,"week",CAST(sum(targets) OVER w AS BIGINT) AS team_targets,CAST(sum(receptions) OVER w AS BIGINT) AS team_receptions,CAST(sum(rushing_attempts) OVER w AS BIGINT) AS team_rush_attempts,CAST(sum(snap_count) OVER w AS BIGINT) AS team_snaps FROM panel WINDOW w AS (PARTITION BY team,season,"week")""")
def _(t):
    from weekgrain.operators.utilization import with_team_totals
    return with_team_totals(t.panel).select(*ID, "team_targets", "team_receptions", "team_rush_attempts", "team_snaps")


@query("A18_tier_trend", """WITH s AS (SELECT season,"position",fantasy_points*2 AS u FROM panel), g AS (SELECT season,"position",CASE WHEN u>=80 THEN 'Elite' WHEN u>=70 THEN 'Strong' WHEN u>=60 THEN 'Average' WHEN u>=50 THEN 'Below Average' ELSE 'Low' END AS tier,u FROM s)
 SELECT season,tier,avg(u) FILTER ("position"='QB') AS QB,avg(u) FILTER ("position"='RB') AS RB,avg(u) FILTER ("position"='WR') AS WR,avg(u) FILTER ("position"='TE') AS TE FROM g GROUP BY ALL""", "QB RB WR TE")
def _(t):
    s = t.panel.withColumn("u", F.col("fantasy_points") * 2)
    return s.groupBy("season", X.utilization_tier(F.col("u")).alias("tier")).pivot("position", C.POSITIONS).agg(F.avg("u"))


@query("A18_usage_rollup", """WITH s AS (SELECT season,player_id,"position",fantasy_points*2 AS u FROM panel), g AS (SELECT *, CASE WHEN u>=80 THEN 'Elite' WHEN u>=70 THEN 'Strong' WHEN u>=60 THEN 'Average' WHEN u>=50 THEN 'Below Average' ELSE 'Low' END AS tier FROM s),
 a AS (SELECT season,"position",tier,count(DISTINCT player_id) AS total_players,count(u) AS n_rows,avg(u) AS avg_util,stddev_samp(u) AS std_util,count(*) FILTER (u>=85) AS elite_count FROM g GROUP BY GROUPING SETS ((season,"position",tier),(season,"position"),("position",tier),("position"),()))
 SELECT *, round(elite_count/total_players*100,1) AS elite_pct,n_rows/total_players AS samples_per_player FROM a""", "avg_util std_util elite_pct samples_per_player")
def _(t):
    return K.usage_rollup(t.panel.withColumn("u", F.col("fantasy_points") * 2), "u")


R2 = [(m, c, n) for m, c in (("form", "r3"), ("season", "r8")) for n in (1, 4, 10)]


@query("A18_r2_pivot", f"""WITH h AS (SELECT "position",avg(fantasy_points) OVER ({PW} {pre(3)}) AS r3,avg(fantasy_points) OVER ({PW} {pre(8)}) AS r8,{nxt('fantasy_points', 1, 'sum', 1)} AS t1,{nxt('fantasy_points', 4, 'sum', 3)} AS t4,{nxt('fantasy_points', 10, 'sum', 8)} AS t10 FROM panel)
 SELECT "position",""" + ",".join(f"1-avg(pow(t{n}-{c}*{n},2))/(var_pop(t{n}) FILTER ({c} IS NOT NULL)) AS {m}_{n}w" for m, c, n in R2) + """ FROM h GROUP BY "position\"""", " ".join(f"{m}_{n}w" for m, _, n in R2))
def _(t):
    p = TG.horizon_targets(W.rolling_means(t.panel, ["fantasy_points"], [3, 8]), (1, 4, 10))
    p = p.withColumns({f"{m}_p{n}": F.col(f"fantasy_points_roll{c[1:]}_mean") * n for m, c, n in R2})
    return E.r2_pivot(p, {f"{m}_{n}w": (f"target_{n}w", f"{m}_p{n}") for m, _, n in R2})


@query("A20_injury_frequency", """WITH c AS (SELECT player_name,count(*) AS n FROM injuries GROUP BY ALL), q AS (SELECT quantile_cont(n,0.75) AS q FROM c) SELECT player_name,n,q AS prone_threshold,CAST(n>=3 AS INT) AS high_risk FROM c,q""", "prone_threshold", "injuries")
def _(t):
    c = t.injuries.groupBy("player_name").agg(F.count(F.lit(1)).alias("n"))
    q = quantiles(c.withColumn("_one", F.lit(1)), ["_one"], "n", {"prone_threshold": 0.75}).select("prone_threshold")
    return c.join(F.broadcast(q)).withColumn("high_risk", (F.col("n") >= 3).cast("int"))


@query("A21_roster_needs", """WITH r AS (SELECT season,player_id%16 AS roster_id,"position",avg(fantasy_points) AS pp FROM panel GROUP BY season,player_id,"position"), x AS (SELECT r0.season,r0.roster_id,i.p AS "position",i.ideal,count(r.pp) AS current,avg(r.pp) AS avg_projected FROM (SELECT DISTINCT season,roster_id FROM r) r0 CROSS JOIN (SELECT unnest(['QB','RB','WR','TE']) AS p, unnest([2,4,4,2]) AS ideal) i LEFT JOIN r ON r.season=r0.season AND r.roster_id=r0.roster_id AND r."position"=i.p GROUP BY ALL)
 SELECT *, greatest(ideal-current,0) AS need,greatest(current-ideal,0) AS surplus,CASE WHEN current<ideal THEN CASE WHEN current=0 THEN 'High' ELSE 'Medium' END END AS priority FROM x""", "avg_projected")
def _(t):
    r = t.panel.groupBy("season", "player_id", "position").agg(F.avg("fantasy_points").alias("projected_points"))
    return K.roster_needs(r.withColumn("roster_id", F.col("player_id") % 16), ["season", "roster_id"])


@query("A22_depth_chart", """WITH r AS (SELECT season,player_id,team,"position",sum(snap_count) AS s FROM panel GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY season,team%5,"position" ORDER BY -s,player_id) AS depth_rank FROM r)
 SELECT season,player_id,CAST(team%5 AS INT) AS team,"position",depth_rank,CAST(CASE "position" WHEN 'QB' THEN CASE depth_rank WHEN 1 THEN 1.0 ELSE 0.05 END WHEN 'RB' THEN CASE depth_rank WHEN 1 THEN 0.55 WHEN 2 THEN 0.3 WHEN 3 THEN 0.1 ELSE 0.05 END
 WHEN 'WR' THEN CASE depth_rank WHEN 1 THEN 0.3 WHEN 2 THEN 0.25 WHEN 3 THEN 0.2 WHEN 4 THEN 0.15 ELSE 0.05 END ELSE CASE depth_rank WHEN 1 THEN 0.7 WHEN 2 THEN 0.2 ELSE 0.1 END END AS DOUBLE) AS expected_utilization FROM d""", "expected_utilization")
def _(t):
    r = t.panel.groupBy("season", "player_id", (F.col("team") % 5).alias("team"), "position").agg(F.sum("snap_count").alias("s"))
    return K.depth_chart(r, [-F.col("s"), F.col("player_id")], by=["season"]).drop("s")


@query("A23_matchup_summary", f"""WITH {DVP} SELECT panel.team,panel.opponent,panel.season,panel."week",min(coalesce(matchup_score,0.5)) AS opp_matchup_score,min(coalesce(defense_rank,16)) AS opp_defense_rank,count(*) AS players
 FROM panel LEFT JOIN dvp ON dvp.team=panel.opponent AND dvp.season=panel.season AND dvp."week"+1=panel."week" AND dvp."position"=panel."position" GROUP BY ALL""", "opp_matchup_score opp_defense_rank")
def _(t):
    df = CX.with_opponent_matchup(t.panel, CX.defense_vs_position(t.panel))
    return df.groupBy("team", "opponent", "season", "week").agg(F.min("opp_matchup_score").alias("opp_matchup_score"), F.min("opp_defense_rank").alias("opp_defense_rank"), F.count(F.lit(1)).alias("players"))


@query("X11_winsor", """WITH q AS (SELECT quantile_cont(fantasy_points,0.01) AS lo,quantile_cont(fantasy_points,0.99) AS hi FROM panel) SELECT player_id,season,"week",greatest(lo,least(hi,fantasy_points)) AS clipped FROM panel,q""", "clipped")
def _(t):
    from weekgrain.operators.fit import winsorise
    return winsorise(t.panel, t.panel, "fantasy_points", "clipped", []).select(*ID, "clipped")


@query("X20_td_regression", """SELECT player_id,season,"week",CASE "position" WHEN 'RB' THEN rushing_attempts*0.035 WHEN 'QB' THEN rushing_attempts*0.025 END AS expected_rush_tds,CASE "position" WHEN 'RB' THEN targets*0.045 WHEN 'WR' THEN targets*0.055 WHEN 'TE' THEN targets*0.065 END AS expected_rec_tds,
 CASE WHEN "position"='QB' THEN passing_attempts*0.045 END AS expected_pass_tds,rushing_tds*0.5+coalesce(CASE "position" WHEN 'RB' THEN rushing_attempts*0.035 WHEN 'QB' THEN rushing_attempts*0.025 END,0)*0.5 AS regressed_rush_tds FROM panel""", "expected_rush_tds expected_rec_tds expected_pass_tds regressed_rush_tds")
def _(t):
    from weekgrain.operators.fit import expected_touchdowns, regressed
    df = expected_touchdowns(t.panel)
    return df.select(*ID, "expected_rush_tds", "expected_rec_tds", "expected_pass_tds", regressed(F.col("rushing_tds"), F.coalesce("expected_rush_tds", F.lit(0.0))).alias("regressed_rush_tds"))


@query("X21_draft_capital", """WITH d AS (SELECT player_id,CAST(CASE draft_round WHEN 1 THEN 100-(draft_pick-1)*3 WHEN 2 THEN 70-(draft_pick-33)*2 WHEN 3 THEN 50-(draft_pick-65)*1.5 ELSE greatest(10,40-(draft_round-4)*10) END AS DOUBLE) AS draft_capital_score FROM drafted), e AS (SELECT *, CAST(floor(greatest(1,least(4,draft_capital_score/25))) AS INT) AS depth_chart_position FROM d)
 SELECT *, CASE WHEN draft_capital_score>=60 AND depth_chart_position<=2 THEN draft_capital_score*0.5+(5-depth_chart_position)*10 END AS upside_score FROM e""", "draft_capital_score upside_score", "drafted")
def _(t):
    from weekgrain.operators.fit import draft_capital
    return draft_capital(t.drafted).select("player_id", "draft_capital_score", "depth_chart_position", "upside_score")

"""Queries over context features: W27-W38, W45-W48, J13, J15, J19, X09, X10, X13, X19."""

from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions import exprs as X
from weekgrain.operators import context as CX
from weekgrain.operators import features as W
from weekgrain.operators import joins as J
from weekgrain.operators import plays as PL
from weekgrain.plans.q_features import ALLP, ID, PSW, PW, VOL, moments, pre
from weekgrain.plans.q_joins import GAMES
from weekgrain.plans.q_plays import DEF, KICK
from weekgrain.plans.registry import query

STR = """gv AS (SELECT opponent AS team,season,"position",avg(fantasy_points) AS m,count(*) AS games FROM panel GROUP BY ALL HAVING count(*)>=4), lg AS (SELECT season,"position",avg(fantasy_points) AS l FROM panel GROUP BY ALL),
 ds AS (SELECT team,season+1 AS season,"position",m AS pts_allowed_mean,games,greatest(0.5,least(1.5,m/l)) AS defense_strength,
 rank() OVER (PARTITION BY season,"position" ORDER BY round(m,9) DESC)+(count(*) OVER (PARTITION BY season,"position",round(m,9))-1)/2.0 AS defense_rank FROM gv JOIN lg USING (season,"position"))"""


@query("W27_defense_strength", f"WITH {STR} SELECT * FROM ds", "pts_allowed_mean defense_strength defense_rank")
def _(t):
    return CX.defense_strength(t.panel)


def sos_sql(frame):
    return f"""WITH {STR}, o AS (SELECT panel.*, coalesce(defense_strength,1.0) AS st FROM panel LEFT JOIN ds ON ds.team=panel.opponent AND ds.season=panel.season AND ds."position"=panel."position"),
 s AS (SELECT *, coalesce(avg(st) OVER ({PSW} {frame}),1.0) AS sos_next_5, coalesce(CAST(sum(CAST(st>1.1 AS INT)) OVER ({PSW} {frame}) AS BIGINT),2) AS favorable_matchups_next_5 FROM o)
 SELECT player_id,season,"week",sos_next_5,favorable_matchups_next_5,rank() OVER (PARTITION BY season,"week","position" ORDER BY round(sos_next_5,9) DESC)+(count(*) OVER (PARTITION BY season,"week","position",round(sos_next_5,9))-1)/2.0 AS sos_rank_next_5 FROM s"""


@query("W27_schedule_strength", sos_sql("ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"), "sos_next_5 sos_rank_next_5")
def _(t):
    return CX.schedule_strength(t.panel, 5).select(*ID, "sos_next_5", "favorable_matchups_next_5", "sos_rank_next_5")


@query("W27_schedule_strength_serving", sos_sql("ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING"), "sos_next_5 sos_rank_next_5")
def _(t):
    return CX.schedule_strength(t.panel, 5, serving=True).select(*ID, "sos_next_5", "favorable_matchups_next_5", "sos_rank_next_5")


DVP = f"""a AS (SELECT opponent AS team,season,"week","position",sum(fantasy_points) AS points_allowed FROM panel GROUP BY ALL),
 r AS (SELECT *, avg(points_allowed) OVER (PARTITION BY team,"position" ORDER BY season,"week" {pre(4)}) AS defense_pts_allowed_roll4 FROM a),
 b AS (SELECT *, min(defense_pts_allowed_roll4) OVER (PARTITION BY "position" ORDER BY season,"week") AS lo,max(defense_pts_allowed_roll4) OVER (PARTITION BY "position" ORDER BY season,"week") AS hi FROM r),
 dvp AS (SELECT team,season,"week","position",points_allowed,defense_pts_allowed_roll4,coalesce(CASE WHEN hi>lo THEN (defense_pts_allowed_roll4-lo)/(hi-lo) END,0.5) AS matchup_score,
 CASE WHEN defense_pts_allowed_roll4 IS NOT NULL THEN rank() OVER (PARTITION BY season,"week","position" ORDER BY round(defense_pts_allowed_roll4,9) DESC NULLS LAST)+(count(*) OVER (PARTITION BY season,"week","position",round(defense_pts_allowed_roll4,9))-1)/2.0 END AS defense_rank FROM b)"""


@query("W28_defense_vs_position", f"WITH {DVP} SELECT * FROM dvp", "points_allowed defense_pts_allowed_roll4 matchup_score defense_rank")
def _(t):
    return CX.defense_vs_position(t.panel)


@query("J15_opponent_matchup", f"""WITH {DVP} SELECT player_id,panel.season,panel."week",CAST(defense_rank IS NOT NULL AND defense_pts_allowed_roll4 IS NOT NULL AS INT) AS defense_data_available,coalesce(defense_rank,16) AS opp_defense_rank,
 coalesce(matchup_score,0.5) AS opp_matchup_score,coalesce(defense_pts_allowed_roll4,CASE panel."position" WHEN 'QB' THEN 18.0 WHEN 'TE' THEN 10.0 ELSE 12.0 END) AS opp_pts_allowed
 FROM panel LEFT JOIN dvp ON dvp.team=panel.opponent AND dvp.season=panel.season AND dvp."week"+1=panel."week" AND dvp."position"=panel."position\"""", "opp_defense_rank opp_matchup_score opp_pts_allowed")
def _(t):
    return CX.with_opponent_matchup(t.panel, CX.defense_vs_position(t.panel)).select(*ID, "defense_data_available", "opp_defense_rank", "opp_matchup_score", "opp_pts_allowed")


ADJ = "fp_opp_adjusted fp_matchup_adjusted usage_matchup_interaction age_usage_interaction consistency_matchup_interaction"


@query("W42_adjusted_interactions", f"""WITH {DVP}, {STR}, {VOL}, h AS (SELECT *, 21+player_id%20 AS age,avg(fantasy_points) OVER ({PW} {pre(3)}) AS f3,lag(snap_count) OVER ({PW}) AS u FROM vo)
 SELECT player_id,h.season,h."week",fantasy_points/greatest(0.5,least(1.5,coalesce(defense_strength,1.0))) AS fp_opp_adjusted,f3*(1+(coalesce(matchup_score,0.5)-0.5)*0.2) AS fp_matchup_adjusted,u*coalesce(matchup_score,0.5) AS usage_matchup_interaction,
 CAST(age*u AS DOUBLE) AS age_usage_interaction,consistency_score*coalesce(matchup_score,0.5) AS consistency_matchup_interaction FROM h LEFT JOIN dvp ON dvp.team=h.opponent AND dvp.season=h.season AND dvp."week"+1=h."week" AND dvp."position"=h."position"
 LEFT JOIN ds ON ds.team=h.opponent AND ds.season=h.season AND ds."position"=h."position\"""", ADJ)
def _(t):
    p = W.lags(W.rolling_means(W.volatility(t.panel), ["fantasy_points"], [3]), ["snap_count"], [1]).withColumn("age", F.lit(21) + F.col("player_id") % 20)
    p = CX.with_opponent_matchup(p, CX.defense_vs_position(t.panel))
    s = CX.defense_strength(t.panel).select(F.col("team").alias("opponent"), "season", "position", F.col("defense_strength").alias("_s"))
    p = p.join(s, ["opponent", "season", "position"], "left").withColumn("opp_defense_strength", F.coalesce("_s", F.lit(1.0)))
    out = W.adjusted_interactions(p, "snap_count_lag1", "fantasy_points_roll3_mean")
    return out.select(*ID, *[F.col(c).cast("double").alias(c) for c in ADJ.split()])


EG = f"""sg AS (SELECT player_id,season,count(*)/17.0 AS r FROM panel GROUP BY ALL), gr AS (SELECT player_id,season,avg(r) OVER (PARTITION BY player_id ORDER BY season {ALLP}) AS gr FROM sg),
 eg AS (SELECT panel.*, coalesce(gr,CASE "position" WHEN 'QB' THEN 0.92 WHEN 'RB' THEN 0.82 WHEN 'WR' THEN 0.88 ELSE 0.9 END) AS games_rate FROM panel LEFT JOIN gr USING (player_id,season))"""


@query("W29_expected_games", f"WITH {EG} SELECT player_id,season,\"week\",games_rate,greatest(0,least(5,games_rate*5)) AS expected_games_next_5 FROM eg", "games_rate expected_games_next_5")
def _(t):
    return CX.expected_games(t.panel, 5).select(*ID, "games_rate", "expected_games_next_5")


@query("W30_multiweek_projection", f"""WITH {EG},{VOL}, wp AS (SELECT eg.player_id,eg.season,eg."week",eg."position",weekly_volatility,games_rate*5 AS g,
 coalesce(avg(eg.fantasy_points) OVER (PARTITION BY eg.player_id ORDER BY eg.season,eg."week" {pre(3)}),eg.fantasy_points) AS weekly_projection FROM eg JOIN vo USING (player_id,season,"week")), {moments('weekly_projection', ['"position"'], 'wp')},
 q AS (SELECT wp.*, weekly_projection*0.85+coalesce(mean,weekly_projection)*0.15 AS weekly_regressed, sqrt(weekly_volatility*weekly_volatility*g*(1+(g-1)*0.3)) AS std_5w FROM wp LEFT JOIN cs USING ("position",season,"week"))
 SELECT player_id,season,"week",weekly_regressed,weekly_regressed*g AS projection_5w,std_5w,CASE WHEN std_5w IS NOT NULL THEN greatest(0,weekly_regressed*g-1.28*std_5w) END AS floor_5w,weekly_regressed*g+1.28*std_5w AS ceiling_5w FROM q""",
       "weekly_regressed projection_5w std_5w floor_5w ceiling_5w")
def _(t):
    p = W.volatility(t.panel)
    p = W.rolling_means(p, ["fantasy_points"], [3])
    return CX.multiweek_projection(p, 5, "fantasy_points_roll3_mean").select(*ID, "weekly_regressed", "projection_5w", "std_5w", "floor_5w", "ceiling_5w")


@query("W31_injury_outlook", """WITH t AS (SELECT *, rushing_attempts+targets AS tc, CASE WHEN player_id%9=0 THEN 1 ELSE 0 END AS inj FROM panel), m AS (SELECT *, avg(tc) OVER (PARTITION BY season,"week","position") AS mt FROM t),
 p AS (SELECT *, greatest(0,least(0.5,CASE "position" WHEN 'QB' THEN 0.25 WHEN 'RB' THEN 0.45 WHEN 'WR' THEN 0.3 ELSE 0.28 END/17+greatest(-0.1,least(0.2,(tc-mt)*0.002))/17+inj*0.3)) AS weekly_injury_prob FROM m), q AS (SELECT *, 1-pow(1-weekly_injury_prob,5) AS p5 FROM p)
 SELECT player_id,season,"week",weekly_injury_prob,p5 AS injury_prob_next_5,weekly_injury_prob*5 AS expected_missed_games_5,p5/max(p5) OVER (PARTITION BY season,"week") AS injury_risk_score_5 FROM q""",
       "weekly_injury_prob injury_prob_next_5 expected_missed_games_5 injury_risk_score_5")
def _(t):
    p = t.panel.withColumn("inj", F.when(F.col("player_id") % 9 == 0, 1).otherwise(0))
    return CX.injury_outlook(p, 5, "inj").select(*ID, "weekly_injury_prob", "injury_prob_next_5", "expected_missed_games_5", "injury_risk_score_5")


IH = "injury_history_count injury_history_2yr same_bodypart_injuries days_since_last_injury avg_games_missed injury_prone_flag injury_history_risk_multiplier".split()


@query("W32_injury_history", """WITH ij AS (SELECT player_id,season,"week",substr(lower(injury_type),1,4) AS part,games_missed FROM injuries WHERE player_id IS NOT NULL), cur AS (SELECT player_id,season,"week",min(part) AS part FROM ij GROUP BY ALL),
 pc AS (SELECT panel.player_id,panel.season,panel."week",cur.part FROM panel LEFT JOIN cur USING (player_id,season,"week")),
 h AS (SELECT pc.player_id,pc.season,pc."week",count(ij.player_id) AS n,count(ij.player_id) FILTER (ij.season>=pc.season-2) AS n2,count(*) FILTER (ij.part=pc.part) AS same,max(ij.season*100+ij."week") AS last,avg(games_missed) AS missed
  FROM pc LEFT JOIN ij ON ij.player_id=pc.player_id AND (ij.season,ij."week")<(pc.season,pc."week") GROUP BY ALL),
 d AS (SELECT *, CASE WHEN last IS NULL THEN 365 ELSE greatest(0,(season-last//100)*365+CASE WHEN season=last//100 THEN "week"-last%100 ELSE "week"+17-last%100 END*7) END AS days FROM h)
 SELECT player_id,season,"week",n AS injury_history_count,n2 AS injury_history_2yr,same AS same_bodypart_injuries,days AS days_since_last_injury,coalesce(missed,0) AS avg_games_missed,CAST(n2>=3 AS INT) AS injury_prone_flag,
 least(3.0,1+n*0.1+same*0.3+CAST(n2>=3 AS INT)*0.2+CASE WHEN days<60 THEN 0.25 ELSE 0 END) AS injury_history_risk_multiplier FROM d""",
       "avg_games_missed injury_history_risk_multiplier", "panel injuries")
def _(t):
    return CX.injury_history(t.panel, t.injuries).select(*ID, *IH)


@query("W32_estimated_history", """WITH g AS (SELECT player_id,season,"position",count(*) AS games_played FROM panel GROUP BY ALL), m AS (SELECT *, greatest(CASE "position" WHEN 'QB' THEN 16 WHEN 'RB' THEN 14 ELSE 15 END-games_played,0) AS ms FROM g)
 SELECT player_id,season,games_played,CAST(ms>=4 AS INT) AS injury_history_count,CAST(ms>=8 AS INT) AS injury_prone_flag,CASE WHEN ms>=4 THEN CAST(ms AS DOUBLE) ELSE 0.0 END AS avg_games_missed,1+CAST(ms>=4 AS INT)*0.1+CAST(ms>=8 AS INT)*0.2 AS injury_history_risk_multiplier FROM m""",
       "avg_games_missed injury_history_risk_multiplier")
def _(t):
    g = t.panel.groupBy("player_id", "season", "position").agg(F.count(F.lit(1)).alias("games_played"))
    return CX.estimated_injury_history(g).drop("position")


def rec_case(i):
    out = "CASE"
    for word, v in C.RECOVERY.items():
        val = v[i] if i != 1 else "(" + str(v[1]) + ")[least(weeks_since_return,3)+1]"
        if word != "unknown":
            out += f" WHEN lower(injury_type) LIKE '%{word}%' THEN {val}"
        else:
            last = val
    return out + f" ELSE {last} END"


@query("W33_recovery", f"""WITH i AS (SELECT report_id,injury_type,games_missed-2 AS weeks_since_return,CAST(status IN ('Questionable','PROBABLE') AS INT) AS is_returning FROM injuries),
 r AS (SELECT *, CAST(CASE WHEN is_returning=0 THEN 1.0 WHEN weeks_since_return<0 THEN 0.0 ELSE {rec_case(1)} END AS DOUBLE) AS recovery_performance_pct,{rec_case(0)} AS typical_weeks_out,CAST(CASE WHEN is_returning=1 THEN {rec_case(2)} ELSE 0.0 END AS DOUBLE) AS reinjury_risk FROM i)
 SELECT *, CASE WHEN is_returning=1 THEN CAST(floor((1.0-recovery_performance_pct)*4+1e-9) AS INT) ELSE 0 END AS recovery_weeks_remaining,10.0*recovery_performance_pct*(1-reinjury_risk*0.5) AS adjusted_points FROM r""",
       "report_id recovery_performance_pct reinjury_risk adjusted_points", "injuries")
def _(t):
    i = t.injuries.select("report_id", "injury_type", (F.col("games_missed") - 2).alias("weeks_since_return"),
                          F.col("status").isin("Questionable", "PROBABLE").cast("int").alias("is_returning"))
    return CX.recovery_features(i).withColumn("adjusted_points", CX.discounted_for_recovery(F.lit(10.0), F.col("recovery_performance_pct"), F.col("reinjury_risk")))


HZ_RATE = "CASE \"position\" WHEN 'QB' THEN 0.16 WHEN 'RB' THEN 0.29 WHEN 'WR' THEN 0.25 ELSE 0.23 END"
HIGH = "CASE \"position\" WHEN 'RB' THEN 25 WHEN 'WR' THEN 12 WHEN 'TE' THEN 10 ELSE 45 END"
DANGER = "CASE \"position\" WHEN 'RB' THEN 30 WHEN 'WR' THEN 15 WHEN 'TE' THEN 12 ELSE 55 END"
AGER = f"CASE WHEN age<21 THEN 0.85 WHEN age>35 THEN 2.5 ELSE ({[float(v) for v in X.AGE_RISK]})[age-20] END"
HAZ = f"""hz0 AS (SELECT *, 21+player_id%20 AS age, rushing_attempts+targets AS ww, CASE WHEN (player_id+"week")%6=0 THEN 1 ELSE 0 END AS inj FROM panel),
 hz1 AS (SELECT *, sum(ww) OVER ({PSW}) AS sw, coalesce(sum(inj) OVER ({PW} {ALLP}),0) AS pi FROM hz0),
 hz2 AS (SELECT *, least(0.15,CAST(1.3 AS DOUBLE)/17*pow("week"/17.0,0.3)*{HZ_RATE}*17) AS bh,CAST({AGER} AS DOUBLE) AS ar,
  CASE WHEN ww>={DANGER} THEN 1.5 WHEN ww>={HIGH} THEN 1.2 ELSE 1.0 END*CASE WHEN sw>{HIGH}*17*1.2 THEN 1.3 WHEN sw>{HIGH}*17 THEN 1.15 ELSE 1.0 END AS wr FROM hz1),
 hz AS (SELECT *, least(0.25,bh*ar*wr*least(3.0,1+pi*0.1)) AS prob FROM hz2)"""


@query("W34_injury_hazard", f"""WITH {HAZ} SELECT player_id,season,"week",CAST(sw AS BIGINT) AS season_workload,CAST(pi AS BIGINT) AS prior_injuries,prob AS injury_prob_advanced,ar AS injury_age_risk,CAST(wr AS DOUBLE) AS injury_workload_risk,
 CASE WHEN prob>0.12 THEN 'high' WHEN prob>0.06 THEN 'medium' ELSE 'low' END AS injury_risk_level FROM hz""", "injury_prob_advanced injury_age_risk injury_workload_risk")
def _(t):
    p = t.panel.withColumns({"age": (F.lit(21) + F.col("player_id") % 20).cast("int"), "inj": F.when((F.col("player_id") + F.col("week")) % 6 == 0, 1).otherwise(0)})
    return CX.injury_hazard(p, "age", "inj").select(*ID, "season_workload", "prior_injuries", "injury_prob_advanced", "injury_age_risk", "injury_workload_risk", "injury_risk_level")


@query("X13_base_hazard", f"WITH {HAZ} SELECT DISTINCT \"position\",\"week\",bh AS base_hazard FROM hz2", "base_hazard")
def _(t):
    return t.panel.select("position", "week", X.base_hazard(F.col("position"), F.col("week")).alias("base_hazard")).distinct()


def age_case(table, shift=0):
    out = 'CASE "position"'
    for p, v in table.items():
        out += f" WHEN '{p}' THEN ({v})[least({len(v)},greatest(1,age{shift:+d}-20))]"
    return f"CAST({out} END AS DOUBLE)"


AGE = f"""ag AS (SELECT *, {age_case(X.AGE_FACTOR)} AS age_factor,{age_case(X.AGE_GAMES)} AS age_expected_games,{age_case(X.AGE_FACTOR, 1)} AS nf FROM drafted)"""


@query("X10_age_lookup", f"""WITH {AGE} SELECT player_id,age_factor,age_expected_games,(age_factor-nf)/age_factor AS decline_rate,age-CASE "position" WHEN 'QB' THEN 29 WHEN 'RB' THEN 24 WHEN 'WR' THEN 27 ELSE 28 END AS years_from_peak,
 CAST(CASE "position" WHEN 'QB' THEN age BETWEEN 26 AND 34 WHEN 'RB' THEN age BETWEEN 22 AND 27 WHEN 'WR' THEN age BETWEEN 24 AND 30 ELSE age BETWEEN 25 AND 31 END AS INT) AS is_in_prime FROM ag""",
       "age_factor age_expected_games decline_rate", "drafted")
def _(t):
    return CX.age_features(t.drafted).select("player_id", "age_factor", "age_expected_games", "decline_rate", "years_from_peak", "is_in_prime")


KN = X.DRAFT_CURVE
CURVE = "CASE WHEN draft_pick<=1 THEN 1.0 " + " ".join(
    f"WHEN draft_pick<={b[0]} THEN {a[1]}+(draft_pick-{a[0]})*CAST({(b[1] - a[1]) / (b[0] - a[0])!r} AS DOUBLE)" for a, b in zip(KN, KN[1:])) + " ELSE 0.1 END"


@query("X09_draft_value", f"SELECT player_id,draft_pick,CAST({CURVE} AS DOUBLE) AS draft_value FROM drafted", "draft_value", "drafted")
def _(t):
    return t.drafted.select("player_id", "draft_pick", X.piecewise_linear(F.col("draft_pick"), X.DRAFT_CURVE).alias("draft_value"))


@query("W35_games_projection", f"""WITH {AGE}, pj AS (SELECT panel.*, age_expected_games, row_number() OVER ({PW})-1 AS g, dense_rank() OVER (PARTITION BY panel.player_id ORDER BY season)-1 AS s FROM panel JOIN ag USING (player_id)),
 pp AS (SELECT *, CASE "position" WHEN 'QB' THEN 14.5 WHEN 'RB' THEN 12.8 WHEN 'WR' THEN 14.2 ELSE 13.8 END AS pm, CASE "position" WHEN 'QB' THEN 3.5 WHEN 'RB' THEN 4.2 WHEN 'WR' THEN 3.8 ELSE 3.9 END AS ps FROM pj),
 hh AS (SELECT *, CASE WHEN s>0 THEN least(1.0,g/(s*17.0)) ELSE CAST(pm AS DOUBLE)/17 END AS hg FROM pp), rr AS (SELECT *, 0.4*age_expected_games/17+0.4*hg+CAST(0.2 AS DOUBLE)*pm/17 AS rt FROM hh), ss AS (SELECT *, greatest(1,least(17,rt*17)) AS sg FROM rr)
 SELECT player_id,season,"week",hg AS historical_gpg,sg AS projected_games_season,greatest(0,least(17,sg-ps)) AS projected_games_floor,greatest(0,least(17,sg+ps)) AS projected_games_ceiling FROM ss""",
       "historical_gpg projected_games_season projected_games_floor projected_games_ceiling", "panel drafted")
def _(t):
    p = t.panel.join(t.drafted.select("player_id", "age"), "player_id")
    return CX.games_projection(CX.age_features(p)).select(*ID, "historical_gpg", "projected_games_season", "projected_games_floor", "projected_games_ceiling")


ARCH = """CASE "position" WHEN 'QB' THEN CASE WHEN draft_pick<=5 THEN 'elite' WHEN draft_round=1 THEN 'high' WHEN draft_round<=3 THEN 'mid' ELSE 'low' END
 WHEN 'RB' THEN CASE WHEN draft_round<=2 AND draft_pick<=50 THEN 'elite' WHEN draft_round<=3 THEN 'high' WHEN draft_round<=5 THEN 'mid' ELSE 'low' END
 WHEN 'WR' THEN CASE WHEN draft_pick<=15 THEN 'elite' WHEN draft_round<=2 THEN 'high' WHEN draft_round<=4 THEN 'mid' ELSE 'low' END
 ELSE CASE WHEN draft_round=1 THEN 'elite' WHEN draft_round<=3 THEN 'high' WHEN draft_round<=5 THEN 'mid' ELSE 'low' END END"""


def nest(table, key, i):
    return 'CASE "position"' + " ".join(f" WHEN '{p}' THEN CASE {key}" + " ".join(f" WHEN '{k}' THEN {v[i]}" for k, v in tt.items()) + " END" for p, tt in table.items()) + " END"


@query("W36_rookie_features", f"""WITH f AS (SELECT panel.player_id,panel.season,panel."week",panel."position",draft_round,draft_pick,CAST(season=min(season) OVER (PARTITION BY panel.player_id) AS INT) AS is_rookie FROM panel JOIN drafted USING (player_id)),
 a AS (SELECT *, CASE WHEN is_rookie=1 THEN {ARCH} ELSE 'mid' END AS rookie_archetype FROM f)
 SELECT player_id,season,"week",is_rookie,rookie_archetype,CAST(CASE WHEN is_rookie=1 THEN {nest(CX.ARCHETYPES, 'rookie_archetype', 0)} END AS DOUBLE) AS rookie_projected_ppg,CAST(CASE WHEN is_rookie=1 THEN {nest(CX.ARCHETYPES, 'rookie_archetype', 1)} END AS DOUBLE) AS rookie_projected_games,
 CASE WHEN is_rookie=1 THEN greatest(0,1-("week"-1)/10.0) ELSE 0.0 END AS rookie_weight FROM a""", "rookie_projected_ppg rookie_projected_games rookie_weight", "panel drafted")
def _(t):
    p = t.panel.join(t.drafted.select("player_id", "draft_round", "draft_pick"), "player_id")
    return CX.rookie_features(p).select(*ID, "is_rookie", "rookie_archetype", "rookie_projected_ppg", "rookie_projected_games", "rookie_weight")


TIER = "CASE WHEN draft_round=1 AND draft_pick<=10 THEN 'round_1_top10' WHEN draft_round=1 THEN 'round_1' WHEN draft_round=2 THEN 'round_2' ELSE 'round_3_plus' END"
RO = "opportunity_score rookie_draft_value rookie_breakout_prob rookie_bust_prob rookie_projected_ppg rookie_floor_ppg rookie_ceiling_ppg"


@query("W36_rookie_outlook", f"""WITH po AS (SELECT team,"position",sum(fantasy_points) AS p FROM panel GROUP BY ALL), te AS (SELECT team,sum(fantasy_points) AS t FROM panel GROUP BY ALL),
 op AS (SELECT team,"position",CASE WHEN t>0 THEN least(1.0,p/t*2) ELSE 0.5 END AS opportunity_score FROM po JOIN te USING (team)),
 r AS (SELECT player_id,d."position",draft_round,draft_pick,coalesce(opportunity_score,0.5) AS opportunity_score,CAST({CURVE} AS DOUBLE) AS rookie_draft_value,{TIER} AS tier FROM (SELECT *, CAST(player_id%25 AS INT) AS team FROM drafted) d LEFT JOIN op ON op.team=d.team AND op."position"=d."position"),
 s AS (SELECT *, {nest(CX.DRAFT_TIER_STATS, 'tier', 0)}*(0.8+opportunity_score*0.4) AS ppg,{nest(CX.DRAFT_TIER_STATS, 'tier', 1)} AS sd FROM r)
 SELECT player_id,opportunity_score,rookie_draft_value,least(0.6,CASE WHEN draft_pick<=10 THEN 0.35 WHEN draft_pick<=32 THEN 0.25 WHEN draft_pick<=64 THEN 0.15 WHEN draft_pick<=100 THEN 0.08 ELSE 0.03 END*CASE "position" WHEN 'RB' THEN 1.3 WHEN 'WR' THEN 1.0 WHEN 'TE' THEN 0.7 ELSE 0.9 END*(0.7+opportunity_score*0.6)) AS rookie_breakout_prob,
 CAST(least(0.7,CASE WHEN draft_pick<=10 THEN 0.15 WHEN draft_pick<=32 THEN 0.25 WHEN draft_pick<=64 THEN 0.35 WHEN draft_pick<=100 THEN 0.45 ELSE 0.55 END*CASE "position" WHEN 'TE' THEN 1.3 WHEN 'QB' THEN 1.2 WHEN 'WR' THEN 1.0 ELSE 0.9 END) AS DOUBLE) AS rookie_bust_prob,
 ppg AS rookie_projected_ppg,greatest(0,ppg-1.5*sd) AS rookie_floor_ppg,ppg+1.5*sd AS rookie_ceiling_ppg FROM s""", RO, "panel drafted")
def _(t):
    d = t.drafted.withColumn("team", (F.col("player_id") % 25).cast("int"))
    return CX.rookie_outlook(d, CX.opportunity_scores(t.panel)).select("player_id", *RO.split())


def metric(m, lines, lower):
    s = -1 if lower else 1
    e, g, a = (f"CAST({s * v} AS DOUBLE)" for v in lines)
    k = 10 if lower else 2
    v = f"({s}*{m})"
    return f"greatest(0,least(100,CASE WHEN {v}>={e} THEN 90+({v}-{e})*{k} WHEN {v}>={g} THEN 70+({v}-{g})/({e}-{g})*20 WHEN {v}>={a} THEN 50+({v}-{a})/({g}-{a})*20 ELSE greatest(10,50-({a}-{v})*{k}) END))"


def combine(pos):
    parts = [(m, w, metric(m, ln, m in CX.LOWER_IS_BETTER)) for m, w, ln in zip(CX.COMBINE_METRICS, CX.COMBINE_WEIGHTS[pos], CX.COMBINE_LINES[pos])]
    num = "+".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {e}*{w} END" for m, w, e in parts)
    den = "+".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE CAST({w} AS DOUBLE) END" for m, w, e in parts)
    return f"({num})/({den})"


COMB = "cb AS (SELECT *, CASE \"position\" " + " ".join(f"WHEN '{p}' THEN {combine(p)}" for p in CX.COMBINE_WEIGHTS) + """ END AS exact FROM drafted),
 cbs AS (SELECT *, round(exact+1e-9,1) AS combine_score, CASE WHEN exact>=85 THEN 'Elite' WHEN exact>=70 THEN 'Good' WHEN exact>=50 THEN 'Average' ELSE 'Below Average' END AS athleticism_grade FROM cb)"""


@query("W37_combine_score", f"WITH {COMB} SELECT player_id,combine_score,athleticism_grade FROM cbs", "combine_score", "drafted")
def _(t):
    return CX.combine_scores(t.drafted).select("player_id", "combine_score", "athleticism_grade")


@query("J13_combine_join", f"""WITH {COMB}, l AS (SELECT k,combine_score,athleticism_grade FROM (SELECT *, string_split(lower(player_name),' ')[-1] AS k,row_number() OVER (PARTITION BY string_split(lower(player_name),' ')[-1] ORDER BY player_name) AS rn FROM cbs WHERE player_id%4<>2 OR player_id%3=0) WHERE rn=1),
 j AS (SELECT panel.player_id,season,"week","position",combine_score AS cs,athleticism_grade AS g FROM panel LEFT JOIN l ON l.k=string_split(lower(name),' ')[-1])
 SELECT player_id,season,"week",coalesce(cs,avg(cs) OVER (PARTITION BY "position"),50.0) AS combine_score,coalesce(g,'Unknown') AS athleticism_grade FROM j""", "combine_score", "panel drafted")
def _(t):
    s = CX.combine_scores(t.drafted).where((F.col("player_id") % 4 != 2) | (F.col("player_id") % 3 == 0))
    return J.with_combine(t.panel, s).select(*ID, "combine_score", "athleticism_grade")


def _rookie_history(t):
    h = CX.combine_scores(t.drafted)
    ppg = t.panel.groupBy("player_id").agg(F.round(F.avg("fantasy_points"), 6).alias("ppg"), F.count(F.lit(1)).alias("games"))
    h = h.join(ppg, "player_id").withColumnRenamed("player_name", "name").withColumnRenamed("draft_season", "season")
    return h.select("player_id", "position", "draft_round", "draft_pick", "combine_score", "name", "season", "ppg", "games")


SIM = f"""WITH {COMB}, pg AS (SELECT player_id,round(avg(fantasy_points),6) AS ppg,count(*) AS games FROM panel GROUP BY ALL), h AS (SELECT cbs.*,ppg,games FROM cbs JOIN pg USING (player_id)),
 w AS (SELECT DISTINCT "position",draft_round,draft_pick,combine_score FROM cbs),
 s AS (SELECT w.*, h.player_name AS name,h.draft_season AS season,ppg,games,round(0.7*CASE abs(w.draft_round-h.draft_round) WHEN 0 THEN 1-least(0.5,abs(w.draft_pick-h.draft_pick)/50) WHEN 1 THEN 0.7-least(0.4,abs(w.draft_pick-h.draft_pick)/75)
  ELSE greatest(0.1,0.5-abs(w.draft_round-h.draft_round)*0.15-abs(w.draft_pick-h.draft_pick)/100) END+0.3*greatest(0,1-abs(w.combine_score-h.combine_score)/30),9) AS similarity FROM w JOIN h ON h."position"=w."position"),
 cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "position",draft_round,draft_pick,combine_score ORDER BY similarity DESC,name,season) AS _pos FROM s) WHERE _pos<=5)"""


@query("J19_comparable_rookies", SIM + " SELECT * EXCLUDE (_pos), _pos AS place FROM cp", "combine_score ppg similarity", "panel drafted")
def _(t):
    h = _rookie_history(t)
    want = CX.combine_scores(t.drafted)
    return CX.comparable_rookies(want, h).withColumnRenamed("_pos", "place")


@query("J19_comparable_projection", SIM + """ SELECT "position",draft_round,draft_pick,combine_score,avg(ppg) FILTER (ppg>0) AS ppg_from_comps,avg(games) AS games_from_comps,max(ppg) AS ceiling_from_comps,min(ppg) AS floor_from_comps FROM cp GROUP BY ALL""",
       "combine_score ppg_from_comps games_from_comps ceiling_from_comps floor_from_comps", "panel drafted")
def _(t):
    h = _rookie_history(t)
    want = CX.combine_scores(t.drafted)
    return CX.comparable_projection(CX.comparable_rookies(want, h))


def adp(rank):
    return 'CASE "position" ' + " ".join(f"WHEN '{p}' THEN CASE WHEN {rank}<={len(r)} THEN ({r})[CAST({rank} AS INT)] ELSE least(20,{r[-1]}+CAST(floor(({rank}-{len(r)})/3) AS INT)) END" for p, r in CX.ADP_ROUNDS.items()) + " END"


@query("W38_adp_features", f"""WITH f AS (SELECT *, avg(fantasy_points) OVER ({PSW} {pre(3)}) AS fm FROM panel), k AS (SELECT *, CASE WHEN fm IS NULL THEN count(*) OVER (PARTITION BY season,"week","position") ELSE rank() OVER (PARTITION BY season,"week","position" ORDER BY round(fm,9) DESC NULLS LAST) END AS position_rank FROM f),
 sm AS (SELECT player_id,season,"position",avg(fantasy_points) AS m FROM panel GROUP BY ALL), sp AS (SELECT *, lag(m) OVER (PARTITION BY player_id ORDER BY season) AS pm FROM sm), sr AS (SELECT player_id,season,rank() OVER (PARTITION BY season,"position" ORDER BY round(pm,9) DESC) AS srk FROM sp WHERE pm IS NOT NULL),
 z AS (SELECT k.*, coalesce(srk,first_value(position_rank) OVER (PARTITION BY k.player_id,k.season ORDER BY "week")) AS season_position_rank FROM k LEFT JOIN sr ON sr.player_id=k.player_id AND sr.season=k.season),
 y AS (SELECT *, {adp('season_position_rank')} AS estimated_adp_round,{adp('position_rank')} AS projected_adp_round FROM z)
 SELECT player_id,season,"week",position_rank,season_position_rank,estimated_adp_round,projected_adp_round,greatest(-1,least(1,(estimated_adp_round-projected_adp_round)/16.0))*CASE "position" WHEN 'QB' THEN 0.7 WHEN 'RB' THEN 1.0 WHEN 'WR' THEN 0.9 ELSE 0.8 END AS adjusted_adp_value FROM y""", "adjusted_adp_value")
def _(t):
    return CX.adp_features(t.panel).select(*ID, "position_rank", "season_position_rank", "estimated_adp_round", "projected_adp_round", "adjusted_adp_value")


def form(src, key, a, b, c):
    return f"""n AS (SELECT {key} AS player_id,team,season,"week",fantasy_points,row_number() OVER (PARTITION BY {key} ORDER BY season DESC,"week" DESC) AS rn FROM {src}),
 g AS (SELECT player_id,max(team) FILTER (rn=1) AS team,count(*) AS games_played,{a}*avg(fantasy_points) FILTER (rn<=4)+{b}*avg(fantasy_points) FILTER (rn<=8)+{c}*avg(fantasy_points) AS p,stddev_pop(fantasy_points) FILTER (rn<=8) AS sd FROM n GROUP BY ALL HAVING count(*)>=2)"""


@query("W45_kicker_projection", f"""WITH {KICK}, {form('kw', 'player_id', 0.5, 0.3, 0.2)} SELECT player_id,team,games_played,CASE WHEN team%2=0 THEN 'home' ELSE 'away' END AS home_away,p*CASE WHEN team%2=0 THEN 1.03 ELSE 1 END*4 AS predicted_points,sd*2 AS prediction_std FROM g""",
       "predicted_points prediction_std", "plays")
def _(t):
    sched = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("team"), F.when(F.col("n_nationkey") % 2 == 0, "home").otherwise("away").alias("home_away"))
    return CX.recent_form_projection(PL.kicker_weeks(t.plays), (0.5, 0.3, 0.2), 1.03, 4, sched)


@query("W45_defense_projection", f"""WITH {DEF}, {form('dw', 'player_id', 0.45, 0.35, 0.2)} SELECT player_id,team,games_played,p AS predicted_points,sd AS prediction_std FROM g""", "predicted_points prediction_std", "plays")
def _(t):
    return CX.recent_form_projection(PL.defense_weeks(t.plays), (0.45, 0.35, 0.2), 1.05)


@query("W46_upcoming_rows", f"""WITH {GAMES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC,"week" DESC) AS rn FROM panel) WHERE rn=1)
 SELECT player_id,l.team,name,2001 AS season,10 AS "week",l.season AS last_season,l."week" AS last_week,gm.opponent,CASE gm.is_home WHEN 1 THEN 'home' WHEN 0 THEN 'away' ELSE 'away' END AS home_away,fantasy_points
 FROM l JOIN gm ON gm.team=l.team AND gm.season=2001 AND gm."week"=10""", "fantasy_points", "panel schedule")
def _(t):
    up = CX.upcoming_rows(t.panel, 2001, 10, J.team_games(t.schedule)).where(F.col("opponent").isNotNull())
    return up.select("player_id", "team", "name", "season", "week", "last_season", "last_week", "opponent", "home_away", "fantasy_points")


PWR = """pwr AS (SELECT team,season+1 AS season,greatest(0,least(100,50+(avg(points_scored)-avg(points_allowed))*2+(avg(total_yards)-300)/10)) AS rating FROM team_week GROUP BY ALL),
 wd AS (SELECT gm.team,gm.season,gm."week",gm.opponent,is_home,coalesce(rating,50) AS opponent_rating,coalesce(rating,50)+CASE WHEN is_home=0 THEN 5 ELSE 0 END AS matchup_difficulty FROM gm LEFT JOIN pwr ON pwr.team=gm.opponent AND pwr.season=gm.season)"""


@query("W47_strength_of_schedule", f"""WITH {GAMES},{PWR}, s AS (SELECT season,team,avg(opponent_rating) AS sos_rating,count(*) AS num_games FROM wd GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(sos_rating,6) DESC,team) AS sos_rank FROM s""", "sos_rating", "panel schedule team_week")
def _(t):
    games = J.team_games(t.schedule)
    power = CX.team_power(t.team_week).withColumn("rating", F.round("rating", 9))
    return CX.strength_of_schedule(games, power)


@query("W47_weekly_difficulty", f"WITH {GAMES},{PWR} SELECT * FROM wd", "opponent_rating matchup_difficulty", "panel schedule team_week")
def _(t):
    return CX.weekly_difficulty(J.team_games(t.schedule), CX.team_power(t.team_week))


@query("W48_recent_subset", """SELECT player_id,name,team,"position",avg(fantasy_points) AS fantasy_points,avg(fantasy_points)*0.9 AS low,avg(fantasy_points)*1.1 AS high,
 CASE WHEN avg(fantasy_points)>=85 THEN 'elite' WHEN avg(fantasy_points)>=70 THEN 'high' WHEN avg(fantasy_points)>=50 THEN 'moderate' ELSE 'low' END AS tier FROM panel WHERE team IN (3,11) AND season=2000 AND "week" BETWEEN 8 AND 10 GROUP BY ALL""", "fantasy_points low high")
def _(t):
    return CX.recent_subset_average(t.panel, [3, 11], 2000, 10, "fantasy_points")


@query("X19_utilization_bands", "WITH s AS (SELECT player_id,season,\"week\",\"position\",fantasy_points*1.2 AS score FROM panel) SELECT player_id,season,\"week\",CASE WHEN score>=80 THEN 'Elite' WHEN score>=70 THEN 'Strong' WHEN score>=60 THEN 'Average' WHEN score>=50 THEN 'Below Average' ELSE 'Low' END AS tier,CAST(CASE \"position\" " +
       " ".join(f"WHEN '{p}' THEN CASE " + " ".join(f"WHEN score>={b[0]} AND score<{b[1]} THEN {b[3]}" for b in bands) + f" ELSE {bands[-1][3]} END" for p, bands in C.PPG_BANDS.items()) + " END AS DOUBLE) AS expected_ppg FROM s", "expected_ppg")
def _(t):
    score = F.col("fantasy_points") * 1.2
    return t.panel.select(*ID, X.utilization_tier(score).alias("tier"), X.expected_ppg(score, F.col("position"), 1).alias("expected_ppg"))

"""Queries over joins and team context: J01, J02, J06-J18, X03-X07, X14, X16, X17."""

from pyspark.sql import functions as F

from weekgrain.functions import calendar as CAL
from weekgrain.functions import exprs as X
from weekgrain.operators import context as CX
from weekgrain.operators import joins as J
from weekgrain.operators import plays as PL
from weekgrain.plans.q_features import ALLP, ID, PW, pre
from weekgrain.plans.registry import query

ALL4 = """al AS (SELECT opponent AS team,season,"week",coalesce(sum(fantasy_points) FILTER ("position"='QB'),0.0) AS fantasy_points_allowed_qb, coalesce(sum(fantasy_points) FILTER ("position"='RB'),0.0) AS fantasy_points_allowed_rb,
 coalesce(sum(fantasy_points) FILTER ("position"='WR'),0.0) AS fantasy_points_allowed_wr, coalesce(sum(fantasy_points) FILTER ("position"='TE'),0.0) AS fantasy_points_allowed_te FROM panel GROUP BY ALL)"""


@query("J01_training_panel", f"""WITH {ALL4}, st AS (SELECT player_id,season,"week",team,opponent,fantasy_points,snap_count FROM panel WHERE player_id % 7 <> 0 OR season < 1996),
 us AS (SELECT player_id,season,"week",targets AS usage FROM panel WHERE player_id % 5 <> 0), g AS (SELECT player_id FROM st GROUP BY 1 HAVING count(*)>=12)
 SELECT st.player_id,st.season,st."week",st.team,st.opponent,st.fantasy_points,s_name AS name,usage,points_scored AS team_points,total_yards AS team_yards,al."week" AS opp_defense_week,
 fantasy_points_allowed_qb,fantasy_points_allowed_rb,fantasy_points_allowed_wr,fantasy_points_allowed_te
 FROM st JOIN supplier ON s_suppkey=st.player_id LEFT JOIN us USING (player_id,season,"week") LEFT JOIN team_week tw ON tw.team=st.team AND tw.season=st.season AND tw."week"=st."week"
 LEFT JOIN al ON al.team=st.opponent AND al.season=st.season AND al."week"=st."week"-1 WHERE st.player_id IN (SELECT player_id FROM g)""",
       "fantasy_points team_points team_yards fantasy_points_allowed_qb fantasy_points_allowed_rb fantasy_points_allowed_wr fantasy_points_allowed_te", "panel team_week")
def _(t):
    p = t.panel
    stats = p.where((F.col("player_id") % 7 != 0) | (F.col("season") < 1996)).select(*ID, "team", "opponent", "fantasy_points")
    usage = p.where(F.col("player_id") % 5 != 0).select(*ID, F.col("targets").alias("usage"))
    players = t.raw("supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"))
    ts = t.team_week.select("team", "season", "week", F.col("points_scored").alias("team_points"), F.col("total_yards").alias("team_yards"))
    return J.training_panel(stats, players, usage, ts, PL.points_allowed_by_position(p), 12)


@query("F04_min_games", """WITH g AS (SELECT player_id FROM panel GROUP BY 1 HAVING count(*)>=83) SELECT player_id,season,"week" FROM panel WHERE player_id IN (SELECT player_id FROM g)""")
def _(t):
    return J.with_min_games(t.panel, 83).select(*ID)  # those who missed no week


STINT = """st AS (SELECT player_id,season,team,min("week") AS start_week,max("week") AS end_week FROM mv GROUP BY ALL)"""
MV = """mv AS (SELECT player_id,season,"week",(team+CASE WHEN "week">=7 AND (player_id+season)%3=0 THEN 7 ELSE 0 END)%25 AS team FROM panel)"""


def _mv(t):
    moved = F.when((F.col("week") >= 7) & ((F.col("player_id") + F.col("season")) % 3 == 0), 7).otherwise(0)
    return t.panel.withColumn("team", (F.col("team") + moved) % 25)


@query("J02_player_team_history", f"""WITH {MV},{STINT} SELECT mv.player_id,mv.season,mv."week",mv.team,s_name AS name,st.team AS stint_team,start_week,end_week FROM mv JOIN supplier ON s_suppkey=mv.player_id
 LEFT JOIN st ON st.player_id=mv.player_id AND st.season=mv.season WHERE mv.player_id=17""")
def _(t):
    p = _mv(t)
    players = t.raw("supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"))
    return J.player_history(p.select(*ID, "team"), players, J.stints_of(p), 17)


@query("J18_stint_interval", f"""WITH {MV},{STINT} SELECT panel.player_id,panel.season,panel."week",st.team AS stint_team,start_week,end_week FROM panel LEFT JOIN st
 ON st.player_id=panel.player_id AND st.season=panel.season AND panel."week" BETWEEN start_week AND end_week""")
def _(t):
    return J.within_stint(t.panel.select(*ID), J.stints_of(_mv(t)))


TM = ["points_scored", "points_allowed", "total_yards", "passing_yards", "rushing_yards", "turnovers"]
AVGS = "av AS (SELECT team,season+1 AS season," + ",".join(f"avg({c}) AS {c}" for c in TM) + " FROM team_week GROUP BY ALL)"
CTXC = [f"team_{s}_{c}" for s in "ab" for c in TM]


@query("J06_prior_season_context", f"WITH {AVGS} SELECT player_id,panel.season,\"week\"," + ",".join(f"{s}.{c} AS team_{s}_{c}" for s in "ab" for c in TM) +
       " FROM panel LEFT JOIN av a ON a.team=panel.team AND a.season=panel.season LEFT JOIN av b ON b.team=panel.opponent AND b.season=panel.season", " ".join(CTXC), "panel team_week")
def _(t):
    return J.prior_season_context(t.panel, t.team_week, TM).select(*ID, *CTXC)


INS = 'ins AS (SELECT team,season,"week",' + ",".join(
    f'CASE WHEN count({c}) OVER w>=2 THEN avg({c}) OVER w END AS i_{c}' for c in TM) + ' FROM team_week WINDOW w AS (PARTITION BY team,season ORDER BY "week" ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))'
BL = ("bl AS (SELECT player_id,panel.season,panel.\"week\"," + ",".join(
    f"CASE WHEN panel.\"week\">=5 AND i_{c} IS NOT NULL THEN 0.6*i_{c}+0.4*a.{c} ELSE a.{c} END AS team_a_{c}" for c in TM) + "," + ",".join(f"b.{c} AS team_b_{c}" for c in TM) +
      " FROM panel LEFT JOIN av a ON a.team=panel.team AND a.season=panel.season LEFT JOIN av b ON b.team=panel.opponent AND b.season=panel.season LEFT JOIN ins ON ins.team=panel.team AND ins.season=panel.season AND ins.\"week\"=panel.\"week\")")


@query("J07_in_season_blend", f"WITH {AVGS},{INS},{BL} SELECT player_id,season,\"week\"," + ",".join(f"team_a_{c}" for c in TM) + " FROM bl", " ".join(f"team_a_{c}" for c in TM), "panel team_week")
def _(t):
    df = J.blend_in_season(J.prior_season_context(t.panel, t.team_week, TM), t.team_week, TM)
    return df.select(*ID, *[f"team_a_{c}" for c in TM])


EDGE = "matchup_scoring_edge matchup_yards_diff matchup_pass_diff matchup_rush_diff expected_game_total expected_point_diff"


@query("J07_matchup_edges", f"""WITH {AVGS},{INS},{BL} SELECT player_id,season,"week",coalesce(team_a_points_scored-team_b_points_allowed,0) AS matchup_scoring_edge,coalesce(team_a_total_yards-team_b_total_yards,0) AS matchup_yards_diff,
 coalesce(team_a_passing_yards-team_b_passing_yards,0) AS matchup_pass_diff,coalesce(team_a_rushing_yards-team_b_rushing_yards,0) AS matchup_rush_diff,coalesce(team_a_points_scored+team_b_points_scored,44.0) AS expected_game_total,
 coalesce(team_a_points_scored-team_b_points_allowed,0) AS expected_point_diff,coalesce(team_a_turnovers,1.5) AS team_a_turnovers FROM bl""", EDGE + " team_a_turnovers", "panel team_week")
def _(t):
    df = J.matchup_edges(J.blend_in_season(J.prior_season_context(t.panel, t.team_week, TM), t.team_week, TM))
    return df.select(*ID, *EDGE.split(), "team_a_turnovers")


GAMES = """g0 AS (SELECT season,"week",home_team AS team,away_team AS opponent,1 AS is_home,spread_line AS spread,total_line AS game_total,div_game AS is_divisional,
 CAST(CAST(split_part(gametime,':',1) AS INT)>=20 OR lower(weekday) IN ('thursday','monday') AS INT) AS is_primetime,temp,wind,weather FROM schedule
 UNION ALL SELECT season,"week",away_team,home_team,0,-spread_line,total_line,div_game,CAST(CAST(split_part(gametime,':',1) AS INT)>=20 OR lower(weekday) IN ('thursday','monday') AS INT),temp,wind,weather FROM schedule),
 gm AS (SELECT * EXCLUDE (rn), (game_total-spread)/2 AS implied_team_total FROM (SELECT *, row_number() OVER (PARTITION BY season,"week",team ORDER BY is_home DESC,opponent,spread) AS rn FROM g0) WHERE rn=1)"""


@query("J08_team_games", f"WITH {GAMES} SELECT * FROM gm", "spread game_total temp wind implied_team_total", "schedule")
def _(t):
    return J.team_games(t.schedule)


@query("X14_betting_lines", f"""WITH {GAMES} SELECT player_id,panel.season,panel."week",coalesce(spread,0) AS spread,coalesce(game_total,46) AS game_total,coalesce(implied_team_total,23) AS implied_team_total,
 greatest(0.05,least(0.95,0.5-greatest(-14,least(14,coalesce(spread,0)))/28)) AS win_probability,CAST(coalesce(spread,0)<0 AS INT) AS is_favorite,least(0.5,abs(coalesce(spread,0))/20) AS blowout_risk
 FROM panel LEFT JOIN gm ON gm.team=panel.team AND gm.season=panel.season AND gm."week"=panel."week\"""", "spread game_total implied_team_total win_probability blowout_risk", "panel schedule")
def _(t):
    return J.with_lines(t.panel, J.team_games(t.schedule)).select(*ID, "spread", "game_total", "implied_team_total", "win_probability", "is_favorite", "blowout_risk")


@query("X16_weather", f"""WITH {GAMES}, w AS (SELECT player_id,panel.season,panel."week",temp,coalesce(wind,0) AS wind,weather,
 CAST(coalesce(CASE WHEN home_away='home' THEN panel.team ELSE panel.opponent END IN (1,2,8,10,12),false) AS INT) AS is_dome FROM panel LEFT JOIN gm ON gm.team=panel.team AND gm.season=panel.season AND gm."week"=panel."week")
 SELECT player_id,season,"week",is_dome,1-is_dome AS is_outdoor,CAST(coalesce(temp<35 AND is_dome=0,false) AS INT) AS is_cold_game,
 CAST(coalesce(regexp_matches(lower(weather),'rain|shower|precip|snow|sleet') AND is_dome=0,false) AS INT) AS is_rain_game,
 CASE WHEN is_dome=1 THEN 1.0 WHEN temp IS NOT NULL THEN greatest(0.3,1.0-CASE WHEN temp<35 THEN 0.15 WHEN temp<45 THEN 0.05 ELSE 0 END-CASE WHEN wind>20 THEN 0.15 WHEN wind>10 THEN 0.05 ELSE 0 END)
 ELSE 1-CASE WHEN "week">=14 THEN 0.3 WHEN "week"<=4 THEN 0.1 ELSE 0.05 END END AS weather_score FROM w""", "weather_score", "panel schedule")
def _(t):
    return J.with_weather(t.panel, J.team_games(t.schedule), [1, 2, 8, 10, 12]).select(*ID, "is_dome", "is_outdoor", "is_cold_game", "is_rain_game", "weather_score")


ROST = """ro AS (SELECT player_id,season,max_by(team,"week") AS team,max_by(name,"week") AS name,max_by("position","week") AS "position"
 FROM (SELECT player_id,season,"week",name,"position",(team+CASE WHEN (player_id+season)%4=0 THEN 3 ELSE 0 END)%25 AS team FROM panel WHERE (player_id*3+season)%11<>0) GROUP BY ALL)"""


def _rosters(t):
    p = t.panel.where((F.col("player_id") * 3 + F.col("season")) % 11 != 0)
    return J.season_teams(p.withColumn("team", (F.col("team") + F.when((F.col("player_id") + F.col("season")) % 4 == 0, 3).otherwise(0)) % 25))


@query("J09_roster_changes", f"""WITH {ROST}, b AS (SELECT coalesce(p.player_id,c.player_id) AS player_id,coalesce(p.name,c.name) AS name,coalesce(p."position",c."position") AS "position",p.team AS previous_team,c.team AS current_team
 FROM (SELECT * FROM ro WHERE season=1999) p FULL JOIN (SELECT * FROM ro WHERE season=2000) c ON p.player_id=c.player_id)
 SELECT *, CASE WHEN previous_team IS NULL THEN 'New Player' WHEN current_team IS NULL THEN 'Left League' ELSE 'Team Change' END AS change_type FROM b WHERE previous_team IS NULL OR current_team IS NULL OR previous_team<>current_team""")
def _(t):
    return J.roster_changes(_rosters(t), 1999, 2000, every_kind=True)


@query("J10_current_team", f"""WITH {ROST} SELECT l.player_id,l.season,l."week",coalesce(a.team,l.team) AS team,b.team AS team_next_season
 FROM panel l LEFT JOIN ro a ON a.player_id=l.player_id AND a.season=l.season+1 LEFT JOIN ro b ON b.player_id=l.player_id AND b.season=l.season+2""")
def _(t):
    return J.with_current_team(t.panel.select(*ID, "team"), _rosters(t))


AV = "CASE upper(trim(status)) WHEN 'OUT' THEN 0.0 WHEN 'DOUBTFUL' THEN 0.15 WHEN 'QUESTIONABLE' THEN 0.5 WHEN 'PROBABLE' THEN 0.85 WHEN 'IR' THEN 0.0 ELSE 1.0 END"


@query("J11_injury_status", f"""WITH a AS (SELECT player_id,season,"week",min({AV}) AS s FROM injuries WHERE player_id IS NOT NULL GROUP BY ALL), b AS (SELECT lower(player_name) AS nm,season,"week",min({AV}) AS s FROM injuries GROUP BY ALL)
 SELECT panel.player_id,panel.season,panel."week",coalesce(a.s,b.s,1.0) AS injury_score,CAST(coalesce(a.s,b.s,1.0)<1 AS INT) AS is_injured FROM panel LEFT JOIN a USING (player_id,season,"week") LEFT JOIN b ON b.nm=lower(panel.name) AND b.season=panel.season AND b."week"=panel."week\"""",
       "injury_score", "panel injuries")
def _(t):
    return J.with_injury_status(t.panel, t.injuries).select(*ID, "injury_score", "is_injured")


@query("X17_availability", f"SELECT status,{AV} AS score,count(*) AS n FROM injuries GROUP BY ALL", "score", "injuries")
def _(t):
    return t.injuries.groupBy("status", X.availability(F.col("status")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


DR = """dz AS (SELECT * FROM drafted WHERE player_id % 3 <> 0 UNION ALL SELECT * REPLACE (player_name||' Jr Smith' AS player_name) FROM drafted WHERE player_id % 6 = 0),
 f AS (SELECT lower(player_name) AS k,draft_round,draft_pick FROM (SELECT *, row_number() OVER (PARTITION BY lower(player_name) ORDER BY draft_season DESC,draft_pick) AS rn FROM dz) WHERE rn=1),
 l AS (SELECT k,draft_round,draft_pick FROM (SELECT *, string_split(lower(player_name),' ')[-1] AS k, row_number() OVER (PARTITION BY string_split(lower(player_name),' ')[-1] ORDER BY draft_season DESC,lower(player_name),draft_pick) AS rn FROM dz) WHERE rn=1),
 pn AS (SELECT *, CASE WHEN player_id%15=0 THEN 'Joe Smith' ELSE name END AS nm FROM panel)"""


@query("J12_draft_join", f"""WITH {DR} SELECT player_id,season,"week",coalesce(f.draft_round,l.draft_round,8) AS draft_round,coalesce(f.draft_pick,l.draft_pick,260) AS draft_pick,CAST(coalesce(f.draft_pick,l.draft_pick) IS NULL AS INT) AS is_undrafted
 FROM pn LEFT JOIN f ON f.k=lower(nm) LEFT JOIN l ON l.k=string_split(lower(nm),' ')[-1] AND length(l.k)>2""", "", "panel drafted")
def _(t):
    d = t.drafted
    extra = d.where(F.col("player_id") % 6 == 0).withColumn("player_name", F.concat("player_name", F.lit(" Jr Smith")))
    drafted = d.where(F.col("player_id") % 3 != 0).unionByName(extra)
    p = t.panel.withColumn("name", F.when(F.col("player_id") % 15 == 0, "Joe Smith").otherwise(F.col("name")))
    return J.with_draft(p, drafted).select(*ID, "draft_round", "draft_pick", "is_undrafted")


@query("J14_opponent_strength", """WITH gv AS (SELECT opponent AS team,season,"position",avg(fantasy_points) AS m,count(*) AS g FROM panel GROUP BY ALL HAVING count(*)>=4), lg AS (SELECT season,"position",avg(fantasy_points) AS l FROM panel GROUP BY ALL)
 SELECT player_id,panel.season,"week",CASE WHEN m IS NULL THEN 1.0 ELSE greatest(0.5,least(1.5,m/l)) END AS opp_defense_strength FROM panel LEFT JOIN (gv JOIN lg USING (season,"position")) d ON d.team=panel.opponent AND d.season+1=panel.season AND d."position"=panel."position\"""", "opp_defense_strength")
def _(t):
    return CX.with_opponent_strength(t.panel, CX.defense_strength(t.panel)).select(*ID, "opp_defense_strength")


@query("J16_predictions_actuals", """SELECT player_id,season,"week",predicted_points,fantasy_points FROM preds""", "predicted_points fantasy_points", "preds")
def _(t):
    p = t.predictions.select(*ID, "predicted_points")
    return J.predictions_with_actuals(p, t.panel).select(*ID, "predicted_points", "fantasy_points")


@query("J17_expert_join", """WITH e AS (SELECT upper(trim('  '||upper(s_name))) AS k,max(s_acctbal/400) AS pts FROM supplier WHERE s_suppkey%4<>1 GROUP BY ALL)
 SELECT preds.player_id,season,"week",predicted_points,fantasy_points,pts AS expert_pts FROM preds JOIN supplier ON s_suppkey=preds.player_id JOIN e ON e.k=upper(trim(s_name))""", "predicted_points fantasy_points expert_pts", "preds")
def _(t):
    s = t.raw("supplier")
    experts = s.where(F.col("s_suppkey") % 4 != 1).select(F.concat(F.lit("  "), F.upper("s_name")).alias("player_name"), (F.col("s_acctbal") / 400).alias("pts"))
    p = t.predictions.drop("name").join(s.select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name")), "player_id")
    return J.with_expert(p, experts).select(*ID, "predicted_points", "fantasy_points", "expert_pts")


# --- scalar functions ------------------------------------------------------------------
@query("X03_scoring_formats", """SELECT player_id,season,"week",fantasy_points-0.5*1*receptions AS half_ppr,fantasy_points-1.0*4*receptions AS standard_4w FROM panel""", "half_ppr standard_4w")
def _(t):
    fp, r = F.col("fantasy_points"), F.col("receptions")
    return t.panel.select(*ID, X.rescale_format(fp, r, "half_ppr").alias("half_ppr"), X.rescale_format(fp, r, "standard", 4).alias("standard_4w"))


@query("X04_names_and_ids", """WITH n AS (SELECT c_custkey, '  '||replace(c_name,'#',' Jr. ')||CASE WHEN c_custkey%2=0 THEN ' III' ELSE '' END AS nm FROM customer),
 m AS (SELECT *, trim(regexp_replace(lower(replace(replace(replace(replace(replace(replace(trim(nm),' Jr.',''),' Sr.',''),' III',''),' II',''),' IV',''),' V','')),'\\s+',' ','g')) AS norm FROM n)
 SELECT c_custkey,norm,CASE WHEN len(string_split(norm,' '))>=2 THEN substr(string_split(norm,' ')[1],1,3)||substr(string_split(norm,' ')[-1],1,4) ELSE substr(norm,1,7) END||'_rb' AS made_id FROM m""", "", "")
def _(t):
    nm = F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), F.lit(" Jr. ")), F.when(F.col("c_custkey") % 2 == 0, " III").otherwise(""))
    return t.raw("customer").select("c_custkey", X.normal_name(nm).alias("norm"), X.made_id(nm, F.lit("RB")).alias("made_id"))


@query("X05_team_codes", """WITH n AS (SELECT n_name,n_nationkey,(['Chicago Bears','packers','NYG','Oakland Raiders','Testville','kc',''])[n_nationkey%7+1] AS team FROM nation)
 SELECT n_nationkey,team,(['CHI','GB','NYG','LV','TES','KC',''])[n_nationkey%7+1] AS code FROM n""", "", "")
def _(t):
    names = F.array(*[F.lit(x) for x in ("Chicago Bears", "packers", "NYG", "Oakland Raiders", "Testville", "kc", "")])
    n = t.raw("nation").withColumn("team", F.element_at(names, (F.col("n_nationkey") % 7 + 1).cast("int")))
    return n.select("n_nationkey", "team", X.team_code(F.col("team")).alias("code"))


@query("X06_season_week_of_date", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
 SELECT CAST(d AS VARCHAR) AS day,CASE WHEN month(d)>=9 THEN year(d) ELSE year(d)-1 END AS season,
 greatest(1,least(18,CASE WHEN month(d)>=9 THEN ((weekofyear(d)-35)%18+18)%18+1 ELSE (weekofyear(d)+17)%18+1 END)) AS week_no FROM d""", "", "")
def _(t):
    d = t.raw("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    season, week = X.approx_season_week(F.col("d"))
    return d.select(F.col("d").cast("string").alias("day"), season.alias("season"), week.alias("week_no"))


X07 = """d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT d,CASE WHEN month(d)<=8 THEN year(d)-1 ELSE year(d) END AS season FROM d),
 k AS (SELECT *, make_date(season,9,1)+CAST((4-isodow(make_date(season,9,1))+7)%7 AS INT) AS st, make_date(season+1,9,1)+CAST((4-isodow(make_date(season+1,9,1))+7)%7 AS INT) AS st2 FROM s),
 cal AS (SELECT *, CAST(CASE WHEN d BETWEEN make_date(season+1,1,27) AND make_date(season+1,2,9) THEN 22 WHEN d BETWEEN make_date(season+1,1,19) AND make_date(season+1,1,26) THEN 21
  WHEN d BETWEEN make_date(season+1,1,17) AND make_date(season+1,1,19) THEN 20 WHEN d BETWEEN make_date(season+1,1,10) AND make_date(season+1,1,13) THEN 19 WHEN d<st THEN 0
  ELSE least(18,greatest(1,(d-st)//7+1)) END AS INT) AS wk, CAST(d>make_date(season+1,2,9) AND d<st2 AS INT) AS off_season FROM k)"""


@query("X07_calendar", f"""WITH {X07} SELECT CAST(d AS VARCHAR) AS "day",season,CAST(st AS VARCHAR) AS start_day,wk AS week_no,off_season,
 CASE WHEN wk<=0 THEN 'Preseason' WHEN wk=19 THEN 'Wild Card' WHEN wk=20 THEN 'Divisional Round' WHEN wk=21 THEN 'Conference Championships'
 WHEN wk=22 THEN 'Super Bowl '||(['XXVIII','XXIX','XXX','XXXI','XXXII','XXXIII','XXXIV','XXXV','XXXVI'])[season-1993] ELSE 'Week '||wk END AS label,
 CAST(1998>season OR (1998=season AND 5>=wk) AS INT) AS still_ahead FROM cal""", "", "")
def _(t):
    d = t.raw("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    day = F.col("d")
    s, w = CAL.season_of(day), CAL.week_of(day)
    return d.select(day.cast("string").alias("day"), s.alias("season"), CAL.season_start(s).cast("string").alias("start_day"), w.alias("week_no"),
                    CAL.is_off_season(day).cast("int").alias("off_season"), CAL.week_label(w, s).alias("label"),
                    CAL.is_current_or_future(F.lit(1998), F.lit(5), day).cast("int").alias("still_ahead"))


@query("X07_next_weeks", f"""WITH {X07}, f AS (SELECT d,CASE WHEN wk=22 OR d>make_date(season+1,2,9) THEN season+1 ELSE season END AS s0,CASE WHEN wk=22 OR d>make_date(season+1,2,9) THEN 1 ELSE greatest(wk,1) END AS w0 FROM cal)
 SELECT CAST(d AS VARCHAR) AS "day",CAST(s0+(w0-1+k)//22 AS INT) AS season,CAST((w0-1+k)%22+1 AS INT) AS "week" FROM f, (SELECT unnest([0,1,2,3]) AS k)""", "", "")
def _(t):
    d = t.raw("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("day"), F.explode(CAL.next_weeks(F.col("d"), 4)).alias("n")).select("day", "n.season", "n.week")

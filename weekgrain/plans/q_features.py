"""Queries over history features: W01-W26, W39-W44, X01-X02, X08, X18."""

from pyspark.sql import functions as F

from weekgrain.operators import features as W
from weekgrain.operators import plays as PL
from weekgrain.operators import targets as T
from weekgrain.plans.registry import query

ID = ["player_id", "season", "week"]
PW = 'PARTITION BY player_id ORDER BY season, "week"'
PSW = 'PARTITION BY player_id, season ORDER BY "week"'
ALLP = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def pre(n):
    return f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


BASE = """base AS (SELECT *, CASE WHEN rushing_attempts=0 THEN 0.0 ELSE rushing_yards/rushing_attempts END AS yards_per_carry,
 CASE WHEN targets=0 THEN 0.0 ELSE receiving_yards/targets END AS yards_per_target,
 CASE WHEN receptions=0 THEN 0.0 ELSE receiving_yards/receptions END AS yards_per_reception,
 CASE WHEN targets=0 THEN 0.0 ELSE receptions/targets END*100 AS catch_rate,
 CASE WHEN passing_attempts=0 THEN 0.0 ELSE completions/passing_attempts END*100 AS completion_pct,
 CASE WHEN passing_attempts=0 THEN 0.0 ELSE passing_yards/passing_attempts END AS yards_per_attempt,
 CASE WHEN passing_attempts=0 THEN 0.0 ELSE passing_tds/passing_attempts END*100 AS td_rate,
 CASE WHEN passing_attempts=0 THEN 0.0 ELSE interceptions/passing_attempts END*100 AS int_rate,
 rushing_attempts+receptions AS total_touches, rushing_yards+receiving_yards AS total_yards, rushing_tds+receiving_tds AS total_tds,
 rushing_attempts+targets AS opportunities, rushing_attempts*2+targets AS weighted_opportunities,
 CASE WHEN passing_attempts=0 THEN 0.0 ELSE air_yards/passing_attempts END AS air_yards_per_attempt,
 passing_tds/(CASE WHEN interceptions=0 THEN CAST(0.5 AS DOUBLE) ELSE interceptions END) AS td_int_ratio,
 CASE WHEN targets=0 THEN 0.0 ELSE air_yards/targets END AS average_depth_of_target,
 CAST(home_away='home' AS INT) AS is_home, "week"/18.0 AS season_week_pct,
 CASE WHEN rushing_tds+receiving_tds=0 THEN 0.0 ELSE (rushing_yards+receiving_yards)/(rushing_tds+receiving_tds) END AS yards_per_td FROM panel)"""
BASE_NEW = ("yards_per_carry yards_per_target yards_per_reception catch_rate completion_pct yards_per_attempt td_rate int_rate "
            "total_yards air_yards_per_attempt td_int_ratio average_depth_of_target season_week_pct yards_per_td")
BASE_INT = "total_touches total_tds opportunities weighted_opportunities is_home"


@query("W41_base_features", f"WITH {BASE} SELECT player_id,season,\"week\",{','.join((BASE_NEW + ' ' + BASE_INT).split())} FROM base", BASE_NEW)
def _(t):
    return W.base_features(t.panel).select(*ID, *BASE_NEW.split(), *BASE_INT.split())


# stand-ins for the columns of richer feeds
RICH = {"sacks": "interceptions+rushing_tds", "deep_pass_attempts": "passing_tds", "deep_pass_completions": "interceptions", "redzone_attempts": "redzone_targets",
        "redzone_completions": "passing_tds", "redzone_carries": "rushing_tds", "goal_line_carries": "rush_inside_10*2", "time_in_pocket": "CASE WHEN targets>3 THEN 2+completions/10.0 END",
        "fumbles_lost": "CASE WHEN interceptions>0 THEN receiving_tds END", "yards_after_contact": "air_yards", "broken_tackles": "receiving_tds", "yards_after_catch": "rushing_yards",
        "contested_catches": "targets_15_plus", "contested_targets": "receptions", "slot_snaps": "targets", "outside_snaps": "receptions", "routes_run": "targets+rushing_attempts",
        "route_diversity_score": "targets/7.0"}
RICH_SQL = "rich AS (SELECT *, " + ",".join(f"{v} AS {k}" for k, v in RICH.items()) + " FROM {0})"


def rich(p):
    return p.withColumns({k: F.expr(v) for k, v in RICH.items()})


BASE_OPT = {"deep_ball_pct": ("deep_pass_attempts", "passing_attempts", 100), "yac_per_carry": ("yards_after_contact", "rushing_attempts", 1), "broken_tackle_rate": ("broken_tackles", "rushing_attempts", 1),
            "yac_per_reception": ("yards_after_catch", "receptions", 1), "contested_catch_rate": ("contested_catches", "contested_targets", 1), "slot_pct": ("slot_snaps", "snap_count", 100),
            "route_participation_rate": ("routes_run", "snap_count", 1)}


@query("W41_optional_ratios", f"WITH {RICH_SQL.format('panel')} SELECT player_id,season,\"week\"," + ",".join(f"CASE WHEN {d}=0 THEN 0.0 ELSE {n}/{d} END*{k} AS {c}" for c, (n, d, k) in BASE_OPT.items()) + " FROM rich", " ".join(BASE_OPT))
def _(t):
    return W.base_features(rich(t.panel)).select(*ID, *BASE_OPT)


@query("X01_safe_divide", 'SELECT player_id,season,"week",CASE WHEN rushing_attempts=0 THEN -1.0 ELSE rushing_yards/rushing_attempts END AS ratio FROM panel', "ratio")
def _(t):
    from weekgrain.functions.exprs import safe_divide
    return t.panel.select(*ID, safe_divide(F.col("rushing_yards"), F.col("rushing_attempts"), -1.0).alias("ratio"))


@query("X02_fantasy_points", """SELECT player_id,season,"week",
 passing_yards*0.04+passing_tds*4-interceptions*2+rushing_yards*0.1+rushing_tds*6+receptions+receiving_yards*0.1+receiving_tds*6 AS ppr,
 passing_yards*0.04+passing_tds*4-interceptions*2+rushing_yards*0.1+rushing_tds*6+receptions*0.5+receiving_yards*0.1+receiving_tds*6 AS half_ppr,
 passing_yards*0.04+passing_tds*4-interceptions*2+rushing_yards*0.1+rushing_tds*6+receiving_yards*0.1+receiving_tds*6 AS standard FROM panel""", "ppr half_ppr standard")
def _(t):
    from weekgrain.functions.exprs import fantasy_points
    p = t.panel
    return p.select(*ID, *[fantasy_points(p.columns, f).alias(f) for f in ("ppr", "half_ppr", "standard")])


ROLL = ("fantasy_points rushing_yards rushing_attempts rushing_tds receiving_yards receptions targets receiving_tds passing_yards "
        "passing_attempts passing_tds interceptions total_touches total_yards opportunities yards_per_carry yards_per_target catch_rate").split()
WINS = (3, 4, 5, 8, 12)
ROLLN = [f"{c}_roll{n}_mean" for n in WINS for c in ROLL]


@query("W01_rolling_mean", f"WITH {BASE} SELECT player_id,season,\"week\"," + ",".join(
    f"avg({c}) OVER ({PW} {pre(n)}) AS {c}_roll{n}_mean" for n in WINS for c in ROLL) + " FROM base", " ".join(ROLLN))
def _(t):
    return W.rolling_means(W.base_features(t.panel), ROLL).select(*ID, *ROLLN)


STD = ["fantasy_points", "total_yards", "total_touches"]
STDN = [f"{c}_roll{n}_std" for n in WINS for c in STD]


@query("W02_rolling_std", f"WITH {BASE} SELECT player_id,season,\"week\"," + ",".join(
    f"CASE WHEN count({c}) OVER ({PW} {pre(n)})>=2 THEN stddev_samp({c}) OVER ({PW} {pre(n)}) END AS {c}_roll{n}_std" for n in WINS for c in STD) + " FROM base", " ".join(STDN))
def _(t):
    return W.rolling_stds(W.base_features(t.panel), STD).select(*ID, *STDN)


EWM = ["fantasy_points", "total_yards", "opportunities"]
EWMN = [f"{c}_ewm{s}" for c in EWM for s in (3, 5, 8)]


def ewm_sql(c, s):
    a = 2.0 / (s + 1)
    return (f"CASE WHEN count({c}) OVER ({PW} {ALLP})>0 THEN list_reduce(list(CAST({c} AS DOUBLE)) OVER ({PW} {ALLP}), "
            f"lambda acc, x: acc*(CAST(1 AS DOUBLE)-CAST({a!r} AS DOUBLE))+x*CAST({a!r} AS DOUBLE)) END")


@query("W03_ewm", f"WITH {BASE} SELECT player_id,season,\"week\"," + ",".join(f"{ewm_sql(c, s)} AS {c}_ewm{s}" for c in EWM for s in (3, 5, 8)) + " FROM base", " ".join(EWMN))
def _(t):
    return W.ewm_means(W.base_features(t.panel), EWM).select(*ID, *EWMN)


def moments(col, groups, src="panel", name="cs"):
    """Expanding stats over strictly earlier periods, as a CTE."""
    g = "".join(f"{x}," for x in groups)
    gw = f"PARTITION BY {','.join(groups)} " if groups else ""
    w = f'OVER ({gw}ORDER BY season, "week" {ALLP})'
    return (f'{name}0 AS (SELECT {g}season,"week",count({col}) AS n,sum(CAST({col} AS DOUBLE)) AS s,sum(CAST({col} AS DOUBLE)*{col}) AS q,min({col}) AS lo,max({col}) AS hi FROM {src} GROUP BY ALL),'
            f'{name} AS (SELECT {g}season,"week",sum(n) {w} AS n,sum(s) {w}/sum(n) {w} AS mean,'
            f'CASE WHEN sum(n) {w}>=2 THEN sqrt(greatest((sum(q) {w}-sum(s) {w}*sum(s) {w}/sum(n) {w})/(sum(n) {w}-1),0)) END AS std,min(lo) {w} AS lo,max(hi) {w} AS hi FROM {name}0)')


@query("W04_regression_to_mean", f"""WITH {moments('fantasy_points', ['"position"'])}, e AS (SELECT *, {ewm_sql('fantasy_points', 8)} AS e8 FROM panel)
 SELECT player_id,season,"week",e8-mean AS fp_deviation_from_pos_mean,(e8-mean)/greatest(std,1.0) AS fp_regression_to_mean_z FROM e LEFT JOIN cs USING ("position",season,"week")""",
       "fp_deviation_from_pos_mean fp_regression_to_mean_z")
def _(t):
    return W.regression_to_mean(t.panel).select(*ID, "fp_deviation_from_pos_mean", "fp_regression_to_mean_z")


@query("W05_season_to_date", f"""WITH a AS (SELECT *, avg(fantasy_points) OVER ({PSW} {ALLP}) AS season_to_date_ppg FROM panel)
 SELECT player_id,season,"week",season_to_date_ppg,lag(season_to_date_ppg) OVER ({PW}) AS prev_season_ppg FROM a""", "season_to_date_ppg prev_season_ppg")
def _(t):
    return W.season_to_date(t.panel).select(*ID, "season_to_date_ppg", "prev_season_ppg")


LAG = ["fantasy_points", "total_yards", "total_touches", "total_tds"]


@query("W06_lags", f"WITH {BASE} SELECT player_id,season,\"week\"," + ",".join(f"lag({c},{k}) OVER ({PW}) AS {c}_lag{k}" for k in (1, 2, 3, 4) for c in LAG) + " FROM base",
       " ".join(f"{c}_lag{k}" for k in (1, 2, 3, 4) for c in LAG[:2]))
def _(t):
    return W.lags(W.base_features(t.panel), LAG).select(*ID, *[f"{c}_lag{k}" for k in (1, 2, 3, 4) for c in LAG])


TRN = [f"{c}_trend{n}" for c in LAG[:2] for n in (3, 5, 8)]


@query("W07_trend_slope", f"WITH {BASE}, r AS (SELECT *, row_number() OVER ({PW}) AS rn FROM base) SELECT player_id,season,\"week\"," + ",".join(
    f"CASE WHEN count({c}) OVER ({PW} {pre(n)})>=2 THEN regr_slope({c},rn) OVER ({PW} {pre(n)}) END AS {c}_trend{n}" for c in LAG[:2] for n in (3, 5, 8)) + " FROM r", " ".join(TRN))
def _(t):
    return W.trends(W.base_features(t.panel), LAG[:2]).select(*ID, *TRN)


WOW = [f"{c}_wow_{k}" for c in LAG[:2] for k in ("change", "pct_change")]


@query("W08_week_over_week", f"WITH {BASE}, l AS (SELECT *," + ",".join(f"lag({c},1) OVER ({PW}) AS {c}1, lag({c},2) OVER ({PW}) AS {c}2" for c in LAG[:2]) + " FROM base) SELECT player_id,season,\"week\"," + ",".join(
    f"{c}1-{c}2 AS {c}_wow_change, CASE WHEN {c}2<>0 THEN {c}1/{c}2-1 END AS {c}_wow_pct_change" for c in LAG[:2]) + " FROM l", " ".join(WOW))
def _(t):
    return W.week_over_week(W.base_features(t.panel), LAG[:2]).select(*ID, *WOW)


ALLOWED = """al AS (SELECT opponent AS team,season,"week",coalesce(sum(fantasy_points) FILTER ("position"='QB'),0.0) AS qb, coalesce(sum(fantasy_points) FILTER ("position"='RB'),0.0) AS rb,
 coalesce(sum(fantasy_points) FILTER ("position"='WR'),0.0) AS wr, coalesce(sum(fantasy_points) FILTER ("position"='TE'),0.0) AS te FROM panel GROUP BY ALL),
pj AS (SELECT panel.*, qb, rb, wr, te FROM panel LEFT JOIN al ON al.team=panel.opponent AND al.season=panel.season AND al."week"+1=panel."week")"""
ZN = [f"fantasy_points_allowed_{p}_zscore" for p in ("qb", "rb", "wr", "te")]


@query("W09_opponent_zscore", f"WITH {ALLOWED}," + ",".join(moments(p, [], "pj", f"c{p}") for p in ("qb", "rb", "wr", "te")) + ' SELECT player_id,season,"week",' + ",".join(
    f"(pj.{p}-c{p}.mean)/greatest(c{p}.std,1e-6) AS fantasy_points_allowed_{p}_zscore" for p in ("qb", "rb", "wr", "te")) +
    ", CASE \"position\" WHEN 'QB' THEN qb WHEN 'RB' THEN rb WHEN 'WR' THEN wr WHEN 'TE' THEN te END AS opp_fpts_allowed FROM pj " + " ".join(
    f'LEFT JOIN c{p} USING (season,"week")' for p in ("qb", "rb", "wr", "te")), " ".join(ZN) + " opp_fpts_allowed")
def _(t):
    return W.opponent_zscores(t.panel, PL.points_allowed_by_position(t.panel)).select(*ID, *ZN, "opp_fpts_allowed")


TM = ["points_scored", "total_yards", "passing_yards", "rushing_yards", "turnovers"]
TW = 'PARTITION BY team, season ORDER BY "week"'


@query("W10_team_rolling", 'SELECT team,season,"week",' + ",".join(
    f"CASE WHEN count({c}) OVER ({TW} {pre(4)})>=2 THEN avg({c}) OVER ({TW} {pre(4)}) END AS inseason_{c}" for c in TM) + " FROM team_week",
       " ".join(f"inseason_{c}" for c in TM), "team_week")
def _(t):
    return W.team_rolling(t.team_week, TM).select("team", "season", "week", *[f"inseason_{c}" for c in TM])


def mom(c):
    def part(a, b, k):
        return f"coalesce(avg({c}) OVER ({TW} ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)*{k},0)"
    return f"CASE WHEN count(*) OVER ({TW} {ALLP})>0 THEN {part(4, 1, 0.6)}+{part(8, 5, 0.3)}+{part('UNBOUNDED', 9, 0.1)} END"


MP = {"points_scored": 0.5, "passing_yards": 0.2, "rushing_yards": 0.15, "turnovers": -0.15}


def tz(c):
    return f"coalesce(CASE WHEN count({c}) OVER ({TW} {ALLP})>=2 THEN ({c}-avg({c}) OVER ({TW} {ALLP}))/greatest(stddev_samp({c}) OVER ({TW} {ALLP}),1e-6) END,0)"


@query("W11_team_momentum", "WITH m AS (SELECT *," + ",".join(f"{mom(c)} AS m_{c}" for c in MP) + " FROM team_week), z AS (SELECT *," + "+".join(f"{tz('m_' + c)}*({k})" for c, k in MP.items()) +
    f" AS mm FROM m) SELECT team,season,\"week\",greatest(0,least(44,coalesce(CASE WHEN count(mm) OVER ({TW} {ALLP})>=2 THEN 22+8*(mm-avg(mm) OVER ({TW} {ALLP}))/greatest(stddev_samp(mm) OVER ({TW} {ALLP}),1e-6) END,22.0))) AS offensive_momentum_score FROM z",
       "offensive_momentum_score", "team_week")
def _(t):
    return W.team_momentum(t.team_week).select("team", "season", "week", "offensive_momentum_score")


@query("W12_rest_features", f"""WITH g AS (SELECT *, "week"-lag("week") OVER ({PW}) AS gap FROM panel), d AS (SELECT *, greatest(coalesce(gap,1),1)*7.0 AS days FROM g)
 SELECT player_id,season,"week",CAST(coalesce(gap>1,false) AS INT) AS post_bye,CAST(days AS DOUBLE) AS days_since_last_game,CAST(days<=4 AS INT) AS short_week,
 CAST(greatest(-4.0,least(7.0,days-7)) AS DOUBLE) AS rest_advantage FROM d""", "days_since_last_game rest_advantage")
def _(t):
    return W.rest_features(t.panel).select(*ID, "post_bye", "days_since_last_game", "short_week", "rest_advantage")


def _moving(t):
    """Panel in which players change team now and then, with a team pass rate."""
    p = t.panel.withColumn("team", (F.col("team") + F.when((F.col("season") + F.floor(F.col("week") / 5)) % 3 == 0, 7).otherwise(0)) % 25)
    rate = F.when(F.col("passing_attempts") + F.col("rushing_attempts") > 0,
                  F.col("passing_attempts") / (F.col("passing_attempts") + F.col("rushing_attempts")))
    return p.withColumn("team_a_pass_rate", rate)


MOVING = """mv AS (SELECT player_id,season,"week","position",fantasy_points,(team+CASE WHEN (season+"week"//5)%3=0 THEN 7 ELSE 0 END)%25 AS team,
 CASE WHEN passing_attempts+rushing_attempts>0 THEN passing_attempts/(passing_attempts+rushing_attempts) END AS pr FROM panel)"""


@query("W13_team_change", f"""WITH {MOVING}, f AS (SELECT *, CAST(coalesce(team<>lag(team) OVER ({PW}),false) AS INT) AS team_changed,
 CAST(coalesce(season<>lag(season) OVER ({PW}),false) AS INT) AS new_season, coalesce(pr-lag(pr) OVER ({PW}),0) AS d FROM mv),
 s AS (SELECT *, sum(greatest(team_changed,new_season)) OVER ({PW}) AS stint,
 CASE WHEN pr IS NULL THEN 0.5 ELSE least(1,abs(pr-CASE "position" WHEN 'QB' THEN 0.6 WHEN 'WR' THEN 0.6 WHEN 'TE' THEN 0.58 WHEN 'RB' THEN 0.45 END)/0.6) END AS mm FROM f)
 SELECT player_id,season,"week",team_changed,new_season,CAST(row_number() OVER (PARTITION BY player_id,stint ORDER BY season,"week") AS INT) AS weeks_on_team,
 d AS team_pass_rate_delta,d*team_changed AS team_change_pass_rate_delta,1-mm AS scheme_fit_score,mm AS scheme_mismatch,mm*team_changed AS scheme_mismatch_on_change,
 CASE WHEN team_changed=1 THEN coalesce(lag(fantasy_points) OVER ({PW}),0) ELSE 0.0 END AS team_change_recent_util FROM s""",
       "team_pass_rate_delta team_change_pass_rate_delta scheme_fit_score scheme_mismatch scheme_mismatch_on_change team_change_recent_util")
def _(t):
    p = W.lags(_moving(t), ["fantasy_points"], [1])
    return W.team_change_features(p, "team_a_pass_rate", "fantasy_points_lag1").select(
        *ID, "team_changed", "new_season", "weeks_on_team", "team_pass_rate_delta", "team_change_pass_rate_delta", "scheme_fit_score",
        "scheme_mismatch", "scheme_mismatch_on_change", "team_change_recent_util")


@query("W14_game_script", """WITH g AS (SELECT passer_player_id AS player_id,season,"week",avg(CAST(coalesce(wp<CAST(0.1 AS DOUBLE) OR wp>CAST(0.9 AS DOUBLE),false) AS INT)) AS garbage_time_pct FROM plays WHERE passer_player_id IS NOT NULL GROUP BY ALL)
 SELECT *, greatest(0.5,least(1.0,1-0.5*garbage_time_pct)) AS game_script_factor, 1-garbage_time_pct AS competitive_snaps_pct FROM g""",
       "garbage_time_pct game_script_factor competitive_snaps_pct", "plays")
def _(t):
    return W.with_game_script(W.garbage_from_plays(t.plays, "passer_player_id"))


@query("W14_game_script_by_margin", """WITH g AS (SELECT team,season,"week",points_scored-points_allowed AS margin FROM team_week)
 SELECT *, CASE WHEN abs(margin)>=28 THEN 0.35 WHEN abs(margin)>=21 THEN 0.25 WHEN abs(margin)>=14 THEN 0.15 WHEN abs(margin)>=7 THEN 0.05 ELSE 0.0 END AS garbage_time_pct,
 1-0.5*CASE WHEN abs(margin)>=28 THEN 0.35 WHEN abs(margin)>=21 THEN 0.25 WHEN abs(margin)>=14 THEN 0.15 WHEN abs(margin)>=7 THEN 0.05 ELSE 0.0 END AS game_script_factor,
 1-CASE WHEN abs(margin)>=28 THEN 0.35 WHEN abs(margin)>=21 THEN 0.25 WHEN abs(margin)>=14 THEN 0.15 WHEN abs(margin)>=7 THEN 0.05 ELSE 0.0 END AS competitive_snaps_pct FROM g""",
       "margin garbage_time_pct game_script_factor competitive_snaps_pct", "team_week")
def _(t):
    tw = t.team_week.select("team", "season", "week", F.round(F.col("points_scored") - F.col("points_allowed"), 6).alias("margin"))
    return W.with_game_script(tw, "margin", final=True)


@query("W15_matchup_quality", f"""WITH b AS (SELECT *, CAST(home_away='home' AS INT) AS is_home, CAST(passing_attempts+rushing_attempts AS DOUBLE) AS pace FROM panel),
 {moments('air_yards', [], 'b', 'c1')},{moments('passing_yards', [], 'b', 'c2')},{moments('pace', [], 'b', 'c3')},
 r AS (SELECT b.*, is_home*0.15+coalesce((air_yards-c1.mean)/greatest(c1.std,0.1),0)*0.35+coalesce((passing_yards-c2.mean)/greatest(c2.std,0.1),0)*0.3+coalesce((pace-c3.mean)/greatest(c3.std,0.1),0)*0.2 AS raw
  FROM b LEFT JOIN c1 USING (season,"week") LEFT JOIN c2 USING (season,"week") LEFT JOIN c3 USING (season,"week")), {moments('raw', [], 'r', 'c4')}
 SELECT player_id,season,"week",greatest(0,least(100,coalesce(CASE WHEN c4.hi-c4.lo>0 THEN (raw-c4.lo)/(c4.hi-c4.lo)*100 END,50))) AS matchup_quality_indicator FROM r LEFT JOIN c4 USING (season,"week")""",
       "matchup_quality_indicator")
def _(t):
    p = t.panel.withColumns({"is_home": (F.col("home_away") == "home").cast("int"),
                             "pace": (F.col("passing_attempts") + F.col("rushing_attempts")).cast("double")})
    return W.matchup_quality(p, "air_yards", "passing_yards", "pace").select(*ID, "matchup_quality_indicator")


BB = {p: (40, 10) for p in ("QB", "RB", "WR", "TE")}


@query("W16_boom_bust", f"""WITH l AS (SELECT *, lag(fantasy_points) OVER ({PW}) AS f1 FROM panel), g AS (SELECT *, CAST(coalesce(f1>=40,false) AS DOUBLE) AS bo, CAST(coalesce(f1<10,false) AS DOUBLE) AS bu FROM l)
 SELECT player_id,season,"week",""" + ",".join(f"avg({a}) OVER ({PW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {b}_rate_roll{n}" for n in (4, 8) for a, b in (("bo", "boom"), ("bu", "bust"))) + " FROM g",
       "boom_rate_roll4 bust_rate_roll4 boom_rate_roll8 bust_rate_roll8")
def _(t):
    return W.boom_bust_rates(t.panel, thresholds=BB).select(*ID, *[f"{k}_rate_roll{n}" for n in (4, 8) for k in ("boom", "bust")])


@query("W17_experience", f"""WITH e AS (SELECT *, season-min(season) OVER (PARTITION BY player_id) AS x FROM panel)
 SELECT player_id,season,"week",x AS nfl_experience_years,CAST(x IN (3,4,7,8) AS INT) AS is_contract_year FROM e""")
def _(t):
    return W.experience_features(t.panel).select(*ID, "nfl_experience_years", "is_contract_year")


USE = "is_workhorse_rb is_committee_rb is_wr1 is_wr2 is_wr3 is_rz_specialist_te is_three_down_back".split()


@query("W18_usage_classes", f"""WITH s AS (SELECT *, snap_count/sum(snap_count) OVER (PARTITION BY team,season,"week") AS ss, rushing_attempts+receptions AS tt FROM panel),
 a AS (SELECT *, avg(tt) OVER ({PW} {pre(4)}) AS t, avg(targets) OVER ({PW} {pre(4)}) AS g, avg(receiving_tds) OVER ({PW} {pre(4)}) AS d, avg(ss) OVER ({PW} {pre(4)}) AS s4, avg(receptions) OVER ({PW} {pre(4)}) AS r FROM s)
 SELECT player_id,season,"week",CAST(coalesce("position"='RB' AND t>=15,false) AS INT) AS is_workhorse_rb,CAST(coalesce("position"='RB' AND t<15 AND t>=5,false) AS INT) AS is_committee_rb,
 CAST(coalesce("position"='WR' AND g>=7,false) AS INT) AS is_wr1,CAST(coalesce("position"='WR' AND g>=4 AND g<7,false) AS INT) AS is_wr2,CAST(coalesce("position"='WR' AND g<4 AND g>=1,false) AS INT) AS is_wr3,
 CAST(coalesce("position"='TE' AND d>=0.3,false) AS INT) AS is_rz_specialist_te,CAST(coalesce("position"='RB' AND s4>=0.5 AND r>=1.5,false) AS INT) AS is_three_down_back FROM a""")
def _(t):
    from weekgrain.operators.utilization import with_team_totals
    p = with_team_totals(W.base_features(t.panel)).withColumn("snap_share", F.col("snap_count") / F.col("team_snaps"))
    return W.usage_classes(p).select(*ID, *USE)


@query("W19_workload", f"""WITH a AS (SELECT panel.*, 21+player_id%20 AS age, coalesce(sum(rushing_attempts+receptions) OVER ({PW} {pre(3)}),0) AS w3, coalesce(sum(rushing_attempts+receptions) OVER ({PW} {pre(4)}),0) AS w4 FROM panel)
 SELECT player_id,season,"week",CAST(w3 AS BIGINT) AS cumulative_workload_3w,CAST(w4 AS BIGINT) AS cumulative_workload_4w,
 least(1.0,least(1.0,w4/CASE "position" WHEN 'RB' THEN 80 WHEN 'WR' THEN 40 WHEN 'TE' THEN 35 ELSE 120 END)*greatest(0.9,least(1.5,1+0.03*greatest(age-27,-3)))) AS workload_injury_risk,
 least(1.0,w4/100) AS workload_injury_risk_raw,least(1.0,coalesce(avg(interceptions+rushing_tds) OVER ({PW} {pre(4)}),0)/5.0) AS qb_sack_injury_risk FROM a""", "workload_injury_risk workload_injury_risk_raw qb_sack_injury_risk")
def _(t):
    p = W.base_features(t.panel).withColumns({"age": F.lit(21) + F.col("player_id") % 20, "sacks": F.col("interceptions") + F.col("rushing_tds")})
    return W.workload_features(p, "age").select(*ID, "cumulative_workload_3w", "cumulative_workload_4w", "workload_injury_risk", "workload_injury_risk_raw", "qb_sack_injury_risk")


@query("W20_return_from_absence", f"""WITH g AS (SELECT *, row_number() OVER ({PW}) AS rn, "week"-lag("week") OVER ({PW}) AS gap FROM panel),
 s AS (SELECT *, rn-max(CASE WHEN gap>1 THEN rn END) OVER ({PW}) AS since FROM g)
 SELECT player_id,season,"week",CAST(CASE WHEN since<=2 THEN since ELSE 99 END AS DOUBLE) AS games_since_injury,CAST(coalesce(since<=2,false) AS INT) AS is_first_3_games_back,
 CAST(CASE since WHEN 0 THEN 0.7 WHEN 1 THEN 0.85 WHEN 2 THEN 0.95 ELSE 1.0 END AS DOUBLE) AS return_from_injury_discount FROM s""", "games_since_injury return_from_injury_discount")
def _(t):
    return W.return_from_absence(t.panel).select(*ID, "games_since_injury", "is_first_3_games_back", "return_from_injury_discount")


@query("W21_outliers", f"""WITH {moments('fantasy_points', [], 'panel', 'c1')}, ty AS (SELECT *, rushing_yards+receiving_yards AS total_yards, CASE WHEN player_id%3=0 THEN 0.5 ELSE 1.0 END AS inj FROM panel), {moments('total_yards', [], 'ty', 'c2')}
 SELECT player_id,season,"week",CAST(coalesce(c1.n>=10 AND abs(fantasy_points-c1.mean)>3*c1.std,false) OR coalesce(c2.n>=10 AND abs(total_yards-c2.mean)>3*c2.std,false) AS INT) AS is_statistical_outlier,
 CAST(coalesce(c1.n>=10 AND fantasy_points<c1.mean-2*c1.std AND inj<0.7,false) AS INT) AS is_outlier_injury FROM ty LEFT JOIN c1 USING (season,"week") LEFT JOIN c2 USING (season,"week")""")
def _(t):
    p = W.base_features(t.panel).withColumn("injury_score", F.when(F.col("player_id") % 3 == 0, 0.5).otherwise(1.0))
    return W.outlier_flags(p, ["fantasy_points", "total_yards"], injury_score="injury_score").select(*ID, "is_statistical_outlier", "is_outlier_injury")


MISS = [f"{c}_lag{k}" for c in ("fantasy_points", "total_yards") for k in (1, 4)]


@query("W22_missing_rates", f"WITH {BASE}, l AS (SELECT " + ",".join(f"lag({c},{k}) OVER ({PW}) AS {c}_lag{k}" for c in ("fantasy_points", "total_yards") for k in (1, 4)) + " FROM base) " +
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CAST({c} IS NULL AS INT)) AS missing_rate FROM l" for c in MISS), "missing_rate")
def _(t):
    return W.missing_rates(W.lags(W.base_features(t.panel), ["fantasy_points", "total_yards"], [1, 4]), MISS)


@query("W22_impute", f"WITH {BASE}, l AS (SELECT player_id,season,\"week\"," + ",".join(f"lag({c},{k}) OVER ({PW}) AS {c}_lag{k}" for c in ("fantasy_points", "total_yards") for k in (1, 4)) +
       " FROM base), f AS (SELECT " + ",".join(f"quantile_cont({c},0.5) FILTER (season<2000) AS m_{c}, avg(CAST({c} IS NULL AS INT)) FILTER (season<2000) AS r_{c}" for c in MISS) + " FROM l) SELECT player_id,season,\"week\"," +
       ",".join(f"coalesce({c},m_{c}) AS {c}, CAST({c} IS NULL AND r_{c}>0.02 AS INT) AS {c}_missing" for c in MISS) + " FROM l, f", " ".join(MISS))
def _(t):
    df = W.lags(W.base_features(t.panel), ["fantasy_points", "total_yards"], [1, 4]).select(*ID, *MISS)
    return W.impute(df, W.fit_medians(df.where(F.col("season") < 2000), MISS), MISS)


VOL = f"""v0 AS (SELECT *, count(fantasy_points) OVER ({PW} {ALLP}) AS n, avg(fantasy_points) OVER ({PW} {ALLP}) AS m,
 stddev_samp(fantasy_points) OVER ({PW} {ALLP}) AS sd, max(fantasy_points) OVER ({PW} {ALLP})-min(fantasy_points) OVER ({PW} {ALLP}) AS rg FROM panel),
vo AS (SELECT *, CASE WHEN n>=3 THEN sd END AS weekly_volatility, CASE WHEN n>=3 AND m>0 THEN sd/m ELSE 0.0 END AS coefficient_of_variation,
 1/(1+CASE WHEN n>=3 AND m>0 THEN sd/m ELSE 0.0 END) AS consistency_score, CASE WHEN n>=3 THEN rg END AS boom_bust_range FROM v0)"""


@query("W23_volatility", f"""WITH {VOL}, rv AS (SELECT *, CASE WHEN count(*) OVER ({PW} {pre(4)})>=2 THEN stddev_samp(fantasy_points) OVER ({PW} {pre(4)}) END AS rolling_volatility,
 CASE WHEN count(*) OVER ({PW} {pre(4)})>=2 THEN avg(fantasy_points) OVER ({PW} {pre(4)}) END AS rm FROM vo)
 SELECT player_id,season,"week",weekly_volatility,coefficient_of_variation,consistency_score,boom_bust_range,rolling_volatility,CASE WHEN rm>0 THEN 1/(1+rolling_volatility/rm) ELSE 0.5 END AS rolling_consistency FROM rv""",
       "weekly_volatility coefficient_of_variation consistency_score boom_bust_range rolling_volatility rolling_consistency")
def _(t):
    return W.rolling_volatility(W.volatility(t.panel)).select(*ID, "weekly_volatility", "coefficient_of_variation", "consistency_score",
                                                             "boom_bust_range", "rolling_volatility", "rolling_consistency")


@query("W24_confidence", f"""WITH {VOL}, g AS (SELECT *, 1-exp(-(row_number() OVER ({PW})-1)/8.0) AS gr FROM vo)
 SELECT player_id,season,"week",greatest(0,least(1,0.4*gr+0.3*consistency_score+0.3*gr)) AS confidence_score FROM g""", "confidence_score")
def _(t):
    return W.confidence(W.volatility(t.panel)).select(*ID, "confidence_score")


@query("W25_risk_adjusted", f"""WITH {VOL}, pd AS (SELECT DISTINCT season,"week" FROM panel),
 cap AS (SELECT pd.season,pd."week",greatest(quantile_cont(weekly_volatility,0.95),0.1) AS cap,count(weekly_volatility) AS cn FROM pd JOIN vo ON (vo.season,vo."week")<(pd.season,pd."week") GROUP BY ALL)
 SELECT player_id,season,"week",CASE WHEN cn>=10 AND weekly_volatility IS NOT NULL THEN least(1.0,weekly_volatility/cap) END AS normalized_volatility,
 fantasy_points*(1-0.15*CASE WHEN cn>=10 AND weekly_volatility IS NOT NULL THEN least(1.0,weekly_volatility/cap) END) AS risk_adjusted_projection FROM vo LEFT JOIN cap USING (season,"week")""",
       "normalized_volatility risk_adjusted_projection")
def _(t):
    return W.risk_adjusted(W.volatility(t.panel)).select(*ID, "normalized_volatility", "risk_adjusted_projection")


APPR = {"fp": "fantasy_points", "touches": "total_touches", "targets": "targets", "ypc": "yards_per_carry", "catch_rate": "catch_rate"}
APPL = {"fp": "fantasy_points", "targets": "targets", "rush_att": "rushing_attempts"}
APP_F = [f"{n}_rolling_{k}" for k in (3, 4, 5, 8) for n in APPR] + ["fp_trend", "fp_season_avg"] + [f"fp_lag_{k}" for k in (1, 2, 3, 4)]
APP_I = [f"{n}_lag_{k}" for k in (1, 2, 3, 4) for n in ("targets", "rush_att")]


@query("W26_app_features", f"WITH {BASE}, r AS (SELECT *," + ",".join(f"avg({c}) OVER ({PW} {pre(k)}) AS {n}_rolling_{k}" for k in (3, 4, 5, 8) for n, c in APPR.items()) + "," +
       ",".join(f"lag({c},{k}) OVER ({PW}) AS {n}_lag_{k}" for k in (1, 2, 3, 4) for n, c in APPL.items()) +
       f",avg(fantasy_points) OVER ({PSW} {ALLP}) AS fp_season_avg FROM base), x AS (SELECT *, fp_rolling_3-fp_rolling_5 AS fp_trend FROM r) SELECT player_id,season,\"week\"," + ",".join(APP_F + APP_I) + " FROM x", " ".join(APP_F))
def _(t):
    return W.app_features(W.base_features(t.panel)).select(*ID, *APP_F, *APP_I)


@query("X18_season_labels", """SELECT player_id,season,"week",CAST("week">18 AS INT) AS is_playoff_week,CAST("week"=22 AS INT) AS is_super_bowl,
 CASE WHEN "week"<=6 THEN 0 WHEN "week"<=12 THEN 1 WHEN "week"<=18 THEN 2 ELSE 3 END AS season_phase,least("week",18)/18.0 AS week_normalized,
 CAST("week" BETWEEN 15 AND 18 AS INT) AS is_late_season,CAST("week">=15 AS INT) AS is_high_stakes FROM (SELECT * REPLACE ("week"*2-2 AS "week") FROM panel)""", "week_normalized")
def _(t):
    p = t.panel.withColumn("week", F.col("week") * 2 - 2)
    return W.season_labels(p).select(*ID, "is_playoff_week", "is_super_bowl", "season_phase", "week_normalized", "is_late_season", "is_high_stakes")


POSF = ("rush_pct_of_plays yards_per_completion receiving_pct td_per_touch goal_line_carry_rate rz_target_rate yards_per_route contested_proxy "
        "rz_specialist_score te_rz_target_rate te_adot te_yac te_yards_per_route").split()


def sd(n, d):
    return f"CASE WHEN ({d})=0 THEN 0.0 ELSE ({n})/({d}) END"


@query("W40_position_features", f"""WITH {BASE} SELECT player_id,season,"week",CASE WHEN "position"='QB' THEN {sd('rushing_attempts', 'passing_attempts+rushing_attempts')}*100 END AS rush_pct_of_plays,
 CASE WHEN "position"='QB' THEN {sd('passing_yards', 'completions')} END AS yards_per_completion, CASE WHEN "position"='RB' THEN {sd('receptions', 'total_touches')}*100 END AS receiving_pct,
 CASE WHEN "position"='RB' THEN {sd('total_tds', 'total_touches')} END AS td_per_touch, CASE WHEN "position"='RB' THEN {sd('rush_inside_10', 'rushing_attempts')} END AS goal_line_carry_rate,
 CASE WHEN "position" IN ('RB','WR') THEN {sd('redzone_targets', 'targets')} END AS rz_target_rate, CASE WHEN "position"='WR' THEN {sd('receiving_yards', 'snap_count')} END AS yards_per_route,
 CASE WHEN "position"='WR' THEN {sd('receiving_yards', 'targets')}*(1-catch_rate/100) END AS contested_proxy, CASE WHEN "position"='TE' THEN {sd('receiving_tds', 'targets')}*100 END AS rz_specialist_score,
 CASE WHEN "position"='TE' THEN {sd('redzone_targets', 'targets')} END AS te_rz_target_rate, CASE WHEN "position"='TE' THEN {sd('air_yards', 'targets')} END AS te_adot,
 CASE WHEN "position"='TE' THEN greatest(receiving_yards-air_yards,0) END AS te_yac, CASE WHEN "position"='TE' THEN {sd('receiving_yards', 'snap_count')} END AS te_yards_per_route FROM base""", " ".join(POSF))
def _(t):
    return W.position_features(W.base_features(t.panel)).select(*ID, *POSF)


POSR = ("adj_pass_attempts sack_rate avg_time_in_pocket rz_completion_pct deep_pass_rate deep_pass_accuracy workload_trend goal_line_carry_rate rz_carry_rate yards_per_route yards_per_catch outside_pct "
        "route_tree_diversity seam_threat te_contested_proxy te_yac te_yards_per_route te_route_participation te_inline_block_rate te_slot_pct te_route_diversity").split()
ONE = lambda p, x, c: f"CASE WHEN \"position\"='{p}' THEN {x} END AS {c}"


@query("W40_rich_position_features", f"""WITH {BASE}, {RICH_SQL.format('base')}, w5 AS (SELECT *, avg(total_touches) OVER ({PW} {pre(5)}) AS t5 FROM rich) SELECT player_id,season,"week",{ONE('QB', 'passing_attempts+sacks', 'adj_pass_attempts')},
 {ONE('QB', sd('sacks', 'passing_attempts+sacks') + '*100', 'sack_rate')},{ONE('QB', 'time_in_pocket', 'avg_time_in_pocket')},{ONE('QB', sd('redzone_completions', 'redzone_attempts') + '*100', 'rz_completion_pct')},
 {ONE('QB', sd('deep_pass_attempts', 'passing_attempts') + '*100', 'deep_pass_rate')},{ONE('QB', sd('deep_pass_completions', 'deep_pass_attempts') + '*100', 'deep_pass_accuracy')},{ONE('RB', 'total_touches-t5', 'workload_trend')},
 {ONE('RB', sd('goal_line_carries', 'rushing_attempts'), 'goal_line_carry_rate')},{ONE('RB', sd('redzone_carries', 'rushing_attempts'), 'rz_carry_rate')},{ONE('WR', sd('receiving_yards', 'routes_run'), 'yards_per_route')},
 {ONE('WR', sd('receiving_yards', 'receptions'), 'yards_per_catch')},{ONE('WR', sd('outside_snaps', 'snap_count') + '*100', 'outside_pct')},{ONE('WR', 'route_diversity_score', 'route_tree_diversity')},
 {ONE('TE', 'yards_per_target', 'seam_threat')},{ONE('TE', sd('receiving_yards', 'targets') + '*(1-catch_rate/100)', 'te_contested_proxy')},{ONE('TE', 'yards_after_catch', 'te_yac')},{ONE('TE', sd('receiving_yards', 'routes_run'), 'te_yards_per_route')},
 {ONE('TE', sd('routes_run', 'snap_count') + '*100', 'te_route_participation')},{ONE('TE', 'greatest(0,least(1,1-' + sd('routes_run', 'snap_count') + '))*100', 'te_inline_block_rate')},{ONE('TE', sd('slot_snaps', 'snap_count') + '*100', 'te_slot_pct')},
 {ONE('TE', 'route_diversity_score', 'te_route_diversity')} FROM w5""", " ".join(POSR))
def _(t):
    p = W.rolling_means(W.base_features(rich(t.panel)), ["total_touches"], [5])
    out = W.position_features(p)
    return out.select(*ID, *[F.col(c).cast("double").alias(c) for c in POSR])


QM = ["completion_pct", "passer_rating", "td_rate_qb", "int_rate_qb", "yards_per_attempt", "air_yards_per_attempt", "rush_attempt_rate", "turnover_rate", "total_plays", "deep_ball_pct", "sack_rate", "rz_efficiency", "avg_time_in_pocket"]
QS = ["rush_yards_per_carry", "rush_td_rate", "total_yards", "rz_attempts"]
RATE = """CASE WHEN passing_attempts>0 THEN (greatest(0,least(2.375,(completions/passing_attempts-0.3)*5))+greatest(0,least(2.375,(passing_yards/passing_attempts-3)*0.25))
 +greatest(0,least(2.375,passing_tds/passing_attempts*20))+greatest(0,least(2.375,2.375-interceptions/passing_attempts*25)))/6*100 ELSE 0.0 END"""
QB_CORE = f"""player_id,season,"week",{sd('completions', 'passing_attempts')} AS completion_pct,{RATE} AS passer_rating,{sd('passing_tds', 'passing_attempts')} AS td_rate_qb,
 {sd('interceptions', 'passing_attempts')} AS int_rate_qb,{sd('passing_yards', 'passing_attempts')} AS yards_per_attempt,{sd('rushing_attempts', 'passing_attempts+rushing_attempts')} AS rush_attempt_rate,CAST(passing_attempts+rushing_attempts AS DOUBLE) AS total_plays,
 {sd('rushing_yards', 'rushing_attempts')} AS rush_yards_per_carry,{sd('rushing_tds', 'rushing_attempts')} AS rush_td_rate,passing_yards+rushing_yards AS total_yards,CAST(passing_tds+rushing_tds AS BIGINT) AS total_tds,CAST(rushing_attempts>=4 AS INT) AS is_mobile_qb"""
QB_RICH = f"""{RICH_SQL.format('panel')}, qb AS (SELECT {QB_CORE},{sd('air_yards', 'passing_attempts')} AS air_yards_per_attempt,{sd('interceptions+coalesce(fumbles_lost,0)', 'passing_attempts+rushing_attempts')} AS turnover_rate,
 {sd('deep_pass_attempts', 'passing_attempts')} AS deep_ball_pct,CAST(redzone_attempts AS DOUBLE) AS rz_attempts,{sd('passing_tds', 'redzone_attempts')} AS rz_efficiency,{sd('sacks', 'passing_attempts+sacks')} AS sack_rate,
 CAST(coalesce(time_in_pocket,2.6) AS DOUBLE) AS avg_time_in_pocket FROM rich WHERE "position"='QB')"""
QB_PROXY = f"""qb0 AS (SELECT {QB_CORE},{sd('passing_yards', 'passing_attempts')}*0.6 AS air_yards_per_attempt,{sd('interceptions', 'passing_attempts+rushing_attempts')} AS turnover_rate,CAST(0.1 AS DOUBLE) AS deep_ball_pct,
 CAST(round_even(passing_attempts*CAST(0.12 AS DOUBLE),0) AS DOUBLE) AS rz_attempts,CAST(0.065 AS DOUBLE) AS sack_rate FROM panel WHERE "position"='QB'), qb AS (SELECT *, td_rate_qb*3 AS rz_efficiency,CASE WHEN is_mobile_qb=1 THEN 2.4 ELSE 2.7 END AS avg_time_in_pocket FROM qb0)"""
QB_OUT = "SELECT *," + ",".join(f"avg({m}) OVER ({PW} {pre(3)}) AS {m}_roll3, lag({m}) OVER ({PW}) AS {m}_lag1" for m in QM) + " FROM qb"
QB_FLOATS = " ".join(QS + QM + [f"{m}_roll3" for m in QM] + [f"{m}_lag1" for m in QM])


def _qb(panel):
    return W.qb_features(panel).select(*ID, *QS, "total_tds", "is_mobile_qb", *QM, *[f"{m}_roll3" for m in QM], *[f"{m}_lag1" for m in QM])


@query("W39_qb_features", f"WITH {QB_RICH} {QB_OUT}", QB_FLOATS)
def _(t):
    return _qb(rich(t.panel))


@query("W39_qb_proxies", f"WITH {QB_PROXY} {QB_OUT}", QB_FLOATS)
def _(t):
    return _qb(t.panel.drop("air_yards"))


@query("X08_passer_rating", f'SELECT player_id,season,"week",{RATE} AS rating FROM panel', "rating")
def _(t):
    from weekgrain.functions.exprs import passer_rating
    c = F.col
    return t.panel.select(*ID, passer_rating(c("completions"), c("passing_attempts"), c("passing_yards"), c("passing_tds"), c("interceptions")).alias("rating"))


@query("W42_interactions", f"""WITH {BASE}, l AS (SELECT *, lag(fantasy_points) OVER ({PW}) AS u FROM base)
 SELECT player_id,season,"week",u*yards_per_carry AS util_x_ypc,u*yards_per_target AS util_x_ypt,total_touches*yards_per_carry AS touches_x_ypc,
 opportunities*{sd('total_tds', 'opportunities')} AS opp_x_td_rate FROM l""", "util_x_ypc util_x_ypt touches_x_ypc opp_x_td_rate")
def _(t):
    p = W.lags(W.base_features(t.panel), ["fantasy_points"], [1])
    return W.interactions(p, "fantasy_points_lag1").select(*ID, "util_x_ypc", "util_x_ypt", "touches_x_ypc", "opp_x_td_rate")


def nxt(c, n, agg, need, w=PSW):
    fr = f"OVER ({w} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    return f"CASE WHEN count({c}) {fr}>={need} THEN {agg}({c}) {fr} END"


@query("W43_horizon_targets", f"""SELECT player_id,season,"week",{nxt('fantasy_points', 1, 'sum', 1)} AS target_1w,{nxt('fantasy_points', 4, 'sum', 3)} AS target_4w,
 {nxt('fantasy_points', 10, 'sum', 8)} AS target_10w,{nxt('snap_count', 1, 'avg', 1)} AS target_util_1w,{nxt('snap_count', 4, 'avg', 3)} AS target_util_4w,{nxt('snap_count', 10, 'avg', 6)} AS target_util_10w FROM panel""",
       "target_1w target_4w target_10w target_util_1w target_util_4w target_util_10w")
def _(t):
    return T.horizon_targets(t.panel, (1, 4, 10), usage="snap_count").select(*ID, *[f"target_{u}{n}w" for u in ("", "util_") for n in (1, 4, 10)])


@query("W44_next_rows_target", f"""SELECT player_id,season,"week",target FROM (SELECT *, {nxt('fantasy_points', 4, 'sum', 1, PW)} AS target FROM panel) WHERE target IS NOT NULL""", "target")
def _(t):
    return T.next_rows_target(t.panel, 4).select(*ID, "target")

"""Queries over utilization, fitted transforms and models: U01-U17, M01-M10, E16, E19, E20, E23, E24, E27."""

from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.order_stats import quantiles
from weekgrain.keys import settled
from weekgrain.operators import boosting as B
from weekgrain.operators import evaluate as E
from weekgrain.operators import features as W
from weekgrain.operators import fit as U
from weekgrain.operators import models as M
from weekgrain.operators import targets as TG
from weekgrain.operators import utilization as UT
from weekgrain.plans.q_features import ALLP, BASE, ID, PW, ewm_sql, pre
from weekgrain.plans.registry import query

P4 = '"position"'


def sd(n, d):
    return f"CASE WHEN ({d})=0 THEN 0.0 ELSE ({n})/({d}) END"


def c100(x):
    return f"greatest(0,least(100,{x}))"


SHARE = f"""tt AS (SELECT *, sum(targets) OVER w AS team_targets,sum(receptions) OVER w AS team_receptions,sum(rushing_attempts) OVER w AS team_rush,sum(snap_count) OVER w AS team_snaps,sum(air_yards) OVER w AS team_air,sum(redzone_targets) OVER w AS team_rz FROM panel WINDOW w AS (PARTITION BY team,season,"week")),
 s0 AS (SELECT *, {c100(sd('rush_inside_10+targets_15_plus', 'rushing_attempts+targets') + '*100')} AS high_value_touch_rate,{sd('snap_count', 'team_snaps')}*100 AS ss,{sd('targets', 'team_targets')}*100 AS ts FROM tt),
 sh AS (SELECT *, CASE WHEN {P4}<>'QB' THEN ss END AS snap_share_pct,CASE WHEN {P4}<>'QB' THEN ts END AS target_share_pct,CASE {P4} WHEN 'RB' THEN {sd('rushing_attempts', 'team_rush')}*100 WHEN 'QB' THEN rushing_attempts/(rushing_attempts+5)*100 END AS rush_share_pct,
 CASE WHEN {P4}='RB' THEN {c100('(rushing_tds+receiving_tds)*10')} END AS redzone_share_pct,CASE WHEN {P4}='RB' THEN {sd('rushing_attempts+receptions', 'team_rush+team_receptions')}*100 END AS touch_share_pct,CASE WHEN {P4} IN ('WR','TE') THEN {sd('air_yards', 'team_air')}*100 END AS air_yards_share_pct,
 CASE WHEN {P4} IN ('WR','TE') THEN greatest(0,least(1,{sd('redzone_targets', 'team_rz')}))*100 END AS redzone_targets_pct,CASE WHEN {P4}='WR' THEN {c100('ss*0.8')} END AS route_participation_pct,CASE WHEN {P4}='TE' THEN {c100('100-ss/(ts+1)*10')} END AS inline_rate_pct,
 CASE WHEN {P4}='QB' THEN {sd('passing_attempts', 'passing_attempts+rushing_attempts')}*100 END AS dropback_rate_pct,CASE WHEN {P4}='QB' THEN {c100('(passing_tds+rushing_tds)*12')} END AS redzone_opp_pct,CASE WHEN {P4}='QB' THEN {c100('(passing_attempts+rushing_attempts)/50.0*100')} END AS play_volume_pct FROM s0)"""
COMP = UT.COMPONENTS
BND = "bd AS (" + " UNION ALL ".join(f"SELECT {P4},'{c}' AS component,quantile_cont({c},0.01) AS lo,quantile_cont({c},0.99) AS hi,count({c}) AS n FROM sh WHERE season<2000 GROUP BY {P4} HAVING count({c})>=10" for c in COMP) + ")"
NORM = "nm AS (SELECT sh.*," + ",".join(
    f"CASE WHEN b_{c}.hi>b_{c}.lo THEN CASE WHEN {c} IS NOT NULL THEN {c100(f'({c}-b_{c}.lo)/(b_{c}.hi-b_{c}.lo)*100')} END WHEN b_{c}.hi IS NOT NULL AND {c} IS NOT NULL THEN {c100(c)} END AS {c}_norm" for c in COMP) + " FROM sh " + " ".join(
    f"LEFT JOIN (SELECT * FROM bd WHERE component='{c}') b_{c} ON b_{c}.{P4}=sh.{P4}" for c in COMP) + ")"
SCORE = f"CASE {P4} " + " ".join(f"WHEN '{p}' THEN " + c100("+".join(f"coalesce({C.COMPONENT_COLUMNS[p][k]}_norm,0)*{v}" for k, v in w.items())) for p, w in C.UTILIZATION_WEIGHTS.items()) + " END"


def _parts(t):
    return UT.components(UT.high_value_touch_rate(UT.with_team_totals(t.panel)))


def _bounds(t, parts):
    return UT.fit_bounds(parts.where(F.col("season") < 2000))


@query("U01_high_value_touch_rate", f"WITH {SHARE} SELECT player_id,season,\"week\",high_value_touch_rate FROM sh", "high_value_touch_rate")
def _(t):
    return UT.high_value_touch_rate(t.panel).select(*ID, "high_value_touch_rate")


@query("U02_component_shares", f"WITH {SHARE} SELECT player_id,season,\"week\",{','.join(COMP)} FROM sh", " ".join(COMP))
def _(t):
    return _parts(t).select(*ID, *COMP)


@query("U03_fitted_normalisation", f"WITH {SHARE},{BND},{NORM} SELECT player_id,season,\"week\",{','.join(f'{c}_norm' for c in COMP)} FROM nm", " ".join(f"{c}_norm" for c in COMP))
def _(t):
    p = _parts(t)
    return UT.normalize_fitted(p, _bounds(t, p), COMP).select(*ID, *[f"{c}_norm" for c in COMP])


@query("U03_percent_rank", f"""WITH {SHARE} SELECT player_id,season,"week",(rank() OVER (PARTITION BY {P4} ORDER BY round(target_share_pct,9) NULLS LAST)+(count(*) OVER (PARTITION BY {P4},round(target_share_pct,9))-1)/2.0)/count(*) OVER (PARTITION BY {P4})*100 AS target_rank FROM sh""", "target_rank")
def _(t):
    return UT.normalize_by_rank(_parts(t), "target_share_pct", ["position"], "target_rank").select(*ID, "target_rank")


@query("U04_percentile_bounds", f"WITH {SHARE},{BND} SELECT * FROM bd", "lo hi")
def _(t):
    return _bounds(t, _parts(t))


@query("U05_utilization_score", f"WITH {SHARE},{BND},{NORM} SELECT player_id,season,\"week\",{SCORE} AS utilization_score FROM nm", "utilization_score")
def _(t):
    p = _parts(t)
    return UT.utilization(t.panel, _bounds(t, p)).select(*ID, "utilization_score")


@query("U06_fitted_weights")
def _(t):
    p = UT.utilization(t.panel, _bounds(t, _parts(t)))
    p = TG.horizon_targets(p, (1,), usage="utilization_score").where(F.col("season") < 2000)
    weights = U.fit_utilization_weights(p, tune=True)
    return t.spark.createDataFrame([(a, k, float(v)) for a, w in weights.items() for k, v in w.items()], "position string, component string, weight double")


@query("U07_expected_points", f"""WITH {SHARE}, w AS (SELECT *, coalesce(1.5*target_share_pct/100+0.7*air_yards_share_pct/100,0) AS wopr,CASE {P4} WHEN 'RB' THEN rushing_attempts*0.7+targets*1.5 WHEN 'WR' THEN targets*1.5 WHEN 'TE' THEN targets*1.35 ELSE passing_attempts*0.35+rushing_attempts*0.84 END AS expected_fp FROM sh)
 SELECT player_id,season,"week",wopr,{c100('wopr*100/2.2')} AS wopr_normalized,CAST(expected_fp AS DOUBLE) AS expected_fp,fantasy_points-CAST(expected_fp AS DOUBLE) AS fp_over_expected FROM w""", "wopr wopr_normalized expected_fp fp_over_expected")
def _(t):
    return UT.with_expected_points(_parts(t)).select(*ID, "wopr", "wopr_normalized", "expected_fp", "fp_over_expected")


BC = ["catch_rate", "td_rate", "completion_pct"]


@query("U08_bounded_scaling", f"WITH {BASE}, f AS (SELECT " + ",".join(f"min({c}) AS l_{c},max({c}) AS h_{c}" for c in ("td_rate", "season_week_pct", "catch_rate")) + " FROM base WHERE season<2000) SELECT player_id,season,\"week\"," + ",".join(
    f"({c}-l_{c})/(h_{c}-l_{c}) AS {c}" for c in ("td_rate", "season_week_pct", "catch_rate")) + ",total_yards FROM base,f", "td_rate season_week_pct catch_rate total_yards")
def _(t):
    b = W.base_features(t.panel).select(*ID, "td_rate", "season_week_pct", "catch_rate", "total_yards")
    return U.apply_minmax(b, U.fit_bounded(b.where(F.col("season") < 2000)), ["td_rate", "season_week_pct", "catch_rate", "total_yards"])


@query("U09_winsorised_target", f"""WITH q AS (SELECT {P4},quantile_cont(fantasy_points,0.01) AS lo,quantile_cont(fantasy_points,0.99) AS hi FROM panel WHERE season<2000 GROUP BY ALL) SELECT player_id,season,"week",greatest(lo,least(hi,fantasy_points)) AS clipped FROM panel JOIN q USING ({P4}) WHERE season<2000""", "clipped")
def _(t):
    train = t.panel.where(F.col("season") < 2000)
    return U.winsorise(train, train, "fantasy_points", "clipped", ["position"]).select(*ID, "clipped")


@query("U10_temporal_context", f"SELECT player_id,season,\"week\",avg(fantasy_points) OVER ({PW} {pre(5)}) AS fantasy_points_roll5_mean,CASE WHEN season>=2000 THEN 'test' ELSE 'train' END AS part FROM panel", "fantasy_points_roll5_mean")
def _(t):
    p = t.panel
    train, test = U.with_temporal_context(p.where(F.col("season") < 2000), p.where(F.col("season") >= 2000), lambda d: W.rolling_means(d, ["fantasy_points"], [5]))
    out = lambda d, n: d.select(*ID, "fantasy_points_roll5_mean", F.lit(n).alias("part"))
    return out(train, "train").unionByName(out(test, "test"))


@query("U11_target_transforms", f"""WITH b AS (SELECT *, avg(fantasy_points) OVER ({PW} {pre(3)}) AS r3 FROM panel), f AS (SELECT avg(fantasy_points) AS m,stddev_samp(fantasy_points) AS s FROM panel)
 SELECT player_id,season,"week",fantasy_points-coalesce(r3,m) AS target_residual,ln(1+greatest(fantasy_points,0)) AS target_log,(fantasy_points-m)/s AS target_standard,(fantasy_points-m)/s*s+m AS restored FROM b,f""", "target_residual target_log target_standard restored")
def _(t):
    p = W.rolling_means(t.panel, ["fantasy_points"], [3])
    df = U.standardised_target(U.log_target(U.residual_target(p, "fantasy_points_roll3_mean")))
    df = df.withColumn("restored", U.inverse_target(F.col("target_standard"), "standardized", mean=F.col("target_mean"), std=F.col("target_std")))
    return df.select(*ID, "target_residual", "target_log", "target_standard", "restored")


PRI = f"CASE {P4} WHEN 'QB' THEN 7.0 WHEN 'RB' THEN 6.5 WHEN 'WR' THEN 6.0 ELSE 5.0 END"


@query("U12_player_effects", f"""WITH r AS (SELECT {P4},player_id,fantasy_points-predicted_points AS e FROM preds), p AS (SELECT {P4},player_id,avg(e) AS raw_effect,count(*) AS n_games,stddev_samp(e) AS sd FROM r GROUP BY ALL), g AS (SELECT {P4},var_samp(raw_effect) AS vb,avg(sd*sd) AS vw,avg(n_games) AS n,avg(sd) AS es FROM p GROUP BY ALL),
 h AS (SELECT {P4},greatest(vb-vw/n,0) AS between_var,pow(({PRI}+es)/2,2) AS within_var FROM g), k AS (SELECT p.*,between_var,within_var,CASE WHEN between_var>0 THEN between_var/(between_var+within_var/n_games) ELSE 0 END AS shrinkage,greatest(0.1,CASE WHEN between_var>0 THEN 1/(1/between_var+n_games/within_var) ELSE within_var/n_games END) AS pv FROM p JOIN h USING ({P4}))
 SELECT {P4},player_id,raw_effect,n_games,between_var,within_var,shrinkage,shrinkage*raw_effect AS player_effect,sqrt(pv) AS effect_std,sqrt(within_var+pv) AS predictive_std FROM k""", "raw_effect between_var within_var shrinkage player_effect effect_std predictive_std", "preds")
def _(t):
    return U.player_effects(t.predictions.withColumn("residual", F.col("fantasy_points") - F.col("predicted_points")))


@query("U12_shrunk_mean", f"""WITH s AS (SELECT player_id,season,{P4},avg(fantasy_points) AS ppg,count(*) AS games FROM panel GROUP BY ALL) SELECT player_id,season,(1-0.3/(1+games/4.0))*ppg+0.3/(1+games/4.0)*avg(ppg) OVER (PARTITION BY season,{P4}) AS ppg_shrunk FROM s""", "ppg_shrunk")
def _(t):
    s = t.panel.groupBy("player_id", "season", "position").agg(F.avg("fantasy_points").alias("ppg"), F.count(F.lit(1)).alias("games"))
    return U.shrink_to_position(s, "ppg", "games", by=["season"]).select("player_id", "season", "ppg_shrunk")


@query("U13_player_embeddings")
def _(t):
    e = M.player_embeddings(t.panel.where(F.col("season") < 2000), ["fantasy_points", "targets", "rushing_attempts", "receptions", "passing_yards"], 4)
    return M.most_similar(e, "player_id", "embedding", 17, 5)


@query("U13_similar_vectors", """SELECT vec_id,list_cosine_similarity(embedding::DOUBLE[],(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=7)) AS similarity FROM embeddings WHERE vec_id<>7 ORDER BY round(list_cosine_similarity(embedding::DOUBLE[],(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=7)),9) DESC,vec_id LIMIT 10""", "similarity", "")
def _(t):
    return M.most_similar(t.raw("embeddings"), "vec_id", "embedding", 7, 10).withColumn("similarity", F.round("similarity", 6))


@query("U14_recency_weights", 'SELECT player_id,season,"week",pow(0.5,((SELECT max(season) FROM panel)-season)/3.0) AS sample_weight FROM panel', "sample_weight")
def _(t):
    return U.recency_weights(t.panel, 4).select(*ID, "sample_weight")


SEL = ["targets", "rushing_attempts", "receptions", "passing_attempts", "completions", "air_yards", "rushing_yards", "receiving_yards", "passing_yards", "snap_count"]


@query("U15_target_scores", " UNION ALL ".join(f"SELECT count(*) AS n,'{c}' AS feature,corr({c},fantasy_points) AS correlation,pow(corr({c},fantasy_points),2)/(1-pow(corr({c},fantasy_points),2))*(count(*)-2) AS f_score FROM panel" for c in SEL), "correlation f_score")
def _(t):
    return U.target_scores(t.panel, SEL, "fantasy_points")


@query("U15_feature_selection")
def _(t):
    return U.select_features(t.panel.where(F.col("season") < 2000), SEL, "fantasy_points")


MI = ["targets", "rushing_yards", "snap_count"]


def mi_sql(c):
    return f"""SELECT '{c}' AS feature,sum(n/t*ln(n*t/(nx*ny))) AS mutual_information FROM (SELECT n,sum(n) OVER () AS t,sum(n) OVER (PARTITION BY bx) AS nx,sum(n) OVER (PARTITION BY by_) AS ny FROM (SELECT bx,by_,count(*) AS n FROM (SELECT floor((rank() OVER (ORDER BY {c})-1)*10/count(*) OVER ()) AS bx,
 floor((rank() OVER (ORDER BY fantasy_points)-1)*10/count(*) OVER ()) AS by_ FROM panel) GROUP BY ALL))"""


@query("U15_mutual_information", " UNION ALL ".join(mi_sql(c) for c in MI), "mutual_information")
def _(t):
    return U.mutual_information(t.panel, MI, "fantasy_points")


@query("U16_stability_selection")
def _(t):
    return M.stability_selection(t.panel.where(F.col("season") < 2000), SEL, "fantasy_points", rounds=8)


@query("U17_robust_scaling", "WITH q AS (SELECT " + ",".join(f"quantile_cont({c},0.25) AS a_{c},quantile_cont({c},0.5) AS b_{c},quantile_cont({c},0.75) AS c_{c}" for c in ("fantasy_points", "targets")) + " FROM panel WHERE season<2000) SELECT player_id,season,\"week\"," + ",".join(f"({c}-b_{c})/(c_{c}-a_{c}) AS {c}_scaled" for c in ("fantasy_points", "targets")) + " FROM panel,q", "fantasy_points_scaled targets_scaled")
def _(t):
    return U.robust_scale(t.panel, t.panel.where(F.col("season") < 2000), ["fantasy_points", "targets"]).select(*ID, "fantasy_points_scaled", "targets_scaled")


@query("U17_standard_scaling", "WITH q AS (SELECT avg(fantasy_points) AS m,stddev_pop(fantasy_points) AS s FROM panel WHERE season<2000) SELECT player_id,season,\"week\",(fantasy_points-m)/s AS fantasy_points_scaled FROM panel,q", "fantasy_points_scaled")
def _(t):
    return U.standard_scale(t.panel, t.panel.where(F.col("season") < 2000), ["fantasy_points"]).select(*ID, "fantasy_points_scaled")


# --- models ------------------------------------------------------------------------------------
HIST = ["fantasy_points_roll3_mean", "fantasy_points_roll8_mean", "targets_roll3_mean", "targets_roll8_mean", "fantasy_points_lag1"]
HSQL = f"""hx AS (SELECT player_id,season,"week",{P4},fantasy_points,avg(fantasy_points) OVER ({PW} {pre(3)}) AS x1,avg(fantasy_points) OVER ({PW} {pre(8)}) AS x2,avg(targets) OVER ({PW} {pre(3)}) AS x3 FROM panel)"""


def _history(t):
    p = W.rolling_means(t.panel, ["fantasy_points", "targets"], [3, 8])
    return W.lags(p, ["fantasy_points"], [1]).select(*ID, "position", "fantasy_points", *HIST).where(F.col("fantasy_points_lag1").isNotNull())


@query("M01_position_models")
def _(t):
    h = _history(t)
    models = M.fit_pipelines(h.where(F.col("season") < 2000), HIST, "fantasy_points", "forest", numTrees=10, maxDepth=4)
    return E.regression_metrics(M.apply_pipelines(models, h.where(F.col("season") >= 2000)), ["position"])


@query("M01_one_variable_ridge", f"""WITH {HSQL}, f AS (SELECT {P4},covar_pop(x2,fantasy_points)*count(*)/(var_pop(x2)*count(*)+var_pop(x2)*1.0) AS b,avg(x2) AS mx,avg(fantasy_points) AS my FROM hx WHERE season<2000 AND x2 IS NOT NULL GROUP BY {P4})
 SELECT player_id,season,"week",my+b*(x2-mx) AS predicted_points FROM hx JOIN f USING ({P4}) WHERE season>=2000""", "predicted_points")
def _(t):
    h = _history(t)
    betas = M.fit_positions(h.where(F.col("season") < 2000), ["fantasy_points_roll8_mean"], "fantasy_points", 1.0)
    return M.predict_positions(h.where(F.col("season") >= 2000), ["fantasy_points_roll8_mean"], betas).select(*ID, "predicted_points")


KINDS = ["ridge", "boosted"]


def _seasons(t):
    return sorted(r[0] for r in t.panel.select("season").distinct().collect())


def _oof(t):
    """All seasons but the first, which has nothing before it."""
    return settled(M.out_of_fold(_history(t), _seasons(t)[1:], HIST, "fantasy_points", KINDS, trees=5, depth=2))


@query("M02_stacking")
def _(t):
    o, last = _oof(t), _seasons(t)[-1]
    meta = M.stack(o.where(F.col("season") < last), KINDS, "fantasy_points")
    out = M.predict_positions(o.where(F.col("season") == last), [f"oof_{k}" for k in KINDS], meta, "predicted_points")
    return E.regression_metrics(out, ["position"])


@query("M02_out_of_fold")
def _(t):
    o = _oof(t)
    parts = [E.regression_metrics(o.withColumnRenamed(f"oof_{k}", "predicted_points"), ["position", "season"]).withColumn("kind", F.lit(k)) for k in KINDS]
    return parts[0].unionByName(parts[1])


@query("M02_one_variable_folds", f"""WITH {HSQL}, mo AS (SELECT {P4},season,count(*) AS n,sum(x2) AS sx,sum(fantasy_points) AS sy,sum(x2*x2) AS sxx,sum(x2*fantasy_points) AS sxy FROM hx WHERE x2 IS NOT NULL GROUP BY ALL),
 pa AS (SELECT te.{P4},te.season,sum(tn.n) AS n,sum(tn.sx) AS sx,sum(tn.sy) AS sy,sum(tn.sxx) AS sxx,sum(tn.sxy) AS sxy FROM mo te JOIN mo tn ON tn.{P4}=te.{P4} AND tn.season<te.season GROUP BY ALL HAVING sum(tn.n)>=20),
 be AS (SELECT *, (sxy/n-sx/n*sy/n)/((sxx/n-sx/n*sx/n)*(1+1.0/n)) AS b FROM pa) SELECT player_id,season,"week",sy/n+b*(x2-sx/n) AS oof_ridge FROM hx JOIN be USING ({P4},season) WHERE x2 IS NOT NULL""", "oof_ridge")
def _(t):
    return M.out_of_fold(_history(t), _seasons(t)[1:], ["fantasy_points_roll8_mean"], "fantasy_points", ["ridge"]).select(*ID, "oof_ridge")


@query("M03_isotonic_calibration")
def _(t):
    h = _history(t)
    betas = M.fit_positions(h.where(F.col("season") < 2000), HIST, "fantasy_points")
    p = M.predict_positions(h.where(F.col("season") >= 2000), HIST, betas)
    return M.isotonic_if_better(p, "predicted_points", "fantasy_points").groupBy("position").agg(
        F.max("calibration_kept").alias("kept"), F.avg("calibrated").alias("mean_calibrated"), F.avg("fantasy_points").alias("mean_actual"))


@query("M04_conformal_table", f"""WITH r AS (SELECT {P4},abs(fantasy_points-predicted_points) AS a,predicted_std FROM preds), s AS (SELECT {P4},stddev_pop(a) AS sd FROM r GROUP BY ALL), b AS (SELECT {P4},a,a/greatest(0.7*sd+0.3*predicted_std,1e-8) AS b FROM r JOIN s USING ({P4}))
 SELECT {P4},count(*) AS n,""" + ",".join(f"quantile_cont(a,{x}) AS q{int(x * 100)},greatest(0.5,least(5.0,quantile_cont(b,{x})/{z})) AS scale{int(x * 100)}" for x, z in ((0.5, 0.6744897501960817), (0.8, 1.2815515655446008), (0.9, 1.6448536269514729), (0.95, 1.959963984540054))) + f" FROM b GROUP BY {P4}",
       "q50 q80 q90 q95 scale50 scale80 scale90 scale95", "preds")
def _(t):
    return M.conformal_table(t.predictions, "predicted_points", "fantasy_points", "predicted_std")


@query("M05_usage_to_points")
def _(t):
    p = W.rolling_means(W.base_features(t.panel), ["snap_count", "catch_rate"], [3, 8]).withColumn("snap_count", F.col("snap_count").cast("double"))
    p = p.where(F.col("snap_count_roll3_mean").isNotNull())
    out = M.usage_to_points(p.where(F.col("season") < 2000), p.where(F.col("season") >= 2000), "snap_count", ["snap_count_roll3_mean", "snap_count_roll8_mean"], ["catch_rate_roll3_mean"])
    errors = out.groupBy("position").agg(F.max("conversion_error_80").alias("conversion_error_80"), F.max("conversion_error_95").alias("conversion_error_95"),
                                         F.avg((F.abs(F.col("fantasy_points") - F.col("predicted_points")) <= F.col("conversion_error_95")).cast("double")).alias("within_95"))
    return E.regression_metrics(out, ["position"]).join(errors, "position")


@query("M06_quantile_intervals", f"""WITH q AS (SELECT {P4},""" + ",".join(f"quantile_cont(fantasy_points-predicted_points,{x / 100}) AS e{x}" for x in (10, 25, 50, 75, 90)) + f""" FROM preds WHERE season<2000 GROUP BY {P4}) SELECT player_id,season,"week",""" + ",".join(f"greatest(0,predicted_points+e{x}) AS q{x}" for x in (10, 25, 50, 75, 90)) + f" FROM preds JOIN q USING ({P4}) WHERE season>=2000", "q10 q25 q50 q75 q90", "preds")
def _(t):
    p = t.predictions
    return M.quantile_intervals(p.where(F.col("season") < 2000), p.where(F.col("season") >= 2000), "predicted_points", "fantasy_points").select(*ID, "q10", "q25", "q50", "q75", "q90")


@query("M07_injury_classifier")
def _(t):
    # the label is a report in the following week
    reports = t.injuries.select("player_id", "season", (F.col("week") - 1).alias("week"), F.lit(1).alias("_r")).distinct()
    p = t.panel.select(*ID, F.col("rushing_attempts").cast("double").alias("rushing_attempts"), F.col("targets").cast("double").alias("targets")).join(reports, ID, "left")
    p = p.withColumn("is_injured", F.coalesce("_r", F.lit(0))).drop("_r")
    out = M.injury_classifier(p.where(F.col("season") < 2000), p.where(F.col("season") >= 2000), ["rushing_attempts", "targets"], "is_injured")
    return out.groupBy("is_injured").agg(F.count(F.lit(1)).alias("n"), F.avg("injury_prob_ml").alias("mean_probability"))


@query("M08_target_choice")
def _(t):
    h = TG.horizon_targets(W.lags(W.rolling_means(t.panel, ["fantasy_points", "targets"], [3, 8]), ["fantasy_points"], [1]), (1,), usage="snap_count")
    q = h.where((F.col("position") == "QB") & F.col("fantasy_points_lag1").isNotNull())
    return M.choose_target(q.where(F.col("season") < 2000), q.where(F.col("season") >= 2000), HIST, "target_util_1w", "target_1w")


@query("M09_penalty_search")
def _(t):
    return M.penalty_search(_history(t), HIST, "fantasy_points")


@query("M10_bias_and_outliers", f"""WITH b AS (SELECT {P4},avg(fantasy_points-predicted_points) AS b FROM preds WHERE season<2000 GROUP BY ALL) SELECT player_id,season,"week",predicted_points+b AS corrected FROM preds JOIN b USING ({P4}) WHERE season>=2000""", "corrected", "preds")
def _(t):
    p = t.predictions
    return M.bias_corrected(p.where(F.col("season") < 2000), p.where(F.col("season") >= 2000), "predicted_points", "fantasy_points").select(*ID, "corrected")


@query("M10_outlier_filter", f"""WITH f AS (SELECT {P4},avg(fantasy_points) AS m,stddev_samp(fantasy_points) AS s FROM panel GROUP BY ALL) SELECT player_id,season,"week" FROM panel JOIN f USING ({P4}) WHERE abs(fantasy_points-m)<=2*s""")
def _(t):
    return M.without_outliers(t.panel, "fantasy_points", 2.0).select(*ID)


@query("E16_weekly_refit")
def _(t):
    return M.weekly_refit(_history(t), HIST, "fantasy_points", 1998).select(*ID, "position", "predicted_points", "fantasy_points")


ONE = "fantasy_points_roll8_mean"
MOM = f"""mo AS (SELECT {P4},season,"week",count(*) AS n,sum(x2) AS sx,sum(fantasy_points) AS sy,sum(x2*x2) AS sxx,sum(x2*fantasy_points) AS sxy FROM hx WHERE x2 IS NOT NULL GROUP BY ALL)"""


@query("E16_weekly_refit_single", f"""WITH {HSQL},{MOM}, cal AS (SELECT DISTINCT {P4},season,"week" FROM mo), pa AS (SELECT cal.{P4},cal.season,cal."week",sum(n) AS n,sum(sx) AS sx,sum(sy) AS sy,sum(sxx) AS sxx,sum(sxy) AS sxy FROM cal JOIN mo ON mo.{P4}=cal.{P4} AND (mo.season,mo."week")<(cal.season,cal."week") GROUP BY ALL),
 be AS (SELECT *, (sxy/n-sx/n*sy/n)/((sxx/n-sx/n*sx/n)*(1+1.0/n)) AS b FROM pa WHERE season>=1999) SELECT player_id,season,"week",sy/n+b*(x2-sx/n) AS predicted_points FROM hx JOIN be USING ({P4},season,"week") WHERE x2 IS NOT NULL""", "predicted_points")
def _(t):
    return M.weekly_refit(_history(t), [ONE], "fantasy_points", 1999).select(*ID, "predicted_points")


CUTS = [50.0, 100.0, 150.0, 200.0, 300.0]


@query("E16_weekly_refit_stump", f"""WITH {HSQL}, r AS (SELECT *,season*100+"week" AS pd,len(list_filter({CUTS}::DOUBLE[],lambda e: e<x2)) AS b FROM hx WHERE x2 IS NOT NULL), f AS (SELECT DISTINCT pd AS fold FROM r WHERE season=2001),
 h AS (SELECT {P4},fold,b,count(*) AS n,sum(fantasy_points) AS s FROM r JOIN f ON pd<fold GROUP BY ALL), c AS (SELECT *,sum(n) OVER w AS ln,sum(s) OVER w AS ls,sum(n) OVER z AS tn,sum(s) OVER z AS ts FROM h WINDOW w AS (PARTITION BY {P4},fold ORDER BY b),z AS (PARTITION BY {P4},fold)),
 g AS (SELECT *,row_number() OVER (PARTITION BY {P4},fold ORDER BY CASE WHEN tn>ln THEN pow(ls-ts/tn*ln,2)/ln+pow(ls-ts/tn*ln,2)/(tn-ln) ELSE -1 END DESC,b) AS k FROM c)
 SELECT player_id,season,"week",r.{P4},CASE WHEN tn=ln THEN ts/tn WHEN r.b<=g.b THEN ls/ln ELSE (ts-ls)/(tn-ln) END AS predicted_points FROM r JOIN g ON g.{P4}=r.{P4} AND g.fold=r.pd AND g.k=1""", "predicted_points")
def _(t):
    edges = {p: {ONE: CUTS} for p in C.POSITIONS}
    return B.weekly_boosted(_history(t), [ONE], "fantasy_points", 2001, edges=edges, trees=1, depth=1, rate=1.0, ridge=0.0, min_rows=1).select(*ID, "position", "predicted_points")


@query("E16_weekly_refit_boosted")
def _(t):
    return B.weekly_boosted(_history(t), HIST, "fantasy_points", 2001, trees=6, depth=2).select(*ID, "position", "predicted_points")


@query("E24_training_windows_single", f"""WITH {HSQL}, mo AS (SELECT {P4},season,count(*) AS n,sum(x2) AS sx,sum(fantasy_points) AS sy,sum(x2*x2) AS sxx,sum(x2*fantasy_points) AS sxy,sum(fantasy_points*fantasy_points) AS syy FROM hx WHERE x2 IS NOT NULL GROUP BY ALL),
 k AS (SELECT unnest([1,2,3]) AS y), tr AS (SELECT te.{P4},te.season,y,sum(tn.n) AS n,sum(tn.sx) AS sx,sum(tn.sy) AS sy,sum(tn.sxx) AS sxx,sum(tn.sxy) AS sxy FROM mo te,k,mo tn WHERE te.season>=1999 AND tn.{P4}=te.{P4} AND tn.season<te.season AND tn.season>=te.season-y GROUP BY ALL),
 b AS (SELECT *, (sxy/n-sx/n*sy/n)/((sxx/n-sx/n*sx/n)*(1+1.0/n)) AS b FROM tr), e AS (SELECT b.{P4},y,b.season,sqrt((te.syy+pow(b.sy/b.n-b.b*b.sx/b.n,2)*te.n+b.b*b.b*te.sxx-2*(b.sy/b.n-b.b*b.sx/b.n)*te.sy-2*b.b*te.sxy+2*(b.sy/b.n-b.b*b.sx/b.n)*b.b*te.sx)/te.n) AS r FROM b JOIN mo te ON te.{P4}=b.{P4} AND te.season=b.season),
 g AS (SELECT {P4},y AS n_train_years,avg(r) AS mean_rmse,stddev_pop(r) AS std_rmse,count(*) AS n_folds FROM e GROUP BY ALL) SELECT *, CAST(mean_rmse=min(mean_rmse) OVER (PARTITION BY {P4}) AS INT) AS is_best FROM g""", "mean_rmse std_rmse")
def _(t):
    return M.training_windows(_history(t), [ONE], "fantasy_points", years=(1, 2, 3))


@query("E19_shift_auc")
def _(t):
    p = t.panel.select("season", *[F.col(c).cast("double").alias(c) for c in ("fantasy_points", "targets", "air_yards")])
    test = p.where(F.col("season") >= 2000).withColumn("air_yards", F.col("air_yards") * 2)
    return M.shift_auc(p.where(F.col("season") < 2000), test, ["fantasy_points", "targets", "air_yards"])


@query("E20_out_of_distribution", f"""WITH x AS (SELECT player_id,season,"week",fantasy_points AS a,CAST(targets AS DOUBLE) AS b FROM panel), f AS (SELECT avg(a) AS ma,avg(b) AS mb,var_samp(a)+1e-6 AS va,var_samp(b)+1e-6 AS vb,covar_samp(a,b) AS cab FROM x WHERE season<2000),
 d AS (SELECT x.*, sqrt(greatest(0,((a-ma)*(a-ma)*vb-2*(a-ma)*(b-mb)*cab+(b-mb)*(b-mb)*va)/(va*vb-cab*cab))) AS mahalanobis FROM x,f), q AS (SELECT quantile_cont(mahalanobis,0.95) AS q FROM d WHERE season<2000) SELECT player_id,season,"week",mahalanobis,CAST(mahalanobis>q AS INT) AS is_ood FROM d,q WHERE season>=2000""", "mahalanobis")
def _(t):
    cols = ["fantasy_points", "targets"]
    mean, inv, line = U.fit_mahalanobis(t.panel.where(F.col("season") < 2000), cols)
    return U.with_mahalanobis(t.panel.where(F.col("season") >= 2000), cols, mean, inv).select(*ID, "mahalanobis", (F.col("mahalanobis") > line).cast("int").alias("is_ood"))


@query("E23_permutation_importance")
def _(t):
    h = _history(t).where(F.col("season") >= 2000)
    betas = M.fit_positions(_history(t).where(F.col("season") < 2000), HIST, "fantasy_points")
    return M.permutation_importance(h, HIST, lambda d: M.predict_positions(d, HIST, betas), "fantasy_points")


@query("E23_importance_stability", "WITH c AS (" + " UNION ALL ".join(f"SELECT season,'{c}' AS feature,abs(corr({c},fantasy_points)) AS v FROM panel GROUP BY season" for c in MI) + ") SELECT feature,avg(v) AS mean_importance,stddev_pop(v) AS std_importance,1-stddev_pop(v)/avg(v) AS stability FROM c GROUP BY feature", "mean_importance std_importance stability")
def _(t):
    return M.importance_stability(t.panel, MI, "fantasy_points")


@query("E23_partial_dependence", f"""WITH {HSQL}, f AS (SELECT {P4},covar_pop(x2,fantasy_points)/(var_pop(x2)*(1+1.0/count(*))) AS b,avg(x2) AS mx,avg(fantasy_points) AS my FROM hx WHERE season<2000 AND x2 IS NOT NULL GROUP BY {P4}), d AS (SELECT {P4},min(x2) OVER () AS lo,max(x2) OVER () AS hi FROM hx WHERE season>=2000)
 SELECT lo+(hi-lo)*k/19 AS value,avg(my+b*(lo+(hi-lo)*k/19-mx)) AS mean_prediction FROM d JOIN f USING ({P4}),(SELECT unnest(range(20)) AS k) GROUP BY ALL""", "value mean_prediction")
def _(t):
    h = _history(t)
    c = "fantasy_points_roll8_mean"
    betas = M.fit_positions(h.where(F.col("season") < 2000), [c], "fantasy_points")
    return M.partial_dependence(h.where(F.col("season") >= 2000), c, lambda d: M.predict_positions(d, [c], betas))


@query("E24_training_windows")
def _(t):
    return M.training_windows(_history(t), HIST, "fantasy_points", years=(1, 2, 3, 4, 5))


@query("E27_learning_curve")
def _(t):
    return M.learning_curve(_history(t), HIST, "fantasy_points", 2000)


@query("E27_feature_count")
def _(t):
    return M.feature_count_curve(_history(t), HIST, "fantasy_points")

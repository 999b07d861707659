"""Queries over evaluation and folds: E01-E27, A17, A19."""

from pyspark.sql import functions as F

from weekgrain.operators import evaluate as E
from weekgrain.operators import features as W
from weekgrain.operators import fit as U
from weekgrain.operators import folds as FO
from weekgrain.operators import joins as J
from weekgrain.plans.q_features import ALLP, ID, PSW, PW, pre
from weekgrain.plans.registry import query

P4 = '"position"'
E_ = "(fantasy_points-predicted_points)"
MET = f"""count(*) AS n,sqrt(avg({E_}*{E_})) AS rmse,avg(abs{E_}) AS mae,1-sum({E_}*{E_})/(sum(fantasy_points*fantasy_points)-sum(fantasy_points)*sum(fantasy_points)/count(*)) AS r2,corr(fantasy_points,predicted_points) AS correlation,
 avg(abs{E_}/greatest(abs(fantasy_points),3.0))*100 AS mape_floor3,avg(abs{E_}/abs(fantasy_points)) FILTER (fantasy_points<>0)*100 AS mape_nonzero,avg(-{E_}) AS mean_error,stddev_samp({E_}) AS std_error,avg(fantasy_points) AS avg_actual,avg(predicted_points) AS avg_predicted,
 stddev_samp(fantasy_points) AS std_actual,stddev_samp(predicted_points) AS std_predicted,avg(CAST(abs{E_}<=3 AS INT))*100 AS within_3_pct,avg(CAST(abs{E_}<=5 AS INT))*100 AS within_5_pct,avg(CAST(abs{E_}<=7 AS INT))*100 AS within_7_pct,avg(CAST(abs{E_}<=10 AS INT))*100 AS within_10_pct"""
METF = "rmse mae r2 correlation mape_floor3 mape_nonzero mean_error std_error avg_actual avg_predicted std_actual std_predicted within_3_pct within_5_pct within_7_pct within_10_pct"


@query("E01_metrics_by_position", f"SELECT {P4},{MET} FROM preds GROUP BY {P4}", METF, "preds")
def _(t):
    return E.regression_metrics(t.predictions, ["position"])


@query("E01_metrics_by_week", f"SELECT season,\"week\",{MET} FROM preds GROUP BY ALL", METF, "preds")
def _(t):
    return E.regression_metrics(t.predictions, ["season", "week"])


@query("E01_direction_accuracy", f"WITH m AS (SELECT *, avg(fantasy_points) OVER (PARTITION BY {P4},season) AS m FROM preds) SELECT {P4},season,avg(CAST((predicted_points>m)=(fantasy_points>m) AS INT))*100 AS directional_accuracy_pct FROM m GROUP BY ALL", "directional_accuracy_pct", "preds")
def _(t):
    return E.direction_accuracy(t.predictions, ["position", "season"])


@query("E01_error_quantiles", f"SELECT {P4},count(*) AS n,quantile_cont(abs{E_},0.5) AS median_error,quantile_cont(abs{E_},0.9) AS p90_error,quantile_cont(abs{E_},0.95) AS p95_error FROM preds GROUP BY ALL", "median_error p90_error p95_error", "preds")
def _(t):
    return E.error_quantiles(t.predictions, ["position"])


AR = lambda c, g: f"rank() OVER (PARTITION BY {g} ORDER BY round({c},9))+(count(*) OVER (PARTITION BY {g},round({c},9))-1)/2.0"


@query("E02_spearman", f"WITH r AS (SELECT {P4},season,{AR('fantasy_points', P4 + ',season')} AS a,{AR('predicted_points', P4 + ',season')} AS p FROM preds) SELECT {P4},season,corr(a,p) AS spearman_rho,count(*) AS n FROM r GROUP BY ALL", "spearman_rho", "preds")
def _(t):
    return E.spearman(t.predictions, ["position", "season"])


@query("E02_spearman_top50", f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {P4} ORDER BY round(predicted_points,9) DESC,player_id,season,"week") AS rn FROM preds) WHERE rn<=50), r AS (SELECT {P4},{AR('fantasy_points', P4)} AS a,{AR('predicted_points', P4)} AS p FROM b) SELECT {P4},corr(a,p) AS spearman_rho,count(*) AS n FROM r GROUP BY ALL""", "spearman_rho", "preds")
def _(t):
    return E.spearman_top(t.predictions, ["position"])


TI = lambda c: f"CASE WHEN {c}>=18 AND {c}<100 THEN 'e' WHEN {c}>=12 AND {c}<18 THEN 's' WHEN {c}>=7 AND {c}<12 THEN 'f' ELSE 'w' END"


@query("E03_tier_accuracy", f"SELECT {P4},avg(CAST({TI('fantasy_points')}={TI('predicted_points')} AS INT)) AS tier_accuracy FROM preds GROUP BY ALL", "tier_accuracy", "preds")
def _(t):
    return E.tier_accuracy(t.predictions, ["position"])


def bb(name, a, p):
    tp, pp, ap = f"count(*) FILTER ({a} AND {p})", f"count(*) FILTER ({p})", f"count(*) FILTER ({a})"
    return (f"avg(CAST({a} AS INT)) AS {name}_prevalence,CASE WHEN {pp}>0 THEN {tp}/{pp} ELSE 0.0 END AS {name}_precision,{tp}/{ap} AS {name}_recall,"
            f"CASE WHEN {tp}>0 THEN 2.0*{tp}/({pp}+{ap}) ELSE 0.0 END AS {name}_f1")


BBF = "boom_prevalence boom_precision boom_recall boom_f1 bust_prevalence bust_precision bust_recall bust_f1"


@query("E04_boom_bust", f"SELECT {P4}," + bb("boom", "fantasy_points>=30", "predicted_points>=30") + "," + bb("bust", "fantasy_points<15", "predicted_points<15") + f" FROM preds GROUP BY {P4}", BBF, "preds")
def _(t):
    return E.boom_bust(t.predictions, ["position"], boom=30.0, bust=15.0)


VA = f"CASE {P4} WHEN 'QB' THEN 12.0 WHEN 'TE' THEN 8.0 ELSE 10.0 END"


@query("E05_vor_accuracy", f"WITH v AS (SELECT season,fantasy_points-{VA} AS va,predicted_points-{VA} AS vp FROM preds), r AS (SELECT season,{AR('va', 'season')} AS a,{AR('vp', 'season')} AS p FROM v) SELECT season,corr(a,p) AS vor_rank_correlation,count(*) AS n FROM r GROUP BY ALL", "vor_rank_correlation", "preds")
def _(t):
    return E.vor_accuracy(t.predictions, ["season"])


ZS = {0.5: 0.6744897501960817, 0.8: 1.2815515655446008, 0.9: 1.6448536269514729, 0.95: 1.959963984540054}


@query("E06_interval_calibration", " UNION ALL ".join(
    f"SELECT {P4},CAST({lv} AS DOUBLE) AS nominal,count(*) AS n,avg(CAST(abs{E_}<={z}*predicted_std AS INT)) AS actual_coverage,avg(2*{z}*predicted_std) AS mean_interval_width,abs(avg(CAST(abs{E_}<={z}*predicted_std AS INT))-{lv}) AS calibration_error,CAST(abs(avg(CAST(abs{E_}<={z}*predicted_std AS INT))-{lv})<0.1 AS INT) AS passed FROM preds WHERE predicted_std>0 GROUP BY {P4}" for lv, z in ZS.items()),
       "nominal actual_coverage mean_interval_width calibration_error", "preds")
def _(t):
    return E.interval_calibration(t.predictions, "predicted_std", ["position"])


@query("E07_top_hits", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {P4},season,"week" ORDER BY round(predicted_points,9) DESC,player_id) AS rp,row_number() OVER (PARTITION BY {P4},season,"week" ORDER BY round(fantasy_points,9) DESC,player_id) AS ra FROM preds)
 SELECT {P4},season,"week",count(*) AS n,""" + ",".join(f"CASE WHEN count(*)>={k} THEN count(*) FILTER (rp<={k} AND ra<={k})/{k}.0*100 END AS top_{k}_hit_rate" for k in (5, 10, 20)) + " FROM r GROUP BY ALL", "top_5_hit_rate top_10_hit_rate top_20_hit_rate", "preds")
def _(t):
    return E.top_hits(t.predictions, ["position", "season", "week"])


@query("E08_top_performers", f"""WITH s AS (SELECT season,{P4},player_id,name,sum(fantasy_points) AS actual_total,sum(predicted_points) AS predicted_total FROM preds GROUP BY ALL),
 r AS (SELECT *, {AR('-actual_total', 'season,' + P4)} AS actual_rank,{AR('-predicted_total', 'season,' + P4)} AS pred_rank FROM s) SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY season,{P4} ORDER BY actual_rank,player_id) AS rn FROM r) WHERE rn<=10""",
       "actual_total predicted_total actual_rank pred_rank", "preds")
def _(t):
    return E.top_performers(t.predictions, by=["season"])


@query("E08_biggest_misses", f"SELECT player_id,season,\"week\",fantasy_points,predicted_points,round({E_},9) AS error FROM preds ORDER BY abs(round({E_},9)) DESC,player_id,season,\"week\" LIMIT 10", "fantasy_points predicted_points error", "preds")
def _(t):
    return E.biggest_misses(t.predictions).select(*ID, "fantasy_points", "predicted_points", "error")


BASE = f"""bs AS (SELECT panel.*, avg(fantasy_points) OVER ({PW} {pre(3)}) AS baseline_trailing_3,avg(fantasy_points) OVER ({PW} {pre(5)}) AS baseline_trailing_5,avg(fantasy_points) OVER ({PW} {pre(4)}) AS baseline_rolling_4,avg(fantasy_points) OVER ({PSW} {ALLP}) AS baseline_season_avg,
 lag(fantasy_points) OVER ({PW}) AS baseline_persistence,avg(fantasy_points) OVER (PARTITION BY season,"week",{P4}) AS oracle_position_week FROM panel),
 ps AS (SELECT player_id,season+1 AS season,avg(fantasy_points) AS baseline_prior_season FROM panel GROUP BY ALL), bl AS (SELECT bs.*, baseline_prior_season FROM bs LEFT JOIN ps USING (player_id,season))"""
BN = E.BASELINES + ["oracle_position_week"]


@query("E09_baselines", f"WITH {BASE} SELECT player_id,season,\"week\",{','.join(BN)} FROM bl", " ".join(BN))
def _(t):
    return E.with_baselines(t.panel).select(*ID, *BN)


def cmp_sql(groups):
    g = "".join(x + "," for x in groups)
    one = lambda b: f"SELECT {g}'{b}' AS baseline,count(*) AS n_compared,sqrt(avg(pow(fantasy_points-m,2))) AS model_rmse,avg(abs(fantasy_points-m)) AS model_mae,sqrt(avg(pow(fantasy_points-{b},2))) AS baseline_rmse,avg(abs(fantasy_points-{b})) AS baseline_mae FROM mm WHERE m IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
    return f"""WITH {BASE}, mm AS (SELECT *, avg(fantasy_points) OVER ({PW} {pre(8)}) AS m FROM bl), c AS ({' UNION ALL '.join(one(b) for b in E.BASELINES)}),
 cc AS (SELECT *, (1-model_rmse/baseline_rmse)*100 AS rmse_improvement_pct,(1-model_mae/baseline_mae)*100 AS mae_improvement_pct FROM c),
 cf AS (SELECT *, CAST(model_rmse<baseline_rmse AS INT) AS beats,CAST(rmse_improvement_pct>=20 AS INT) AS beats_by_20_pct,CAST(rmse_improvement_pct>=25 AS INT) AS beats_by_25_pct FROM cc)"""


CF = "model_rmse model_mae baseline_rmse baseline_mae rmse_improvement_pct mae_improvement_pct"


def _model(t):
    b = E.with_baselines(t.panel)
    return W.rolling_means(b, ["fantasy_points"], [8]).withColumnRenamed("fantasy_points_roll8_mean", "predicted_points")


@query("E10_baseline_comparison", cmp_sql([P4]) + " SELECT * FROM cf", CF)
def _(t):
    return E.compare_with(_model(t), E.BASELINES, ["position"])


@query("E10_baseline_verdict", cmp_sql([]) + " SELECT min(beats_by_20_pct) AS beats_all_by_20_pct,min(beats_by_25_pct) AS beats_all_by_25_pct,min_by(baseline,baseline_rmse) AS strongest_baseline,min(baseline_rmse) AS strongest_rmse,max(model_rmse) AS model_rmse,CAST(max(model_rmse)<min(baseline_rmse) AS INT) AS beats_strongest FROM cf", "strongest_rmse model_rmse")
def _(t):
    return E.baseline_verdict(E.compare_with(_model(t), E.BASELINES))


@query("E11_expert_comparison", f"""WITH e AS (SELECT preds.*, s_acctbal/400 AS x FROM preds JOIN supplier ON s_suppkey=player_id WHERE player_id%4<>1)
 SELECT {P4},'expert_pts' AS baseline,count(*) AS n_compared,sqrt(avg(pow(fantasy_points-predicted_points,2))) AS model_rmse,avg(abs{E_}) AS model_mae,sqrt(avg(pow(fantasy_points-x,2))) AS baseline_rmse,avg(abs(fantasy_points-x)) AS baseline_mae,(1-sqrt(avg(pow(fantasy_points-predicted_points,2)))/sqrt(avg(pow(fantasy_points-x,2))))*100 AS rmse_improvement_pct,
 (1-avg(abs{E_})/avg(abs(fantasy_points-x)))*100 AS mae_improvement_pct,CAST(sqrt(avg(pow(fantasy_points-predicted_points,2)))<sqrt(avg(pow(fantasy_points-x,2))) AS INT) AS beats,CAST(1-sqrt(avg(pow(fantasy_points-predicted_points,2)))/sqrt(avg(pow(fantasy_points-x,2)))>=0.2 AS INT) AS beats_by_20_pct,CAST(1-sqrt(avg(pow(fantasy_points-predicted_points,2)))/sqrt(avg(pow(fantasy_points-x,2)))>=0.25 AS INT) AS beats_by_25_pct FROM e GROUP BY {P4}""", CF, "preds")
def _(t):
    s = t.raw("supplier")
    experts = s.where(F.col("s_suppkey") % 4 != 1).select(F.col("s_name").alias("player_name"), (F.col("s_acctbal") / 400).alias("pts"))
    p = t.predictions.drop("name").join(s.select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name")), "player_id")
    return E.compare_with(J.with_expert(p, experts), ["expert_pts"], ["position"])


@query("E12_conformal_intervals", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {P4} ORDER BY season,"week",player_id) AS rn,count(*) OVER (PARTITION BY {P4}) AS n FROM preds), c AS (SELECT {P4},count(*) AS k,quantile_cont({E_},0.1) AS lo,quantile_cont({E_},0.9) AS hi FROM r WHERE rn<=greatest(n//2,least(n,10)) GROUP BY ALL),
 w AS (SELECT {P4},lo*CASE WHEN k>=200 THEN 1.0 WHEN k>=50 THEN 1.05 WHEN k>=20 THEN 1.1 ELSE 1.2 END AS lo,hi*CASE WHEN k>=200 THEN 1.0 WHEN k>=50 THEN 1.05 WHEN k>=20 THEN 1.1 ELSE 1.2 END AS hi FROM c)
 SELECT player_id,season,"week",greatest(0,predicted_points+lo) AS ci_lower,predicted_points+hi AS ci_upper FROM preds JOIN w USING ({P4})""", "ci_lower ci_upper", "preds")
def _(t):
    return E.conformal_intervals(t.predictions).select(*ID, "ci_lower", "ci_upper")


@query("E13_evaluation_matrix", f"""WITH h AS (SELECT *, '1w' AS horizon FROM preds UNION ALL SELECT * REPLACE (predicted_points*1.1 AS predicted_points),'4w' FROM preds WHERE "week">4)
 SELECT {P4},horizon,count(*) AS n,sqrt(avg({E_}*{E_})) AS rmse,avg(abs{E_}) AS mae,1-sum({E_}*{E_})/(sum(fantasy_points*fantasy_points)-sum(fantasy_points)*sum(fantasy_points)/count(*)) AS r2,avg(CAST(abs{E_}<=7 AS INT))*100 AS within_7_pct,avg(CAST(abs{E_}<=10 AS INT))*100 AS within_10_pct,
 avg(CAST({TI('fantasy_points')}={TI('predicted_points')} AS INT)) AS tier_accuracy,CASE WHEN count(*) FILTER (fantasy_points>=20 AND predicted_points>=20)>0 THEN 2.0*count(*) FILTER (fantasy_points>=20 AND predicted_points>=20)/(count(*) FILTER (fantasy_points>=20)+count(*) FILTER (predicted_points>=20)) ELSE 0.0 END AS boom_f1,
 CASE WHEN count(*) FILTER (fantasy_points<5 AND predicted_points<5)>0 THEN 2.0*count(*) FILTER (fantasy_points<5 AND predicted_points<5)/(count(*) FILTER (fantasy_points<5)+count(*) FILTER (predicted_points<5)) ELSE 0.0 END AS bust_f1,
 sqrt(avg(pow(fantasy_points-predicted_std,2))) AS baseline_rmse,(1-sqrt(avg({E_}*{E_}))/sqrt(avg(pow(fantasy_points-predicted_std,2))))*100 AS vs_baseline_pct FROM h GROUP BY {P4},horizon""",
       "rmse mae r2 within_7_pct within_10_pct tier_accuracy boom_f1 bust_f1 baseline_rmse vs_baseline_pct", "preds")
def _(t):
    p = t.predictions
    h = p.withColumn("horizon", F.lit("1w")).unionByName(p.where(F.col("week") > 4).withColumns({"predicted_points": F.col("predicted_points") * 1.1, "horizon": F.lit("4w")}))
    return E.evaluation_matrix(h, ["position", "horizon"], baseline="predicted_std")


@query("E13_by_score_range", f"""WITH s AS (SELECT *, CASE WHEN fantasy_points>0 AND fantasy_points<=8 THEN 'Low (0-8)' WHEN fantasy_points>8 AND fantasy_points<=15 THEN 'Medium (8-15)' WHEN fantasy_points>15 AND fantasy_points<=25 THEN 'High (15-25)' WHEN fantasy_points>25 AND fantasy_points<=100 THEN 'Elite (25+)' END AS score_range FROM preds)
 SELECT score_range,count(*) AS n,avg(-{E_}) AS mean_error,sqrt(avg({E_}*{E_})) AS rmse FROM s WHERE score_range IS NOT NULL GROUP BY ALL""", "mean_error rmse", "preds")
def _(t):
    p = t.predictions.withColumn("score_range", E.score_range(F.col("fantasy_points"))).where(F.col("score_range").isNotNull())
    return E.regression_metrics(p, ["score_range"]).select("score_range", "n", "mean_error", "rmse")


@query("E13_by_utilization_tier", f"""WITH s AS (SELECT *, CASE WHEN predicted_std*5>=80 THEN 'Elite' WHEN predicted_std*5>=70 THEN 'Strong' WHEN predicted_std*5>=60 THEN 'Average' WHEN predicted_std*5>=50 THEN 'Below Average' ELSE 'Low' END AS tier FROM preds) SELECT tier,count(*) AS n,avg(fantasy_points) AS avg_actual,avg(predicted_points) AS avg_predicted,sqrt(avg({E_}*{E_})) AS rmse,avg(abs{E_}) AS mae FROM s GROUP BY ALL""", "avg_actual avg_predicted rmse mae", "preds")
def _(t):
    from weekgrain.functions.exprs import utilization_tier
    p = t.predictions.withColumn("tier", utilization_tier(F.col("predicted_std") * 5))
    return E.regression_metrics(p, ["tier"]).select("tier", "n", "avg_actual", "avg_predicted", "rmse", "mae")


@query("E13_error_profile", f"""SELECT {P4},count(*) AS n,avg(-{E_}) AS mean_error,stddev_samp({E_}) AS std_error,skewness(-{E_}) AS skewness,avg(CAST({E_}<0 AS INT))*100 AS over_predictions_pct,avg(CAST({E_}>0 AS INT))*100 AS under_predictions_pct,avg(CAST(abs{E_}>10 AS INT))*100 AS large_misses_pct,max(-{E_}) AS worst_over_prediction,min(-{E_}) AS worst_under_prediction FROM preds GROUP BY {P4}""",
       "mean_error std_error skewness over_predictions_pct under_predictions_pct large_misses_pct worst_over_prediction worst_under_prediction", "preds")
def _(t):
    p = t.predictions
    return E.error_profile(p, ["position"])


@query("E14_success_criteria", f"""WITH m AS (SELECT {P4},{MET} FROM preds GROUP BY {P4}) SELECT {P4},rmse,CAST(CASE {P4} WHEN 'QB' THEN 7.5 WHEN 'RB' THEN 8.5 WHEN 'WR' THEN 8.0 ELSE 7.0 END AS DOUBLE) AS rmse_target,CAST(rmse<=CASE {P4} WHEN 'QB' THEN 7.5 WHEN 'RB' THEN 8.5 WHEN 'WR' THEN 8.0 ELSE 7.0 END AS INT) AS rmse_pass,
 CAST(r2>=0.5 AS INT) AS r2_pass,CAST(mape_floor3<25 AS INT) AS mape_pass,CAST(within_7_pct>=70 AS INT) AS within_7_pass,CAST(within_10_pct>=80 AS INT) AS within_10_pass FROM m""", "rmse rmse_target", "preds")
def _(t):
    return E.success_criteria(E.regression_metrics(t.predictions, ["position"])).select("position", "rmse", "rmse_target", "rmse_pass", "r2_pass", "mape_pass", "within_7_pass", "within_10_pass")


@query("E14_week_stability", f"""WITH w AS (SELECT season,"week",sqrt(avg({E_}*{E_})) AS rmse FROM preds GROUP BY ALL), s AS (SELECT season,avg(rmse) AS avg_weekly_rmse,max(rmse) AS max_weekly_rmse FROM w GROUP BY ALL) SELECT *, (max_weekly_rmse/avg_weekly_rmse-1)*100 AS max_degradation_pct,CAST((max_weekly_rmse/avg_weekly_rmse-1)*100<=20 AS INT) AS season_stability_ok FROM s""", "avg_weekly_rmse max_weekly_rmse max_degradation_pct", "preds")
def _(t):
    return E.week_stability(t.predictions)


@query("A17_across_seasons", f"""WITH m AS (SELECT season,{P4},{MET} FROM preds GROUP BY season,{P4}) SELECT {P4},avg(rmse) AS rmse_mean,stddev_pop(rmse) AS rmse_std,avg(mae) AS mae_mean,stddev_pop(mae) AS mae_std,avg(r2) AS r2_mean,stddev_pop(r2) AS r2_std,count(*) AS n_folds FROM m GROUP BY {P4}""", "rmse_mean rmse_std mae_mean mae_std r2_mean r2_std", "preds")
def _(t):
    return E.across_seasons(E.regression_metrics(t.predictions, ["season", "position"]), ["position"])


LOG = f"""lg AS (SELECT {P4},'1w' AS horizon,season,"week",avg(abs{E_}) AS mae,sqrt(avg({E_}*{E_})) AS rmse,1-sum({E_}*{E_})/(sum(fantasy_points*fantasy_points)-sum(fantasy_points)*sum(fantasy_points)/count(*)) AS r2,avg(CAST(abs{E_}<=10 AS INT))*100 AS accuracy_pct,count(*) AS n_predictions FROM preds GROUP BY ALL)"""


def _log(t):
    m = E.regression_metrics(t.predictions, ["position", "season", "week"])
    return m.select("position", F.lit("1w").alias("horizon"), "season", "week", "mae", "rmse", "r2", F.col("within_10_pct").alias("accuracy_pct"), F.col("n").alias("n_predictions"))


@query("A19_accuracy_dashboard", f"""WITH {LOG} SELECT {P4},horizon,avg(mae) AS avg_mae,avg(rmse) AS avg_rmse,avg(r2) AS avg_r2,avg(accuracy_pct) AS avg_accuracy,CAST(sum(n_predictions) AS BIGINT) AS total_predictions,count(*) AS weeks_tracked FROM lg WHERE season>=(SELECT max(season) FROM lg) AND "week">=(SELECT max("week") FROM lg)-4 GROUP BY ALL""".replace("FROM lg WHERE", "FROM lg WHERE"), "avg_mae avg_rmse avg_r2 avg_accuracy", "preds")
def _(t):
    return E.accuracy_dashboard(_log(t))


@query("E22_run_drift", f"""WITH {LOG}, s AS (SELECT {P4},season,avg(rmse) AS rmse FROM lg GROUP BY ALL), l AS (SELECT *, lag(rmse) OVER (PARTITION BY {P4} ORDER BY season) AS previous_rmse FROM s) SELECT *, (rmse/previous_rmse-1)*100 AS pct_change,CAST(coalesce((rmse/previous_rmse-1)*100>2,false) AS INT) AS drift_detected FROM l""", "rmse previous_rmse pct_change", "preds")
def _(t):
    runs = _log(t).groupBy("position", "season").agg(F.avg("rmse").alias("rmse"))
    return E.run_drift(runs, ["position"], "season", 2.0)


@query("E25_training_requirements", f"SELECT {P4},count(DISTINCT player_id) AS n_players,7 AS n_seasons,CAST(count(DISTINCT player_id)>=CASE {P4} WHEN 'QB' THEN 30 WHEN 'RB' THEN 60 WHEN 'WR' THEN 70 ELSE 30 END AS INT) AS players_ok,0 AS seasons_ok FROM panel GROUP BY {P4}")
def _(t):
    return E.training_requirements(t.panel, "18w")


@query("E25_outlier_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\",CAST(sum(CAST(abs({c}-m)>3*s AS INT)) AS BIGINT) AS n_outliers,avg(CAST(abs({c}-m)>3*s AS INT)) AS share FROM panel,(SELECT avg({c}) AS m,stddev_samp({c}) AS s FROM panel)" for c in ("fantasy_points", "targets", "air_yards")), "share")
def _(t):
    return E.outlier_report(t.panel, ["fantasy_points", "targets", "air_yards"])


@query("E26_season_error_totals", f"""WITH s AS (SELECT season,player_id,name,{P4},sum(predicted_points) AS predicted_total,sum(fantasy_points) AS actual_total,count(*) AS games FROM preds GROUP BY ALL) SELECT *, predicted_total-actual_total AS error FROM s QUALIFY row_number() OVER (PARTITION BY season ORDER BY round(actual_total,9) DESC,player_id)<=200""", "predicted_total actual_total error", "preds")
def _(t):
    return E.season_error_totals(t.predictions)


# --- folds ---------------------------------------------------------------------------------
SZ = "sz AS (SELECT season,row_number() OVER (ORDER BY season) AS s,count(*) OVER () AS top FROM (SELECT DISTINCT season FROM panel))"
TZ = 'tz AS (SELECT season,"week",row_number() OVER (ORDER BY season,"week") AS t,count(*) OVER () AS top FROM (SELECT DISTINCT season,"week" FROM panel))'


@query("E15_season_holdout", "SELECT 1 AS fold,CASE WHEN season>=2000 THEN 'test' ELSE 'train' END AS role,season FROM (SELECT DISTINCT season FROM panel) WHERE season>=2000 OR season<1999")
def _(t):
    return FO.season_holdout(t.panel, [2000, 2001], gap=1)


@query("E15_season_folds", f"WITH {SZ} SELECT f.fold,CASE WHEN s=top-3+f.fold THEN 'test' ELSE 'train' END AS role,season FROM sz,(SELECT unnest([1,2,3]) AS fold) f WHERE s=top-3+f.fold OR s<=top-3+f.fold-2")
def _(t):
    return FO.season_folds(t.panel, 3, gap=1)


@query("E15_purged_folds", f"WITH {TZ} SELECT f.fold,CASE WHEN t<=f.fold*(top//6)-1 THEN 'train' ELSE 'test' END AS role,season,\"week\" FROM tz,(SELECT unnest([1,2,3,4,5]) AS fold) f WHERE f.fold*(top//6)>=0.3*top AND (t<=f.fold*(top//6)-1 OR (t>f.fold*(top//6)+1 AND t<=f.fold*(top//6)+1+top//6))")
def _(t):
    return FO.purged_folds(t.panel)


@query("E15_walk_forward", f"WITH {SZ} SELECT f.fold,CASE WHEN s<f.fold+3 THEN 'train' ELSE 'test' END AS role,season FROM sz,(SELECT unnest([1,2,3,4]) AS fold) f WHERE f.fold<=top-4 AND s>=f.fold AND (s<f.fold+3 OR s=f.fold+4) AND f.fold<=top-3-1-1+1")
def _(t):
    return FO.walk_forward_seasons(t.panel, 3, 1, gap=1)


@query("E15_expanding_weeks", f"WITH {TZ}, f AS (SELECT t AS fold FROM tz WHERE t>=70) SELECT fold,CASE WHEN t=fold THEN 'test' ELSE 'train' END AS role,season,\"week\" FROM tz,f WHERE t=fold OR (t<fold AND t>=fold-8)")
def _(t):
    return FO.expanding_weeks(t.panel, 70, window=8)


@query("E15_fold_metrics", f"WITH {SZ}, f AS (SELECT f.fold,season FROM sz,(SELECT unnest([1,2,3]) AS fold) f WHERE s=top-3+f.fold) SELECT fold,count(*) AS n,sqrt(avg({E_}*{E_})) AS rmse FROM preds JOIN f USING (season) GROUP BY fold", "rmse", "preds")
def _(t):
    folds = FO.season_folds(t.panel, 3, gap=1).where(F.col("role") == "test")
    return E.regression_metrics(FO.with_folds(t.predictions, folds), ["fold"]).select("fold", "n", "rmse")


# --- leaks and drift ----------------------------------------------------------------------
@query("E17_shift_check", f"""WITH a AS (SELECT player_id,season,"week",avg(fantasy_points) OVER ({PW} {pre(3)}) AS fantasy_points_roll3_mean,avg(fantasy_points) OVER ({PW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad_roll FROM panel), f AS (SELECT * FROM (SELECT *, row_number() OVER ({PW}) AS rn FROM a) WHERE rn=1)
 SELECT 'fantasy_points_roll3_mean' AS "column",avg(CAST(fantasy_points_roll3_mean IS NULL AS INT)) AS first_null_rate,1 AS shifted FROM f UNION ALL SELECT 'bad_roll',avg(CAST(bad_roll IS NULL AS INT)),0 FROM f""", "first_null_rate")
def _(t):
    from weekgrain.keys import KEYS
    p = W.rolling_means(t.panel, ["fantasy_points"], [3]).withColumn("bad_roll", F.avg("fantasy_points").over(KEYS.entity_window().rowsBetween(-2, 0)))
    return E.shifted_check(p, ["fantasy_points_roll3_mean", "bad_roll"])


@query("E17_suspicious_correlations", " UNION ALL ".join(f"SELECT '{c}' AS \"column\",corr({e},fantasy_points) AS correlation,CAST(abs(corr({e},fantasy_points))>0.95 AS INT) AS suspicious FROM panel" for c, e in (("targets", "targets"), ("copy", "fantasy_points*2+1"), ("air_yards", "air_yards"))), "correlation")
def _(t):
    return E.suspicious_correlations(t.panel.withColumn("copy", F.col("fantasy_points") * 2 + 1), ["targets", "copy", "air_yards"])


@query("E18_error_drift", f"""WITH e AS (SELECT season,{P4},fantasy_points-predicted_points AS e FROM preds), c AS (SELECT {P4},count(*) AS n_rows,sqrt(avg(e*e)) AS rmse,avg(abs(e)) AS mae FROM e WHERE season>=2000 GROUP BY ALL HAVING count(*)>=5), r AS (SELECT {P4},sqrt(avg(e*e)) AS reference_rmse FROM e WHERE season<2000 GROUP BY ALL)
 SELECT *, (rmse-reference_rmse)/reference_rmse AS degradation,CAST(coalesce((rmse-reference_rmse)/reference_rmse>0.02,false) AS INT) AS rmse_alert FROM c LEFT JOIN r USING ({P4})""", "rmse mae reference_rmse degradation", "preds")
def _(t):
    p = t.predictions
    return E.error_drift(p.where(F.col("season") >= 2000), p.where(F.col("season") < 2000), ["position"], limit=0.02)


@query("E18_moment_drift", f"""WITH c AS (SELECT {P4},avg(CAST(predicted_points IS NULL AS INT)) AS batch_null_rate,avg(predicted_points) AS batch_mean,stddev_pop(predicted_points) AS batch_std FROM preds WHERE season=2001 GROUP BY ALL), r AS (SELECT {P4},avg(predicted_points) AS reference_mean,stddev_pop(predicted_points) AS reference_std FROM preds WHERE season<2000 GROUP BY ALL)
 SELECT *, abs(batch_mean-reference_mean)/reference_mean AS mean_drift,abs(batch_std-reference_std)/reference_std AS std_drift,CAST(batch_null_rate>0.05 AS INT) AS null_alert,CAST(abs(batch_mean-reference_mean)/reference_mean>0.25 AS INT) AS mean_alert,CAST(abs(batch_std-reference_std)/reference_std>0.5 AS INT) AS std_alert FROM c JOIN r USING ({P4})""",
       "batch_null_rate batch_mean batch_std reference_mean reference_std mean_drift std_drift", "preds")
def _(t):
    p = t.predictions
    return E.moment_drift(p.where(F.col("season") == 2001), p.where(F.col("season") < 2000), "predicted_points", ["position"])


KSC = ["fantasy_points", "targets", "air_yards"]


@query("E18_feature_drift", "WITH " + ",".join(
    f"u{i} AS (SELECT {c}*CASE WHEN season>=2000 THEN {k} ELSE 1 END AS v,CAST(season>=2000 AS INT) AS s FROM panel), g{i} AS (SELECT v,sum(s) AS a,sum(1-s) AS b FROM u{i} GROUP BY v), h{i} AS (SELECT '{c}' AS feature,sum(a) OVER (ORDER BY v)/sum(a) OVER () AS fa,sum(b) OVER (ORDER BY v)/sum(b) OVER () AS fb,sum(a) OVER () AS na,sum(b) OVER () AS nb FROM g{i})" for i, (c, k) in enumerate(zip(KSC, (1, 1, 2)))) +
    " SELECT feature,max(abs(fa-fb)) AS ks_stat,CAST(max(na) AS BIGINT) AS n_cur,CAST(max(nb) AS BIGINT) AS n_ref,CAST(max(abs(fa-fb))>0.2 AS INT) AS drifted FROM (" + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(3)) + ") GROUP BY feature", "ks_stat")
def _(t):
    p = t.panel.withColumn("targets", F.col("targets").cast("double"))
    cur = p.where(F.col("season") >= 2000).withColumn("air_yards", F.col("air_yards") * 2)
    return E.feature_drift(cur, p.where(F.col("season") < 2000), KSC).drop("p_value")


@query("E18_mean_shift", " UNION ALL ".join(f"SELECT '{c}' AS feature,abs((SELECT avg({c}) FROM panel WHERE season>=2000)-avg({c}))/stddev_samp({c}) AS z,CAST(abs((SELECT avg({c}) FROM panel WHERE season>=2000)-avg({c}))/stddev_samp({c})>2 AS INT) AS drifted FROM panel WHERE season<2000" for c in KSC), "z")
def _(t):
    p = t.panel
    return E.mean_shift(p.where(F.col("season") >= 2000), p.where(F.col("season") < 2000), KSC)


@query("E19_ranking_auc", f"""WITH l AS (SELECT CAST(season>=2000 AS INT) AS y,fantasy_points AS x FROM panel), r AS (SELECT y,{AR('x', '1')} AS r FROM l) SELECT (sum(r) FILTER (y=1)-count(*) FILTER (y=1)*(count(*) FILTER (y=1)+1)/2.0)/(count(*) FILTER (y=1)*count(*) FILTER (y=0)) AS auc,count(*) FILTER (y=1) AS n_pos,count(*) FILTER (y=0) AS n_neg FROM r""", "auc")
def _(t):
    p = t.panel.select((F.col("season") >= 2000).cast("int").alias("y"), F.round("fantasy_points", 9).alias("x"))
    return E.ranking_auc(p, "y", "x")


@query("E21_shadow_compare", f"""WITH d AS (SELECT *, avg(fantasy_points) OVER ({PW} {pre(8)}) AS cand FROM panel), e AS (SELECT d.season,d."week",p.fantasy_points,p.predicted_points,cand FROM preds p JOIN d USING (player_id,season,"week")), w AS (SELECT season,"week",sqrt(avg(pow(fantasy_points-predicted_points,2))) AS a,sqrt(avg(pow(fantasy_points-cand,2))) AS b FROM e GROUP BY ALL),
 m AS (SELECT avg(a) AS production_rmse_avg,avg(b) AS candidate_rmse_avg,count(*) AS weeks_evaluated FROM w), x AS (SELECT round(abs(fantasy_points-predicted_points)-abs(fantasy_points-cand),9) AS df FROM e), y AS (SELECT df,{AR('abs(df)', '1')} AS r,count(*) OVER (PARTITION BY abs(df)) AS tc FROM x WHERE df<>0),
 z AS (SELECT sum(r) FILTER (df>0) AS w_plus,CAST(count(*) AS DOUBLE) AS n,sum(tc*tc-1.0) AS tt FROM y), q AS (SELECT *, (w_plus-n*(n+1)/4)/sqrt((n*(n+1)*(2*n+1)-tt/2)/24) AS z FROM z)
 SELECT production_rmse_avg,candidate_rmse_avg,weeks_evaluated,w_plus,n,z,(1-candidate_rmse_avg/production_rmse_avg)*100 AS improvement_pct,CAST(z>1.6448536269514722 AS INT) AS is_significant,CASE WHEN (1-candidate_rmse_avg/production_rmse_avg)*100>=2 AND z>1.6448536269514722 THEN 'PROMOTE' ELSE 'ROLLBACK' END AS recommendation FROM m,q""",
       "production_rmse_avg candidate_rmse_avg w_plus n z improvement_pct", "preds")
def _(t):
    cand = W.rolling_means(t.panel, ["fantasy_points"], [8]).select(*ID, F.col("fantasy_points_roll8_mean").alias("cand"))
    return E.shadow_compare(t.predictions.join(cand, ID), "predicted_points", "cand").drop("p_value")

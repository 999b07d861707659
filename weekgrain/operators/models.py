"""Models on Spark ML, and linear models from additive moments.

Linear fits never rescan rows for another fold, window or penalty: the moments of
every (position, season[, week]) are summed once and solved on the driver, where
they are p x p. Trees, calibration and classification are Spark ML.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.exprs import clip, lookup
from weekgrain.functions.order_stats import quantiles, with_ranks
from weekgrain.keys import KEYS, Keys, settled
from weekgrain.operators.evaluate import ranking_auc
from weekgrain.operators.boosting import season_boosted
from weekgrain.operators.fit import bootstrap_grams, gram_by, ridge, rmse, sse

# --- linear models from moments -------------------------------------------------------------


def ridge_scaled(gram: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """[intercept, x...] of a ridge whose penalty acts on standardised columns."""
    n = gram[0, 0]
    mean = gram[0, 1:-1] / n
    cov = gram[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd = np.where(sd > 1e-9, sd, 1.0)
    ym = gram[0, -1] / n
    xy = (gram[1:-1, -1] / n - mean * ym) / sd
    z = cov / np.outer(sd, sd)
    b = np.linalg.solve(z * n + alpha * np.eye(len(sd)), xy * n) / sd
    return np.concatenate([[ym - b @ mean], b])


def linear(columns: Sequence[str], beta: np.ndarray) -> Column:
    """Prediction of given coefficients as one JVM expression."""
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(b) for c, b in zip(columns, beta[1:])), F.lit(float(beta[0])))


def linear_from(columns: Sequence[str], coefs: str) -> Column:
    """Prediction of coefficients that sit in an array column of the row."""
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return F.aggregate(F.zip_with(x, F.col(coefs), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def fit_positions(train: DataFrame, columns: Sequence[str], target: str, alpha: float = 1.0, keys: Keys = KEYS) -> dict[str, np.ndarray]:
    """One scan, one ridge per position."""
    grams = gram_by(train, [keys.group], columns, target, centre=True)
    return {k[0]: grams.unshifted(ridge_scaled(g, alpha)) for k, g in grams.table.items() if g[0, 0] > len(columns) + 1}


def predict_positions(df: DataFrame, columns: Sequence[str], betas: Mapping[str, np.ndarray], out: str = "predicted_points", keys: Keys = KEYS) -> DataFrame:
    return df.withColumn(out, lookup(F.col(keys.group), {p: linear(columns, b) for p, b in betas.items()}))


def weekly_refit(panel: DataFrame, columns: Sequence[str], target: str, first_season: int, alpha: float = 1.0, min_total: int = 100,
                 min_group: int = 30, keys: Keys = KEYS) -> DataFrame:
    """Every week from ``first_season`` on is predicted by a ridge fitted on all strictly earlier weeks of its position.

    The columns must be history features: same-week statistics would give the answer away.
    One scan collects moments by (position, season, week); prefix sums give every fold.
    """
    grams = gram_by(panel, [keys.group, keys.season, keys.week], columns, target, centre=True)
    rows = []
    weeks = sorted({k[1:] for k in grams.table})
    groups = sorted({k[0] for k in grams.table})
    past = {g: np.zeros((len(columns) + 2,) * 2) for g in groups}
    for at in weeks:
        total = sum(p[0, 0] for p in past.values())
        if at[0] >= first_season and total >= min_total:
            rows += [(g, at[0], at[1], [float(b) for b in grams.unshifted(ridge_scaled(past[g], alpha))]) for g in groups if past[g][0, 0] >= min_group]
        for g in groups:
            past[g] = past[g] + grams.table.get((g, *at), 0.0)
    schema = f"{keys.group} string, {keys.season} int, {keys.week} int, _coef array<double>"
    coefs = panel.sparkSession.createDataFrame(rows, schema)  # positions x weeks rows; the join picks its way by size
    return panel.join(coefs, [keys.group, *keys.period]).withColumn("predicted_points", linear_from(columns, "_coef")).drop("_coef")


def training_windows(panel: DataFrame, columns: Sequence[str], target: str, years: Sequence[int] = tuple(range(1, 11)), folds: int = 3,
                     alpha: float = 1.0, min_train: int = 50, keys: Keys = KEYS) -> DataFrame:
    """RMSE of every training-window length per position over the last seasons, and the best, without rescanning."""
    grams = gram_by(panel, [keys.group, keys.season], columns, target, centre=True)
    rows = []
    for g in sorted({k[0] for k in grams.table}):
        seasons = sorted(k[1] for k in grams.table if k[0] == g)
        for n in years:
            errs = []
            for test in seasons[-folds:]:
                window = [s for s in seasons if s < test][-n:]
                train = grams.total(lambda k: k[0] == g and k[1] in window)
                if len(window) == n and train[0, 0] >= min_train and (g, test) in grams.table:
                    now = grams.table[(g, test)]
                    errs.append(rmse(now, ridge_scaled(train, alpha)))
            if errs:
                rows.append((g, n, float(np.mean(errs)), float(np.std(errs)), len(errs)))
    df = panel.sparkSession.createDataFrame(rows, f"{keys.group} string, n_train_years int, mean_rmse double, std_rmse double, n_folds int")
    best = df.groupBy(keys.group).agg(F.min_by("n_train_years", "mean_rmse").alias("_best"))
    return df.join(best, keys.group).withColumn("is_best", (F.col("n_train_years") == F.col("_best")).cast("int")).drop("_best")


def penalty_search(panel: DataFrame, columns: Sequence[str], target: str, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0), folds: int = 3, keys: Keys = KEYS) -> DataFrame:
    """RMSE of every penalty per position over season folds that never train on later seasons."""
    grams = gram_by(panel, [keys.group, keys.season], columns, target, centre=True)
    rows = []
    for g in sorted({k[0] for k in grams.table}):
        seasons = sorted(k[1] for k in grams.table if k[0] == g)
        for a in alphas:
            for test in seasons[-folds:]:
                train, now = grams.total(lambda k: k[0] == g and k[1] < test), grams.table[(g, test)]
                if train[0, 0] > len(columns) + 1 and now[0, 0] > 0:
                    rows.append((g, float(a), int(test), rmse(now, ridge_scaled(train, a))))
    return panel.sparkSession.createDataFrame(rows, f"{keys.group} string, alpha double, test_season int, rmse double")


def learning_curve(panel: DataFrame, columns: Sequence[str], target: str, test_season: int, parts: int = 10, keys: Keys = KEYS) -> DataFrame:
    """Train and test RMSE for growing shares of the training rows (shares by key hash, so they are nested)."""
    slot = F.when(F.col(keys.season) >= test_season, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*keys.grain), F.lit(parts)).cast("int"))
    grams = gram_by(panel.withColumn("_slot", slot), ["_slot"], columns, target, centre=True)
    test, rows = grams.table[(-1,)], []
    for k in range(1, parts + 1):
        train = grams.total(lambda s: 0 <= s[0] < k)
        b = ridge_scaled(train)
        rows.append((k / parts, int(train[0, 0]), rmse(train, b), rmse(test, b)))
    df = panel.sparkSession.createDataFrame(rows, "fraction double, n_train long, train_rmse double, test_rmse double")
    return df.withColumn("gap_ratio", F.col("test_rmse") / F.col("train_rmse"))


def feature_count_curve(panel: DataFrame, ranked: Sequence[str], target: str, folds: int = 3, keys: Keys = KEYS) -> DataFrame:
    """Cross-validated RMSE by number of ranked features; the smallest count within one standard error of the best is chosen."""
    grams = gram_by(panel, [keys.season], ranked, target, centre=True)
    seasons = sorted(k[0] for k in grams.table)
    rows = []
    for k in range(1, len(ranked) + 1):
        pick = [0, *range(1, k + 1), len(ranked) + 1]
        errs = []
        for test in seasons[-folds:]:
            train, now = grams.total(lambda s: s[0] < test)[np.ix_(pick, pick)], grams.table[(test,)][np.ix_(pick, pick)]
            errs.append(rmse(now, ridge_scaled(train)))
        rows.append((k, float(np.mean(errs)), float(np.std(errs) / len(errs) ** 0.5)))
    low = min(rows, key=lambda r: r[1])
    chosen = min(r[0] for r in rows if r[1] <= low[1] + low[2])
    return panel.sparkSession.createDataFrame([(*r, int(r[0] == chosen)) for r in rows], "n_features int, cv_rmse double, standard_error double, chosen int")


def stability_selection(panel: DataFrame, columns: Sequence[str], target: str, rounds: int = 10, penalty: float = 0.05, keep: float = 0.6, keys: Keys = KEYS) -> DataFrame:
    """Share of bootstraps in which a lasso keeps each column.

    Poisson(1) row weights come from a key hash per round, so the moments of all bootstraps come from one pass over the rows as they are, and a
    re-run draws the same weights.
    """
    u = lambda r: F.pmod(F.xxhash64(*keys.grain, F.lit(r)), F.lit(1_000_000)) / 1e6
    grams = bootstrap_grams(panel, columns, target, [_poisson(u(r)) for r in range(rounds)])
    hits = np.zeros(len(columns))
    for g in grams.table.values():
        hits += _lasso(g, penalty) != 0
    rows = [(c, float(h / len(grams.table)), int(h / len(grams.table) >= keep)) for c, h in zip(columns, hits)]
    return panel.sparkSession.createDataFrame(rows, "feature string, frequency double, selected int")


def _poisson(u: Column) -> Column:
    """Poisson(1) draw from a uniform."""
    # fixed values: cumulative Poisson(1) probabilities 0..4
    return F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)


def _lasso(gram: np.ndarray, penalty: float, sweeps: int = 200) -> np.ndarray:
    """Coordinate descent on standardised moments; penalty relative to the largest correlation."""
    n = gram[0, 0]
    mean = gram[0, 1:-1] / n
    cov = gram[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    z, xy = cov / np.outer(sd, sd), (gram[1:-1, -1] / n - mean * gram[0, -1] / n) / sd
    lam, b = penalty * np.abs(xy).max(), np.zeros(len(sd))
    for _ in range(sweeps):
        old = b.copy()
        for j in range(len(b)):
            r = xy[j] - z[j] @ b + z[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - lam, 0.0) / z[j, j]
        if np.abs(b - old).max() < 1e-9:
            break
    return b


# --- Spark ML pipelines --------------------------------------------------------------------------
def prepared(columns: Sequence[str]) -> list:
    """Median fill, assembly and scaling, all fitted on training rows."""
    return [Imputer(strategy="median", inputCols=list(columns), outputCols=[f"_i_{c}" for c in columns]),
            VectorAssembler(inputCols=[f"_i_{c}" for c in columns], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]


def regressor(kind: str, target: str, weight: str | None = None, **params):
    """ridge, forest or boosted trees."""
    made = {"ridge": lambda: LinearRegression(featuresCol="features", labelCol=target, regParam=params.get("regParam", 0.1), elasticNetParam=0.0),
            "forest": lambda: RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=params.get("numTrees", 30), maxDepth=params.get("maxDepth", 6), seed=42),
            "boosted": lambda: GBTRegressor(featuresCol="features", labelCol=target, maxIter=params.get("maxIter", 15), maxDepth=params.get("maxDepth", 4), seed=42)}[kind]()
    return made.setWeightCol(weight) if weight else made


def fit_pipelines(train: DataFrame, columns: Sequence[str], target: str, kind: str = "forest", positions: Sequence[str] = tuple(C.POSITIONS),
                  weight: str | None = None, keys: Keys = KEYS, **params) -> dict[str, PipelineModel]:
    """One pipeline per position (target and horizon are the caller's). Columns must be doubles."""
    used = [keys.group, *columns, target, *([weight] if weight else [])]
    known = train.where(F.col(target).isNotNull()).select(*used).persist(StorageLevel.MEMORY_AND_DISK)  # read by every stage of every position
    try:
        return {p: Pipeline(stages=[*prepared(columns), regressor(kind, target, weight, **params)]).fit(known.where(F.col(keys.group) == p)) for p in positions}
    finally:
        known.unpersist()


def apply_pipelines(models: Mapping[str, PipelineModel], df: DataFrame, out: str = "predicted_points", keys: Keys = KEYS) -> DataFrame:
    parts = [m.transform(df.where(F.col(keys.group) == p)).select(*df.columns, F.col("prediction").alias(out)) for p, m in models.items()]
    res = parts[0]
    for other in parts[1:]:
        res = res.unionByName(other)
    return res


def fold_coefficients(panel: DataFrame, seasons: Sequence[int], columns: Sequence[str], target: str, alpha: float = 1.0, min_rows: int = 20, keys: Keys = KEYS) -> DataFrame:
    """Ridge of every (position, season) on all earlier seasons. One scan: a fold's moments are those of all rows less those of its own and later seasons."""
    grams = gram_by(panel, [keys.group, keys.season], columns, target, centre=True)
    rows = []
    for g in sorted({k[0] for k in grams.table if k[0] is not None}):
        every = grams.total(lambda k: k[0] == g)
        for s in seasons:
            past = every - grams.total(lambda k: k[0] == g and k[1] >= s)
            if past[0, 0] >= max(min_rows, len(columns) + 2):
                rows.append((g, int(s), [float(b) for b in grams.unshifted(ridge_scaled(past, alpha))]))
    return panel.sparkSession.createDataFrame(rows, f"{keys.group} string, {keys.season} int, _coef array<double>")  # positions x seasons rows


def out_of_fold(panel: DataFrame, seasons: Sequence[int], columns: Sequence[str], target: str, kinds: Sequence[str], positions: Sequence[str] = tuple(C.POSITIONS),
                alpha: float = 1.0, keys: Keys = KEYS, **params) -> DataFrame:
    """Predictions of each season by models of all earlier seasons, one column ``oof_<kind>`` per kind; rows that a kind cannot predict are left out.

    ``ridge`` comes from moments and ``boosted`` from additive histograms (``params`` go there): all folds and positions at once, without a row copied
    per fold. Any other kind of :func:`regressor` is a Spark ML pipeline fitted per season and position.
    """
    panel = settled(panel.where(F.col(keys.group).isin(list(positions))))  # every kind scans it
    now = panel.where(F.col(keys.season).isin(list(seasons)) & F.col(target).isNotNull())
    for kind in kinds:
        name = f"oof_{kind}"
        if kind == "ridge":
            coefs = fold_coefficients(panel, seasons, columns, target, alpha, keys=keys)
            now = now.join(coefs, [keys.group, keys.season]).withColumn(name, linear_from(columns, "_coef")).drop("_coef")
        elif kind == "boosted":
            now = now.join(season_boosted(panel, seasons, columns, target, name, keys=keys, **params), [*keys.grain, keys.group])
        else:
            parts = [apply_pipelines(fit_pipelines(panel.where(F.col(keys.season) < s), columns, target, kind, positions, keys=keys), now.where(F.col(keys.season) == s), name, keys)
                     for s in seasons]
            now = reduce(DataFrame.unionByName, parts)
    return now


# fixed values: shares of the kinds where there is too little to learn them from
ENSEMBLE_SHARES = {"forest": 0.30, "boosted": 0.40, "ridge": 0.30}


def stack(oof: DataFrame, kinds: Sequence[str], target: str, alphas: Sequence[float] = tuple(np.logspace(-2, 2, 20)), min_rows: int = 20, shares: Mapping[str, float] = ENSEMBLE_SHARES,
          keys: Keys = KEYS) -> dict[str, np.ndarray]:
    """Ridge over out-of-fold predictions per position; fixed shares of the kinds where there are too few rows.

    The penalty is the one with the least error over seasons left out in turn: their moments are subtracted from the total, so nothing is rescanned.
    With one season it is 1.
    """
    cols = [f"oof_{k}" for k in kinds]
    grams = gram_by(oof, [keys.group, keys.season], cols, target, centre=True)
    given = np.array([shares.get(k, 1.0 / len(kinds)) for k in kinds])
    fixed = np.concatenate([[0.0], given / given.sum()])
    out = {}
    for g in sorted({k[0] for k in grams.table if k[0] is not None}):
        folds = [m for k, m in grams.table.items() if k[0] == g]
        every = sum(folds)
        if every[0, 0] < min_rows:
            out[g] = fixed
            continue
        usable = [f for f in folds if every[0, 0] - f[0, 0] > len(kinds) + 1]
        error = lambda a: sum(max(sse(f, ridge_scaled(every - f, a)), 0.0) for f in usable)
        out[g] = grams.unshifted(ridge_scaled(every, min(alphas, key=error) if usable else 1.0))
    return out


def isotonic_if_better(oof: DataFrame, pred: str, target: str, out: str = "calibrated") -> DataFrame:
    """Isotonic calibration of a prediction, kept only when its RMSE is no more than 1 % worse."""
    model = IsotonicRegression(featuresCol="_x", labelCol=target).fit(VectorAssembler(inputCols=[pred], outputCol="_x").transform(oof))
    cal = model.transform(VectorAssembler(inputCols=[pred], outputCol="_x").transform(oof))
    e = lambda c: F.sqrt(F.avg(F.pow(F.col(target) - F.col(c), 2)))
    r = cal.agg(e(pred).alias("raw"), e("prediction").alias("cal")).first()
    use = r["cal"] < r["raw"] * 1.01
    return cal.select(*oof.columns, F.col("prediction" if use else pred).alias(out), F.lit(int(use)).alias("calibration_kept"))


def conformal_table(oof: DataFrame, pred: str, target: str, spread: str, levels: Sequence[float] = (0.50, 0.80, 0.90, 0.95), keys: Keys = KEYS) -> DataFrame:
    """Per position: quantiles of absolute residuals, and of residuals over the blended spread against the normal quantile."""
    from statistics import NormalDist
    r = oof.withColumn("_a", F.abs(F.col(target) - F.col(pred)))
    sd = r.groupBy(keys.group).agg(F.stddev_pop("_a").alias("_sd"))
    r = r.join(sd, keys.group).withColumn("_b", F.col("_a") / F.greatest(0.7 * F.col("_sd") + 0.3 * F.col(spread), F.lit(1e-8)))
    name = lambda x: str(int(round(x * 100)))
    q = quantiles(r, [keys.group], "_a", {f"q{name(x)}": x for x in levels}).drop("n")
    z = quantiles(r, [keys.group], "_b", {f"z{name(x)}": x for x in levels})
    scale = {f"scale{name(x)}": clip(F.col(f"z{name(x)}") / NormalDist().inv_cdf(0.5 + x / 2), 0.5, 5.0) for x in levels}
    return q.join(z, keys.group).withColumns(scale).drop(*[f"z{name(x)}" for x in levels])


def quantile_intervals(train: DataFrame, test: DataFrame, pred: str, target: str, levels: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), keys: Keys = KEYS) -> DataFrame:
    """Quantiles of the outcome around a prediction: training residual quantiles of the position, kept in order and not below zero."""
    name = lambda x: f"q{int(round(x * 100)):02d}"
    q = quantiles(train.withColumn("_e", F.col(target) - F.col(pred)), [keys.group], "_e", {f"_{name(x)}": x for x in levels}).drop("n")
    out = test.join(q, keys.group, "left")
    return out.withColumns({name(x): F.greatest(F.col(pred) + F.col(f"_{name(x)}"), F.lit(0.0)) for x in levels}).drop(*[f"_{name(x)}" for x in levels])


def usage_to_points(train: DataFrame, test: DataFrame, usage: str, history: Sequence[str], efficiency: Sequence[str], points: str = "fantasy_points", levels: Sequence[float] = (0.80, 0.95),
                    positions: Sequence[str] = tuple(C.POSITIONS), min_validation: int = 20, keys: Keys = KEYS, **params) -> DataFrame:
    """Points of the test rows from predicted usage and efficiency, with the conversion error at each level per position.

    The trees see usage as it is at serving time, a prediction from ``history``: of each training season by models of the earlier ones (the first season
    keeps the usage itself), of the test rows by a model of all training rows. They are fitted without the last training season, on which a line then
    calibrates them and whose absolute residuals give ``conversion_error_<level>``; a position with fewer than ``min_validation`` rows there has neither.
    """
    seasons = sorted(r[0] for r in train.select(keys.season).distinct().collect())
    if not seasons:
        raise ValueError("no training rows")
    last = seasons[-1]
    seen = train.join(fold_coefficients(train, seasons[1:], history, usage, keys=keys), [keys.group, keys.season], "left")
    seen = settled(seen.withColumn("_usage", F.coalesce(F.when(F.col("_coef").isNotNull(), linear_from(history, "_coef")), F.col(usage).cast("double"))).drop("_coef"))
    served = predict_positions(test, history, fit_positions(train, history, usage, keys=keys), "_usage", keys)
    cols = ["_usage", *efficiency]
    fitting = seen if len(seasons) == 1 else seen.where(F.col(keys.season) < last)
    models = fit_pipelines(fitting, cols, points, "boosted", positions, keys=keys, **params)
    held = apply_pipelines(models, seen.where((F.col(keys.season) == last) & F.col(points).isNotNull()), "_raw_fp", keys)
    grams = gram_by(held, [keys.group], ["_raw_fp"], points, centre=True)
    lines = {p: np.array([0.0, 1.0]) for p in positions}
    lines |= {k[0]: grams.unshifted(ridge(g, 1.0)) for k, g in grams.table.items() if g[0, 0] >= min_validation}
    off = predict_positions(held, ["_raw_fp"], lines, "_cal", keys).withColumn("_off", F.abs(F.col(points) - F.col("_cal")))
    name = lambda x: f"conversion_error_{int(round(x * 100))}"
    errors = quantiles(off, [keys.group], "_off", {name(x): x for x in levels})
    errors = errors.where(F.col("n") >= min_validation).drop("n")
    out = predict_positions(apply_pipelines(models, served, "_raw_fp", keys), ["_raw_fp"], lines, "predicted_points", keys)
    return out.join(errors, keys.group, "left").drop("_raw_fp", "_usage")


def injury_classifier(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Probability of injury from a forest whose rows weigh inversely to their class."""
    share = train.agg(F.avg(label).alias("_p"))
    weighted = train.join(F.broadcast(share)).withColumn("_w", F.when(F.col(label) == 1, 0.5 / F.col("_p")).otherwise(0.5 / (1 - F.col("_p"))))  # one row
    clf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", numTrees=30, maxDepth=5, seed=42)
    model = Pipeline(stages=[*prepared(columns), clf]).fit(weighted)
    return model.transform(test).select(*test.columns, vector_to_array("probability")[1].alias("injury_prob_ml"))


def shift_auc(train: DataFrame, test: DataFrame, columns: Sequence[str], limit: float = 0.85) -> DataFrame:
    """How well trees tell test rows from train rows, on rows the trees have not seen."""
    both = train.select(*columns).withColumn("_label", F.lit(0)).unionByName(test.select(*columns).withColumn("_label", F.lit(1)))
    part = F.pmod(F.xxhash64(*columns), F.lit(2))
    model = Pipeline(stages=[*prepared(columns), GBTClassifier(featuresCol="features", labelCol="_label", maxIter=10, maxDepth=3, seed=42)]).fit(both.where(part == 0))
    scored = model.transform(both.where(part == 1)).select("_label", vector_to_array("rawPrediction")[1].alias("_score"))
    auc = ranking_auc(scored, "_label", "_score").first()["auc"]
    return both.sparkSession.createDataFrame([(float(auc), int(auc > limit))], "auc double, shifted int")


def choose_target(train: DataFrame, test: DataFrame, columns: Sequence[str], usage_target: str, points_target: str, keys: Keys = KEYS) -> DataFrame:
    """Hold-out RMSE of predicting points directly and through a usage target, and the better of the two."""
    direct = fit_positions(train, columns, points_target, keys=keys)
    usage = fit_positions(train, columns, usage_target, keys=keys)
    through = fit_positions(predict_positions(train, columns, usage, "_u", keys), ["_u"], points_target, keys=keys)
    scored = predict_positions(predict_positions(predict_positions(test, columns, direct, "_d", keys), columns, usage, "_u", keys), ["_u"], through, "_t", keys)
    rms = lambda c: F.sqrt(F.avg(F.pow(F.col(points_target) - F.col(c), 2)))
    out = scored.where(F.col(points_target).isNotNull()).groupBy(keys.group).agg(rms("_d").alias("points_rmse"), rms("_t").alias("usage_rmse"))
    return out.withColumn("chosen", F.when(F.col("usage_rmse") <= F.col("points_rmse"), "usage").otherwise("points"))


def bias_corrected(train: DataFrame, test: DataFrame, pred: str, target: str, keys: Keys = KEYS) -> DataFrame:
    """Test predictions plus the mean training residual of their position."""
    bias = train.groupBy(keys.group).agg(F.avg(F.col(target) - F.col(pred)).alias("_bias"))
    return test.join(bias, keys.group, "left").withColumn("corrected", F.col(pred) + F.coalesce("_bias", F.lit(0.0))).drop("_bias")


def without_outliers(train: DataFrame, target: str, sigma: float = 3.0, keys: Keys = KEYS) -> DataFrame:
    fit = train.groupBy(keys.group).agg(F.avg(target).alias("_m"), F.stddev_samp(target).alias("_s"))
    return train.join(fit, keys.group).where(F.abs(F.col(target) - F.col("_m")) <= sigma * F.col("_s")).drop("_m", "_s")


# --- embeddings -----------------------------------------------------------------------------------------
def player_embeddings(train: DataFrame, columns: Sequence[str], k: int = 8, keys: Keys = KEYS) -> DataFrame:
    """(player, embedding): mean, spread and maximum of each column, standardised, first k principal components."""
    stats = train.groupBy(keys.entity).agg(*[F.coalesce(f(c).cast("double"), F.lit(0.0)).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))],
                                          F.count(F.lit(1)).cast("double").alias("games"))
    cols = [c for c in stats.columns if c != keys.entity]
    stages = [VectorAssembler(inputCols=cols, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), PCA(k=k, inputCol="_scaled", outputCol="_pca")]
    return Pipeline(stages=stages).fit(stats).transform(stats).select(keys.entity, vector_to_array("_pca").alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def most_similar(vectors: DataFrame, key: str, vector: str, wanted, top: int = 5) -> DataFrame:
    """The rows closest by cosine to one given row (one vector goes to all tasks, tasks send back ``top`` rows)."""
    one = vectors.where(F.col(key) == wanted).select(F.col(vector).alias("_q")).limit(1)
    j = vectors.where(F.col(key) != wanted).join(F.broadcast(one))  # one row
    cos = dot(F.col(vector), F.col("_q")) / (F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(F.col("_q"), F.col("_q"))) + 1e-8)
    return j.select(key, cos.alias("similarity")).orderBy(F.round("similarity", 9).desc(), key).limit(top)


# --- looking into a model -----------------------------------------------------------------------------------
def permutation_importance(df: DataFrame, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame], target: str, pred: str = "predicted_points",
                           seed: int = 1, keys: Keys = KEYS) -> DataFrame:
    """Rise of the RMSE when a column's values are dealt out anew.

    Rows are numbered in two hash orders (by the value ladder, so no task sees them all); a row gets
    the value of the row that has its number in the other order.
    """
    order = lambda s: F.struct(F.xxhash64(*keys.grain, F.lit(s)).alias("h"), *keys.grain)
    base = settled(with_ranks(df.withColumns({"_o1": order(seed), "_o2": order(seed + 1)}), [([], "_o1", "_r1", "min", True), ([], "_o2", "_r2", "min", True)]).drop("_o1", "_o2"))
    rms = lambda d: d.agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col(pred), 2))).alias("rmse"))
    other = base.select(F.col("_r2").alias("_r1"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    mixed = base.join(other, "_r1")
    out = rms(predict(base)).select(F.lit("(none)").alias("feature"), "rmse")
    for c in columns:
        out = out.unionByName(rms(predict(mixed.withColumn(c, F.col(f"_s_{c}")))).select(F.lit(c).alias("feature"), "rmse"))
    plain = out.where(F.col("feature") == "(none)").select(F.col("rmse").alias("_base"))
    return out.where(F.col("feature") != "(none)").join(F.broadcast(plain)).select("feature", (F.col("rmse") - F.col("_base")).alias("importance"))  # one row


def importance_stability(panel: DataFrame, columns: Sequence[str], target: str, keys: Keys = KEYS) -> DataFrame:
    """Mean absolute correlation of each column with the target over seasons, and 1 - spread / mean."""
    per = panel.groupBy(keys.season).agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target))).alias(c) for c in columns])
    long = per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    out = long.groupBy("feature").agg(F.avg("v").alias("mean_importance"), F.stddev_pop("v").alias("std_importance"))
    return out.withColumn("stability", F.when(F.col("mean_importance") > 0, 1 - F.col("std_importance") / F.col("mean_importance")).otherwise(0.0))


def partial_dependence(df: DataFrame, column: str, predict: Callable[[DataFrame], DataFrame], grid: int = 20, pred: str = "predicted_points") -> DataFrame:
    """Mean prediction with one column held at each of ``grid`` values between its extremes (each row counts once per value)."""
    lim = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    j = df.join(F.broadcast(lim))  # one row
    step = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    held = j.withColumn("_k", step).withColumn(column, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / (grid - 1))
    return predict(held).groupBy("_k").agg(F.max(column).alias("value"), F.avg(pred).alias("mean_prediction")).drop("_k")

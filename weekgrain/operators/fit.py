"""Quantities fitted on training rows and applied elsewhere.

A fit returns a small frame (or a driver-side table of p x p size); an apply never
looks at the rows it is applied to. Second moments are additive, so one scan gives
the Gram matrices of every (group, season), and all folds, windows and penalties
are solved from their sums.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.functions.exprs import clip, lookup, safe_divide
from weekgrain.functions.order_stats import melt, quantiles, value_ladder
from weekgrain.keys import KEYS, Keys, settled


# --- bounds and scaling ----------------------------------------------------------------
def winsorise(df: DataFrame, train: DataFrame, column: str, out: str, groups: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values held between the training percentiles of their group."""
    if not groups:
        line = quantiles(train.withColumn("_one", F.lit(1)), ["_one"], column, {"_lo": low, "_hi": high}).select("_lo", "_hi")
        joined = df.join(F.broadcast(line))  # one row
    else:
        joined = df.join(quantiles(train, groups, column, {"_lo": low, "_hi": high}).drop("n"), groups, "left")
    held = F.when(F.col("_lo").isNull(), F.col(column)).otherwise(clip(F.col(column), F.col("_lo"), F.col("_hi")))
    return joined.withColumn(out, held).drop("_lo", "_hi")


# fixed values: name parts of bounded columns
BOUNDED_TOKENS = ("pct", "rate", "share", "prob", "probability", "percentage")


def fit_bounded(train: DataFrame) -> DataFrame:
    """(component, lo, hi) of percentage-like columns: named so, and with 1st/99th percentile inside 0..1.5 or 0..100.5."""
    numeric = [c for c, t in train.dtypes if t in ("double", "float", "int", "bigint")]
    named = [c for c in numeric if any(tok in c.lower() for tok in BOUNDED_TOKENS) and not c.startswith("target_")]
    if not named:
        return train.sparkSession.createDataFrame([], "component string, lo double, hi double")
    long = melt(train, [], named).where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = quantiles(long, ["component"], "value", {"p01": 0.01, "p99": 0.99})
    lim = long.groupBy("component").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ok = (F.col("n") >= 3) & (F.col("p01") >= -1e-6) & (F.col("p99") <= 100.5)
    return settled(q.where(ok).join(lim, "component").select("component", "lo", "hi"))


def apply_minmax(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - lo) / (hi - lo) with the fitted limits; columns without limits stay as they are."""
    one = fitted.agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("lo", "hi")))).alias("_fit"))  # one row per column
    out = df.join(F.broadcast(one))

    def scaled(c):
        fit = F.col("_fit")[c]
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        span = F.when(fit["hi"] > fit["lo"], fit["hi"] - fit["lo"]).otherwise(F.lit(1.0))
        return F.when(fit.isNotNull(), (x - fit["lo"]) / span).otherwise(F.col(c))

    return out.withColumns({c: scaled(c) for c in columns}).drop("_fit")


def robust_scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / IQR with training quartiles."""
    q = quantiles(melt(train, [], columns), ["component"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    one = q.agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("q1", "q2", "q3")))).alias("_fit"))
    out = df.join(F.broadcast(one))  # one row, one entry per column
    def scaled(c):
        f = F.col("_fit")[c]
        iqr = F.when(f["q3"] > f["q1"], f["q3"] - f["q1"]).otherwise(F.lit(1.0))
        return (F.col(c) - f["q2"]) / iqr
    return out.withColumns({f"{c}_scaled": scaled(c) for c in columns}).drop("_fit")


def standard_scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation of the training rows."""
    fit = train.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(fit))  # one row
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def with_temporal_context(train: DataFrame, test: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Train features from train rows alone; test features from train and test together, test rows kept."""
    both = train.withColumn("_is_test", F.lit(0)).unionByName(test.withColumn("_is_test", F.lit(1)), allowMissingColumns=True)
    return transform(train), transform(both).where(F.col("_is_test") == 1).drop("_is_test")


# --- targets ---------------------------------------------------------------------------------
def residual_target(df: DataFrame, baseline: str, target: str = "fantasy_points") -> DataFrame:
    """Target minus baseline, the overall target mean standing in for a missing baseline."""
    mean = df.agg(F.avg(target).alias("_mean"))
    out = df.join(F.broadcast(mean))  # one row
    return out.withColumn("target_residual", F.col(target) - F.coalesce(F.col(baseline), F.col("_mean"))).drop("_mean")


def log_target(df: DataFrame, target: str = "fantasy_points", skew_gate: float | None = None) -> DataFrame:
    """log1p of the non-negative target; with a gate only when the target's skewness exceeds it."""
    y = F.log1p(F.greatest(F.col(target), F.lit(0.0)))
    if skew_gate is None:
        return df.withColumn("target_log", y)
    out = df.join(F.broadcast(df.agg(F.skewness(target).alias("_skew"))))  # one row
    return out.withColumns({"log_applied": (F.abs("_skew") > skew_gate).cast("int"), "target_log": F.when(F.abs("_skew") > skew_gate, y).otherwise(F.col(target))}).drop("_skew")


def standardised_target(df: DataFrame, target: str = "fantasy_points") -> DataFrame:
    fit = df.agg(F.avg(target).alias("target_mean"), F.stddev_samp(target).alias("target_std"))
    return df.join(F.broadcast(fit)).withColumn("target_standard", (F.col(target) - F.col("target_mean")) / F.col("target_std"))  # one row


def inverse_target(pred: Column, method: str, baseline: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
    return {"residual": lambda: pred + baseline, "log": lambda: F.expm1(pred), "standardized": lambda: pred * std + mean}.get(method, lambda: pred)()


def recency_weights(df: DataFrame, n_weeks: int = 1, keys: Keys = KEYS) -> DataFrame:
    """0.5 to the power (latest season - season) / half-life; longer horizons forget more slowly."""
    half = C.HORIZON_HALFLIFE.get(n_weeks, 2.0)
    top = df.agg(F.max(keys.season).alias("_top"))
    return df.join(F.broadcast(top)).withColumn("sample_weight", F.pow(F.lit(0.5), (F.col("_top") - F.col(keys.season)) / half)).drop("_top")  # one row


# --- priors -------------------------------------------------------------------------------------
def shrink_to_position(df: DataFrame, column: str, games: str, weight: float = 0.3, keys: Keys = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Pulls a value toward the mean of its position (and ``by``, for instance the season), less so with more games."""
    inside = [*by, keys.group]
    means = df.groupBy(*inside).agg(F.avg(column).alias("_mean"))
    k = F.lit(weight) / (1 + F.col(games) / 4.0)
    return df.join(means, inside).withColumn(f"{column}_shrunk", (1 - k) * F.col(column) + k * F.col("_mean")).drop("_mean")


# fixed values: prior standard deviation of weekly points
WEEKLY_STD_PRIOR = {"QB": 7.0, "RB": 6.5, "WR": 6.0, "TE": 5.0}


def player_effects(residuals: DataFrame, value: str = "residual", keys: Keys = KEYS) -> DataFrame:
    """Empirical-Bayes effect of every player within its position: shrunken mean residual and posterior sd."""
    per = residuals.groupBy(keys.group, keys.entity).agg(F.avg(value).alias("raw_effect"), F.count(value).alias("n_games"), F.stddev_samp(value).alias("_sd"))
    pos = per.groupBy(keys.group).agg(F.var_samp("raw_effect").alias("_vb"), F.avg(F.pow("_sd", 2)).alias("_vw"), F.avg("n_games").alias("_n"), F.avg("_sd").alias("_es"))
    tau2 = F.greatest(F.col("_vb") - F.col("_vw") / F.col("_n"), F.lit(0.0))
    sigma = (lookup(F.col(keys.group), WEEKLY_STD_PRIOR, 5.0) + F.col("_es")) / 2
    pos = pos.select(keys.group, tau2.alias("between_var"), F.pow(sigma, 2).alias("within_var"))
    df = per.join(pos, keys.group)
    t, s, n = F.col("between_var"), F.col("within_var"), F.col("n_games")
    k = F.when(t > 0, t / (t + s / n)).otherwise(F.lit(0.0))
    post = F.when(t > 0, 1 / (1 / t + n / s)).otherwise(s / n)
    return df.withColumns({"shrinkage": k, "player_effect": k * F.col("raw_effect"), "effect_std": F.sqrt(F.greatest(post, F.lit(0.1))),
                           "predictive_std": F.sqrt(s + F.greatest(post, F.lit(0.1)))}).drop("_sd")


# --- touchdowns and draft ---------------------------------------------------------------------------
# fixed values: touchdowns per opportunity
TD_RATES = {"rush": ("rushing_attempts", {"RB": 0.035, "QB": 0.025}), "rec": ("targets", {"RB": 0.045, "WR": 0.055, "TE": 0.065}),
            "pass": ("passing_attempts", {"QB": 0.045})}


def expected_touchdowns(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    return df.withColumns({f"expected_{n}_tds": F.col(c) * lookup(F.col(keys.group), rates) for n, (c, rates) in TD_RATES.items()})


def regressed(actual: Column, expected: Column, share: float = 0.5) -> Column:
    return actual * (1 - share) + expected * share


def draft_capital(rookies: DataFrame) -> DataFrame:
    """Capital by round and pick, depth guess, and upside of early picks likely to start."""
    r, p = F.col("draft_round"), F.col("draft_pick")
    score = (F.when(r == 1, 100 - (p - 1) * 3.0).when(r == 2, 70 - (p - 33) * 2.0).when(r == 3, 50 - (p - 65) * 1.5)
             .otherwise(F.greatest(F.lit(10.0), 40 - (r - 4) * 10.0)))
    df = rookies.withColumn("draft_capital_score", score)
    df = df.withColumn("depth_chart_position", clip(F.col("draft_capital_score") / 25, 1.0, 4.0).cast("int"))
    c, d = F.col("draft_capital_score"), F.col("depth_chart_position")
    return df.withColumn("upside_score", F.when((c >= 60) & (d <= 2), c * 0.5 + (5 - d) * 10))


# --- Gram matrices ------------------------------------------------------------------------------------
class Grams:
    """Additive second moments of [1, x - shift..., y - shift] per group: at most (groups x (p+2)^2) numbers on the driver."""

    def __init__(self, columns: Sequence[str], table: dict[tuple, np.ndarray], shift: np.ndarray | None = None):
        self.columns, self.table = list(columns), table
        self.shift = np.zeros(len(self.columns) + 1) if shift is None else shift

    def unshifted(self, beta: np.ndarray) -> np.ndarray:
        """Coefficients for the columns as they are, from those of a fit on these moments."""
        return np.concatenate([[beta[0] + self.shift[-1] - beta[1:] @ self.shift[:-1]], beta[1:]])

    def total(self, where: Callable[[tuple], bool]) -> np.ndarray:
        p = len(self.columns) + 2
        return sum((g for k, g in self.table.items() if where(k)), np.zeros((p, p)))


def gram_aggregates(columns: Sequence[str], target: str) -> list[Column]:
    """Count, means and covariances of [x..., y], which Spark merges without cancelling digits; rows are those whose target is known."""
    terms = [*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns], F.col(target).cast("double")]
    means = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(terms)]
    return [F.count(F.lit(1)).alias("n"), *means, *[F.covar_pop(terms[i], terms[j]).alias(f"c_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]]


def gram_by(df: DataFrame, groups: Sequence[str], columns: Sequence[str], target: str, centre: bool = False, wide: bool = False) -> Grams:
    """One scan. The groups must be few (positions, seasons, weeks): their sums come to the driver.

    Groups without a known target are left out. With ``centre`` the moments are taken about one mean per column, so that a large common level does not
    cancel digits. ``wide`` is for inputs of some dozens of columns, whose products are summed per Arrow batch instead of as one expression each.
    """
    known = df.where(F.col(target).isNotNull())
    p = len(columns) + 1
    if wide:
        return _grams(columns, _wide_moments(known, groups, columns, target), groups, centre)
    found = {}
    for row in known.groupBy(*groups).agg(*gram_aggregates(columns, target)).collect():
        c = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                c[i, j] = c[j, i] = row[f"c_{i}_{j}"]
        found[tuple(row[x] for x in groups)] = row["n"], np.array([row[f"m_{i}"] for i in range(p)]), c
    return _about_one_mean(columns, found, centre)


def _about_one_mean(columns: Sequence[str], found: dict[tuple, tuple], centre: bool) -> Grams:
    """Second moments of all groups about the mean of all rows, from (count, means, covariances) per group."""
    shift = np.zeros(len(columns) + 1)
    if centre and found:
        shift = sum(n * m for n, m, _ in found.values()) / sum(n for n, _, _ in found.values())
    table = {}
    for key, (n, m, c) in found.items():
        d = np.concatenate([[1.0], m - shift])
        table[key] = n * np.outer(d, d)
        table[key][1:, 1:] += n * c
    return Grams(columns, table, shift)


def _grams(columns: Sequence[str], moments: DataFrame, groups: Sequence[str], centre: bool = True) -> Grams:
    p = len(columns) + 1
    return _about_one_mean(columns, {tuple(r[x] for x in groups): (r["n"], np.array(r["_mean"]), np.array(r["_cov"]).reshape(p, p)) for r in moments.collect()}, centre)


def _merged(a: tuple | None, b: tuple) -> tuple:
    """(weight, means, sums of products about them) of two parts together."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + np.outer(d, d) * a[0] * b[0] / n


def _merge_parts(parts: DataFrame, names: list[str], schema: str) -> DataFrame:
    """One row per group from parts (one per task) that hold sums of products; the result holds covariances."""

    def whole(part):
        import pandas as pd

        total = None
        for n, m, c in zip(part["n"], part["_mean"], part["_cov"]):
            total = _merged(total, (n, np.array(m), np.array(c).reshape(len(m), -1)))
        n, m, c = total
        return pd.DataFrame({**{k: part[k].iloc[:1] for k in names}, "n": [n], "_mean": [m], "_cov": [c.ravel() / n]})

    return parts.groupBy(*names).applyInPandas(whole, schema)


def _wide_moments(known: DataFrame, groups: Sequence[str], columns: Sequence[str], target: str) -> DataFrame:
    """Count, means and covariances per group for many columns, where p x p aggregate expressions would be too many.

    Every task multiplies its Arrow batches into one matrix per group, about the means that it has seen, and hands out that matrix once; the parts of a
    group, one per task, are merged pairwise about their own means.
    """
    groups, columns = list(groups), list(columns)
    doubles = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(columns)]
    known = known.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], *doubles, F.col(target).cast("double").alias("_y"))
    names = [f"_k{i}" for i in range(len(groups))]

    def partial(batches):
        import pandas as pd

        sums: dict[tuple, tuple] = {}
        for b in batches:
            for key, part in b.groupby(names, dropna=False):
                x = part.drop(columns=names).to_numpy(float)
                m = x.mean(0)
                sums[key] = _merged(sums.get(key), (len(x), m, (x - m).T @ (x - m)))
        for key, (n, m, c) in sums.items():
            yield pd.DataFrame({**{k: [v] for k, v in zip(names, key)}, "n": [n], "_mean": [m], "_cov": [c.ravel()]})

    kinds = dict(known.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", n long, _mean array<double>, _cov array<double>"
    return _merge_parts(known.mapInPandas(partial, schema), names, schema).select(*[F.col(n).alias(g) for n, g in zip(names, groups)], "n", "_mean", "_cov")


def bootstrap_grams(df: DataFrame, columns: Sequence[str], target: str, weights: Sequence[Column]) -> Grams:
    """Moments of every bootstrap in one pass over the rows, none of which is repeated: each Arrow batch meets a matrix of its rows' weights."""
    doubles = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(columns)]
    drawn = F.array(*[w.cast("double") for w in weights]).alias("_w")
    known = df.where(F.col(target).isNotNull()).select(*doubles, F.col(target).cast("double").alias("_y"), drawn)

    def partial(batches):
        import pandas as pd

        sums: dict[int, tuple] = {}
        for b in batches:
            if len(b):
                x, w = b.drop(columns="_w").to_numpy(float), np.stack(b["_w"].to_numpy())
                for r in np.flatnonzero(w.sum(0)).tolist():
                    n = w[:, r].sum()
                    m = w[:, r] @ x / n
                    sums[r] = _merged(sums.get(r), (n, m, ((x - m) * w[:, r:r + 1]).T @ (x - m)))
        for r, (n, m, c) in sums.items():
            yield pd.DataFrame({"round": [r], "n": [n], "_mean": [m], "_cov": [c.ravel()]})

    schema = "round int, n double, _mean array<double>, _cov array<double>"
    return _grams(columns, _merge_parts(known.mapInPandas(partial, schema), ["round"], schema), ["round"])


def ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients [intercept, x...] from a Gram matrix; the intercept carries no penalty."""
    a = gram[:-1, :-1].copy()
    a[np.arange(1, len(a)), np.arange(1, len(a))] += alpha
    return np.linalg.lstsq(a, gram[:-1, -1], rcond=None)[0]


def sse(gram: np.ndarray, beta: np.ndarray) -> float:
    """Squared error of coefficients on the rows behind a Gram matrix."""
    return float(gram[-1, -1] - 2 * beta @ gram[:-1, -1] + beta @ gram[:-1, :-1] @ beta)


def rmse(gram: np.ndarray, beta: np.ndarray) -> float:
    return float((max(sse(gram, beta), 0.0) / gram[0, 0]) ** 0.5)


def non_negative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| with x >= 0 by an active set: the unknown with the steepest gain enters, those that turn negative leave."""
    p = a.shape[1]
    x, free = np.zeros(p), np.zeros(p, bool)
    tolerance = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(10 * p + 10):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        enter = int(np.argmax(gain)) if p else 0
        if p == 0 or gain[enter] <= tolerance:
            break
        free[enter] = True
        while True:
            z = np.zeros(p)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (z <= 0)
            if not bad.any():
                x = z
                break
            step = float(np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0.0
    return x


# fixed values: components that keep a floor
CORE = {"RB": ["snap_share", "rush_share", "target_share", "redzone_share"], "WR": ["target_share", "air_yards_share", "snap_share", "redzone_targets"],
        "TE": ["target_share", "snap_share", "redzone_targets"], "QB": ["dropback_rate", "rush_attempt_share", "redzone_opportunity", "play_volume"]}
FLOOR = 0.03


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(max(v, 0.0) for v in weights.values())
    return {k: max(v, 0.0) / total if total > 0 else 0.0 for k, v in weights.items()}


def with_floor(weights: Mapping[str, float], core: Sequence[str], floor: float = FLOOR, default: Mapping[str, float] | None = None) -> dict[str, float]:
    """Normalised weights in which every core component has at least the floor; the excess is scaled down to fit.

    Weights that are all zero take the shape of ``default`` (equal shares without one), and so do floors that leave no room.
    """
    w = normalised(weights)
    shape = normalised(default or dict.fromkeys(w, 1.0))
    held = {k: floor if k in core else 0.0 for k in w}
    room, extra = 1.0 - sum(held.values()), {k: max(w[k] - held[k], 0.0) for k in w}
    if room <= 0:
        return shape
    spare = sum(extra.values())
    if spare <= 0:
        return normalised({k: max(shape.get(k, 0.0), held[k]) for k in w})
    return {k: held[k] + extra[k] * room / spare for k in w}


def fit_utilization_weights(train: DataFrame, target: str | None = None, alpha: float = 1.0, tune: bool = False, min_rows: int = 200, min_known: int = 100,
                            alphas: Sequence[float] = (0.1, 0.5, 1.0, 2.0, 5.0), folds: int = 3, keys: Keys = KEYS) -> dict[str, dict[str, float]]:
    """Non-negative component weights per position; with ``tune`` the penalty is chosen on the last seasons.

    The target is next week's usage where the table has it, else next week's points. A position needs ``min_rows`` rows, and ``min_known`` whose target
    is known and not negative; others keep the default weights, as all do without a target. One scan collects the moments of all components by position
    and season; positions, folds and penalties read blocks and sums of them.
    """
    target = target if target in train.columns else next((c for c in ("target_util_1w", "target_1w") if c in train.columns), None)
    if target is None:
        return {p: dict(C.UTILIZATION_WEIGHTS[p]) for p in C.COMPONENT_COLUMNS}
    sizes = {r[0]: r[1] for r in train.groupBy(keys.group).agg(F.count("*")).collect()}  # positions
    cols = sorted({c for comp in C.COMPONENT_COLUMNS.values() for c in comp.values()})
    held = train.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col(c), F.lit(0.0)))) for c in cols}
                             | {target: F.when(F.col(target) >= 0, F.col(target))})
    every = gram_by(held, [keys.group, keys.season], cols, target, wide=True)
    out = {}
    for pos, comp in C.COMPONENT_COLUMNS.items():
        block = np.ix_(*[[0, *[1 + cols.index(c) for c in comp.values()], len(cols) + 1]] * 2)
        grams = Grams(list(comp.values()), {k[1:]: g[block] for k, g in every.table.items() if k[0] == pos})
        chosen = _best_alpha(grams, alphas, folds, _normal_weights) if tune else alpha
        full = grams.total(lambda k: True)
        w = _normal_weights(full, chosen) if sizes.get(pos, 0) >= min_rows and full[0, 0] >= min_known else None
        out[pos] = dict(C.UTILIZATION_WEIGHTS[pos]) if w is None else with_floor(dict(zip(comp, w)), CORE[pos], default=C.UTILIZATION_WEIGHTS[pos])
    return out


def _normal_weights(g: np.ndarray, alpha: float) -> np.ndarray | None:
    p = g.shape[0] - 2
    x = non_negative(g[1:-1, 1:-1] + alpha * np.eye(p), g[1:-1, -1])
    return x / x.sum() if x.sum() > 0 else None


def _best_alpha(grams: Grams, alphas, folds, solve) -> float:
    seasons = sorted(k[0] for k in grams.table)
    if len(seasons) < folds + 1:
        return 1.0
    scores = {}
    for a in alphas:
        errs = []
        for s in seasons[-folds:]:
            past, now = grams.total(lambda k: k[0] < s), grams.table[(s,)]
            w = solve(past, a)
            if w is not None and now[0, 0] > 0:
                errs.append((max(sse(now, np.concatenate([[0.0], w])), 0.0) / now[0, 0]) ** 0.5)
        if errs:
            scores[a] = float(np.mean(errs))
    return min(scores, key=scores.get) if scores else 1.0


# --- feature selection ------------------------------------------------------------------------------------
def correlations(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix and variances from one scan (p x p on the driver)."""
    row = df.agg(*[F.covar_samp(F.coalesce(F.col(a).cast("double"), F.lit(0.0)), F.coalesce(F.col(b).cast("double"), F.lit(0.0))).alias(f"c_{i}_{j}")
                   for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]).first()
    p = len(columns)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c_{i}_{j}"] or 0.0
    sd = np.sqrt(np.diag(cov))
    safe = np.where(sd > 0, sd, 1.0)
    corr = cov / np.outer(safe, safe)
    np.fill_diagonal(corr, 1.0)
    return corr, np.diag(cov)


def varying(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Columns whose variance is above the threshold (nulls count as zero), from one scan."""
    row = df.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"v_{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if (row[f"v_{i}"] or 0.0) > threshold]


def drop_correlated(columns: Sequence[str], corr: np.ndarray, var: np.ndarray, threshold: float = 0.92) -> list[str]:
    """Of every too similar pair or bundle only the column with the largest variance stays."""
    gone = set()
    for j in range(len(columns)):
        bundle = [i for i in range(j) if abs(corr[i, j]) > threshold]
        if bundle:
            group = [j, *bundle]
            keep = max(group, key=lambda i: var[i])
            gone.update(i for i in group if i != keep)
    return [c for i, c in enumerate(columns) if i not in gone]


def variance_inflation(columns: Sequence[str], corr: np.ndarray, var: np.ndarray) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix; constant columns count as infinite."""
    live = [i for i in range(len(columns)) if var[i] >= 1e-12]
    out = {c: float("inf") for c in columns}
    if len(live) < 2:
        out.update({columns[i]: 1.0 for i in live})
        return out
    inv = np.linalg.pinv(corr[np.ix_(live, live)] + 1e-10 * np.eye(len(live)))
    out.update({columns[i]: float(v) if v > 0 else float("inf") for i, v in zip(live, np.diag(inv))})
    return out


def prune_by_inflation(columns: Sequence[str], corr: np.ndarray, var: np.ndarray, threshold: float = 10.0) -> list[str]:
    """Removes the most inflated column until none is above the threshold."""
    left = list(range(len(columns)))
    while len(left) > 2:
        v = variance_inflation([columns[i] for i in left], corr[np.ix_(left, left)], var[left])
        worst = max(left, key=lambda i: v[columns[i]])
        if v[columns[worst]] <= threshold:
            break
        left.remove(worst)
    return [columns[i] for i in left]


def adaptive_count(n_rows: int, default: int = 50) -> int:
    return min(default, max(20, int(n_rows ** 0.5)))


def select_features(df: DataFrame, columns: Sequence[str], target: str, variance: float = 0.01, correlation: float = 0.92, inflation: float = 10.0, default: int = 50) -> DataFrame:
    """One row per column: whether it survives each step (variance, correlation, inflation), its F score, and whether it is selected.

    Of the columns that survive, as many as the number of rows allows (:func:`adaptive_count`) are selected, by F score, then name.
    """
    varied = varying(df, columns, variance)
    corr, var = correlations(df, varied)
    kept = drop_correlated(varied, corr, var, correlation)
    at = [varied.index(c) for c in kept]
    inner, spread = corr[np.ix_(at, at)], var[at]
    vif = variance_inflation(kept, inner, spread)
    left = prune_by_inflation(kept, inner, spread, inflation)
    scores = {r["feature"]: (r["f_score"], r["n"]) for r in target_scores(df, list(columns), target).collect()}  # one row per column
    score = lambda c: scores[c][0] if scores[c][0] is not None else float("-inf")
    n_rows = max((n for _, n in scores.values()), default=0)
    chosen = set(sorted(left, key=lambda c: (-score(c), c))[:adaptive_count(n_rows, default)])
    rows = [(c, c in varied, c in kept, float(vif[c]) if c in kept else None, c in left, None if scores[c][0] is None else float(scores[c][0]), c in chosen) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, varied boolean, kept boolean, vif double, not_inflated boolean, f_score double, selected boolean")


def target_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, correlation, f_score) of every column against the target, in one scan."""
    row = df.where(F.col(target).isNotNull())
    agg = row.agg(F.count(F.lit(1)).alias("n"), *[F.corr(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col(target)).alias(c) for c in columns])
    long = agg.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])).alias("f")).select("n", "f.*")
    r2 = F.pow("correlation", 2)
    return long.withColumn("f_score", F.when(r2 < 1, r2 / (1 - r2) * (F.col("n") - 2)))


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats between equal-count bins of each column and of the target.

    Bins come from the value ladder (position in the order of distinct values), so equal values share a bin.
    """
    base = df.where(F.col(target).isNotNull())
    long = melt(base.withColumn("_y", F.col(target).cast("double")), ["_y"], columns).where(F.col("value").isNotNull())
    x = value_ladder(long, ["component"], "value").select(F.col("component").alias("_c"), F.col("v").alias("_v"), F.floor(F.col("below") * bins / F.col("total")).alias("bx"))
    y = value_ladder(base.withColumn("_y", F.col(target).cast("double")), [], "_y").select(F.col("v").alias("_w"), F.floor(F.col("below") * bins / F.col("total")).alias("by"))
    cells = (long.groupBy("component", "value", "_y").agg(F.count(F.lit(1)).alias("n"))
             .join(x, (F.col("component") == F.col("_c")) & (F.col("value") == F.col("_v"))).join(y, F.col("_y") == F.col("_w"))
             .groupBy("component", "bx", "by").agg(F.sum("n").alias("n")))
    by_c = Window.partitionBy("component")  # at most bins x bins cells
    cells = cells.withColumns({"t": F.sum("n").over(by_c), "nx": F.sum("n").over(Window.partitionBy("component", "bx")), "ny": F.sum("n").over(Window.partitionBy("component", "by"))})
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return cells.groupBy(F.col("component").alias("feature")).agg(F.sum(term).alias("mutual_information"))


# --- out of distribution --------------------------------------------------------------------------------------
def fit_mahalanobis(train: DataFrame, columns: Sequence[str], percentile: float = 0.95) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and the percentile of the training distances."""
    means = train.agg(*[F.avg(c).alias(c) for c in columns]).first()
    corr, var = correlations(train, columns)
    sd = np.sqrt(var)
    inv = np.linalg.inv(corr * np.outer(sd, sd) + 1e-6 * np.eye(len(columns)))
    mean = np.array([means[c] for c in columns], dtype=float)
    dist = with_mahalanobis(train, columns, mean, inv)
    line = quantiles(dist.withColumn("_one", F.lit(1)), ["_one"], "mahalanobis", {"q": percentile}).first()["q"]
    return mean, inv, float(line)


def with_mahalanobis(df: DataFrame, columns: Sequence[str], mean: np.ndarray, inv: np.ndarray) -> DataFrame:
    """Distance from the training mean as one JVM expression."""
    d = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(m) for c, m in zip(columns, mean)]
    q = sum((d[i] * d[j] * float(inv[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.withColumn("mahalanobis", F.sqrt(F.greatest(q, F.lit(0.0))))

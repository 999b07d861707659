"""Gradient-boosted trees for all positions and refit folds at once, from additive histograms.

Columns are cut into bins once, at quantiles of the rows before the first fold. A level of the trees of every (position, fold) is then one scan: each task
adds up gradients and row counts by (position, fold, node, column, bin), the tasks' histograms are summed, and the splits are chosen on the driver from
(positions x folds x nodes x columns x bins) numbers, however many rows there are. Rows are neither copied per fold nor moved between scans; what a row has
been predicted so far follows from the trees, which travel with the task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrain.functions.order_stats import quantiles
from weekgrain.keys import KEYS, Keys, settled


@dataclass
class Tree:
    """Complete binary tree: of node i the children are 2i + 1 and 2i + 2. ``column`` is -1 in a leaf."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row of bins reaches, going down ``levels`` splits at most."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.levels() if levels is None else levels):
            split = self.column[at] >= 0
            right = x[np.arange(len(x)), np.maximum(self.column[at], 0)] > self.bin[at]
            at = np.where(split, 2 * at + 1 + right, at)
        return at

    def levels(self) -> int:
        return (len(self.column) + 1).bit_length() - 2


@dataclass
class Boosted:
    base: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.nodes(x)]
        return out


def period_of(keys: Keys = KEYS):
    return (F.col(keys.season) * 100 + F.col(keys.week)).cast("int")


def quantile_edges(rows: DataFrame, columns: Sequence[str], bins: int = 16, keys: Keys = KEYS) -> dict[str, dict[str, list[float]]]:
    """Per position and column: bins - 1 exact quantiles, equal ones once."""
    long = rows.select(keys.group, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("column", "v"))
    qs = {f"q{k}": k / bins for k in range(1, bins)}
    out: dict[str, dict[str, list[float]]] = {}
    for r in quantiles(long, [keys.group, "column"], "v", qs).collect():  # positions x columns rows
        out.setdefault(r[keys.group], {})[r["column"]] = sorted({r[q] for q in qs})
    return out


def binned(rows: DataFrame, columns: Sequence[str], target: str, edges: dict[str, dict[str, list[float]]], keys: Keys = KEYS, period: Column | None = None) -> DataFrame:
    """Keys, period (the week unless given), target and the bin of each column: 0 where it is null, else 1 + the number of edges below the value."""
    period = period_of(keys) if period is None else period.cast("int")

    def bin_of(c):
        value = F.col(c).cast("double")
        out = F.lit(None).cast("int")
        for group, own in edges.items():
            below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in own.get(c, [])]).cast("array<double>"), lambda e: e < value))
            out = F.when(F.col(keys.group) == group, below + 1).otherwise(out)
        return F.when(value.isNull() | out.isNull(), 0).otherwise(out)

    return settled(rows.select(*keys.grain, keys.group, period.alias("_period"), F.col(target).cast("double").alias("_y"), F.array(*map(bin_of, columns)).alias("_bins")))


def _bases(rows: DataFrame, folds: Sequence[int], min_rows: int, keys: Keys) -> dict[tuple[str, int], Boosted]:
    """The mean of all earlier rows for each (position, fold) that has enough of them."""
    known = rows.where(F.col("_y").isNotNull()).groupBy(keys.group, "_period").agg(F.count("*").alias("n"), F.sum("_y").alias("s")).collect()  # positions x periods
    out = {}
    for group in sorted({r[keys.group] for r in known if r[keys.group] is not None}):
        for fold in folds:
            past = [r for r in known if r[keys.group] == group and r["_period"] < fold]
            n = sum(r["n"] for r in past)
            if n >= max(min_rows, 1):
                out[group, fold] = Boosted(sum(r["s"] for r in past) / n)
    return out


def _histograms(rows: DataFrame, models: dict[tuple[str, int], Boosted], growing: dict[tuple[str, int], Tree], level: int, shape: tuple[int, int], huber: float | None, keys: Keys):
    """{(position, fold): [node of the level, column, bin, (gradient, count)]} in one scan."""
    n_columns, n_bins = shape
    width = 1 << level
    size = width * n_columns * n_bins
    group = keys.group

    def partial(batches):
        import pandas as pd

        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for g, part in b.groupby(group):
                x, y, period = np.stack(part["_bins"].to_numpy()), part["_y"].to_numpy(float), part["_period"].to_numpy()
                for fold in sorted(f for p, f in models if p == g):
                    past = period < fold
                    if not past.any():
                        continue
                    mine, tree = x[past], growing[g, fold]
                    slope = models[g, fold].predict(mine) - y[past]
                    if huber is not None:
                        slope = np.clip(slope, -huber, huber)
                    node = tree.nodes(mine, level) - (width - 1)
                    live = node >= 0  # rows that stopped at a leaf further up are done
                    cell = ((node[live, None] * n_columns + np.arange(n_columns)) * n_bins + mine[live]).ravel()
                    found = np.stack([np.bincount(cell, np.repeat(slope[live], n_columns), size), np.bincount(cell, minlength=size)])
                    sums[g, fold] = sums.get((g, fold), 0.0) + found
        for (g, fold), found in sums.items():
            yield pd.DataFrame({group: [g], "fold": [fold], "cells": [found.ravel()]})

    def whole(part):
        import pandas as pd

        return pd.DataFrame({group: part[group].iloc[:1], "fold": part["fold"].iloc[:1], "cells": [np.sum(np.stack(part["cells"].to_numpy()), 0)]})

    schema = f"{group} string, fold int, cells array<double>"
    known = rows.where(F.col("_y").isNotNull()).select(group, "_period", "_y", "_bins")
    summed = known.mapInPandas(partial, schema).groupBy(group, "fold").applyInPandas(whole, schema)  # a histogram per task and group, then one per group
    return {(r[group], r["fold"]): np.array(r["cells"]).reshape(2, width, n_columns, n_bins) for r in summed.collect()}


def _grow(tree: Tree, hist: np.ndarray, level: int, rate: float, ridge: float, min_rows: int) -> None:
    """Sets the splits of one level and the values of its children."""
    for k in range(1 << level):
        node = (1 << level) - 1 + k
        if node and tree.column[(node - 1) // 2] < 0:
            continue
        g, n = hist[0, k], hist[1, k]
        total_g, total_n = g[0].sum(), n[0].sum()
        if total_n == 0:
            continue
        left_g, left_n = np.cumsum(g, 1), np.cumsum(n, 1)
        right_g, right_n = total_g - left_g, total_n - left_n
        # a split stands at the upper end of a bin that has rows, so no two splits part the rows alike
        fits = (n > 0) & (left_n >= min_rows) & (right_n >= max(min_rows, 1))
        gain = np.where(fits, left_g ** 2 / np.maximum(left_n + ridge, 1e-12) + right_g ** 2 / np.maximum(right_n + ridge, 1e-12) - total_g ** 2 / (total_n + ridge), -np.inf)
        best = int(np.argmax(gain))  # the first of equals: least column, then least bin
        c, b = divmod(best, gain.shape[1])
        if not gain[c, b] > 1e-12:
            continue
        tree.column[node], tree.bin[node] = c, b
        for child, gg, nn in ((2 * node + 1, left_g[c, b], left_n[c, b]), (2 * node + 2, right_g[c, b], right_n[c, b])):
            tree.value[child] = -rate * gg / (nn + ridge)


def fit_boosted(rows: DataFrame, folds: Sequence[int], n_columns: int, n_bins: int, trees: int = 10, depth: int = 3, rate: float = 0.1, ridge: float = 1.0, min_rows: int = 20,
                huber: float | None = None, keys: Keys = KEYS) -> dict[tuple[str, int], Boosted]:
    """One model per (position, fold) on :func:`binned` rows of strictly earlier periods; trees x depth scans in all. ``huber`` bounds the gradient."""
    models = _bases(rows, folds, min_rows, keys)
    nodes = (1 << depth + 1) - 1
    for _ in range(trees):
        growing = {k: Tree(np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)) for k in models}
        for level in range(depth):
            for k, hist in _histograms(rows, models, growing, level, (n_columns, n_bins), huber, keys).items():
                _grow(growing[k], hist, level, rate, ridge, min_rows)
        for k, t in growing.items():
            models[k].trees.append(t)
    return models


def predicted(rows: DataFrame, models: dict[tuple[str, int], Boosted], out: str = "predicted_points", keys: Keys = KEYS) -> DataFrame:
    """Keys, position and prediction of the rows of each fold's own period."""
    group = keys.group

    def score(batches):
        for b in batches:
            value = np.full(len(b), np.nan)
            pairs = list(zip(b[group], b["_period"]))
            for key in set(pairs) & set(models):
                at = np.array([p == key for p in pairs])
                value[at] = models[key].predict(np.stack(b["_bins"].to_numpy()[at]))
            kept = b[[*keys.grain, group]].assign(**{out: value})
            yield kept[~np.isnan(value)]

    kinds = dict(rows.dtypes)
    names = [*keys.grain, group]
    return rows.select(*names, "_period", "_bins").mapInPandas(score, ", ".join(f"{c} {kinds[c]}" for c in names) + f", {out} double")


def bin_count(edges: dict[str, dict[str, list[float]]]) -> int:
    return 2 + max((len(e) for own in edges.values() for e in own.values()), default=0)


def season_boosted(panel: DataFrame, seasons: Sequence[int], columns: Sequence[str], target: str, out: str = "predicted_points", bins: int = 16, keys: Keys = KEYS, **params) -> DataFrame:
    """Every season predicted by trees of its position that were fitted on all strictly earlier seasons."""
    cuts = quantile_edges(panel.where(F.col(keys.season) < min(seasons)), columns, bins, keys)
    rows = binned(panel, columns, target, cuts, keys, F.col(keys.season))
    return predicted(rows, fit_boosted(rows, sorted(seasons), len(columns), bin_count(cuts), keys=keys, **params), out, keys)


def weekly_boosted(panel: DataFrame, columns: Sequence[str], target: str, season: int, bins: int = 16, edges: dict[str, dict[str, list[float]]] | None = None, keys: Keys = KEYS, **params) -> DataFrame:
    """Every week of a season predicted by trees of its position that were fitted on all strictly earlier weeks. The columns must be history features."""
    folds = sorted(r[0] for r in panel.where(F.col(keys.season) == season).select(period_of(keys)).distinct().collect())
    cuts = edges or quantile_edges(panel.where(F.col(keys.season) < season), columns, bins, keys)
    rows = binned(panel, columns, target, cuts, keys)
    return predicted(rows, fit_boosted(rows, folds, len(columns), bin_count(cuts), keys=keys, **params), keys=keys)


def weekly_backtest(panel: DataFrame, season: int, factory: Callable[[DataFrame, str], Callable[[DataFrame], DataFrame]], positions: Sequence[str],
                    pipeline: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, target: str = "fantasy_points", keys: Keys = KEYS) -> DataFrame:
    """Refits any model every week: ``factory(train, position)`` gives a function from test rows to rows with ``predicted``.

    ``pipeline(train, test)`` derives features without looking ahead. One fit per week and position; :func:`weekly_boosted` and the ridge from
    moments fit all of them together and are the ones for large panels.
    """
    weeks = sorted(r[0] for r in panel.where(F.col(keys.season) == season).select(keys.week).distinct().collect())
    out = None
    for week in weeks:
        past = panel.where((F.col(keys.season) < season) | ((F.col(keys.season) == season) & (F.col(keys.week) < week)))
        now = panel.where((F.col(keys.season) == season) & (F.col(keys.week) == week))
        for p in positions:
            train, test = past.where((F.col(keys.group) == p) & F.col(target).isNotNull()), now.where(F.col(keys.group) == p)
            if pipeline:
                train, test = pipeline(train, test)
            if train.isEmpty():
                continue
            rows = factory(train, p)(test).select(*keys.grain, keys.group, "predicted", F.col(target).alias("actual"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return panel.limit(0).select(*keys.grain, keys.group, F.lit(0.0).alias("predicted"), F.col(target).alias("actual"))
    return out

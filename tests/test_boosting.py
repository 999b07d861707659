"""Boosted trees from histograms against a plain implementation over rows, and the weekly backtest with any model."""

import numpy as np
from pyspark.sql import functions as F

from weekgrain.operators import boosting as B

GRAIN = ["player_id", "season", "week"]


def plain(x, y, trees, depth, rate, ridge, min_rows, huber=None):
    """Predictions of every row by trees that scan all rows for each split."""
    base = y.mean()
    pred = np.full(len(y), base)
    made = []

    def grow(rows, level, g):
        if level == depth:
            return None
        best = (1e-12, None)
        G, n = g[rows].sum(), len(rows)
        for c in range(x.shape[1]):
            for b in sorted(set(x[rows, c])):
                left = rows[x[rows, c] <= b]
                m = len(left)
                if m < min_rows or n - m < max(min_rows, 1):
                    continue
                a = g[left].sum()
                gain = a * a / (m + ridge) + (G - a) ** 2 / (n - m + ridge) - G * G / (n + ridge)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (c, b))
        if best[1] is None:
            return None
        c, b = best[1]
        parts = [rows[x[rows, c] <= b], rows[x[rows, c] > b]]
        return c, b, [(-rate * g[r].sum() / (len(r) + ridge), grow(r, level + 1, g)) for r in parts]

    def apply(tree, rows, z):
        out, node = 0.0, tree
        while node:
            c, b, kids = node
            out, node = kids[int(z[rows, c] > b)]
        return out

    for _ in range(trees):
        g = pred - y
        if huber is not None:
            g = np.clip(g, -huber, huber)
        t = grow(np.arange(len(y)), 0, g)
        made.append(t)
        pred = pred + np.array([apply(t, i, x) for i in range(len(y))])
    return lambda z: np.array([base + sum(apply(t, i, z) for t in made) for i in range(len(z))])


def test_histogram_trees_equal_plain_trees(panel):
    cols = ["targets", "air_yards", "snap_count"]
    rows = panel.withColumn("air_yards", F.when(F.col("player_id") % 5 != 0, F.col("air_yards"))).repartition(3)
    for huber in (None, 4.0):
        args = {"trees": 3, "depth": 2, "rate": 0.5, "ridge": 1.0, "min_rows": 4, "huber": huber}
        got = {tuple(r[c] for c in GRAIN): r.predicted_points for r in B.weekly_boosted(rows, cols, "fantasy_points", 2020, bins=6, **args).collect()}
        cuts = B.quantile_edges(rows.where("season < 2020"), cols, 6)
        every = B.binned(rows, cols, "fantasy_points", cuts).toPandas()
        assert len(got) == (every.season == 2020).sum()
        for (p, fold), now in every[(every.season == 2020) & every.week.isin([2, 7])].groupby(["position", "_period"]):
            past = every[(every.position == p) & (every._period < fold)]
            model = plain(np.stack(past._bins), past._y.to_numpy(), **args)
            for (_, r), want in zip(now.iterrows(), model(np.stack(now._bins))):
                assert abs(got[r.player_id, r.season, r.week] - want) < 1e-9


def test_later_rows_change_nothing(panel):
    cols = ["targets", "air_yards"]
    run = lambda df: sorted(map(tuple, B.weekly_boosted(df, cols, "fantasy_points", 2020, bins=4, trees=2, depth=2, min_rows=3).where("week <= 5").collect()))
    after = panel.withColumn("fantasy_points", F.when((F.col("season") == 2020) & (F.col("week") >= 5), 999.0).otherwise(F.col("fantasy_points")))
    assert [r[:4] for r in run(panel)] == [r[:4] for r in run(after)]
    assert np.allclose([r[4] for r in run(panel)], [r[4] for r in run(after)])


def test_trees_learn_a_step(panel):
    stepped = panel.withColumn("fantasy_points", F.when(F.col("targets") > 6, 20.0).otherwise(5.0))
    got = B.weekly_boosted(stepped, ["targets", "air_yards"], "fantasy_points", 2020, trees=20, depth=2, rate=0.5, min_rows=2).join(stepped.select(*GRAIN, "fantasy_points"), GRAIN)
    assert got.select(F.avg(F.abs(F.col("predicted_points") - F.col("fantasy_points")))).first()[0] < 1.0


def test_backtest_with_a_factory(panel):
    sizes = []

    def factory(train, position):
        row = train.agg(F.count("*").alias("n"), F.avg("fantasy_points").alias("m"), F.max(F.col("season") * 100 + F.col("week")).alias("last")).first()
        sizes.append((position, row["n"], row["last"]))
        return lambda test: test.withColumn("predicted", F.lit(row["m"]))

    seen = []
    few = panel.where("week <= 4")
    got = B.weekly_backtest(few, 2020, factory, ["RB"], lambda a, b: seen.append(1) or (a, b)).collect()
    assert {r.season for r in got} == {2020} and {r.week for r in got} == {1, 2, 3, 4} and {r.position for r in got} == {"RB"}
    assert [n for _, n, _ in sizes] == sorted(n for _, n, _ in sizes) and [x for _, _, x in sizes] == sorted(x for _, _, x in sizes) and len(seen) == 4
    assert all(last < 202000 + w for (_, _, last), w in zip(sizes, (1, 2, 3, 4)))

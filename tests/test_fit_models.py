"""Fits against NumPy, apply without refit, refits that look back only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.operators import evaluate as E
from weekgrain.operators import features as W
from weekgrain.operators import fit as U
from weekgrain.operators import folds as FO
from weekgrain.operators import models as M
from weekgrain.operators import rank as K
from weekgrain.operators import utilization as UT


def test_gram_ridge_equals_numpy(panel):
    cols = ["targets", "rushing_attempts"]
    b = M.fit_positions(panel, cols, "fantasy_points", 2.0)["RB"]
    p = panel.where("position='RB'").toPandas()
    x = p[cols].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    y = p.fantasy_points.to_numpy()
    w = np.linalg.solve(z.T @ z + 2.0 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(b, [y.mean() - w @ x.mean(0), *w])
    g = U.gram_by(panel.where("position='RB'"), ["position"], cols, "fantasy_points").table[("RB",)]
    assert np.isclose(U.sse(g, b), ((y - b[0] - x @ b[1:]) ** 2).sum())


def test_wide_moments_equal_the_aggregates(panel):
    cols = ["targets", "rushing_attempts", "air_yards"]
    a, b = (U.gram_by(panel.repartition(3), ["position", "season"], cols, "fantasy_points", wide=w).table for w in (False, True))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_bootstraps_weigh_rows_without_repeating_them(panel):
    cols = ["targets", "air_yards"]
    weights = [F.pmod(F.xxhash64("player_id", "season", "week", F.lit(r)), F.lit(3)) for r in range(4)]
    got = U.bootstrap_grams(panel.repartition(3), cols, "fantasy_points", weights)
    p = panel.select(*cols, "fantasy_points", *[w.alias(f"w{r}") for r, w in enumerate(weights)]).toPandas()
    x = np.column_stack([np.ones(len(p)), p[[*cols, "fantasy_points"]].to_numpy(float) - got.shift])
    for r in range(4):
        assert np.allclose(got.table[(r,)], (x * p[f"w{r}"].to_numpy()[:, None]).T @ x)


def test_planted_columns_are_stable(panel):
    noise = {f"n{i}": F.pmod(F.xxhash64("player_id", "season", "week", F.lit(100 + i)), F.lit(1000)).cast("double") for i in range(6)}
    planted = panel.withColumns(noise).withColumn("y", 1e7 + 3 * F.col("targets") - F.col("air_yards") + F.col("n0") / 500)
    got = {r.feature: r.frequency for r in M.stability_selection(planted, ["targets", "air_yards", *noise], "y", rounds=8).collect()}
    assert got["targets"] == got["air_yards"] == 1.0 and max(v for k, v in got.items() if k[0] == "n") <= 0.25


def test_non_negative_solution_beats_a_grid():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(6, 3)), rng.normal(size=6)
    x = U.non_negative(a, b)
    best = min(((a @ np.array(v) - b) ** 2).sum() for v in np.stack(np.meshgrid(*[np.linspace(0, 2, 21)] * 3), -1).reshape(-1, 3))
    assert (x >= 0).all() and ((a @ x - b) ** 2).sum() <= best + 1e-9


def test_weights_sum_to_one_with_floor():
    w = U.with_floor({"a": 0.0, "b": 5.0, "c": 0.001, "d": 1.0}, ["a", "b"])
    assert np.isclose(sum(w.values()), 1.0) and w["a"] >= 0.03 - 1e-12 and w["b"] > w["d"]
    for p, comp in C.UTILIZATION_WEIGHTS.items():
        assert np.isclose(sum(comp.values()), 1.0) and set(comp) == set(C.COMPONENT_COLUMNS[p])


def test_bounds_round_trip_refuses_other_seasons(spark, panel, tmp_path):
    parts = UT.components(UT.high_value_touch_rate(UT.with_team_totals(panel)))
    b = UT.fit_bounds(parts.where("season < 2020"))
    UT.save_bounds(b, str(tmp_path / "b"), [2018, 2019])
    assert sorted(map(tuple, UT.load_bounds(spark, str(tmp_path / "b"), [2019, 2018]).collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        UT.load_bounds(spark, str(tmp_path / "b"), [2018])


def test_scores_stay_in_range(panel):
    parts = UT.components(UT.high_value_touch_rate(UT.with_team_totals(panel)))
    s = UT.utilization(panel, UT.fit_bounds(parts)).agg(F.min("utilization_score"), F.max("utilization_score"), F.count("utilization_score")).first()
    assert s[0] >= 0 and s[1] <= 100 and s[2] == panel.count()


def test_weekly_refit_looks_back_only(panel):
    h = W.rolling_means(panel, ["fantasy_points"], [3]).where("fantasy_points_roll3_mean is not null")
    got = M.weekly_refit(h, ["fantasy_points_roll3_mean"], "fantasy_points", 2020, min_total=20, min_group=5)
    pdf = h.toPandas()
    rows = got.toPandas()
    for _, r in rows.sample(20, random_state=2).iterrows():
        past = pdf[(pdf.position == r.position) & ((pdf.season < r.season) | ((pdf.season == r.season) & (pdf.week < r.week)))]
        x, y = past.fantasy_points_roll3_mean.to_numpy(), past.fantasy_points.to_numpy()
        n = len(x)
        b = ((x * y).mean() - x.mean() * y.mean()) / (x.var() * (1 + 1 / n))
        assert np.isclose(r.predicted_points, y.mean() + b * (r.fantasy_points_roll3_mean - x.mean()))


def test_folds_never_train_on_the_test_or_later(panel):
    for folds in (FO.season_folds(panel, 2), FO.walk_forward_seasons(panel, 1), FO.season_holdout(panel, [2020], gap=1)):
        for f in {r.fold for r in folds.collect()}:
            part = folds.where(F.col("fold") == f)
            top = part.where("role='train'").agg(F.max("season")).first()[0]
            assert top < part.where("role='test'").agg(F.min("season")).first()[0]
    for folds in (FO.purged_folds(panel, 4), FO.expanding_weeks(panel, 12)):
        at = F.col("season") * 100 + F.col("week")
        bad = folds.where("role='train'").groupBy("fold").agg(F.max(at).alias("a")).join(folds.where("role='test'").groupBy("fold").agg(F.min(at).alias("b")), "fold").where("a >= b")
        assert bad.isEmpty()


def test_future_rows_are_refused(panel):
    E.assert_no_future(panel.where("season < 2020"), panel.where("season = 2020"))
    with pytest.raises(ValueError):
        E.assert_no_future(panel.where("season <= 2020"), panel.where("season = 2020"))


def test_permutation_finds_the_used_column(panel):
    pred = lambda d: d.withColumn("predicted_points", F.col("targets") * 2.0)
    df = panel.withColumn("y", F.col("targets") * 2.0)
    imp = {r.feature: r.importance for r in M.permutation_importance(df, ["targets", "snap_count"], pred, "y").collect()}
    assert imp["targets"] > 1 and abs(imp["snap_count"]) < 1e-9


def test_permutation_deals_out_the_same_values(panel):
    seen = {}

    def predict(d):
        seen["v"] = sorted(r[0] for r in d.select("targets").collect())
        return d.withColumn("predicted_points", F.lit(0.0))

    M.permutation_importance(panel, ["targets"], predict, "fantasy_points")
    assert seen["v"] == sorted(r[0] for r in panel.select("targets").collect())


def test_lasso_bootstraps_keep_the_driver_of_the_target(panel):
    df = panel.withColumn("y", F.col("targets") * 3.0 + F.col("rushing_attempts") * 0.001)
    s = {r.feature: r.frequency for r in M.stability_selection(df, ["targets", "rushing_attempts", "snap_count"], "y", rounds=5).collect()}
    assert s["targets"] == 1.0 and s["snap_count"] < 0.6


def test_lineups_match_brute_force(panel):
    p = panel.where("season=2020 and week=3").select((F.col("player_id") % 2).alias("roster"), "player_id", "position", F.col("fantasy_points").alias("v"))
    got = {r: set() for r in (0, 1)}
    for r in K.best_lineups(p, ["roster"], "v").collect():
        got[r.roster].add((r.player_id, r.slot))
    pdf = p.toPandas()
    for roster, g in pdf.groupby("roster"):
        left, want = g.sort_values(["v", "player_id"], ascending=[False, True]), set()
        for pos, n in K.LINEUP.items():
            top = left[left.position == pos].head(n)
            want |= {(i, pos) for i in top.player_id}
            left = left.drop(top.index)
        want |= {(i, "FLEX") for i in left[left.position.isin(K.FLEX)].head(1).player_id}
        assert got[roster] == want


def test_ks_and_auc_against_brute_force(spark):
    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.5, 1, 200), 1)
    cur, ref = (spark.createDataFrame([(float(x),) for x in v], "x double") for v in (a, b))
    r = E.feature_drift(cur, ref, ["x"]).first()
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert np.isclose(r.ks_stat, want) and r.p_value < 0.01
    both = cur.withColumn("y", F.lit(1)).unionByName(ref.withColumn("y", F.lit(0)))
    assert np.isclose(E.ranking_auc(both, "y", "x").first().auc, np.mean([(x > z) + 0.5 * (x == z) for x in a for z in b]))


def test_moment_rmse_at_a_high_level(spark):
    """Values near 1e8: the RMSE from moments equals the one over rows."""
    import numpy as np

    from weekgrain.operators import fit as U
    from weekgrain.operators import models as M

    rng = np.random.default_rng(5)
    x = 1e8 + rng.normal(size=400)
    y = 1e8 + 2 * (x - 1e8) + rng.normal(size=400)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)] + [("none", 1.0, None)], "g string, x double, y double")
    grams = U.gram_by(df, ["g"], ["x"], "y", centre=True)
    assert list(grams.table) == [("a",)]  # a group without known targets is left out
    beta = M.ridge_scaled(grams.table[("a",)], 1.0)
    whole = grams.unshifted(beta)
    direct = float(np.sqrt(np.mean((y - whole[0] - whole[1] * x) ** 2)))
    assert abs(U.rmse(grams.table[("a",)], beta) - direct) < 1e-6


def test_non_negative_solve_meets_its_optimality_conditions():
    import numpy as np

    from weekgrain.operators.fit import non_negative

    rng = np.random.default_rng(2)
    for p in (1, 4, 25):
        a, b = rng.normal(size=(p + 10, p)), rng.normal(size=p + 10)
        x = non_negative(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-8).all() and abs(g @ x) < 1e-8

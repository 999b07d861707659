"""Fitting across folds, drift of errors, feature selection and rollups, against plain recomputation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekgrain import config as C
from weekgrain.operators import context as CX
from weekgrain.operators import evaluate as E
from weekgrain.operators import features as W
from weekgrain.operators import fit as U
from weekgrain.operators import joins as J
from weekgrain.operators import models as M
from weekgrain.operators import rank as K

COLS = ["fantasy_points_roll3_mean", "targets_roll3_mean"]


@pytest.fixture(scope="module")
def history(panel):
    p = W.rolling_means(panel, ["fantasy_points", "targets"], [3]).where(F.col("fantasy_points_roll3_mean").isNotNull())
    return p.select("player_id", "season", "week", "position", "fantasy_points", *COLS).persist()


def test_out_of_fold_ridge_equals_a_fit_per_season(history):
    got = {(r.player_id, r.season, r.week): r.oof_ridge for r in M.out_of_fold(history, [2019, 2020], COLS, "fantasy_points", ["ridge"]).collect()}
    want = {}
    for s in (2019, 2020):
        betas = M.fit_positions(history.where(F.col("season") < s), COLS, "fantasy_points")
        want |= {(r.player_id, r.season, r.week): r.p for r in M.predict_positions(history.where(F.col("season") == s), COLS, betas, "p").collect()}
    assert got.keys() == want.keys() and got
    assert all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_out_of_fold_kinds_stand_side_by_side_and_ignore_later_seasons(history):
    run = lambda h: {(r.player_id, r.season, r.week): (r.oof_ridge, r.oof_boosted) for r in M.out_of_fold(h, [2019, 2020], COLS, "fantasy_points", ["ridge", "boosted"], trees=2, depth=1).collect()}
    before = run(history)
    after = run(history.withColumn("fantasy_points", F.when(F.col("season") == 2020, 0.0).otherwise(F.col("fantasy_points"))))
    assert before.keys() == after.keys() and len(before) == history.where("season > 2018").count()
    assert all(np.allclose(before[k], after[k]) for k in before)


def test_stack_chooses_its_penalty_over_seasons_left_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, s, w, "QB", float(y), float(y + rng.normal()), float(rng.normal())) for s in (1, 2, 3) for w in (1, 2) for i, y in enumerate(rng.normal(10, 4, 15))]
    rows += [(99, 1, 1, "TE", 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "player_id int, season int, week int, position string, y double, oof_ridge double, oof_boosted double")
    got = M.stack(df, ["ridge", "boosted"], "y")
    x = np.array([[r[5], r[6]] for r in rows if r[3] == "QB"])
    y, season = np.array([r[4] for r in rows if r[3] == "QB"]), np.array([r[1] for r in rows if r[3] == "QB"])

    def fit(x, y, a):
        m, sd = x.mean(0), x.std(0)
        z = (x - m) / sd
        b = np.linalg.solve(z.T @ z + a * np.eye(2), z.T @ (y - y.mean())) / sd
        return np.concatenate([[y.mean() - b @ m], b])

    def error(a):
        return sum(((y[season == s] - np.c_[np.ones((season == s).sum()), x[season == s]] @ fit(x[season != s], y[season != s], a)) ** 2).sum() for s in (1, 2, 3))

    best = min(np.logspace(-2, 2, 20), key=error)
    assert np.allclose(got["QB"], fit(x, y, best))
    assert np.allclose(got["TE"], [0.0, 3 / 7, 4 / 7])  # too few rows: fixed shares


def test_conversion_errors_come_from_the_last_training_season(panel):
    p = W.rolling_means(panel, ["snap_count", "targets"], [3]).withColumn("snap_count", F.col("snap_count").cast("double")).where(F.col("snap_count_roll3_mean").isNotNull())
    out = M.usage_to_points(p.where("season < 2020"), p.where("season = 2020"), "snap_count", ["snap_count_roll3_mean"], ["targets_roll3_mean"], maxIter=2, maxDepth=2)
    rows = out.collect()
    assert len(rows) == p.where("season = 2020").count()
    assert {r.position for r in rows} == set(C.POSITIONS)
    assert all(0 < r.conversion_error_80 <= r.conversion_error_95 for r in rows)
    assert all(math.isfinite(r.predicted_points) for r in rows)
    # outcomes of the test season do not matter
    again = M.usage_to_points(p.where("season < 2020"), p.where("season = 2020").withColumn("fantasy_points", F.lit(0.0)), "snap_count", ["snap_count_roll3_mean"], ["targets_roll3_mean"],
                              maxIter=2, maxDepth=2)
    assert sorted((r.player_id, r.week, round(r.predicted_points, 9)) for r in rows) == sorted((r.player_id, r.week, round(r.predicted_points, 9)) for r in again.collect())


def test_error_drift_counts_known_finite_rows(spark):
    row = "position string, fantasy_points double, predicted_points double"
    now = spark.createDataFrame([("QB", 10.0, 7.0)] * 5 + [("QB", None, 1.0), ("QB", float("nan"), 1.0), ("QB", 1.0, float("inf"))] + [("RB", 1.0, 2.0)] * 4 + [("WR", 4.0, 2.0)] * 6 + [("TE", 3.0, 2.0)] * 5, row)
    past = spark.createDataFrame([("QB", 2.0, 0.0)] * 9 + [("TE", 1.0, 1.0)] * 9, row)
    got = {r.position: (r.n_rows, r.rmse, r.mae, r.reference_rmse, r.degradation, r.rmse_alert) for r in E.error_drift(now, past, ["position"]).collect()}
    assert got == {"QB": (5, 3.0, 3.0, 2.0, 0.5, 1), "WR": (6, 2.0, 2.0, None, None, 0), "TE": (5, 1.0, 1.0, 0.0, None, 0)}  # RB has four rows
    assert E.error_drift(now, past).first().n_rows == 20
    assert E.error_drift(now.limit(0), past, ["position"]).count() == 0


def test_metrics_of_a_constant_prediction(spark):
    df = spark.createDataFrame([("QB", 1.0, 3.0), ("QB", 5.0, 3.0), ("RB", 1.0, 2.0), ("RB", 2.0, 4.0)], "position string, fantasy_points double, predicted_points double")
    got = {r.position: r for r in E.regression_metrics(df, ["position"]).collect()}
    assert got["QB"].correlation is None and got["QB"].rmse == 2.0 and abs(got["RB"].correlation - 1.0) < 1e-12


def test_selection_steps(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "twin": a * 3 + rng.normal(size=400) * 0.01, "b": b, "flat": 0.5 + rng.normal(size=400) * 0.01, "noise": rng.normal(size=400), "y": a + 0.2 * b}))
    got = {r.feature: r for r in U.select_features(df, ["a", "twin", "b", "flat", "noise"], "y").collect()}
    assert not got["flat"].varied and not got["flat"].selected
    assert got["twin"].kept and not got["a"].kept  # of the two the one that varies more
    assert {f for f, r in got.items() if r.selected} == {"twin", "b", "noise"}
    few = {r.feature for r in U.select_features(df, ["a", "twin", "b", "flat", "noise"], "y", default=1).collect() if r.selected}
    assert few == {"twin"}
    assert U.adaptive_count(100) == 20 and U.adaptive_count(900) == 30 and U.adaptive_count(10 ** 6) == 50


def test_floor_falls_back_to_the_default_shape():
    got = U.with_floor({"x": 0.0, "y": 0.0, "z": 0.0}, ["x"], 0.03, {"x": 0.0, "y": 3.0, "z": 1.0})
    assert np.isclose(sum(got.values()), 1.0) and np.isclose(got["y"] / got["z"], 3.0) and np.isclose(got["x"], 0.03 / 1.03)
    assert U.with_floor({"x": 1.0, "y": 0.0}, ["x", "y"], 0.5, {"x": 1.0, "y": 3.0}) == {"x": 0.25, "y": 0.75}
    held = U.with_floor({"x": 0.01, "y": 0.99}, ["x"], 0.03)
    assert np.isclose(held["x"], 0.03) and np.isclose(held["y"], 0.97)


def test_weights_keep_defaults_without_rows_or_target(spark, panel):
    assert U.fit_utilization_weights(panel.limit(0)) == {p: dict(C.UTILIZATION_WEIGHTS[p]) for p in C.COMPONENT_COLUMNS}


def test_roster_team_of_the_following_season(spark):
    rows = spark.createDataFrame([(1, 2000, 5), (1, 2001, 6), (2, 2000, 7), (3, 2002, 8)], "player_id int, season int, team int")
    rosters = spark.createDataFrame([(1, 2001, 11), (1, 2002, 12), (2, 2002, 13)], "player_id int, season int, team int")
    got = {(r.player_id, r.season): (r.team, r.team_next_season) for r in J.with_current_team(rows, rosters).collect()}
    assert got == {(1, 2000): (11, 12), (1, 2001): (12, None), (2, 2000): (7, 13), (3, 2002): (8, None)}
    one = {(r.player_id, r.season): (r.team, r.team_next_season) for r in J.with_current_team(rows, rosters, 2001).collect()}
    assert one == {(1, 2000): (11, 12), (1, 2001): (11, 12), (2, 2000): (7, 13), (3, 2002): (8, None)}


def test_rollup_levels(panel):
    got = {(r.season, r.position, r.tier): r for r in K.usage_rollup(panel.withColumn("u", F.col("fantasy_points") * 4), "u").collect()}
    pdf = panel.toPandas()
    pdf["u"] = pdf.fantasy_points * 4
    qb = pdf[(pdf.position == "QB") & (pdf.season == 2019)]
    r = got[(2019, "QB", None)]
    assert (r.total_players, r.n_rows, r.elite_count) == (qb.player_id.nunique(), len(qb), int((qb.u >= 85).sum()))
    assert np.isclose(r.avg_util, qb.u.mean()) and np.isclose(r.std_util, qb.u.std())
    every = got[(None, None, None)]
    assert every.n_rows == len(pdf) and every.total_players == 12
    assert sum(x.n_rows for k, x in got.items() if None not in k) == len(pdf)


def similarity(a, b):
    gap, rounds = abs(a[2] - b[2]), abs(a[1] - b[1])
    draft = 1 - min(gap / 50, 0.5) if rounds == 0 else 0.7 - min(gap / 75, 0.4) if rounds == 1 else max(0.1, 0.5 - rounds * 0.15 - gap / 100)
    return round(draft * 0.7 + max(0.0, 1 - abs(a[3] - b[3]) / 30) * 0.3, 9)


@pytest.mark.parametrize("n", [30, 1500])
def test_comparable_rookies_equal_all_pairs(spark, n):
    """Few rookies go through all bands, many are settled by the first."""
    rng = np.random.default_rng(n)
    hist = [("QB" if rng.random() < 0.6 else "RB", int(rng.integers(1, 8)), int(rng.integers(1, 60)), round(float(rng.uniform(40, 99)), 1), f"n{i}", 2000 + i % 5, float(i % 17), 16) for i in range(n)]
    want = list({("QB" if rng.random() < 0.6 else "RB", int(rng.integers(1, 8)), int(rng.integers(1, 60)), round(float(rng.uniform(40, 99)), 1)) for _ in range(40)})
    h = spark.createDataFrame(hist, "position string, draft_round int, draft_pick int, combine_score double, name string, season int, ppg double, games int")
    w = spark.createDataFrame(want, "position string, draft_round int, draft_pick int, combine_score double")
    got = {}
    for r in CX.comparable_rookies(w, h).orderBy("_pos").collect():
        got.setdefault((r.position, r.draft_round, r.draft_pick, r.combine_score), []).append((r.similarity, r["name"], r.season))
    for p in want:
        best = sorted(((-similarity(p, x), x[4], x[5]) for x in hist if x[0] == p[0]))[:5]
        assert got.get(p, []) == [(-s, a, b) for s, a, b in best], p

"""Golden values and the causality property of history features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekgrain.functions import calendar as CAL
from weekgrain.keys import KEYS, Keys
from weekgrain.operators import context as CX
from weekgrain.operators import evaluate as E
from weekgrain.operators import features as W
from weekgrain.operators import plays as PL
from weekgrain.operators import targets as TG


def line(spark, values, player=1, season=2023):
    return spark.createDataFrame([(player, season, i + 1, "RB", v) for i, v in enumerate(values)], "player_id int, season int, week int, position string, fantasy_points double")


def column(df, c):
    return [r[c] for r in df.orderBy("player_id", "season", "week").collect()]


def test_rolling_mean_of_earlier_weeks(spark):
    df = W.rolling_means(line(spark, [10.0 * w for w in range(1, 11)]), ["fantasy_points"], [4])
    assert column(df, "fantasy_points_roll4_mean")[4] == 25.0 and column(df, "fantasy_points_roll4_mean")[0] is None


def test_horizon_targets(spark):
    df = TG.horizon_targets(line(spark, [10.0, 20.0, 30.0, 40.0, 50.0]), (1, 4))
    assert column(df, "target_1w") == [20.0, 30.0, 40.0, 50.0, None]
    assert column(df, "target_4w") == [140.0, 120.0, None, None, None]
    assert column(TG.next_rows_target(line(spark, [10.0, 20.0, 30.0, 40.0, 50.0]), 4), "target") == [140.0, 120.0, 90.0, 50.0]


def test_ewm_with_gaps_matches_pandas(spark):
    v = [None, 3.0, None, None, 8.0, 1.0, None, 4.0, 4.5]
    df = W.ewm_means(line(spark, v), ["fantasy_points"], [3, 5])
    s = pd.Series([np.nan if x is None else x for x in v])
    for span in (3, 5):
        want = s.shift(1).ewm(span=span, adjust=False).mean()
        got = pd.Series(column(df, f"fantasy_points_ewm{span}"), dtype=float)
        assert np.allclose(got, want, equal_nan=True)


def test_slope_matches_polyfit(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    got = column(W.trends(line(spark, v), ["fantasy_points"], [5]), "fantasy_points_trend5")
    assert got[0] is None and got[1] is None
    for i in range(2, len(v)):
        past = v[max(0, i - 5):i]
        assert np.isclose(got[i], np.polyfit(range(len(past)), past, 1)[0])


def test_changes_stay_inside_the_player(spark):
    df = line(spark, [1.0, 2.0, 4.0]).unionByName(line(spark, [100.0, 50.0, 25.0], player=2))
    assert column(W.week_over_week(df, ["fantasy_points"]), "fantasy_points_wow_change") == [None, None, 1.0, None, None, -50.0]


def test_return_from_absence(spark):
    df = spark.createDataFrame([(1, 2023, w) for w in (1, 2, 5, 6, 7, 8)], "player_id int, season int, week int")
    out = W.return_from_absence(df)
    assert column(out, "games_since_injury") == [99.0, 99.0, 0.0, 1.0, 2.0, 99.0]
    assert column(out, "return_from_injury_discount") == [1.0, 1.0, 0.70, 0.85, 0.95, 1.0]


def test_baselines_and_playoff_calendar(spark):
    days = ["2023-09-06", "2023-09-07", "2023-12-31", "2024-01-10", "2024-01-18", "2024-01-19", "2024-01-27", "2024-02-09", "2024-02-10", "2024-08-31"]
    d = spark.createDataFrame([(x,) for x in days], "d string").select(F.to_date("d").alias("d"))
    got = {str(r.d): (r.w, r.s, r.off) for r in d.select("d", CAL.week_of(F.col("d")).alias("w"), CAL.season_of(F.col("d")).alias("s"), CAL.is_off_season(F.col("d")).alias("off")).collect()}
    assert [got[x][0] for x in days] == [0, 1, 17, 19, 20, 21, 22, 22, 18, 18]
    assert got["2024-02-09"][1:] == (2023, False) and got["2024-02-10"][1:] == (2023, True)
    lab = spark.range(1).select(CAL.week_label(F.lit(22), F.lit(2025)).alias("x")).first().x
    assert lab == "Super Bowl LIX"


# --- the causality property -------------------------------------------------------------------
def _allowed(p):
    return W.opponent_zscores(p, PL.points_allowed_by_position(p))


OPERATORS = {
    "rolling_means": lambda p: W.rolling_means(p, ["fantasy_points", "targets"], [3, 8]),
    "rolling_stds": lambda p: W.rolling_stds(p, ["fantasy_points"], [4]),
    "ewm": lambda p: W.ewm_means(p, ["fantasy_points"], [3]),
    "lags": lambda p: W.lags(p, ["fantasy_points"]),
    "trends": lambda p: W.trends(p, ["fantasy_points"]),
    "wow": lambda p: W.week_over_week(p, ["fantasy_points"]),
    "regression_to_mean": W.regression_to_mean,
    "season_to_date": W.season_to_date,
    "opponent_zscores": lambda p: _allowed(p),
    "boom_bust": W.boom_bust_rates,
    "volatility": lambda p: W.rolling_volatility(W.volatility(p)),
    "outlook_games": lambda p: CX.expected_games(p, 5),
    "defense_matchup": lambda p: CX.with_opponent_matchup(p, CX.defense_vs_position(p)),
    "schedule_strength": lambda p: CX.schedule_strength(p, 3),
    "baselines": lambda p: E.with_baselines(p).drop("oracle_position_week"),
    "team_rolling": lambda p: W.team_rolling(p.groupBy("team", "season", "week").agg(F.sum("fantasy_points").alias("x")), ["x"]).drop("x").withColumn("player_id", F.col("team")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_features_do_not_see_their_own_or_later_weeks(panel, name):
    """Changing every points value from (2020, 5) on leaves all features up to and including that week as they were."""
    op = OPERATORS[name]
    late = (F.col("season") > 2020) | ((F.col("season") == 2020) & (F.col("week") >= 5))
    changed = panel.withColumns({"fantasy_points": F.when(late, F.col("fantasy_points") * 3 + 11).otherwise(F.col("fantasy_points")),
                                 "targets": F.when(late, F.col("targets") + 40).otherwise(F.col("targets"))})
    raw = {"fantasy_points", "targets"}
    upto = (F.col("season") < 2020) | ((F.col("season") == 2020) & (F.col("week") <= 5))

    def view(p):
        df = op(p).where(upto)
        cols = sorted(c for c in df.columns if c not in raw)
        if name == "opponent_zscores":
            cols = [c for c in cols if "zscore" in c or c in ("player_id", "season", "week")]
        return [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(cols).orderBy("player_id", "season", "week").collect()]

    assert view(panel) == view(changed)


@pytest.mark.parametrize("name", ["rolling_means", "regression_to_mean", "defense_matchup", "schedule_strength"])
def test_row_order_and_partitioning_do_not_matter(panel, name):
    op = OPERATORS[name]
    shuffled = panel.orderBy(F.xxhash64("player_id", "week")).repartition(5)
    norm = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).orderBy("player_id", "season", "week").collect()]
    assert norm(op(panel)) == norm(op(shuffled))


def test_impute_uses_train_medians_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, None), (None, float("inf"))], "a_lag1 double, b double")
    test = spark.createDataFrame([(None, None)], "a_lag1 double, b double")
    r = W.impute(test, W.fit_medians(train, ["a_lag1", "b"]), ["a_lag1", "b"]).first()
    assert (r.a_lag1, r.b, r.a_lag1_missing) == (2.0, 5.0, 1)


def test_unique_key_keeps_grain(panel):
    for op in ("rolling_means", "regression_to_mean", "schedule_strength", "defense_matchup"):
        out = OPERATORS[op](panel)
        assert out.count() == panel.count() == out.select(*KEYS.grain).distinct().count()


# --- other key names -------------------------------------------------------------------------
NAMES = {"player_id": "sku", "season": "yr", "week": "mo", "position": "segment", "team": "store", "opponent": "rival"}
OTHER = Keys(entity="sku", season="yr", week="mo", group="segment", team="store", opponent="rival")
GENERIC = {
    "rolling_means": lambda p, k: W.rolling_means(p, ["fantasy_points"], [3], k),
    "ewm": lambda p, k: W.ewm_means(p, ["fantasy_points"], [3], k),
    "regression_to_mean": lambda p, k: W.regression_to_mean(p, keys=k),
    "momentum": lambda p, k: W.rest_features(W.boom_bust_rates(p, keys=k), k),
    "outliers": lambda p, k: W.outlier_flags(p, ["fantasy_points"], keys=k),
    "risk_adjusted": lambda p, k: W.risk_adjusted(W.volatility(p, keys=k), keys=k),
    "schedule_strength": lambda p, k: CX.schedule_strength(p, 3, keys=k),
    "defense_matchup": lambda p, k: CX.with_opponent_matchup(p, CX.defense_vs_position(p, k), k),
    "expected_games": lambda p, k: CX.expected_games(p, 5, keys=k),
    "adp": lambda p, k: CX.adp_features(p, k),
    "targets": lambda p, k: TG.horizon_targets(p, keys=k),
    "baselines": lambda p, k: E.with_baselines(p, keys=k),
}


@pytest.mark.parametrize("name", GENERIC)
def test_operators_run_on_other_key_names(panel, name):
    renamed = panel
    for a, b in NAMES.items():
        renamed = renamed.withColumnRenamed(a, b)
    back = GENERIC[name](renamed, OTHER)
    for a, b in NAMES.items():
        back = back.withColumnRenamed(b, a)
    plain = GENERIC[name](panel, KEYS)
    norm = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(plain.columns)).orderBy("player_id", "season", "week").collect()]
    assert norm(back) == norm(plain)


def test_group_stats_keep_digits_at_a_high_level(spark):
    """Values near 1e8 with a spread of 1: running std equals the direct one."""
    from pyspark.sql import functions as F

    from weekgrain.functions.windows import causal_group_stats

    rows = [("a", 2000, w, float(1e8 + (7 * w + i) % 4)) for w in range(1, 9) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, season int, week int, x double")
    got = {r.week: r for r in causal_group_stats(df, {"x": "x"}, ["g"]).collect()}
    for w in range(2, 9):
        want = df.where(F.col("week") < w).agg(F.stddev_samp("x").alias("s"), F.avg("x").alias("m")).first()
        assert abs(got[w].x_std - want.s) < 1e-6 and abs(got[w].x_mean - want.m) < 1e-6

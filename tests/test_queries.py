"""A sample of registered queries beside their SQL twins at the smallest scale; check_oracle.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, rows
from weekgrain.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
SAMPLE = ["A08_pass_rate_over_expected", "A14_defense_weeks", "E06_interval_calibration", "E15_purged_folds", "E18_feature_drift", "F08_prediction_view", "J01_training_panel",
          "J12_draft_join", "K01_value_over_replacement", "K11_lineups", "M04_conformal_table", "S11_upsert_table", "T04_late_repair", "U05_utilization_score", "W01_rolling_mean",
          "W11_team_momentum", "W32_injury_history", "X07_calendar"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_query_has_a_sql_twin_or_a_reason():
    """Queries without SQL are trees, hashes, bootstraps or multi-variable solves."""
    bare = {n for n in REGISTRY if n not in E.oracle_sql()}
    assert {n[0] for n in bare} <= set("EFMSU")


def test_fit_queries_take_all_positions_and_columns(spark):
    from weekgrain.config import POSITIONS
    from weekgrain.plans.q_fit import HIST

    q = E.queries()
    assert {r.feature for r in q["E23_permutation_importance"](spark, SF).collect()} == set(HIST)
    for name in ("M02_out_of_fold", "M05_usage_to_points"):
        assert {r.position for r in q[name](spark, SF).collect()} == set(POSITIONS), name

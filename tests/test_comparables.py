import pytest
from pyspark.sql import functions as F

from weekgrain.operators import context as CX


@pytest.fixture
def rows_in(monkeypatch):
    """How many rows each ranking of comparables gets."""
    sizes, real = [], CX.first_rows

    def counted(df, groups, order, k):
        if "similarity" in df.columns:
            sizes.append(df.count())
        return real(df, groups, order, k)

    monkeypatch.setattr(CX, "first_rows", counted)
    return sizes


def test_a_slot_hands_on_its_best_rows_only(spark, rows_in):
    """One slot with 40 combine scores of 5 rows each: those that k rows of the slot are ahead of reach no ranking."""
    history = [("QB", 1, 9, 40.0 + i / 2, f"P{i:02d}-{j}", 1990 + j, float(i), 3) for i in range(40) for j in range(5)]
    h = spark.createDataFrame(history, "position string, draft_round int, draft_pick int, combine_score double, name string, season int, ppg double, games int")
    want = spark.createDataFrame([("QB", 1, 9, 50.1)], "position string, draft_round int, draft_pick int, combine_score double")
    found = CX.comparable_rookies(want, h).orderBy("_pos").collect()
    assert [(r.name, r.season, r._pos) for r in found] == [(f"P20-{j}", 1990 + j, j + 1) for j in range(5)]
    assert max(rows_in) <= 5


def test_ties_of_a_slot_stay(spark):
    """Two scores equally far away: both are handed on, and name and season decide."""
    history = [("QB", 1, 9, 48.0, f"B{j}", 1990, 1.0, 3) for j in range(5)] + [("QB", 1, 9, 52.0, f"A{j}", 1990, 1.0, 3) for j in range(4)] + [("QB", 1, 10, 50.0, "C", 1990, 1.0, 3)]
    h = spark.createDataFrame(history, "position string, draft_round int, draft_pick int, combine_score double, name string, season int, ppg double, games int")
    want = spark.createDataFrame([("QB", 1, 9, 50.0)], "position string, draft_round int, draft_pick int, combine_score double")
    found = CX.comparable_rookies(want, h).orderBy("_pos")
    assert [r.name for r in found.collect()] == ["C", "A0", "A1", "A2", "A3"]
    assert found.where(F.col("similarity").isNull()).count() == 0

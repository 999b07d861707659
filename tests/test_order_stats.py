"""The value ladder against pandas, with ties, nulls and one group that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekgrain.functions.order_stats import expanding_quantile, first_rows, quantiles, value_ladder, with_rank, with_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(4000) < 0.7, "hot", rng.choice(list("abc"), 4000))
    v = np.where(rng.random(4000) < 0.3, 1.5, np.round(rng.normal(0, 50, 4000), 1))
    pdf = pd.DataFrame({"id": range(4000), "g": g, "v": v, "t": rng.integers(0, 12, 4000)})
    pdf.loc[rng.random(4000) < 0.02, "v"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, sdf


@pytest.mark.parametrize("method,kw", [("min", {"method": "min"}), ("average", {"method": "average"}), ("pct", {"pct": True, "method": "average"})])
def test_ranks_match_pandas(skewed, method, kw):
    pdf, sdf = skewed
    got = with_rank(sdf.repartition(7), ["g"], "v", "r", method).toPandas().set_index("id").r.sort_index()
    want = pdf.groupby("g").v.rank(na_option="bottom", **kw)
    assert np.allclose(got.to_numpy(float), want.to_numpy(float))


def test_descending_and_ungrouped_together(skewed):
    pdf, sdf = skewed
    full = sdf.where("v is not null")
    got = with_ranks(full, [(["g"], "v", "r", "min", False), ([], "v", "o", "average", True)]).toPandas().set_index("id").sort_index()
    p = pdf.dropna()
    assert (got.r.to_numpy() == p.groupby("g").v.rank(method="min", ascending=False).to_numpy()).all()
    assert np.allclose(got.o, p.v.rank())


def test_quantiles_match_numpy(skewed):
    pdf, sdf = skewed
    got = quantiles(sdf, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.95}).toPandas().set_index("g")
    for g, s in pdf.dropna().groupby("g").v:
        assert np.allclose(got.loc[g, ["a", "b", "c"]].to_numpy(float), np.quantile(s, [0.01, 0.5, 0.95]))
        assert got.loc[g, "n"] == len(s)


def test_ladder_counts_parts(skewed):
    pdf, sdf = skewed
    lad = value_ladder(sdf, ["g"], "v", parts={"even": F.col("id") % 2 == 0}).where("v is not null").toPandas()
    for _, r in lad.sample(60, random_state=1).iterrows():
        inside = pdf[pdf.g == r.g]
        assert r.below == (inside.v < r.v).sum() and r.below_even == ((inside.v < r.v) & (inside.id % 2 == 0)).sum()


def test_few_and_many_splits_agree(skewed):
    _, sdf = skewed
    a, b = (value_ladder(sdf, ["g"], "v", splits=s).select("g", "v", "below").orderBy("g", "v").collect() for s in (1, 63))
    assert a == b


def test_expanding_quantile(skewed):
    pdf, sdf = skewed
    got = expanding_quantile(sdf, ["t"], "v", 0.9, "q", splits=15).toPandas().set_index("t")
    for t in range(12):
        past = pdf[pdf.t < t].v.dropna()
        assert got.loc[t, "n"] == len(past)
        assert (len(past) == 0 and pd.isna(got.loc[t, "q"])) or np.isclose(got.loc[t, "q"], np.quantile(past, 0.9))


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_no_task_holds_a_hot_group(spark, threshold):
    """A group of 36,000 distinct values is ordered in many intervals, also where nothing may be broadcast."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"), F.xxhash64("id").alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        lad = value_ladder(df, ["g"], "v", splits=31)
        assert lad.where("g = 'hot'").agg(F.max("below")).first()[0] == 35_999
        lines = lad._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    at = next(i for i, ln in enumerate(lines) if "Window [sum(n#" in ln)
    below = next(ln for ln in lines[at:] if "Exchange" in ln)
    assert "hashpartitioning(_g0#" in below and "_b#" in below


def test_first_rows_limits_before_the_shuffle(skewed):
    pdf, sdf = skewed
    top = first_rows(sdf, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 12

"""Stateful streams in any order of arrival, and versioned tables through a crash."""

import pytest
from pyspark.sql import functions as F

from weekgrain.keys import shared_dir
from weekgrain.sources.versions import VersionedTable, VersionTaken
from weekgrain.streaming import stateful as ST

DAY = 86_400


def arrivals(spark, rows, order):
    """The rows as ten files of ten days each, in the given order, one file per batch; the last file's rows are shared among all files."""
    root = shared_dir(spark, "in")
    for k, i in enumerate(order):
        rows.where((F.floor(F.col("id") / 80) == i) & (F.col("id") % 9 != 0) | (F.col("id") % 9 == 0) & (F.col("id") % 10 == k)).coalesce(1).write.parquet(f"{root}/{k:02d}")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(root)


@pytest.fixture(scope="module")
def rows(spark):
    ts = F.when(F.col("id") % 97 != 5, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10_800))
    return spark.range(800).select("id", ts.alias("ts"), F.when(F.col("id") % 13 != 0, F.col("id") % 4).alias("p"), F.when(F.col("id") % 6 != 0, (F.col("id") % 7).cast("double")).alias("yards")).cache()


@pytest.mark.parametrize("order", [list(range(10)), [9, 0, 8, 1, 7, 2, 6, 3, 5, 4]], ids=["in order", "mixed up"])
def test_totals_lose_no_row_and_state_stays_bounded(spark, rows, order):
    root = shared_dir(spark, "totals")
    totals = ST.windowed_totals(arrivals(spark, rows, order), "ts", DAY, "5 days", ["p"], ["yards"], buckets=2)
    table = VersionedTable(spark, f"{root}/table", "part")
    q = ST.totals_sink(totals, table, f"{root}/late", f"{root}/cp", ["window", "bucket", "p"], DAY)
    q.awaitTermination()
    assert q.exception() is None
    late = spark.read.schema(totals.drop("late").schema).parquet(f"{root}/late")
    assert late.count() > 0 and table.read().count() > 0
    got = ST.merged_totals(table.read(), late, ["p"], ["yards"])
    want = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("yards").alias("yards"))
    assert sorted(map(repr, got.select("p", "n", "yards").collect())) == sorted(map(repr, want.collect()))
    states = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
    assert len(states) == 10 and max(s["numRowsTotal"] for s in states) <= 2  # one row per bucket
    assert states[-1]["memoryUsedBytes"] < 200_000


def test_first_rows_once_in_any_order(spark, rows):
    root = shared_dir(spark, "first")
    twice = rows.unionByName(rows.where("id % 3 = 0").withColumn("id", F.col("id") + 0))
    plays = twice.withColumns({"game": F.col("id") % 50, "play": F.floor(F.col("id") / 50)})
    stream = arrivals(spark, plays, [3, 1, 4, 0, 5, 9, 2, 6, 8, 7])
    found = ST.first_rows(stream, "ts", DAY, "5 days", ["game", "play"], buckets=2)
    q = ST.rows_sink(found, f"{root}/rows", f"{root}/late", f"{root}/cp")
    q.awaitTermination()
    assert q.exception() is None
    read = lambda n: spark.read.schema(found.drop("late").schema).parquet(f"{root}/{n}")
    got = ST.merged_rows(read("rows"), read("late"), ["game", "play"]).collect()
    assert read("late").count() > 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, plays.select("game", "play").distinct().collect()))


def test_a_batch_that_died_after_its_upsert_runs_again(spark, rows):
    root = shared_dir(spark, "died")
    totals = ST.windowed_totals(arrivals(spark, rows, list(range(10))), "ts", DAY, "5 days", ["p"], ["yards"], buckets=2)
    table = VersionedTable(spark, f"{root}/table", "part")
    left = [3]

    def dies(batch_id):
        if batch_id in (1, 4) and left[0]:
            left[0] -= 1
            raise RuntimeError("died")

    for _ in range(4):
        q = ST.totals_sink(totals, table, f"{root}/late", f"{root}/cp", ["window", "bucket", "p"], DAY, after=dies)
        try:
            q.awaitTermination()
            break
        except Exception:  # noqa: BLE001
            continue
    assert left == [0] and q.exception() is None
    late = spark.read.schema(totals.drop("late").schema).parquet(f"{root}/late")
    got = ST.merged_totals(table.read(), late, ["p"], ["yards"])
    want = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("yards").alias("yards"))
    assert sorted(map(repr, got.select("p", "n", "yards").collect())) == sorted(map(repr, want.collect()))


def test_versions_stay_and_a_crash_before_the_switch_shows_nothing(spark, monkeypatch):
    table = VersionedTable(spark, shared_dir(spark, "versions"))
    assert table.version() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    base = spark.createDataFrame([(1, 2000, 1, 1.0), (2, 2000, 1, 2.0), (3, 2001, 1, 3.0), (4, None, 1, 4.0)], "player_id long, season int, week int, x double")
    keys = ["player_id", "season", "week"]
    rows = lambda v=None: sorted(map(tuple, table.read(v).select("player_id", "x").collect()))
    assert table.overwrite(base) == 1
    up = spark.createDataFrame([(1, 2000, 1, 5.0), (9, 2002, 1, 9.0)], base.schema)
    pinned = table.read()
    folders = dict(map(tuple, table.manifest()["folders"]))
    assert table.upsert(up, keys) == 2 and table.upsert(up, keys) == 3
    want = [(1, 5.0), (2, 2.0), (3, 3.0), (4, 4.0), (9, 9.0)]
    assert rows() == rows(2) == want and rows(1) == sorted(map(tuple, pinned.select("player_id", "x").collect())) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]
    assert dict(map(tuple, table.manifest()["folders"]))[2001] == folders[2001]  # untouched partitions are not written again

    switch = table._switch
    monkeypatch.setattr(table, "_switch", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        table.upsert(up.withColumn("x", F.lit(0.0)), keys)
    assert table.version() == 3 and rows() == want
    monkeypatch.setattr(table, "_switch", lambda m, v: switch(m, 3))  # another writer was first
    with pytest.raises(VersionTaken):
        table.upsert(up.withColumn("x", F.lit(0.0)), keys)
    monkeypatch.setattr(table, "_switch", switch)
    assert rows() == want
    assert table.insert_missing(spark.createDataFrame([(1, 2000, 1, 0.0), (7, 2000, 2, 7.0)], base.schema), keys) == 4 and (7, 7.0) in rows() and (1, 5.0) in rows()
    assert table.replace_up_to(spark.createDataFrame([(8, 2000, 1, 8.0), (8, 2000, 2, 0.0)], base.schema), 2000, "week", 1) == 5
    assert rows() == [(3, 3.0), (4, 4.0), (7, 7.0), (8, 8.0), (9, 9.0)]


def test_stream_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    """T02 holds its seen plays in as many buckets as the table has times BUCKET_ROWS rows."""
    import datetime

    from weekgrain.plans import q_ingest, registry  # noqa: F401

    rows = [(i % 50, i % 7, i % 5, i % 4 + 1, float(i % 50), 1.0, 0.01, 0.0, "RNA"[i % 3], "FO"[i % 2], datetime.datetime(1995, 1, 1) + datetime.timedelta(days=3 * i)) for i in range(240)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                               "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    used, real = [], ST.first_rows
    monkeypatch.setattr(ST, "BUCKET_ROWS", 20, raising=False)
    monkeypatch.setattr(ST, "first_rows", lambda *a: used.append(a[5] if len(a) > 5 else 8) or real(*a))
    got = sorted(map(tuple, registry.run("T02_unique_plays", spark, str(tmp_path)).collect()))
    assert used == [12]
    assert got == sorted({(i % 5 * 100 + i % 7, i % 50) for i in range(240)})

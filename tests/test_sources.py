"""Tables, validation, guards and streams."""

import pytest
from pyspark.sql import functions as F

from weekgrain.keys import KEYS, shared_dir, unique_on
from weekgrain.operators import filters as FL
from weekgrain.operators import joins as J
from weekgrain.sources import ingest as S
from weekgrain.streaming import jobs as T

GRAIN = KEYS.grain


def test_upsert_twice_is_upsert_once(spark, panel):
    path = shared_dir(spark, "t")
    base = panel.select(*GRAIN, "fantasy_points")
    S.overwrite_partitions(base.where("season < 2020"), path)
    up = base.where("season >= 2019 and player_id < 4").withColumn("fantasy_points", F.lit(-1.0))
    for _ in range(2):
        S.upsert_table(spark, path, up, GRAIN, shared_dir(spark, "s"))
    out = spark.read.parquet(path)
    assert out.count() == base.where("season < 2020 or player_id < 4").count() == out.select(*GRAIN).distinct().count()
    assert out.where("fantasy_points = -1").count() == up.count()


def test_season_cache_computes_only_what_is_missing(spark, panel):
    path, calls = shared_dir(spark, "c"), []

    def compute(seasons):
        calls.append(seasons)
        return panel.where(F.col("season").isin(seasons)).select(*GRAIN)

    S.cached_by_season(spark, path, [2018], compute)
    got = S.cached_by_season(spark, path, [2018, 2019], compute)
    assert calls == [[2018], [2019]] and got.count() == panel.where("season < 2020").count()
    assert "PartitionFilters: [isnotnull(season" in S.read_seasons(spark, path, [2019])._jdf.queryExecution().toString()


def test_schedule_needs_its_columns(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("season,week,home_team,away_team\n2026,1,KC,BUF\n2026,,KC,BUF\n")
    (tmp_path / "bad.csv").write_text("season,week,home_team\n2026,1,KC\n")
    r = S.read_schedule_csv(spark, str(tmp_path / "ok.csv")).collect()
    assert len(r) == 1 and r[0].venue == ""
    with pytest.raises(ValueError):
        S.read_schedule_csv(spark, str(tmp_path / "bad.csv"))


def test_strict_validation_raises(panel):
    with pytest.raises(S.InvalidTable):
        S.validate_weekly(panel.drop("team"), strict=True)
    assert S.validate_weekly(panel, strict=True).isEmpty()


def test_fingerprint_ignores_order_and_sees_content(panel):
    a = S.fingerprint(panel).first()
    assert a == S.fingerprint(panel.orderBy(F.rand(3)).repartition(3)).first()
    assert a != S.fingerprint(panel.withColumn("targets", F.col("targets") + F.when(F.col("player_id") == 3, 1).otherwise(0))).first()


def test_unique_on_takes_the_preferred_row(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, None)], "k int, p int, v string")
    assert sorted(map(tuple, unique_on(df, ["k"], [F.col("p")]).collect())) == [(1, 1, "a"), (2, 2, None)]


def test_context_week_must_be_earlier(panel):
    ok = panel.withColumn("opp_defense_week", F.col("week") - 1)
    J.assert_strictly_prior(ok)
    with pytest.raises(ValueError):
        J.assert_strictly_prior(ok.withColumn("opp_defense_week", F.col("week")))


def test_leak_rules():
    cols = ["player_id", "target_1w", "target_util_4w", "target_share", "predicted_points", "projection_4w", "baseline_x", "points_next", "sos_next_5",
            "fp_future", "utilization_score", "utilization_score_lag1", "week", "target"]
    assert FL.safe_columns(cols) == ["target_share", "sos_next_5", "utilization_score_lag1", "week"]
    with pytest.raises(ValueError):
        FL.assert_no_leaks(["week", "target_1w"])
    FL.assert_no_leaks(["week", "target_share"])


def test_stream_equals_batch_over_several_files(spark):
    root = shared_dir(spark, "plays")
    plays = spark.range(600).select((F.col("id") % 5).alias("p"), F.lit(2023).alias("season"), (F.col("id") % 3 + 1).cast("int").alias("week"), (F.col("id") % 7).cast("double").alias("yards"),
                                    (F.col("id") % 11 == 0).cast("int").alias("touchdown"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"))
    for i in range(3):
        plays.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == i).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(plays.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    run = T.running_player_weeks(stream, "p").select(F.to_date("_day.start").alias("day"), "season", "week", "player_id", "plays", "yards", "touchdowns")
    q = T.upsert_sink(run, spark, f"{root}/out", ["day", "season", "week", "player_id"], f"{root}/cp", f"{root}/st")
    q.awaitTermination()
    assert q.exception() is None
    got = spark.read.parquet(f"{root}/out").groupBy("season", "week", "player_id").agg(F.sum("plays"), F.sum("yards"), F.sum("touchdowns"))
    want = plays.groupBy("season", "week", F.col("p").alias("player_id")).agg(F.count("*"), F.sum("yards"), F.sum("touchdown"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("files,per_batch", [(1, 1), (10, 1), (10, 3)])
def test_shares_lose_nothing_in_any_order(spark, files, per_batch):
    """400 days of plays in random order over files: one file or many, one batch or many, read once or again."""
    root = shared_dir(spark, "shares")
    plays = spark.range(800).select((F.col("id") % 5).alias("p"), F.lit(2023).alias("season"), (F.col("id") % 3 + 1).cast("int").alias("week"), (F.col("id") % 7).cast("double").alias("yards"),
                                    (F.col("id") % 11 == 0).cast("int").alias("touchdown"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 43_200).alias("ts"))
    for i in range(files):
        plays.where(F.pmod(F.xxhash64("ts"), F.lit(files)) == (i * 7) % files).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = lambda: T.with_origin(spark.readStream.schema(plays.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).parquet(f"{root}/in"))
    for k in range(2):  # a lost checkpoint
        q = T.share_sink(stream(), f"{root}/out", f"{root}/cp{k}", lambda b: T.player_week_shares(b, "p"))
        q.awaitTermination()
        assert q.exception() is None
    got = T.merged_sums(spark.read.parquet(f"{root}/out"), GRAIN, ["plays", "yards", "touchdowns"])
    want = plays.groupBy("season", "week", F.col("p").alias("player_id")).agg(F.count("*").alias("plays"), F.sum("yards").alias("yards"), F.sum("touchdown").alias("touchdowns"))
    cols = [*GRAIN, "plays", "yards", "touchdowns"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_monitor_moments_merge_at_a_high_level(spark):
    rows = [(f"f{i % 3}", "2024-01-01 00:00:00", 1e8 + i % 5, 1e8 + i % 7) for i in range(90)]
    e = spark.createDataFrame(rows, "origin string, ts string, pred double, actual double").withColumn("ts", F.to_timestamp("ts"))
    got = T.merged_monitor(T.monitor_shares(e)).first()
    want = e.agg(F.stddev_pop("pred").alias("s"), F.sqrt(F.avg((F.col("actual") - F.col("pred")) ** 2)).alias("r")).first()
    assert abs(got.std_prediction - want.s) < 1e-6 and abs(got.rmse - want.r) < 1e-6


def test_last_update_of_a_key_wins(spark):
    path = shared_dir(spark, "dup")
    base = spark.createDataFrame([(1, 2000, 1, 1.0), (2, 2000, 1, 2.0)], "player_id long, season int, week int, x double")
    S.overwrite_partitions(base, path)
    up = spark.createDataFrame([(1, 2000, 1, 5.0, 1), (1, 2000, 1, 4.0, 2)], "player_id long, season int, week int, x double, at int")
    S.upsert_table(spark, path, up, GRAIN, shared_dir(spark, "s"), order="at")
    out = sorted((r.player_id, r.x) for r in spark.read.parquet(path).collect())
    assert out == [(1, 4.0), (2, 2.0)]
    assert [r.x for r in S.inserted(base, up.withColumn("player_id", F.lit(9).cast("long")), GRAIN, "at").collect()] == [4.0]


def test_first_write_that_died_is_no_table(spark, tmp_path):
    (tmp_path / "t" / "_temporary").mkdir(parents=True)
    assert not T._exists(spark, str(tmp_path / "t")) and not T._exists(spark, str(tmp_path / "none"))

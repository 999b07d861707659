"""Structured Streaming jobs for newly arriving plays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekgrain.keys import KEYS, Keys
from weekgrain.sources.ingest import overwrite_partitions, upsert_table


def running_player_weeks(plays: DataFrame, player: str, time: str = "ts", delay: str = "400 days", keys: Keys = KEYS) -> DataFrame:
    """Running sums per player-week. The event-time day is part of the key so that state can expire with the watermark."""
    return (plays.where(F.col(player).isNotNull()).withWatermark(time, delay)
            .groupBy(F.window(time, "1 day").alias("_day"), keys.season, keys.week, F.col(player).alias(keys.entity))
            .agg(F.count(F.lit(1)).alias("plays"), F.sum("yards").alias("yards"), F.sum("touchdown").alias("touchdowns")))


def with_origin(stream: DataFrame) -> DataFrame:
    """A file stream with the file that each row came from. Files reach a job whole, so a file's share of a result is known at once."""
    return stream.withColumn("origin", F.md5(F.col("_metadata.file_path")))


def share_sink(stream: DataFrame, path: str, checkpoint: str, reduce: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Writes what each file adds to a result, one partition per file.

    No state is kept in the job and nothing is ever too late: rows of any time may come in any file, in any order, in one batch or in
    many. A file that is read again, after a failure or a lost checkpoint, replaces its own share. ``reduce`` aggregates by origin and key; the
    result is the merge of all shares (:func:`merged_sums`, :func:`merged_monitor`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def player_week_shares(plays: DataFrame, player: str, keys: Keys = KEYS) -> DataFrame:
    return (plays.where(F.col(player).isNotNull()).groupBy("origin", keys.season, keys.week, F.col(player).alias(keys.entity))
            .agg(F.count(F.lit(1)).alias("plays"), F.sum("yards").alias("yards"), F.sum("touchdown").alias("touchdowns")))


def merged_sums(shares: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return shares.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def monitor_shares(events: DataFrame, time: str = "ts", pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Counts and central moments of each file's predictions per day."""
    e = F.col(actual) - F.col(pred)
    return events.groupBy("origin", F.to_date(time).cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count(pred).alias("known"), F.avg(pred).alias("mean"), F.var_pop(pred).alias("var"), F.count(e).alias("errors"), F.avg(e * e).alias("mse"))


def merged_monitor(shares: DataFrame, reference_mean: float = 0.0, reference_rmse: float = 0.0, mean_limit: float = 0.25, rmse_limit: float = 0.2) -> DataFrame:
    """Null rate, mean, spread and RMSE of predictions per day over all shares, with alert flags. Moments are merged about one share's mean."""
    pilot = shares.groupBy("day").agg(F.min("mean").alias("pilot"))
    d = F.col("mean") - F.col("pilot")
    s = shares.join(pilot, "day").groupBy("day").agg(
        F.sum("n").alias("n"), F.sum("known").alias("k"), F.min("pilot").alias("p"), F.sum(F.col("known") * d).alias("s"), F.sum(F.col("known") * (F.col("var") + d * d)).alias("q"),
        F.sum("errors").alias("m"), F.sum(F.col("errors") * F.col("mse")).alias("e"))
    shift = F.col("s") / F.col("k")
    out = s.select("day", "n", (1 - F.col("k") / F.col("n")).alias("null_rate"), (F.col("p") + shift).alias("mean_prediction"),
                   F.sqrt(F.greatest(F.col("q") / F.col("k") - shift * shift, F.lit(0.0))).alias("std_prediction"), F.sqrt(F.col("e") / F.col("m")).alias("rmse"))
    return _alerts(out, reference_mean, reference_rmse, mean_limit, rmse_limit)


def _alerts(df: DataFrame, reference_mean: float, reference_rmse: float, mean_limit: float, rmse_limit: float) -> DataFrame:
    drift = F.abs(F.col("mean_prediction") - reference_mean) / reference_mean if reference_mean else F.lit(0.0)
    worse = (F.col("rmse") - reference_rmse) / reference_rmse if reference_rmse else F.lit(0.0)
    return df.withColumns({"mean_alert": F.coalesce((drift > mean_limit).cast("int"), F.lit(0)), "rmse_alert": F.coalesce((worse > rmse_limit).cast("int"), F.lit(0))})


def upsert_sink(stream: DataFrame, spark: SparkSession, table: str, keys: Sequence[str], checkpoint: str, staging: str,
                partition: str = "season", mode: str = "update") -> StreamingQuery:
    """Writes every micro-batch into a partitioned table by key.

    A batch that is run again after a failure rewrites the same keys from its own staging folder,
    so the table ends the same.
    """
    first = {"pending": True}

    def write(batch: DataFrame, batch_id: int) -> None:
        place = f"{staging}/batch-{batch_id}"
        if first["pending"] and not _exists(spark, table):
            overwrite_partitions(batch, table, partition)
        else:
            upsert_table(spark, table, batch, keys, place, partition)
        first["pending"] = False

    return (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _exists(spark: SparkSession, table: str) -> bool:
    """Whether the table holds data files; a first write that died may have left an empty folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/*/*.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def completed_windows(events: DataFrame, time: str, width: str, delay: str, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Windows that can no longer change; rows later than the delay are dropped by the watermark."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by)
    return grouped.agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("window_start"), *by, *aggs)


def repair_windows(written: DataFrame, full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows of a batch recount that are missing from, or differ from, what the stream wrote."""
    values = [c for c in full.columns if c not in keys]
    old = written.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values])
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return full.join(old, list(keys), "left").where(~same).select(*full.columns)

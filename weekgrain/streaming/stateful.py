"""Streams that keep state for open windows only, and lose no row that comes later.

Event time is cut into windows. While a window is open its totals (or the keys it has seen) are state, held per bucket; a bucket releases what the
watermark has passed whenever it gets rows. Rows that come for a closed window are handed out as late shares, into a side table that readers merge
with the totals. So state is bounded by the windows that the delay holds open, whatever the stream holds, and any order of arrival gives the same result.

Nothing times out: an event-time timeout would drop late rows before the function sees them. Rows for totals are dealt to buckets by all their columns, so a
key with most of the rows is spread and its totals are kept per bucket; rows that are looked up by key are dealt by key. Rows without an event time belong to no
window and are late shares. Each batch is written once; its totals are upserted by key, its late shares replace those of the same batch, so a batch that
runs again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weekgrain.sources.versions import VersionedTable

PARTS = 64  # windows in one partition of a table
BUCKET_ROWS = 100_000  # rows of a stream's expected input in one bucket, about


def buckets_for(rows: int) -> int:
    """How many buckets to hold state in. A bucket's state and the rows that it gets in a batch are in memory at once, so buckets grow in number and not in size.

    The number belongs to a stream's checkpoint: one that goes on from a checkpoint keeps its number.
    """
    return max(8, -(-rows // BUCKET_ROWS))


def _bytes(frame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _frame(raw: bytes):
    return pa.ipc.open_stream(raw).read_all().to_pandas(integer_object_nulls=True)


def _windowed(stream: DataFrame, time: str, width: int, delay: str, by: Sequence[str], more: Sequence, bucket) -> DataFrame:
    """The event time (with its watermark), the start of its window in seconds, and a bucket."""
    start = (F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / F.lit(width)) * width).cast("long")
    return stream.withWatermark(time, delay).select(F.col(time), start.alias("window"), bucket.cast("int").alias("bucket"), *by, *more)


def _typed(frame, schema: T.StructType):
    """Whole numbers that may be null keep their type."""
    for f in schema:
        if isinstance(f.dataType, T.IntegralType):
            frame[f.name] = frame[f.name].astype("Int64")
    return frame[[f.name for f in schema]]


def _open(frame, width: int, state: GroupState):
    """Rows whose window the watermark has not passed."""
    return (frame["window"].notna() & ((frame["window"].fillna(0).astype("int64") + width) * 1000 > state.getCurrentWatermarkMs())).to_numpy(bool)


def windowed_totals(stream: DataFrame, time: str, width: int, delay: str, by: Sequence[str], sums: Sequence[str], buckets: int = 8) -> DataFrame:
    """Per (window, bucket, by): n and the sums, again in each batch that changes them (``late`` false); or a batch's late share (``late`` true)."""
    by, sums = list(by), list(sums)
    names, values = ["window", *by], ["n", *sums]
    fields = [T.StructField("window", T.LongType()), T.StructField("bucket", T.IntegerType()), *(stream.schema[c] for c in by), T.StructField("n", T.LongType())]
    out = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in sums), T.StructField("late", T.BooleanType())])

    def add(key, batches, state: GroupState):
        import pandas as pd

        summed = lambda frames: pd.concat(frames, ignore_index=True).groupby(names, dropna=False, sort=False)[values].sum(min_count=1).reset_index()
        added = None
        for rows in batches:
            part = summed([rows.assign(n=1)])
            added = part if added is None else summed([added, part])
        still = _open(added, width, state)
        late, fresh = added[~still], added[still]
        held = _frame(state.get[0]) if state.exists else added.iloc[:0]
        held = held[_open(held, width, state)]
        both = summed([held, fresh]) if len(held) or len(fresh) else held
        state.update((_bytes(both[[*names, *values]]),))
        changed = both.merge(fresh[names], on=names, how="inner") if len(fresh) else fresh
        for rows, flag in ((changed, False), (late, True)):
            if len(rows):
                yield _typed(rows.assign(bucket=key[0], late=flag), out)

    doubles = [F.col(c).cast("double").alias(c) for c in sums]
    keyed = _windowed(stream, time, width, delay, by, doubles, F.pmod(F.xxhash64(*stream.columns), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(add, out, "totals binary", "update", GroupStateTimeout.NoTimeout)


def first_rows(stream: DataFrame, time: str, width: int, delay: str, by: Sequence[str], buckets: int = 8) -> DataFrame:
    """(window, by) of keys that their open window has not seen before (``late`` false), or that came for a closed one (``late`` true, perhaps seen before)."""
    by = list(by)
    names = ["window", *by]
    out = T.StructType([T.StructField("window", T.LongType()), *(stream.schema[c] for c in by), T.StructField("late", T.BooleanType())])

    def fresh(key, batches, state: GroupState):
        import pandas as pd

        rows = pd.concat([b[names].drop_duplicates() for b in batches], ignore_index=True).drop_duplicates(ignore_index=True)
        still = _open(rows, width, state)
        late, new = rows[~still], rows[still]
        held = _frame(state.get[0]) if state.exists else rows.iloc[:0]
        held = held[_open(held, width, state)]
        if len(held) and len(new):
            new = new[(new.merge(held, on=names, how="left", indicator=True)["_merge"] == "left_only").to_numpy()]
        state.update((_bytes(pd.concat([held, new], ignore_index=True) if len(held) else new),))
        for found, flag in ((new, False), (late, True)):
            if len(found):
                yield _typed(found.assign(late=flag), out)

    keyed = _windowed(stream, time, width, delay, by, [], F.pmod(F.xxhash64(*by), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(fresh, out, "seen binary", "update", GroupStateTimeout.NoTimeout)


def in_parts(rows: DataFrame, width: int) -> DataFrame:
    """Adds the partition of a window."""
    return rows.withColumn("part", F.floor(F.col("window") / F.lit(width * PARTS)).cast("int"))


def totals_sink(totals: DataFrame, table: VersionedTable, late: str, checkpoint: str, keys: Sequence[str], width: int, after=None) -> StreamingQuery:
    """Upserts the totals of each batch into ``table`` (partitioned by ``part``) and writes its late shares to ``late``. ``after(batch_id)`` runs last, for tests."""
    spark = totals.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        place = f"{checkpoint}-batches/{batch_id}"
        batch.write.mode("overwrite").parquet(place)  # the state is read once
        rows = spark.read.schema(batch.schema).parquet(place)
        rows.where("late").drop("late").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        table.upsert(in_parts(rows.where("not late").drop("late"), width), list(keys))
        if after:
            after(batch_id)

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_sink(rows: DataFrame, path: str, late: str, checkpoint: str) -> StreamingQuery:
    """Writes the new rows of each batch to ``path`` and late ones to ``late``."""
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        place = f"{checkpoint}-batches/{batch_id}"
        batch.write.mode("overwrite").parquet(place)
        found = spark.read.schema(batch.schema).parquet(place)
        for cond, to in (("late", late), ("not late", path)):
            found.where(cond).drop("late").write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_totals(totals: DataFrame, late: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """n and sums per ``by`` over windows, of what the stream totalled and what came late."""
    cols = [*by, "n", *sums]
    return totals.select(cols).unionByName(late.select(cols)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", *sums)])


def repaired(totals: DataFrame, late: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """New totals of the keys that late rows touched: what the stream totalled and the late shares; other keys are not among the result."""
    touched = late.select(*keys).distinct()
    return merged_totals(totals.join(touched, list(keys), "left_semi"), late, keys, sums)


def merged_rows(rows: DataFrame, late: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every key once: rows that open windows saw first, and late ones that their window had not seen."""
    cols = ["window", *by]
    main = rows.select(cols)
    unseen = late.select(cols).distinct()
    same = [unseen[c].eqNullSafe(main[c]) for c in cols]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return main.select(*by).unionByName(unseen.join(main, cond, "left_anti").select(*by))

"""Shared pieces: tables, written intermediate results, and byte-level arithmetic over blocks of texts.

Byte-level work runs inside Arrow batches that Spark partitions and shuffles. Texts of a batch are taken in
blocks of about ``BLOCK`` bytes, so memory does not depend on how many rows a batch holds; a single text that is
longer than a block forms a block alone.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.keys import shared_dir

BLOCK = 1 << 19
# Odd multiplier of the polynomial hash mod 2^64 and its inverse; a seeded table spreads byte values first.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a fresh folder beside the session's checkpoints and reads it back: a cut that survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs inside hand whole texts to Python a thousand rows at a time, which holds less in the executor and in its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


PART_ROWS = 100_000


def few_parts(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in about three parts a core, without a shuffle; with ``rows`` (about as many as it has) in one for each ``PART_ROWS`` of them, if that is fewer. Hadoop starts
    several processes for each file that it writes to a local folder (permissions of the file and of its checksum), and while one starts it holds the memory of the executor
    a second time; many small files also cost each reader."""
    most = max(16, 3 * df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(most if rows is None else min(most, max(1, -(-rows // PART_ROWS))))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 2 * BLOCK), np.uint64)
        out[0] = 1
        done = 1
        while done < len(out):
            k = min(done, len(out) - done)
            out[done:done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
        if n > 8 * BLOCK:  # one very long text: do not keep its table for the life of the worker
            return out
        _POWERS[base] = have = out
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose low and high bits all depend on every input bit."""
    y = x >> np.uint64(32)
    y ^= x
    y *= np.uint64(0xD6E8FEB86659FD93)
    y ^= y >> np.uint64(29)
    y *= np.uint64(0xA0761D6478BD642F)
    y ^= y >> np.uint64(32)
    return y


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] the sum of the first i spread bytes times BASE^position (mod 2^64); spans come from :func:`span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SPREAD[data] * powers(len(data))[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end); equal spans have equal hashes wherever they stand."""
    n = len(prefix)
    return mixed((prefix[end] - prefix[start]) * powers(n, INVERSE)[start] + (end - start).astype(np.uint64))


def strings(column) -> pa.Array:
    """A text column of a batch as an array of strings without nulls (a null text counts as empty)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(a.type):
        a = a.cast(pa.large_string())
    return pc.fill_null(a, "") if a.null_count else a


def text_blocks(column, limit: int = BLOCK):
    """Yields (first row, end row, bytes of these rows joined, row borders) for consecutive rows of about ``limit`` bytes."""
    a = strings(column)
    if len(a) == 0:
        return
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(a):
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(len(a), max(end, row + 1))
        yield row, end, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


def text_list(column) -> list[str]:
    return strings(column).to_pylist()


_WORDS_KEPT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def letters_and_digits(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return raw.translate(_WORDS_KEPT).split()


def lowered(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(_LOWERED, np.uint8)[data]


def word_spans(data: np.ndarray, borders: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-separator bytes inside each text of a block, and each run's row."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~separator[data]
    start_at = np.flatnonzero(solid[1:-1] & ~solid[:-2])
    # a text border inside a run splits it
    inner = borders[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[solid[inner + 1] & solid[inner]]
    end_at = np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    if len(cut):
        cut = np.unique(cut)
        start_at = np.sort(np.concatenate([start_at, cut]))
        end_at = np.sort(np.concatenate([end_at, cut]))
    rows = np.searchsorted(borders, start_at, side="right") - 1
    return start_at, end_at, rows


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


MEMBER_BITS = 1 << 23
_CHUNK_BITS = 1 << 15  # of one bitmap of the built-in functions


def _slot(column: str):
    slot = F.pmod(F.xxhash64(column), F.lit(MEMBER_BITS)).cast("int")
    return F.shiftright(slot, 15), slot.bitwiseAND(_CHUNK_BITS - 1)


def member_bits(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """A bit map of MEMBER_BITS hashed ids in 256 rows, of one size (1 MB) whatever the number of ids.

    It keeps rows that surely have no partner out of a shuffle; those that pass by chance find none in the join that follows.
    """
    chunk, bit = _slot(column)
    return stored(ids.groupBy(chunk.alias("_chunk")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("_bits")).coalesce(4), "members")


def member_flag(df: DataFrame, bits: DataFrame, name: str, column: str = "doc_id") -> DataFrame:
    """Adds whether a row's id may be among the ids of :func:`member_bits`; false means that it surely is not."""
    chunk, bit = _slot(column)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.expr("1 << (_bit & 7)").bitwiseAND(F.col("_byte")) != 0, F.lit(False))
    with_bits = df.withColumn("_chunk", chunk).join(F.broadcast(bits), "_chunk", "left")
    return with_bits.withColumns({"_bit": bit, "_byte": byte}).withColumn(name, found).select(*df.columns, name)


def may_be_member(df: DataFrame, bits: DataFrame, column: str = "doc_id", keep: bool = True) -> DataFrame:
    """Rows whose id may be (or, with ``keep`` false, surely is not) among the ids of :func:`member_bits`."""
    return member_flag(df, bits, "_member", column).where("_member" if keep else "not _member").select(df.columns)


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids``; only rows that may be in it are shuffled."""
    bits = member_bits(ids, column)
    maybe = may_be_member(docs, bits, column).join(ids.select(column).distinct(), column, "left_anti").select(docs.columns)
    return may_be_member(docs, bits, column, keep=False).unionByName(maybe)

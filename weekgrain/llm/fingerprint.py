"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays over the bytes of a text, one for each of two primes of 31 bits and its seeded base, give the hash of any span in constant
time, so equality of spans is one comparison and the longest common extension of two positions is a binary search. Unequal spans of n bytes have
equal hashes for at most n of the bases of a prime. (Modulo a power of two there are strings that no base tells apart.) The fingerprint slides spans of
``SPAN`` bytes over the text and keeps, for each of ``BINS`` classes of hashes, the least one (a minimum per bin; empty bins borrow from
a neighbour chosen by their number). The share of equal bins estimates the share of spans that two texts have in common.
Texts shorter than a span are one span; all empty texts have one fingerprint. Equal texts have equal fingerprints.

:func:`fingerprints` also compares each text with an edited one: its last quarter replaced by the beginning of the next text in
order of doc_id. Texts are range-partitioned by doc_id, so the next text is the next row; only the last text of each partition
waits for the first of the following one, and these few rows are completed in a second, small step.

Null texts count as empty. Rows that share a doc_id are ordered by their text's hash, equal rows by nothing. An empty table gives an
empty result; a single text is followed by itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import BLOCK, INVERSE, mixed, powers, prefix_hash, span_hash, stored, text_list

SPAN = 24
BINS = 64
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = tuple(int(b) for b in np.random.default_rng(97).integers(1 << 20, 1 << 30, 2))
_PRIME_POWERS = np.ones((2, 0), np.uint64)
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "n_common_prefix long, n_common_suffix long")
WORK = RESULT + ", part int, kind int, text string"


def raw_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _prime_powers(n: int) -> np.ndarray:
    """BASES^0 .. BASES^(n-1) for each prime; kept for texts of up to a block."""
    global _PRIME_POWERS
    if _PRIME_POWERS.shape[1] < n:
        out = np.ones((2, max(n, BLOCK)), np.uint64)
        for row, base, prime in zip(out, BASES, PRIMES):
            done = 1
            while done < len(row):
                k = min(done, len(row) - done)
                row[done:done + k] = row[:k] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
                done += k
        if n > 8 * BLOCK:
            return out
        _PRIME_POWERS = out
    return _PRIME_POWERS


def prefix_arrays(data: np.ndarray) -> np.ndarray:
    """For each prime: S[i], the sum of the first i bytes (plus one) times base^position."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    own = data.astype(np.uint64) + np.uint64(1)
    for row, power, prime in zip(out, _prime_powers(len(data)), PRIMES):
        row[1:] = np.cumsum(own * power[:len(data)] % np.uint64(prime)) % np.uint64(prime)
    return out


def equal_spans(a: np.ndarray, i: int, b: np.ndarray, j: int, n: int) -> bool:
    """Whether bytes [i, i+n) of the text with prefix arrays ``a`` equal [j, j+n) of that with ``b``."""
    for x, y, base, prime in zip(a, b, BASES, PRIMES):
        if ((int(x[i + n]) - int(x[i])) * pow(base, j, prime) - (int(y[j + n]) - int(y[j])) * pow(base, i, prime)) % prime:
            return False
    return True


def common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many bytes from i in one text and j in the other are equal: binary search over prefix hashes."""
    low, high = 0, min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal_spans(a, i, b, j, mid) else (low, mid - 1)
    return low


def common_suffix(a: np.ndarray, b: np.ndarray) -> int:
    low, high = 0, min(a.shape[1], b.shape[1]) - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal_spans(a, a.shape[1] - 1 - mid, b, b.shape[1] - 1 - mid, mid) else (low, mid - 1)
    return low


def sketch(prefix: np.ndarray, span: int = SPAN, bins: int = BINS) -> np.ndarray:
    """``bins`` 16-bit values: the least span hash of each class of hashes."""
    n = len(prefix) - 1
    if n < span:
        h = span_hash(prefix, np.array([0]), np.array([n]))
    else:
        # long texts in stretches, so that memory does not grow with them
        least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
        back = powers(n, INVERSE)
        for i in range(0, n - span + 1, BLOCK):
            j = min(i + BLOCK, n - span + 1)
            h = mixed((prefix[i + span:j + span] - prefix[i:j]) * back[i:j])
            np.minimum.at(least, (h & np.uint64(bins - 1)).astype(np.int64), h >> np.uint64(6))
        return _filled(least, bins)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h & np.uint64(bins - 1)).astype(np.int64), h >> np.uint64(6))
    return _filled(least, bins)


def _filled(least: np.ndarray, bins: int) -> np.ndarray:
    empty = least == np.iinfo(np.uint64).max
    if empty.any():
        # an empty bin looks at other bins in an order that depends only on its number
        taken = np.flatnonzero(~empty)
        for b in np.flatnonzero(empty).tolist():
            k, step = b, 0
            while empty[k]:
                step += 1
                k = int(mixed(np.array([b * 1009 + step], np.uint64))[0] % np.uint64(bins)) if step < 8 * bins else int(taken[b % len(taken)])
            least[b] = mixed(least[k:k + 1] + np.uint64(step))[0] >> np.uint64(6)
    return (least & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


class Printed:
    """A text with its prefix arrays and fingerprint."""

    def __init__(self, text: str):
        self.text = text
        data = raw_bytes(text)
        self.prefix = prefix_arrays(data)
        self.sketch = sketch(prefix_hash(data))


def compared(doc_id, a: Printed, b: Printed) -> tuple:
    """The result row of text ``a`` whose next text is ``b``."""
    e = Printed(edited(a.text, b.text))
    return (doc_id, len(a.text), hashlib.sha256(e.text.encode()).hexdigest(), a.sketch.tobytes().hex(), e.sketch.tobytes().hex(), likeness(a.sketch, e.sketch),
            likeness(a.sketch, b.sketch), common_extension(a.prefix, 0, e.prefix, 0), common_suffix(a.prefix, e.prefix))


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
NAMES = [c.split()[0] for c in WORK.split(", ")]


def _batch(rows):
    cols = list(zip(*rows)) if rows else [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS)], NAMES)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def walk(batches):
        part, last, blank = TaskContext.get().partitionId(), None, (None,) * 8
        for b in batches:
            rows = []
            for d, s in zip(b.column(0).to_pylist(), text_list(b.column(1))):
                here = Printed(s)
                if last is None:
                    rows.append((d, *blank, part, 1, s))  # the first of a partition: the next of some other's last
                else:
                    rows.append((*compared(last[0], last[1], here), part, 0, None))
                last = (d, here)
            yield _batch(rows)
        if last is not None:
            yield _batch([(last[0], *blank, part, 2, last[1].text)])

    work = stored(ordered.mapInArrow(walk, WORK), "fingerprints")
    names = RESULT.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    done = work.where("kind = 0").select(names)
    # which partition follows which: one row per partition
    order = sorted(r["part"] for r in work.where("kind = 1").select("part").collect())
    follow = spark.createDataFrame(list(zip(order, order[1:] + order[:1])), "part int, follows int")
    lasts = work.where("kind = 2").select("doc_id", "text", "part").join(follow, "part")
    firsts = work.where("kind = 1").select(F.col("part").alias("follows"), F.col("text").alias("next"))

    def finish(batches):
        for b in batches:
            yield _batch([(*compared(d, Printed(s), Printed(t)), None, None, None) for d, s, t in zip(b.column(0).to_pylist(), text_list(b.column(1)), text_list(b.column(2)))])

    rest = lasts.join(firsts, "follows").select("doc_id", "text", "next").mapInArrow(finish, WORK).select(names)
    return done.unionByName(rest)

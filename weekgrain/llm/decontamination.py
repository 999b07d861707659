"""Benchmark decontamination by greedy string tiling.

Benchmark items are token sequences. Shared runs of ``LEAST`` tokens are seeds: every text's runs are looked up among the items' runs,
and only stretches of a text that seeds cover are compared with the item. There, running Karp-Rabin matching finds the longest
common runs, marks them in both sequences so that no token is used twice, and goes on to shorter ones down to ``LEAST``. The share of an item's
tokens that lie under marks is its coverage by the text; order does not matter, so passages whose parts were moved around
are found as well. A text is contaminated if it covers an item by ``threshold`` or more.

Tokens are runs of a-z, 0-9 and non-ASCII bytes, A-Z lower-cased, as 64-bit hashes. Items with fewer than ``LEAST`` tokens are too short
to tell and are not tested; null items are skipped. The benchmark is a stated query set: it is taken in blocks of at most
``BLOCK_CHARS`` characters, each sent to the tasks and held against all texts; texts are never shuffled. Null and empty texts are clean. Repeated
rows are judged alike; other columns are kept, input columns with the names of result columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrain.llm.common import _WORDS_KEPT, lowered, mixed, prefix_hash, span_hash, text_blocks, word_spans

LEAST = 5
BLOCK_CHARS = 8 << 20
NOT_WORD = np.frombuffer(_WORDS_KEPT, np.uint8) == 0x20
_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(LEAST)]
_PRIME, _RADIX = (1 << 61) - 1, 1_000_003
ADDED = [T.StructField("contaminated", T.BooleanType()), T.StructField("coverage", T.DoubleType()), T.StructField("item_id", T.LongType()),
         T.StructField("item_ids", T.ArrayType(T.LongType()))]


def tokens(column):
    """Yields (first row, row of each token, hash of each token) per block of texts."""
    for row, end, data, borders in text_blocks(column):
        low = lowered(data)
        a, b, rows = word_spans(low, borders, NOT_WORD)
        yield row, end - row, rows, span_hash(prefix_hash(low), a, b)


def runs(hashes: np.ndarray) -> np.ndarray:
    """One hash for each run of LEAST consecutive tokens."""
    out = np.zeros(max(len(hashes) - LEAST + 1, 0), np.uint64)
    for k in range(LEAST):
        out += hashes[k:k + len(out)] * _STEP[k]
    return mixed(out)


def _windows(seq: list[int], marked: list[bool], size: int):
    """(start, rolling hash) of every window of unmarked tokens."""
    drop = pow(_RADIX, size, _PRIME)
    run, h = 0, 0
    for i, x in enumerate(seq):
        if marked[i]:
            run, h = 0, 0
            continue
        h = (h * _RADIX + x) % _PRIME
        run += 1
        if run > size:
            h = (h - seq[i - size] * drop) % _PRIME
        if run >= size:
            yield i - size + 1, h


def tiles(text: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length), longest first, no token used twice."""
    used_t, used_i = [False] * len(text), [False] * len(item)
    found = []
    size = max(least, min(len(text), len(item), 4 * least))
    while True:
        index: dict[int, list[int]] = {}
        for j, h in _windows(item, used_i, size):
            index.setdefault(h, []).append(j)
        matches, longest = [], 0
        for i, h in _windows(text, used_t, size):
            for j in index.get(h, ()):
                if i and j and text[i - 1] == item[j - 1] and not used_t[i - 1] and not used_i[j - 1]:
                    continue  # part of a match that starts further left
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and not used_t[i + k] and not used_i[j + k]:
                    k += 1
                if k >= size:
                    matches.append((k, i, j))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        before = len(found)
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(used_t[i:i + k]) and not any(used_i[j:j + k]):
                used_t[i:i + k] = [True] * k
                used_i[j:j + k] = [True] * k
                found.append((i, j, k))
        if size == least and len(found) == before or all(used_i):
            return found  # otherwise what longer tiles cut off is searched again
        size = max(least, size // 2)


def coverage(text: list[int], item: list[int], least: int = LEAST) -> float:
    return sum(k for _, _, k in tiles(text, item, least)) / len(item) if item else 0.0


class Items:
    """A block of benchmark items with its seed index."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.tokens: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
        self.ids = ids
        for row, n, rows, h in tokens(pa.array(texts, pa.large_string())):
            cuts = np.searchsorted(rows, np.arange(n + 1))
            for i in range(n):
                self.tokens[row + i] = h[cuts[i]:cuts[i + 1]]
        seeds = [runs(t) for t in self.tokens]
        flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in seeds])
        order = np.lexsort((owner, flat))
        self.flat, self.owner = flat[order], owner[order]
        self.seeds = np.unique(flat)

    def judged(self, column) -> dict[int, dict[int, float]]:
        """For each row with a seed: coverage of every item that shares one with it."""
        out: dict[int, dict[int, float]] = {}
        if len(self.seeds) == 0:
            return out
        for row, _, rows, h in tokens(column):
            grams = runs(h)
            at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
            hit = np.flatnonzero((self.seeds[at] == grams) & (rows[:len(grams)] == rows[LEAST - 1:]))
            if len(hit) == 0:
                continue
            for i in np.unique(rows[hit]):
                mine = hit[rows[hit] == i]
                first, last = np.searchsorted(self.flat, grams[mine], "left"), np.searchsorted(self.flat, grams[mine], "right")
                by_item: dict[int, list[int]] = {}
                for place, a, b in zip(mine.tolist(), first.tolist(), last.tolist()):
                    for item in set(self.owner[a:b].tolist()):
                        by_item.setdefault(item, []).append(place)
                for item, places in by_item.items():
                    out.setdefault(row + int(i), {})[self.ids[item]] = max(out.get(row + int(i), {}).get(self.ids[item], 0.0), self.cover(h, np.array(places), item))
        return out

    def cover(self, h: np.ndarray, places: np.ndarray, item: int) -> float:
        """Tiles the stretches of a text that seeds of one item cover; a value no token has stands between stretches."""
        piece = np.unique((places[:, None] + np.arange(LEAST)).reshape(-1))
        words = [int(x) % _PRIME for x in h[piece]]
        text = []
        for k, w in enumerate(words):
            if k and piece[k] != piece[k - 1] + 1:
                text.append(-k)
            text.append(w)
        return coverage(text, [int(x) % _PRIME for x in self.tokens[item]])


def _null_last(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def judged(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """Adds contaminated, coverage (largest of all items), item_id (that item, the least of equals) and item_ids (all at the threshold, ascending).

    ``benchmark``: item_id, text. Items without an id are tested like others and come after them in order; items of one id count as one, by the larger coverage.
    """
    kept = [c for c in docs.columns if c not in {f.name for f in ADDED}]
    out = docs.select(kept)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // BLOCK_CHARS))
    fields = list(out.schema.fields)
    at = kept.index(text)
    out = out.withColumns({f.name: F.lit(False if f.name == "contaminated" else 0.0 if f.name == "coverage" else None).cast(f.dataType) for f in ADDED})
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()  # one block of the query set
        block = Items([r["item_id"] for r in rows], [r["text"] for r in rows])

        def run(batches, block=block):
            for b in batches:
                cols = [b.column(i) for i in range(len(kept) + 4)]
                best, item, all_ids = (cols[len(kept) + i].to_pylist() for i in (1, 2, 3))
                for row, found in block.judged(b.column(at)).items():
                    for i, c in sorted(found.items(), key=lambda f: _null_last(f[0])):
                        if c > best[row] or (c == best[row] and c > 0 and _null_last(i) < _null_last(item[row])):
                            best[row], item[row] = c, i
                        if c >= threshold:
                            all_ids[row] = sorted({*(all_ids[row] or []), i}, key=_null_last)
                yield pa.RecordBatch.from_arrays([*cols[:len(kept)], pa.array([c >= threshold for c in best], pa.bool_()), pa.array(best, pa.float64()), pa.array(item, pa.int64()),
                                                  pa.array(all_ids, pa.list_(pa.int64()))], [*kept, *(f.name for f in ADDED)])

        out = out.mapInArrow(run, T.StructType([*fields, *ADDED]))
    return out

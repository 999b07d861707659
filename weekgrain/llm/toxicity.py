"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and texts whose class is not looked at (U). With the class prior pi, the risk of a
scorer is ``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))``: the unlabelled risk is corrected by the share of toxic texts in it, and a
negative remainder, which only overfitting can cause, is pushed back instead of followed. A few linear numpy classifiers, each on
its own shuffle of the data, are averaged; then one slope and offset turn their mean into a probability on labelled
training rows.

Features are words (runs of a-z, 0-9 and non-ASCII bytes, A-Z lower-cased) and their beginnings of 4 to 7 bytes as 64-bit hashes, each
at two levels (it occurs; it occurs three times), with weights that can only speak for toxicity, and classes of length. The fit uses
a bounded sample chosen by the hash of doc_id: at most ``max_labelled`` labelled rows and about ``max_unlabelled`` others. Word counts of
that sample pick at most ``max_words`` words whose texts are toxic by a share of ``least_share`` or more; only these reach the driver. Scoring reads all rows
in one pass without a shuffle.

Labels come only from rows outside the held-out fold (``crc32(doc_id as text) mod 4 == 2``). A label row with a null class counts as none;
of several for one doc_id the toxic one counts. Without any positive or any negative label every text gets the score of the prior. Null
texts count as empty, and empty texts get the score of a text without known words. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import _WORDS_KEPT, lowered, prefix_hash, span_hash, stored, text_blocks, word_spans

NOT_WORD = np.frombuffer(_WORDS_KEPT, np.uint8) == 0x20
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


STEMS = (4, 5, 6, 7)  # lengths in bytes of the beginnings of words
OFTEN = 3
LENGTHS = 20
LEVEL = 0xA5A5A5A55A5A5A5A  # tells counts of the second level apart


def word_hashes(column):
    """Yields (first row, rows of the block, words of each row, row and hash of each word and beginning of a word)."""
    for row, end, data, borders in text_blocks(column):
        low = lowered(data)
        a, b, rows = word_spans(low, borders, NOT_WORD)
        prefix = prefix_hash(low)
        hashes, owners = [span_hash(prefix, a, b)], [rows]
        for n in STEMS:
            long = b - a > n
            hashes.append(span_hash(prefix, a[long], a[long] + n) ^ np.uint64(n))
            owners.append(rows[long])
        yield row, end - row, np.bincount(rows, minlength=end - row)[:end - row], np.concatenate(owners), np.concatenate(hashes)


@dataclass
class Model:
    """``weights``: of the known hashes at both levels, then of the length classes."""

    known: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def raw(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=self.weights[cols], minlength=n)[:n] + self.bias

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -35, 35)))


def entries(known: np.ndarray, n: int, words: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set entries (row, column) of the feature matrix of a block."""
    size = np.minimum(np.log2(1 + words).astype(np.int64), LENGTHS - 1) + 2 * len(known)
    r, c = [np.arange(n)], [size]
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        key, count = np.unique(rows[hit].astype(np.int64) * len(known) + at[hit], return_counts=True)
        often = key[count >= OFTEN]
        r += [key // len(known), often // len(known)]
        c += [key % len(known), often % len(known) + len(known)]
    r, c = np.concatenate(r), np.concatenate(c)
    order = np.argsort(r, kind="stable")
    return r[order], c[order]


def nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, width: int, prior: float, seed: int, epochs: int = 80, rate: float = 0.05,
         decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier; (rows, cols) are the set entries of the 0/1 feature matrix. Logistic loss, Adam, mini-batches."""
    rng = np.random.default_rng(seed)
    n = len(positive)
    order = np.argsort(rows, kind="stable")
    cols = cols[order]
    ptr = np.searchsorted(rows[order], np.arange(n + 1))
    w, b = np.zeros(width), -1.0
    m, v, t = np.zeros(width + 1), np.zeros(width + 1), 0
    p_all, u_all = np.flatnonzero(positive), np.flatnonzero(unlabelled)
    batches = max(1, min(16, len(p_all) // 32))

    def gather(ids):
        size = ptr[ids + 1] - ptr[ids]
        owner = np.repeat(np.arange(len(ids)), size)
        at = np.repeat(ptr[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return owner, cols[at]

    def slope(ids, z, factor):
        owner, c = gather(ids)
        return np.append(np.bincount(c, weights=(factor * z)[owner], minlength=width)[:width], (factor * z).sum())

    def values(ids):
        owner, c = gather(ids)
        return np.bincount(owner, weights=w[c], minlength=len(ids))[:len(ids)] + b

    for _ in range(epochs):
        rng.shuffle(p_all)
        rng.shuffle(u_all)
        for p, u in zip(np.array_split(p_all, batches), np.array_split(u_all, batches)):
            zp, zu = values(p), values(u)
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            loss_u, loss_p = np.logaddexp(0, zu).mean(), np.logaddexp(0, zp).mean()
            negative = slope(u, su, 1 / len(u)) - prior * slope(p, sp, 1 / len(p))  # gradient of R_U(-) - pi R_P(-)
            if loss_u - prior * loss_p < 0:
                g = -negative
            else:
                g = negative + prior * slope(p, sp - 1, 1 / len(p))
            g[:width] += decay * w
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            w, b = w - move[:width], b - move[width]
            w[:-LENGTHS] = np.maximum(w[:-LENGTHS], 0)
    return w, float(b)


def calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (raw, y), by Newton steps with a small pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        g = np.array([((p - y) * raw).sum() + (a - 1), (p - y).sum() + 1e-3 * b])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * raw * raw).sum() + 1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_unlabelled: int = 8_000, max_words: int = 4_096, least_share: float = 0.5, members: int = 3) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 2)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()  # ids and classes, no texts
    y_of = {r["doc_id"]: r["toxic"] for r in chosen}
    prior = sum(y_of.values()) / len(y_of) if y_of else 0.0
    if not 0 < prior < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(LENGTHS), 0.0, 0.0, -35.0 if prior == 0 else 35.0)
    total = docs.count()
    share = min(1.0, max_unlabelled / max(total, 1))
    ids = spark.createDataFrame(list(y_of.items()), "doc_id long, y int")
    # at most max_labelled rows of two numbers
    pool = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    pool = pool.withColumn("u", (fold(F.col("doc_id")) != 2) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))))
    # of rows with equal id and text one; ids that hold many texts are thinned by the hash of both
    pool = stored(pool.where("y is not null or u").select("doc_id", "text", F.coalesce("y", F.lit(-1)).alias("y"), "u").dropDuplicates(["doc_id", "text"]), "pool")
    rows_held, bound = pool.count(), 2 * (max_labelled + max_unlabelled)
    if rows_held > bound:
        pool = pool.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) < int(bound / rows_held * (1 << 30)))

    def held_by(wanted=None):
        """Counts rows by word that they hold (and, apart, hold often); only ``wanted`` hashes if given."""

        def words(batches):
            for b in batches:
                seen = []
                for _, _, _, rows, hashes in word_hashes(b.column(0)):
                    order = np.lexsort((hashes, rows))
                    r, h = rows[order], hashes[order]
                    new = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])) if len(r) else np.zeros(0, bool)
                    at = np.flatnonzero(new)
                    often = np.diff(np.append(at, len(r))) >= OFTEN
                    seen += [h[at], h[at[often]] ^ np.uint64(LEVEL)]
                h = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
                if wanted is not None:
                    h = h[np.isin(h, wanted)]
                key, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])

        return words

    n_p = pool.where("y = 1").count()
    least = max(3, n_p // 100)
    # candidates stand in confirmed toxic texts; how common they are is counted over all rows that are not held out
    toxic = pool.where("y = 1").select("text").mapInArrow(held_by(), "h long, n long").groupBy("h").agg(F.sum("n").alias("p")).where(F.col("p") >= least)
    of_p = {r["h"]: r["p"] for r in toxic.collect()}  # words of at most the labelled texts
    wanted = np.sort(np.array(list(of_p), np.int64).view(np.uint64))
    whole = docs.where(F.coalesce(fold(F.col("doc_id")) != 2, F.lit(True)))
    n_u = max(1, whole.count())
    of_u = {r["h"]: r["n"] for r in whole.select("text").mapInArrow(held_by(wanted), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()}
    # the share of toxic texts among those that hold the word, by the prior
    held = [(h, p, of_u.get(h, 0)) for h, p in of_p.items() if prior * p / max(n_p, 1) > least_share * (of_u.get(h, 0) + 1) / n_u]
    # words that stand out: ranked by how far the count in P exceeds what U lets expect
    top = [{"h": h} for h, p, u in sorted(held, key=lambda w: (-(w[1] - n_p * w[2] / n_u) / (w[1] + 1) ** 0.5, w[0]))[:max_words]]
    chosen_hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    vocabulary = np.unique(np.concatenate([chosen_hashes, chosen_hashes ^ np.uint64(LEVEL)]))  # of each pair one is the plain hash; the other meets no word

    def features(batches):
        for b in batches:
            y, u = np.array(b.column(2)), np.array(b.column(3))
            found = [np.zeros(0, np.int32)] * b.num_rows
            for row, n, *found_in in word_hashes(b.column(1)):
                r, c = entries(vocabulary, n, *found_in)
                cuts = np.searchsorted(r, np.arange(n + 1))
                for i in range(n):
                    found[row + i] = c[cuts[i]:cuts[i + 1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(y, pa.int32()), pa.array(u, pa.bool_()), pa.array([list(map(int, f)) for f in found], pa.list_(pa.int32()))],
                                             ["doc_id", "y", "u", "f"])

    sample = sorted(pool.mapInArrow(features, "doc_id long, y int, u boolean, f array<int>").collect(), key=lambda r: (r["doc_id"], r["y"]))
    y = np.array([r["y"] for r in sample])
    u = np.array([r["u"] for r in sample])
    rows = np.repeat(np.arange(len(sample)), [len(r["f"]) for r in sample])
    cols = np.array([c for r in sample for c in r["f"]], np.int64)
    if not (y == 1).any() or not u.any():
        return Model(np.zeros(0, np.uint64), np.zeros(LENGTHS), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    fits = [nnpu(rows, cols, y == 1, u, 2 * len(vocabulary) + LENGTHS, prior, seed) for seed in range(members)]
    w, b = np.mean([f[0] for f in fits], 0), float(np.mean([f[1] for f in fits]))
    raw = np.bincount(rows, weights=w[cols], minlength=len(sample)) + b
    seen = y >= 0
    return Model(vocabulary, w, b, *calibration(raw[seen], y[seen].astype(float)))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for row, n, *found in word_hashes(b.column(1)):
                out[row:row + n] = model.score(model.raw(*entries(model.known, n, *found), n))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (fold(F.col("doc_id")) == 2).alias("held_out")).mapInArrow(run, RESULT)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    return scored(docs, fit(docs, labels, **bounds), threshold)

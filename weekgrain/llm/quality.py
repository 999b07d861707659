"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote
patterns (all texts; as many rows as there are patterns) estimates how often each labeller votes what on good and on bad
texts, and from that each text's chance of being good. Those posterior labels train a linear scorer on hashed
features: trigrams of the character classes of the text with runs joined, and the share of words that repeat the word before or
an earlier one. The scorer is fitted on a sample of at most about ``max_sample`` texts, chosen by the hash of the text; it scores all texts.

Null texts count as empty. Empty texts have nothing to vote on but their length, which votes bad. Repeated rows get equal
results. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrain.llm.common import WHITE, mixed, prefix_hash, span_hash, strings, text_blocks, word_spans

BINS = 1024
GOOD, BAD, NONE = 1, 0, 2
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_SYMBOLS = b"#$%&*|<>{}[]\\^~=_+@"


def measures(raw: bytes) -> tuple:
    """Counts on which the labellers vote."""
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    digits = len(raw) - len(raw.translate(None, b"0123456789.+-()"))
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return (n, len(set(words)), sum(map(eq, words, words[1:])), letters / max(len(raw) - digits, 1), upper / max(letters, 1), symbols / size, raw.count(b"|") / max(n, 1),
            raw.count(b"!") / max(n, 1), (raw.count(b".") + raw.count(b"?")) / max(n, 1), len(lines), len(set(lines)), size / max(n, 1))


def votes(raw: bytes) -> list[int]:
    """One vote per labeller. Labellers that look for a fault say nothing where they find none, and the other way round."""
    n, distinct, again, letters, upper, symbols, pipes, shouts, stops, lines, own_lines, length = measures(raw)
    rich = distinct / max(n, 1) ** 0.5
    return [
        BAD if symbols > 0.08 else NONE,
        BAD if letters < 0.72 and n else GOOD if letters > 0.78 else NONE,
        BAD if again > 0.2 * n and n > 5 else NONE,
        BAD if n > 20 and rich < 2.2 else GOOD if n > 20 and rich > 3.5 else NONE,
        BAD if upper > 0.4 and n > 5 else NONE,
        BAD if pipes > 0.2 and n > 5 else NONE,
        BAD if shouts > 0.25 and n > 5 else NONE,
        GOOD if n and symbols < 0.04 and upper < 0.2 and shouts < 0.1 and again <= 0.05 * n else BAD if n == 0 else NONE,
        GOOD if 0.01 < stops < 0.5 and n > 5 else BAD if n > 60 and stops == 0 else NONE,
        BAD if lines > 6 and own_lines < 0.5 * lines else NONE,
        BAD if n and (length > 14 or length < 2.2) else GOOD if 4 < length < 10 else NONE,
        BAD if n == 0 else NONE,
    ]


LABELLERS = 12


def learned(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, first: float = 0.8) -> tuple[np.ndarray, float]:
    """EM over (votes, count): log chances[labeller, vote, class] and the share of good texts. Starts from labellers that are right at ``first``."""
    v = np.array([p for p, _ in patterns]).reshape(len(patterns), LABELLERS)
    n = np.array([c for _, c in patterns], float)
    hot = np.stack([v == k for k in (BAD, GOOD, NONE)], 2).astype(float)  # pattern, labeller, vote
    said = np.where(v == GOOD, 1, np.where(v == BAD, -1, 0)).sum(1)
    q = 1 / (1 + np.exp(-np.log(first / (1 - first)) * said))
    share = 0.7
    chance = np.zeros((LABELLERS, 3, 2))
    for _ in range(rounds):
        for c, weight in enumerate((n * (1 - q), n * q)):
            got = np.einsum("p,plv->lv", weight, hot) + 0.5 * np.array([[1.5 - c, 0.5 + c, 1.0]])  # a weak belief in each vote's sense
            chance[:, :, c] = np.log(got / got.sum(1, keepdims=True))
        share = float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98))
        q_new = posterior(hot, chance, share)
        if np.abs(q_new - q).max() < 1e-7:
            break
        q = q_new
    return chance, share


def posterior(hot: np.ndarray, chance: np.ndarray, share: float) -> np.ndarray:
    good, bad = (np.einsum("plv,lv->p", hot, chance[:, :, c]) for c in (1, 0))
    return 1 / (1 + np.exp(-np.clip(good + np.log(share) - bad - np.log(1 - share), -35, 35)))


_CLASS = np.array([ord(" ") if WHITE[b] and b != 10 else ord("n") if b == 10 else ord("0") if 48 <= b <= 57 else ord("A") if 65 <= b <= 90 else ord("a") if b >= 97 and b <= 122 or b >= 128
                   else b for b in range(256)], np.uint8)


def features(column):
    """Yields (first row, matrix of hashed features) per block of texts; each row's trigram shares sum to 1."""
    for row, end, data, borders in text_blocks(column):
        n = end - row
        kind = _CLASS[data]
        first = np.zeros(len(data), bool)
        first[borders[:-1][borders[:-1] < len(data)]] = True
        keep = first.copy()
        if len(data):
            keep[0] = True
            keep[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(keep)
        owner = np.searchsorted(borders, at, side="right") - 1
        code = kind[at].astype(np.uint64)
        out = np.zeros((n, BINS), np.float32)
        if len(code) > 2:
            tri = mixed(code[:-2] | code[1:-1] << np.uint64(8) | code[2:] << np.uint64(16))
            same = owner[:-2] == owner[2:]
            cell = owner[:-2][same] * BINS + (tri[same] % np.uint64(BINS - 8)).astype(np.int64)
            out = np.bincount(cell, minlength=n * BINS).reshape(n, BINS).astype(np.float32)
        out /= np.maximum(out.sum(1, keepdims=True), 1)
        a, b, rows = word_spans(data, borders, WHITE)
        words = np.bincount(rows, minlength=n)[:n]
        if len(a):
            h = span_hash(prefix_hash(data), a, b)
            again = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
            order = np.lexsort((h, rows))
            seen = np.bincount(rows[order][1:][(h[order][1:] == h[order][:-1]) & (rows[order][1:] == rows[order][:-1])], minlength=n)[:n]
            out[:, BINS - 1] = np.bincount(rows[1:][again], minlength=n)[:n] / np.maximum(words, 1)
            out[:, BINS - 2] = (words - seen) / np.maximum(words, 1) ** 0.5 < 2.5
            out[:, BINS - 3] = np.minimum(1, 10 / np.maximum(words, 1))
        out[:, BINS - 4] = words == 0
        yield row, out


def trained(x: np.ndarray, q: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, full batches, Adam. Features are scaled by their root mean square; ``weight`` counts equal rows."""
    weight = weight / weight.sum()
    size = np.sqrt(weight @ x.astype(np.float64) ** 2).astype(np.float32) + np.float32(1e-3)
    x = x / size
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -35, 35)))
        e = ((p - q) * weight).astype(np.float32)
        g = np.append(e @ x + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate / (1 + t / 100) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w / size, float(b)


@dataclass
class Model:
    chance: np.ndarray
    share: float
    weights: np.ndarray
    bias: float


def _votes_of(column) -> list[list[int]]:
    return [votes(s.as_buffer().to_pybytes()) for s in strings(column)]


def fit(docs: DataFrame, max_sample: int = 8_000) -> Model:
    """``docs`` with a column text."""

    def tally(batches):
        for b in batches:
            keys = ["".join(map(str, v)) for v in _votes_of(b.column(0))]
            yield pa.RecordBatch.from_pydict({"votes": pa.array(keys, pa.string())})

    counted = docs.select("text").mapInArrow(tally, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(map(int, r["votes"])), r["n"]) for r in counted)
    if not patterns:
        return Model(np.zeros((LABELLERS, 3, 2)), 0.5, np.zeros(BINS), 0.0)
    chance, share = learned(patterns)
    total = sum(n for _, n in patterns)
    part = int(min(1.0, max_sample / total) * (1 << 30))
    # each distinct text once, with the number of its copies as weight: about max_sample rows at most, however often a text repeats
    sample = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < part).groupBy("text").agg(F.count("*").alias("n"))

    def rows(batches):
        for b in batches:
            v = np.array(_votes_of(b.column(0))).reshape(b.num_rows, LABELLERS)
            q = posterior(np.stack([v == k for k in (BAD, GOOD, NONE)], 2).astype(float), chance, share)
            for row, x in features(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(q[row:row + len(x)]), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), b.column(1).slice(row, len(x))], ["q", "x", "n"])

    got = sorted((r["q"], bytes(r["x"]), r["n"]) for r in sample.mapInArrow(rows, "q double, x binary, n long").collect())
    if not got:
        return Model(chance, share, np.zeros(BINS), float(np.log(share / (1 - share))))
    x = np.stack([np.frombuffer(r[1], np.float16) for r in got]).astype(np.float32)
    return Model(chance, share, *trained(x, np.array([r[0] for r in got]), np.array([r[2] for r in got], np.float64)))


def scored(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with quality (chance of being good) and keep; input columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("quality", "keep")]
    docs = docs.select(kept)
    at = kept.index(text)

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for row, x in features(b.column(at)):
                out[row:row + len(x)] = 1 / (1 + np.exp(-np.clip(x @ model.weights.astype(np.float32) + model.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array(out >= threshold)], [*kept, "quality", "keep"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality", T.DoubleType()), T.StructField("keep", T.BooleanType())]))


def classified(docs: DataFrame, threshold: float = 0.5, max_sample: int = 8_000) -> DataFrame:
    return scored(docs, fit(docs, max_sample), threshold)

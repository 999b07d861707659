"""Language model scores against a brute-force model, at several orders, block and bucket sizes, and on odd rows."""

import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from weekgrain.llm import backoff, catalog

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "The cat sat on the mat. The cat sat."), (2, "the cat SAT on\ta\nmat"), (2, "the cat SAT on\ta\nmat"), (3, None), (4, ""), (5, " \n "), (6, "never seen words here"),
    (7, "cat cat cat cat cat cat the the"), (None, "a text without an id\x0bsat\x0con the\x1cmat é漢字 É"), (8, "on the mat the cat"), (9, "sat on the mat é漢字"),
    (-4, "the end"), (10, " ".join(f"w{i % 53}" for i in range(20_000))), (11, "w1 w2 w3 w5 w4 the cat w52 w0"), (9_000_000_000, "a"), (12, "the"), (13, "on a cat"), (14, "mat the cat sat on"),
]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Model:
    """p(w | history) by its definition."""

    def __init__(self, texts, order, prior):
        self.order, self.prior, self.c = order, prior, Counter()
        for words in texts:
            seq = [" ", *words]
            for k in range(1, order + 1):
                self.c.update(tuple(seq[i:i + k]) for i in range(len(seq) - k + 1) if k > 1 or i)
        self.c[" ",] = len(texts)
        own = {g: n for g, n in self.c.items() if len(g) == 1 and g != (" ",)}
        self.n, self.v = sum(own.values()), len(own)

    def p(self, w, h):
        if not h:
            return (self.c[w,] + 0.5) / (self.n + 0.5 * (self.v + 1))
        return (self.c[(*h, w)] + self.prior * self.p(w, h[1:])) / (self.c[h] + self.prior)

    def score(self, words):
        seq = [" ", *words]
        return math.fsum(math.log10(self.p(seq[i], tuple(seq[max(0, i - self.order + 1):i]))) for i in range(1, len(seq)))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in ROWS], "doc_id long, text string, score string, block int, held_out boolean").repartition(3)


def compare(got, rows, order, prior, digits=1e-9):
    model = Model([tokens(t) for i, t in rows if not held(i)], order, prior)
    base = Model([tokens(t) for i, t in rows if not held(i)], 1, prior)
    want = sorted((repr(i), held(i), len(tokens(t)), sum(model.c[w,] > 0 for w in tokens(t)), model.n, base.score(tokens(t)), model.score(tokens(t))) for i, t in rows)
    have = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    for a, b in zip(have, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-12, abs=digits)


@pytest.mark.parametrize("order,block,grams", [(1, 1 << 20, 1 << 20), (2, 40, 64), (3, 1 << 20, 100_000), (4, 60, 5_000)])
def test_against_brute_force(odd, order, block, grams, monkeypatch):
    monkeypatch.setattr(backoff, "BUCKET_GRAMS", grams)
    compare(backoff.scored(odd, order=order, prior=1.5, block_bytes=block).collect(), ROWS, order, 1.5)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = catalog.op12_lm_scores(spark, SF).collect()
    compare(got, rows, 2, 4.0, digits=6e-7)
    # the history helps on texts that the model has not seen
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_of_a_history_sum_to_one():
    texts = [tokens(t) for i, t in ROWS if not held(i) and i != 10]
    model = Model(texts, 3, 2.0)
    words = {w for t in texts for w in t}
    for h in ((), ("the",), ("the", "cat"), (" ",), (" ", "the"), ("sat", "on"), ("never", "met")):
        assert math.fsum(model.p(w, h) for w in words) + model.p("unknown", h) == pytest.approx(1)


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(map(tuple, catalog.op12_lm_scores(spark, SF).select(names).collect()))
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({catalog.SQL['op12_lm_scores']})").fetchall())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=1e-6)


def test_empty_tables(spark, odd):
    assert backoff.scored(odd.where("false")).count() == 0
    alone = [(i, t) for i, t in ROWS if held(i)]
    assert alone
    compare(backoff.scored(odd.where(odd.doc_id.isin([i for i, _ in alone]))).collect(), alone, 2, 4.0)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_a_block_scores_its_texts_as_the_automaton_reads_them(order):
    """Each distinct n-gram is walked once; the same sums come out as token by token."""
    import numpy as np

    seqs = [[w or "" for w in tokens(t)] for _, t in ROWS]
    words = {w: k for k, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
    row = {"ids": [i for i, _ in ROWS], "held": [held(i) for i, _ in ROWS], "sizes": [len(s) for s in seqs], "words": "\n".join(words).encode(),
           "tokens": backoff._packed(np.array([words[w] for s in seqs for w in s], np.uint64))}
    x = backoff._Block(row, order)
    trained = ~np.repeat(x.held, x.sizes)
    for counts, n in ((x.count, int((~x.held).sum())), ([np.zeros_like(c) for c in x.count], 0)):
        model = backoff.Automaton(x, counts, n, int(trained.sum()) if n else 0, int((counts[0] > 0).sum()), 4.0)
        want = [model.score(x.tokens[i:j].tolist()) for i, j in zip(x.start[:-1], x.start[1:])]
        assert model.scores(x) == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("order,piece", [(1, 7), (2, 1), (2, 1 << 20), (3, 3), (4, 5)])
def test_scores_are_read_off_the_arcs(order, piece, monkeypatch):
    """Every token takes an arc, after the failure arcs on the way: with other weights on them the sums are those that a text by text reading finds."""
    import numpy as np

    monkeypatch.setattr(backoff, "PIECE", piece, raising=False)
    seqs = [[w or "" for w in tokens(t)] for _, t in ROWS]
    words = {w: k for k, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
    row = {"ids": [i for i, _ in ROWS], "held": [held(i) for i, _ in ROWS], "sizes": [len(s) for s in seqs], "words": "\n".join(words).encode(),
           "tokens": backoff._packed(np.array([words[w] for s in seqs for w in s], np.uint64))}
    x = backoff._Block(row, order)
    model = backoff.Automaton(x, x.count, int((~x.held).sum()), int(x.sizes[~x.held].sum()), int((x.count[0] > 0).sum()), 4.0)
    draw, plain = np.random.default_rng(5), model.scores(x)
    model.weight = np.asarray(model.weight) * draw.uniform(0.5, 2, len(model.weight))
    model.back = np.asarray(model.back) * np.append(1, draw.uniform(0.5, 2, len(model.back) - 1))  # state 0 has no failure arc
    want = [model.score(x.tokens[i:j].tolist()) for i, j in zip(x.start[:-1], x.start[1:])]
    assert model.scores(x) == pytest.approx(want, abs=1e-7)
    assert all(a != b for a, b in zip(plain, want))

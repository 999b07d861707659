"""The source audit against brute force over all terms, on odd rows, and by both ways of counting."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weekgrain.llm import catalog, divergence

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, ranks):
    """{(lang, source, part, item, value, rank)} with every source held against every term."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    held = Counter((lang, t) for lang, _, words in docs for t in set(words))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= min_docs:
            kept[lang].append(t)
    count = Counter((lang, source, t) for lang, source, words in docs for t in words)
    sources = defaultdict(set)
    for lang, source, _ in docs:
        sources[lang].add(source)
    out = set()
    for lang, own in sources.items():
        terms = kept[lang]

        def shares(of):
            c = {t: sum(count[lang, s, t] for s in of) for t in terms}
            below = sum(c.values()) + 2 * len(terms)
            return {t: 1 + 10**9 * (n + 2) // below for t, n in c.items()}

        p = {s: shares([s]) for s in own}
        q = shares(own)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in terms), o.encode()) for o in own if o != s))
            ups = sorted((-gap(p[s][t], q[t]), t.encode()) for t in terms if count[lang, s, t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", i.decode(), -v, k) for k, (v, i) in enumerate(ups[:ranks], 1)}
    return out


ROWS = [
    (None, None, None), ("", "en", "a"), ("one two two three é漢字", "en", "b"), ("One TWO İ three 4four", "en", "c"), ("one", "en", None), ("alone", "xx", "a"),
    ("one two", "en", "b"), ("one two", "en", "b"), ("three three three", "en", "a"), ("é漢字 z", "en", "\U0001f600"), ("one_two~x", "en", "c"), ("zwei", "de", "a"), ("zwei drei", "de", "b"),
    (" ".join(f"w{i % 31}x" for i in range(30_000)), "de", "c"), ("w x w", "de", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3) for i, (t, lang, s) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, term string, g int, p long, value long").repartition(3)


@pytest.mark.parametrize("limit", [0, 64 << 20])
@pytest.mark.parametrize("min_docs", [1, 2, 99])
def test_against_brute_force(odd, min_docs, limit, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 5)
    got = divergence.audit(odd, min_docs=min_docs, ranks=3, vocabulary_bytes=limit).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(ROWS, min_docs, 3)


def test_whole_table_both_ways(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()], 10, 10)
    assert {tuple(r) for r in catalog.op11_divergence(spark, SF).collect()} == want
    assert {tuple(r) for r in divergence.audit(docs, vocabulary_bytes=0).collect()} == want


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = catalog.op11_divergence(spark, SF)
    want = con.execute(catalog.SQL["op11_divergence"]).fetchall()
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == sorted(want)


def test_empty_table_and_types(spark, odd):
    got = divergence.audit(odd.where("false"))
    assert got.count() == 0
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_large_counts_stay_exact(spark):
    """Shares of counts whose product with the scale leaves 64 bits."""
    n = 40_000_000_000
    got = spark.range(1).select(divergence.share(F.lit(n - 7), F.lit(n), F.lit(3)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert got.p == 1 + 10**9 * (n - 5) // (n + 6) and got.none is None

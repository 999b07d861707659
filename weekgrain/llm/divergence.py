"""Source divergence audit: how far the term shares of each source lie from those of the other sources of its language.

Terms of a text are its runs of letters, A-Z lower-cased. A language keeps the terms that stand in at least ``min_docs`` of its documents, without
a cap on their number. Every document then becomes an exact sparse vector of counts over the terms kept, vectors are summed per (language, source),
and shares are compared pair by pair of sources over the terms that either source holds. The vectors are those of Spark's `CountVectorizer` fitted per
language with `minDF` and the largest `vocabSize`; texts are counted in Arrow batches instead, since that class took more than the CPU time allowed.

The vocabulary is an aggregate, so its size is known before any of it reaches the driver or is broadcast: up to ``vocabulary_bytes`` tasks look terms up
in a broadcast copy; a larger vocabulary stays in its table and meets the counted words by a shuffled join, with the same sums.

All arithmetic is on integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)). For two sources the sum of f over all V terms is
V f(p0, q0) for terms that neither holds, corrected per source by its terms (taken by distinct share, not by term), and by the terms that both hold.
The last part is summed in blocks of terms, dealt by term, so that no (language, term) lists the pairs of its sources.

Null text, language or source count as ''. Each row is a document, repeated rows too. A source without terms has count 0 for all terms; a language
that keeps none gives 0 for each pair of its sources and no terms. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain.llm.common import stored, text_list

SCALE = 1_000_000_000
TERM_BYTES = 64  # of one term in a hash map, besides its characters
BLOCK_CELLS = 1 << 16  # non-zero shares of one block of terms
BLOCK_BYTES = 16 << 20  # of text that a task counts at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def texts_of(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def _terms(text: str) -> list[bytes]:
    """Terms of a text in order, with repeats."""
    return text.encode().translate(_LETTERS).split()


def _blocks(batches):
    """Rows (lang, source, text) of consecutive documents of about BLOCK_BYTES."""
    rows, size = [], 0
    for b in batches:
        for row in zip(*(text_list(b.column(i)) for i in range(3))):
            rows.append(row)
            size += len(row[2])
            if size >= BLOCK_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _strings(values) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def kept_terms(texts: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, n_docs) of the terms that stand in at least ``min_docs`` documents of their language."""

    def held(batches):
        for rows in _blocks(batches):
            docs = defaultdict(Counter)
            for lang, _, text in rows:
                docs[lang].update(set(_terms(text)))
            for lang, n in docs.items():
                yield pa.record_batch([pa.repeat(lang, len(n)).cast(pa.string()), _strings(list(n)), pa.array(n.values(), pa.int64())], ["lang", "term", "n"])

    found = texts.mapInArrow(held, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def numbered(terms: DataFrame) -> DataFrame:
    """Adds ``i``, a number per term whose order within a language is the order of the terms by UTF-8 bytes; written, so that it stays."""
    return stored(terms.orderBy("lang", "term").withColumn("i", F.monotonically_increasing_id()), "terms")


def vector_sums(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, i, count): document vectors over a broadcast vocabulary, summed per block and then per source; for vocabularies of a checked size."""
    shared = texts.sparkSession.sparkContext.broadcast(terms.select("lang", F.col("term").cast("binary"), "i").toArrow().combine_chunks())

    def summed(batches):
        index = defaultdict(dict)
        for lang, term, i in zip(*(c.to_pylist() for c in shared.value.columns)):
            index[lang][term] = i
        for rows in _blocks(batches):
            vectors = defaultdict(list)
            for lang, source, text in rows:
                at = index[lang].get
                found = np.array([i for i in map(at, _terms(text)) if i is not None], np.int64)
                vectors[lang, source].append(np.unique(found, return_counts=True))
            for (lang, source), own in vectors.items():
                at, which = np.unique(np.concatenate([i for i, _ in own]), return_inverse=True)
                n = np.zeros(len(at), np.int64)
                np.add.at(n, which, np.concatenate([c for _, c in own]))
                names = [pa.repeat(x, len(at)).cast(pa.string()) for x in (lang, source)]
                yield pa.record_batch([*names, pa.array(at), pa.array(n)], ["lang", "source", "i", "n"])

    cells = texts.mapInArrow(summed, "lang string, source string, i long, n long")
    return cells.groupBy("lang", "source", "i").agg(F.sum("n").alias("count"))


def joined_sums(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, i, count) for vocabularies of any size: all words counted per block, then matched with the vocabulary by a join on (lang, term)."""

    def counted(batches):
        for rows in _blocks(batches):
            words = defaultdict(list)
            for lang, source, text in rows:
                words[lang, source].append(_terms(text))
            for (lang, source), own in words.items():
                n = Counter(chain.from_iterable(own))
                names = [pa.repeat(x, len(n)).cast(pa.string()) for x in (lang, source)]
                yield pa.record_batch([*names, _strings(list(n)), pa.array(n.values(), pa.int64())], ["lang", "source", "term", "n"])

    cells = texts.mapInArrow(counted, "lang string, source string, term string, n long").join(terms.select("lang", "term", "i"), ["lang", "term"])
    return cells.groupBy("lang", "source", "i").agg(F.sum("n").alias("count"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)) without overflow; null where n + 2 v is 0."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = F.nullif(n + 2 * v, F.lit(0)).cast("decimal(20,0)")
    return F.floor(F.lit(1) + F.call_function("div", top, below)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); squares stay below 2^63 as shares are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _np_gap(p, q):
    d = p - q
    return d * d // (p + q)


def _common_terms(block: pa.Table) -> pa.Table:
    """For each two sources of a block of one language's terms: what the terms that both hold change in their sum."""
    t = np.unique(block["i"].to_numpy(), return_inverse=True)[1]
    g, p, p0 = (block[c].to_numpy() for c in ("g", "p", "p0"))
    order = np.argsort(g, kind="stable")
    t, g, p, p0 = t[order], g[order], p[order], p0[order]
    ids, start = np.unique(g, return_index=True)
    end = np.append(start[1:], len(g))
    of_first = np.zeros(int(t.max()) + 1 if len(t) else 0, np.int64)
    first, second, value = [], [], []
    for k in range(len(ids) - 1):
        mine, rest = slice(start[k], end[k]), slice(end[k], None)
        of_first[t[mine]] = p[mine]
        x, a0 = of_first[t[rest]], p0[start[k]]
        of_first[t[mine]] = 0
        both = x > 0
        x, q, q0 = x[both], p[rest][both], p0[rest][both]
        change = np.zeros(len(both), np.int64)
        change[both] = _np_gap(x, q) - _np_gap(x, q0) - _np_gap(a0, q) + _np_gap(a0, q0)
        first.append(np.full(len(ids) - k - 1, ids[k]))
        second.append(ids[k + 1:])
        value.append(np.add.reduceat(change, start[k + 1:] - end[k]))
    lang = block["lang"][0]
    a, b, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second, value))
    return pa.table({"lang": pa.repeat(lang, len(a)), "g": pa.array(a, pa.int32()), "h": pa.array(b, pa.int32()), "value": pa.array(v, pa.int64())})


def audit(docs: DataFrame, min_docs: int = 10, ranks: int = 10, vocabulary_bytes: int = 32 << 20, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source of the language, ``term`` rows for the ``ranks`` terms that a source uses
    more than its language does, by f of the two shares. Ranks count from 1 by value descending, then item by UTF-8 bytes."""
    texts = texts_of(docs, text, lang, source)
    terms = numbered(kept_terms(texts, min_docs))
    size = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term") + F.octet_length("lang") + TERM_BYTES).alias("bytes")).first()
    if size["n"] and size["bytes"] <= vocabulary_bytes:
        sums = vector_sums(texts, terms)
    else:
        sums = joined_sums(texts, terms)
    sums = stored(sums, "sums")

    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"))
    totals = sums.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("held"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "held", "v")])
    groups = groups.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v"))).withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    groups = stored(groups, "groups")
    shares = sums.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    # pairs of sources
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "g", "v", "p0").join(other.drop("item"), "lang").where("g != h")
    neither = pairs.select("lang", "g", "h", F.coalesce(F.col("v") * gap(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    distinct = shares.groupBy("lang", "g", "p0", "p").agg(F.count("*").alias("n")).join(other.drop("item"), "lang").where("g != h")
    alone = distinct.groupBy("lang", "g", "h").agg(F.sum(F.col("n") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value"))
    blocks = groups.groupBy("lang").agg((F.floor(F.sum("held") / BLOCK_CELLS) + 1).alias("blocks"))
    dealt = shares.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("i"), F.col("blocks")).alias("block"), "i", "g", "p", "p0")
    both = dealt.groupBy("lang", "block").applyInArrow(_common_terms, "lang string, g int, h int, value long")
    swapped = lambda df: df.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value")
    summed = neither.unionByName(alone).unionByName(swapped(alone)).unionByName(both).unionByName(swapped(both)).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = summed.join(groups.select("lang", "source", "g"), ["lang", "g"]).join(other.select("lang", "item", "h"), ["lang", "h"])
    pair = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    # terms of a source; their names are looked up once the ranks are known, as numbers order as names do
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    beside = shares.withColumn("of_lang", F.sum("count").over(Window.partitionBy("lang", "i"))).join(whole, "lang")
    beside = beside.withColumn("q", share(F.col("of_lang"), F.col("n_lang"), F.col("v"))).where("p > q")
    top = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "i")
    term = beside.select("lang", "source", "i", gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= ranks)
    term = term.join(terms.select("lang", "i", F.col("term").alias("item")), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).unionByName(term)


def sql(min_docs: int = 10, ranks: int = 10) -> str:
    """The same rows with every source held against every term of its language."""
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    share_of = lambda c, n: f"1 + ({SCALE}::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words FROM documents),
w AS (SELECT i, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {min_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS n_source, sum(n) OVER (PARTITION BY lang) AS n_lang, sum(n) OVER (PARTITION BY lang, term) AS n_term,
             count(*) OVER (PARTITION BY lang, source)::HUGEINT AS v FROM t),
p AS (SELECT lang, source, term, n, {share_of('n', 'n_source')} AS p, {share_of('n_term', 'n_lang')} AS q FROM s),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum({f('x.p', 'y.p')}), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, {f('p', 'q')} FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= {ranks}"""

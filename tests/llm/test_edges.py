"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekgrain.llm import decontamination, fingerprint, license_scan, ngram_join, piece_sampling, quality, rans_store, repeats, toxicity, url_filter
from weekgrain.llm.catalog import tokenizer

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. All rights reserved."), (1, "The quick brown fox jumps over the lazy dog. All rights reserved."),
    (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "é漢字\U0001f600 ß  two  spaces\r\nand <|endoftext|> marker\x00\x1c."), (7, "a"), (7, "another text under the same id"),
    (None, "a text without an id, licensed under CC BY-NC 4.0"), (-9, "same words here and there"), (9_000_000_000, "same words here and there"),
]
SCHEMA = "doc_id long, text string, score string, kept int, coverage string, quality string, n_chars int, h int, path string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 5, 0, "p") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return sorted(map(repr, rows))


def test_token_store(spark, odd, none):
    path = tokenizer()
    got = rans_store.store_documents(odd, path).collect()
    assert rans_store.store_documents(none, path).count() == 0
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    want = {}
    for i, t in TEXTS:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    # starts follow the order of ids without gaps (null ids first)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, "two words"), (4, ""), (5, "never seen in any of these texts at all")], "item_id long, text string")
    got = decontamination.judged(odd, items)
    assert set(got.columns) >= {"contaminated", "coverage", "item_id", "item_ids", "score", "kept"}
    assert sorted(r.doc_id for r in got.where("contaminated").collect()) == [1, 1]
    assert got.count() == len(TEXTS)
    assert decontamination.judged(none, items).count() == 0
    assert decontamination.judged(odd, items.limit(0)).where("contaminated").count() == 0


def test_url_rules(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.COM/de/x?y#z"), (4, "HTTP://A.Example.COM/de/x?y#z"), (5, "https://example.net/en/"), (6, "x://b.net"), (7, "http://fr.org/fr/?utm_source=feed"),
            (8, "http://a.com/" + "long/" * 50_000), (None, "https://notexample.com/de/")]
    df = spark.createDataFrame([(i, u, "mine") for i, u in rows], "page_id long, url string, verdict string")
    got = {(r.page_id, r.url): r for r in url_filter.judged(df).collect()}
    at = {i: r for (i, _), r in got.items()}
    assert (at[1].host, at[1].path, at[3].host, at[3].path) == ("", "", "", "")
    assert (at[4].host, at[4].path, at[4].rule, at[4].verdict) == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert (at[5].rule, at[5].verdict) == ("example.net/en/", "allow")
    assert (at[6].host, at[6].rule) == ("b.net", None)  # an empty path does not start with /
    assert (at[7].rule, at[7].verdict) == ("org/fr/", "allow")
    assert at[None].rule is None
    assert url_filter.judged(df).count() == len(rows)
    assert url_filter.judged(df.limit(0)).count() == 0


def test_license_scan(spark, odd, none):
    got = {}
    for r in license_scan.license_scan(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.n_base, r.base_labels) for r in got[1]] == [(12, 1, "reserved")] * 2
    assert (got[None][0].base_labels, got[None][0].labels) == ("cc-by", "cc-by,cc-by-nc-4.0")
    assert (got[2][0].n_words, got[2][0].first_word, got[2][0].labels, got[2][0].score) == (0, None, "", 0.0)
    assert license_scan.license_scan(none).count() == 0


def test_ngram_join(spark, odd, none):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(odd.where("doc_id is not null")).collect())
    assert (2, 0, 2) in got and (3, 0, 3) in got and (4, 0, 4) in got
    assert (-9, 2, -9) in got and (9_000_000_000, 2, -9) in got
    assert len(got) == len(TEXTS) - 1
    assert ngram_join.similar_documents(odd).count() == len(TEXTS)
    assert ngram_join.similar_documents(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (5, 1, 0), (6, 1, None), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels)
    assert got.count() == len(TEXTS) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_repeats(spark, odd, none):
    got = {}
    for r in repeats.removed(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2] == [(0, 0, 0, empty)] and got[3] == [(0, 0, 0, empty)]
    assert got[1][0][1] == 0  # below 200 bytes
    assert repeats.removed(none).count() == 0
    twice = spark.createDataFrame([(1, "ab " * 100), (1, "ab " * 100), (2, "é" * 150), (3, "x" + "é" * 150), (4, "q" * 199)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.removed(twice).collect()}
    assert rows == {(1, 300, 300, 1), (2, 300, 300, 1), (3, 301, 300, 1), (4, 199, 0, 0)}


def test_pieces(spark, odd, none):
    model = tokenizer("piece_bpe_32k.model")
    rows = piece_sampling.sampled(odd, model, k=3).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert len({tuple(s.ids) for s in r.samples}) == r.n_samples == len(r.samples)
        assert all(s.decoded for s in r.samples)
    assert {r.doc_id: r.n_samples for r in rows}[3] == 1
    assert piece_sampling.sampled(none, model).count() == 0


def test_fingerprints(spark, odd, none):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == len(TEXTS)
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    one = fingerprint.fingerprints(odd.where("doc_id = 5")).collect()[0]
    n = len(LONG) // 4
    assert one.edited_sha256 == hashlib.sha256((LONG[:len(LONG) - n] + LONG[:n]).encode()).hexdigest() and one.near_next == 1.0
    assert fingerprint.fingerprints(none).count() == 0


def test_quality(spark, odd, none):
    got = quality.classified(odd)
    assert got.columns.count("quality") == 1 and got.count() == len(TEXTS)
    assert got.where("quality is null or quality < 0 or quality > 1").count() == 0
    assert quality.classified(none).count() == 0


def test_stages_keep_columns(spark, odd, tmp_path):
    from weekgrain.llm.stages import STAGES

    odd.sparkSession.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
        docs = spark.createDataFrame(docs.collect(), odd.schema)
    last = STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.columns == [*(c for c in docs.columns if c not in ("n_samples", "samples")), "n_samples", "samples"]
    assert counted(last.drop("n_samples", "samples").collect()) == counted(docs.drop("n_samples", "samples").collect())
    assert all(s.ids is not None and s.n_pieces == len(s.ids) for r in last.collect() for s in r.samples)
    empty = odd.where(F.lit(False))
    for _, stage in STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_one_of_each_group_keeps_clean_rows(spark):
    from weekgrain.llm.stages import one_of_each_group

    passage = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(None, "first without an id"), (None, "second without an id"), (None, passage), (5, passage), (7, passage + " more"), (7, "all of its own here"), (7, "all of its own here"),
            (8, "one text"), (8, None), (8, "quite another text"), (9, other + " end"), (4, other), (4, other + " end"), (-3, "a b c d e"), (-3, "a b c d e"), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, comp string").repartition(3)
    got = one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    kept = counted((r.doc_id, r.text) for r in got.collect())
    first = [x for x in kept if x in (repr((4, other)), repr((4, other + " end")))]
    assert len(first) == 1  # two texts of one id that link: one of them
    want = [(None, "first without an id"), (None, "second without an id"), (None, passage), (5, passage), (7, "all of its own here"), (8, "one text"), (8, None), (8, "quite another text"),
            (-3, "a b c d e"), (6, None)]
    assert kept == sorted([*map(repr, want), *first])

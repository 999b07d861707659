"""Registered queries held against brute force, exact round trips, or held-out labels, on small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weekgrain.llm import catalog, common, decontamination, fingerprint, ngram_join, piece_sampling, rans_store, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# ---------------------------------------------------------------- brute force


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def linked(texts, size, percent):
    """{id: (set size, smallest id reachable)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    both = Counter(p for ids in holders.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def repeated(texts, length):
    """{id: (n_bytes, n_removed, n_spans, remaining bytes)} from the set of all windows."""
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(x[k:k + length] for x in raw.values() for k in range(len(x) - length + 1))
    out = {}
    for i, x in raw.items():
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g))
    return out


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# ---------------------------------------------------------------- queries


def test_op1_round_trip(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(catalog.tokenizer())
    start = 0
    got = {r.doc_id: r for r in catalog.op1_token_store(spark, SF).collect()}
    for i in sorted(docs):
        ids = np.array(lib.encode(docs[i], add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op1_blocks_decode_alone_and_from_checkpoints():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 70_000), 5_000).astype(np.uint32)
    coder = rans_store.Coder(rans_store.scaled(np.bincount(ids)))
    blocks = [ids[:65_536], ids[65_536:], ids[:1], ids[:0]]
    coded = coder.encode(blocks)
    for b, (words, states, checks) in zip(blocks, coded):
        assert (coder.decode([(len(b), rans_store.LANES, words, states)])[0] == b).all()
    step = rans_store.EVERY * rans_store.LANES
    assert (coder.decode_from(65_536, rans_store.LANES, coded[0][0], coded[0][2], 3) == ids[3 * step:65_536]).all()
    with pytest.raises(ValueError):
        row = {"part": 0, "first": 0, "n": 1, "lanes": rans_store.LANES, "words": coded[2][0], "states": coded[2][1], "crc": 1}

        class Batch:
            to_pylist = staticmethod(lambda: [row])

        list(rans_store.decoded_blocks(rans_store.scaled(np.bincount(ids)), [Batch]))


def test_op2_covers_and_reorders(spark, docs):
    got = {r.doc_id: r for r in catalog.op2_decontamination(spark, SF).collect()}
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for i, t in docs.items():
        words = " ".join(tokens(t))
        whole = [k for k, w in items.items() if f" {' '.join(w)} " in f" {words} "]
        assert set(whole) <= set(got[i].item_ids or [])
    a = list(range(1, 31))
    assert decontamination.coverage(a[20:] + [99] + a[:20], a) == 1.0
    assert decontamination.coverage(a[:12], a) == 0.4


def test_op2_tiles_are_maximal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 40)).tolist(), rng.integers(0, 4, rng.integers(1, 30)).tolist()
        tiles = decontamination.tiles(a, b, 3)
        used_a, used_b = ([x for t in tiles for x in range(t[k], t[k] + t[2])] for k in (0, 1))
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all(a[i:i + n] == b[j:j + n] for i, j, n in tiles)
        for i, j in itertools.product(range(len(a) - 2), range(len(b) - 2)):
            assert a[i:i + 3] != b[j:j + 3] or set(range(i, i + 3)) & set(used_a) or set(range(j, j + 3)) & set(used_b)


def test_op3_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT page_id,host,path,rule,verdict,matched FROM ({catalog.SQL['op3_url_rules']})").fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.matched) for r in catalog.op3_url_rules(spark, SF).collect()}
    assert got == want


def test_op4_base_places(spark, docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r.doc_id: r for r in catalog.op4_license_scan(spark, SF).collect()}
    for i, t in docs.items():
        words = tokens(t)
        at = {p: [k for k in range(len(words)) if words[k:k + len(p.split())] == p.split()] for p in phrases}
        every = sorted(k for v in at.values() for k in v)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(every), every[0] if every else None, every[-1] if every else None)
        assert r.base_labels == ",".join(sorted({phrases[p] for p, v in at.items() if v}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        if "released under the mit license" in " ".join(words):
            assert "mit" in r.labels.split(",")


@pytest.mark.parametrize("hot", [1, ngram_join.HOT])
def test_op5_equals_all_pairs(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)  # with 1, every shared shingle takes the way of frequent ones
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.op5_ngram_join(spark, SF).collect()}
    assert got == linked(docs, 4, 85)


def test_op5_links_members_of_groups_whose_names_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 1)
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    passage, x, y = words("p", 40), f"{words('t', 3)} {words('x', 80)}", f"{words('t', 3)} {words('y', 80)}"
    variants = [passage.replace("p5 ", f"q{v} ") for v in range(3)]
    # each variant before x and before y: one group of equal prefix and size; others hold x or y and make their shingles frequent
    texts = {1 + v: f"{p} {x}" for v, p in enumerate(variants)} | {11 + v: f"{p} {y}" for v, p in enumerate(variants)}
    texts |= {100 + k: f"{words(f'f{k}_', 300)} {y if k % 2 else x}" for k in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(rows).collect()}
    assert [got[i][1] for i in (1, 2, 3, 11, 12, 13)] == [1, 1, 1, 11, 11, 11]
    assert got == linked(texts, 4, 85)


def test_op6_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold a dozen held-out toxic texts
    got = catalog.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.collect())
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)


@pytest.mark.parametrize("hot", [0, repeats.HOT])
def test_op7_equals_all_windows(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)  # with 0, every bucket compares single windows
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in catalog.op7_repeats(spark, SF).collect()}
    assert got == {i: (n, m, s, hashlib.sha256(k).hexdigest()) for i, (n, m, s, k) in repeated(docs, 200).items()}


def test_op1_words_are_learnt_once_whatever_follows_them():
    enc = rans_store.Encoder(catalog.tokenizer())
    texts = ["wholly wholly, wholly. wholly; wholly\nWholly", "l'été d'où, öst.) x's, a.'s\nñandú\n\nb ", "", " ", "<|endoftext|> x<|endoftext|>", "中文,x 12,3 a" + "b" * 400, "a \n b\u00a0c, d"]
    assert [*enc.encode_all(texts)] == [enc.whole(t).tobytes() for t in texts]
    enc.forget()
    [*enc.encode_all(texts[:1])]
    assert len(enc.known) == 7  # the word with a space, without one, and with a capital; three marks; a line break


def test_op7_copies_of_one_block_go_on_as_one_row(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = " ".join(word(7) for _ in range(60))
    texts = {i: f"{word(260)} {passage} {word(30)}" for i in range(400)} | {400: "ab " * 3000, 401: "", 402: passage[40:]}
    rows = {}

    def stored(df, name, write=repeats.stored):
        out = write(df, name)
        if name == "anchors":
            rows[name] = out.groupBy("h", "u").count().agg(F.max("count")).first()[0]
        return out

    monkeypatch.setattr(repeats, "stored", stored)
    table = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(table).collect()}
    assert got == {i: (n, m, s, hashlib.sha256(k).hexdigest()) for i, (n, m, s, k) in repeated(texts, 200).items()}
    assert rows["anchors"] <= 3


def test_op7_writes_few_files_whatever_the_number_of_parts(spark, tmp_path, monkeypatch):
    limit = max(16, 3 * spark.sparkContext.defaultParallelism)
    folders = itertools.count()
    monkeypatch.setattr(common, "shared_dir", lambda session, name: f"{tmp_path}/{next(folders)}-{name}")
    one = "".join(f"passage {i} that is not the one before it; " for i in range(12))
    rows = [(i, f"{i} " * 90 + one[:250 + i % 40] + f" {i}" * 60) for i in range(300)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
        repeats.removed(docs, 200).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    written = {d.name: len(list(d.glob("part-*"))) for d in tmp_path.iterdir()}
    assert len(written) > 6 and max(written.values()) <= limit, written
    assert all(r.n_removed >= 250 for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_op5_writes_few_files_whatever_the_number_of_parts(spark, tmp_path, monkeypatch):
    folders = itertools.count()
    monkeypatch.setattr(common, "shared_dir", lambda session, name: f"{tmp_path}/{next(folders)}-{name}")
    # 12 groups of 25 near copies, one word apart
    rows = [(i, " ".join(f"w{i % 12}x{j}" for j in range(60)) + f" end{i}") for i in range(300)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = {k: spark.conf.get(k) for k in (*conf, batch)}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
        found = ngram_join.similar_documents(docs, 4, 85)
        assert spark.conf.get(batch) == old[batch]
        found = {r.doc_id: r.component_id for r in found.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    written = {d.name: len(list(d.glob("part-*"))) for d in tmp_path.iterdir()}
    # the sets of texts stand in few parts; tables of at most a row per text or link in one, bit maps in four
    limit = max(16, 3 * spark.sparkContext.defaultParallelism)
    assert len(written) > 10 and all(n <= (limit if "sets" in d else 4 if "members" in d else 1) for d, n in written.items()), written
    assert found == {i: i % 12 for i in range(300)}


def test_op8_splits_of_a_turn_are_listed_at_once(monkeypatch):
    vocab = piece_sampling.vocabulary(catalog.tokenizer("piece_bpe_32k.model"))
    lattices, calls = [], []
    listed = piece_sampling.Lattices.list_ways

    def counted(lat, units):
        lattices.append(lat)
        calls.append(len(units))
        listed(lat, units)

    monkeypatch.setattr(piece_sampling.Lattices, "list_ways", counted)
    texts = [" ".join(f"{w}ing{i}" for w in ("walk", "sort", "join", "count")) for i in range(40)] + ["", "x", "\u4e00\u4e8c", "a" * 70]
    found = piece_sampling.block_samples(vocab, list(range(len(texts))), texts, 4, 1)
    assert len(calls) <= 3 < 40 <= calls[0]  # one call a turn, not one a word
    lat = lattices[0]
    size = {}
    for u, n in lat.paths.items():
        base, count = int(lat.base[u]), [1]
        for t in range(1, int(lat.size[u]) + 1):
            count.append(sum(count[t - m] for m in range(1, min(t, piece_sampling.LONGEST) + 1) if lat.edge[m - 1, base + t]))
        size[u] = count[-1]
        assert bool(lat.several[u]) == (count[-1] > 1)
    assert size and all(min(n, piece_sampling.MANY) == min(lat.paths[u], piece_sampling.MANY) for u, n in size.items())
    for t, mine in zip(texts, found):
        assert len({tuple(ids.tolist()) for ids, _, _ in mine}) == len(mine) and all(vocab.decode(ids) == t for ids, _, _ in mine)


def test_op7_groups_hold_all_occurrences(spark, docs):
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    raw = {i: t.encode() for i, t in docs.items()}
    groups = defaultdict(set)
    for r in repeats.occurrences(table, 200).collect():
        groups[(r["group"], r.n_bytes)].add((r.doc_id, r.start))
    assert groups
    windows = defaultdict(set)
    for i, x in raw.items():
        for k in range(len(x) - 199):
            windows[x[k:k + 200]].add((i, k))
    for (_, n), places in groups.items():
        strings = {raw[i][k:k + n] for i, k in places}
        assert len(strings) == 1 and len(places) > 1  # one string, at more than one place
    found = {p for places in groups.values() for p in places}
    longest = Counter()
    for (_, n), places in groups.items():
        for i, k in places:
            longest.update((i, j) for j in range(k, k + n - 199))
    assert {p for v in windows.values() if len(v) > 1 for p in v} == set(longest) and found <= set(longest)


def test_op7_groups_join_classes_that_all_have_copies(spark):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    common = text(260)
    a, b = text(700) + common + text(700), text(700) + common + text(700)
    table = spark.createDataFrame([(1, a), (2, a), (3, b), (4, b)], "doc_id long, text string")
    groups = defaultdict(set)
    for r in repeats.occurrences(table, 200).collect():
        groups[(r["group"], r.n_bytes)].add((r.doc_id, r.start))
    for (_, n), places in groups.items():
        assert len({{1: a, 2: a, 3: b, 4: b}[i][k:k + n] for i, k in places}) == 1
    windows = {(i, k) for i in (1, 2, 3, 4) for k in range(700, 761)}  # of common
    held = {(i, j) for (_, n), places in groups.items() if {i for i, _ in places} == {1, 2, 3, 4} for i, k in places for j in range(k, k + n - 199)}
    assert held == windows


def test_op8_samples_follow_the_lattice(spark):
    vocab = piece_sampling.vocabulary(catalog.tokenizer("piece_bpe_32k.model"))

    def paths(word):
        s, out = chr(piece_sampling.SPACE) + word, {}

        def walk(i, ids, log):
            if i == len(s):
                out[tuple(ids)] = log
            for n in range(1, piece_sampling.LONGEST + 1):
                p = vocab.ids.get(s[i:i + n]) if i + n <= len(s) else None
                if p:
                    walk(i + n, [*ids, p], log + vocab.log[p])

        walk(0, [], 0.0)
        z = np.logaddexp.reduce(list(out.values()))
        return {k: math.exp(v - z) for k, v in out.items()}

    chance = {a + b: p * q for (a, p), (b, q) in itertools.product(paths("qi").items(), paths("zba").items())}
    n = 6_000
    found = piece_sampling.block_samples(vocab, list(range(n)), ["qi zba"] * n, 3, 11)
    assert all(len({tuple(s[0].tolist()) for s in r}) == min(3, len(chance)) for r in found)
    first, second, weighted = Counter(), Counter(), Counter()
    for r in found:
        first[tuple(r[0][0].tolist())] += 1
        second[tuple(r[1][0].tolist())] += 1
        for ids, log, inclusion in r:
            weighted[tuple(ids.tolist())] += 1 / inclusion
            assert abs(log - math.log(chance[tuple(ids.tolist())])) < 1e-9
    for path, p in chance.items():
        q = sum(o * p / (1 - o) for other, o in chance.items() if other != path)
        assert abs(first[path] / n - p) < 0.03 and abs(second[path] / n - q) < 0.03
        if p > 0.05:  # inclusion scores make sums over samples unbiased
            assert abs(weighted[path] / n - 1) < 0.1
    again = piece_sampling.block_samples(vocab, [7], ["qi zba"], 3, 11)[0]
    assert [s[0].tolist() for s in again] == [s[0].tolist() for s in found[7]]  # by row key, in any block
    rows = catalog.op8_pieces(spark, SF).collect()
    assert all(r.decoded for r in rows) and len({(r.doc_id, r.ids_crc32) for r in rows}) == len(rows)


def test_op8_draws_four_segmentations(spark, tmp_path):
    """Texts of many words give four distinct samples in falling order of their chance to be among them; short ones all that they have."""
    spark.createDataFrame([(1, "several words of a longer text"), (2, "another one with words enough"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.op8_pieces(spark, str(tmp_path)).collect()
    per = {d: sorted((r.sample, r.ids_crc32) for r in rows if r.doc_id == d) for d in (1, 2, 3, 4)}
    assert [len(per[d]) for d in (1, 2, 3, 4)] == [4, 4, 1, 1]
    assert all(len({c for _, c in x}) == len(x) and [s for s, _ in x] == list(range(len(x))) for x in per.values())
    assert all(r.decoded for r in rows)


def test_op8_hashes_what_depends_on_the_text_once_a_text(monkeypatch):
    vocab = piece_sampling.vocabulary(catalog.tokenizer("piece_bpe_32k.model"))
    hashed, real = [], piece_sampling.mixed

    def counted(x):
        hashed.append(np.size(x))
        return real(x)

    monkeypatch.setattr(piece_sampling, "mixed", counted)
    text = "the " * 2_999 + "end"
    found = piece_sampling.block_samples(vocab, [5], [text], 1, 1)[0]
    # characters and words of the lattice, then of each word: its draw, one for each piece, and two for leaving it
    steps = len(found[0][0])
    assert sum(hashed) < 2 * len(text) + steps + 5 * 3_000, (sum(hashed), steps)
    assert vocab.decode(found[0][0]) == text


def test_op8_bytes_of_many_sequences_at_once():
    vocab = piece_sampling.vocabulary(catalog.tokenizer("piece_bpe_32k.model"))
    texts = ["plain words", "", "naïve \U0001f600 tail", "\u2581 x", "日本 語"]
    drawn = piece_sampling.block_samples(vocab, [1, 2, 3, 4, 5], texts, 3, 1)
    every = [ids for found in drawn for ids, _, _ in found]
    raw = vocab.joined(every)
    assert raw == [b"".join(vocab.raw[i] for i in ids) for ids in every]
    # one character without a piece, spelled in bytes between two pieces; cuts move with what is put in
    piece = vocab.ids["a"]
    ids, cuts = vocab.spelled_out(np.array([piece, -0x1F600 - 1, piece], np.int32), np.array([0, 1, 2, 3]))
    assert ids.tolist() == [piece, *(vocab.bytes_at[b] for b in "\U0001f600".encode()), piece] and cuts.tolist() == [0, 1, 5, 6]
    shown = iter(raw)
    for text, found in zip(texts, drawn):
        assert all((piece_sampling.shown(next(shown)) == text) == ("\u2581" not in text) for _ in found)


def test_op8_looks_up_longer_pieces_only_where_one_may_end():
    vocab = piece_sampling.vocabulary(catalog.tokenizer("piece_bpe_32k.model"))

    def may_go_on(t):
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        return bool(vocab.may_go_on(piece_sampling.point_hash(piece_sampling.point_prefix(points), np.array([0]), np.array([len(points)])))[0])

    assert all(may_go_on(t[-n:]) for t in list(vocab.ids)[::40] for n in range(1, len(t)))
    assert sum(may_go_on(f"qz{i}x") for i in range(200)) < 40


def test_op8_lattice_of_a_long_run():
    vocab = piece_sampling.vocabulary(catalog.tokenizer("piece_bpe_32k.model"))
    text = "internationalization" * 15 + "\U0001f600" * 200 + "\tthe\nother" * 30
    s, forward = chr(piece_sampling.SPACE) + text, [0.0]
    for i in range(1, len(s) + 1):
        ways = [forward[i - n] + vocab.log[p] for n in range(1, min(i, piece_sampling.LONGEST) + 1) if (p := vocab.ids.get(s[i - n:i]))]
        forward.append(np.logaddexp.reduce(ways + ([] if s[i - 1] in vocab.ids else [forward[i - 1] + piece_sampling.BYTE_LOG])))
    byte_of, over = {i: b for b, i in vocab.bytes_at.items()}, 0
    for found in piece_sampling.block_samples(vocab, list(range(20)), [text] * 20, 3, 11):
        assert len({tuple(ids.tolist()) for ids, _, _ in found}) == 3
        for ids, log, _ in found:
            ids = ids.tolist()
            # a character spelled in bytes counts once, at its first byte
            sizes = [len(vocab.strings[i]) if i not in byte_of else int(byte_of[i] & 0xC0 != 0x80) for i in ids]
            want = sum(vocab.log[i] if i not in byte_of else piece_sampling.BYTE_LOG * n for i, n in zip(ids, sizes))
            assert abs(log - (want - forward[-1])) < 1e-6 and vocab.decode(ids) == text
            over += 128 not in set(itertools.accumulate(sizes))
    assert over > 0


def test_op9_fingerprints(spark, docs):
    got = {r.doc_id: r for r in catalog.op9_fingerprints(spark, SF).collect()}
    ids = sorted(docs)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        n = len(docs[a]) // 4
        edit = docs[a][:len(docs[a]) - n] + docs[b][:n]
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (len(docs[a]), hashlib.sha256(edit.encode()).hexdigest())
        x, y = docs[a].encode(), edit.encode()
        assert r.n_common_prefix == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    by_text = defaultdict(set)
    for i, t in docs.items():
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got.values() if r.n_chars > 2_000]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.1 > np.median([r.near_next for r in long])
    a, b = (fingerprint.prefix_arrays(fingerprint.raw_bytes(t)) for t in ("xxabcdefgh", "abcdefxh"))
    assert fingerprint.equal_spans(a, 2, b, 0, 6) and not fingerprint.equal_spans(a, 2, b, 0, 7) and fingerprint.common_extension(a, 2, b, 0) == 6


def test_op9_tells_apart_what_no_base_of_a_power_of_two_does():
    """Thue-Morse strings and their successors, which begin with different bytes."""
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
        other = word.translate({97: 98, 98: 97})
        a, b = (fingerprint.prefix_arrays(fingerprint.raw_bytes(t)) for t in (word, other))
        assert not fingerprint.equal_spans(a, 0, b, 0, len(word)) and fingerprint.common_extension(a, 0, b, 0) == 0
        c, d = (fingerprint.prefix_arrays(fingerprint.raw_bytes(t)) for t in (word + word, other + word))
        assert fingerprint.common_suffix(c, d) == len(word)


def test_op9_prefix_arrays_of_long_texts(monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK", 100)
    monkeypatch.setattr(fingerprint, "_PRIME_POWERS", np.ones((2, 0), np.uint64))
    data = np.random.default_rng(5).integers(0, 256, 3_000).astype(np.uint8)
    for part in (data[:40], data, data[:700]):
        for row, base, prime in zip(fingerprint.prefix_arrays(part), fingerprint.BASES, fingerprint.PRIMES):
            want = 0
            for i, x in enumerate(part.tolist()):
                want = (want + (x + 1) * pow(base, i, prime)) % prime
                assert int(row[i + 1]) == want


def test_op2_items_without_id_and_repetitive_texts(spark):
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "same " * 4_000)], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words)), (7, " ".join(words)), (7, " ".join(words[:6])), (3, " ".join(words)), (9, "same " * 100), (None, "other words that are not there at all")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.judged(docs, items).collect()}
    assert (got[1].item_id, got[1].item_ids, got[1].coverage) == (3, [3, 7, None], 1.0)
    assert (got[2].item_id, got[2].item_ids, got[2].coverage) == (9, [9], 1.0)
    alone = decontamination.judged(docs.where("doc_id = 1"), items.where("item_id is null")).first()
    assert alone.contaminated and alone.item_id is None and alone.item_ids == [None]


def test_op3_keeps_columns_of_any_name(spark):
    from weekgrain.llm import url_filter

    names = ["_plain", "_tokens", "_hit", "_site", "k0", "a.b"]
    got = url_filter.judged(spark.createDataFrame([("http://example.net/x", *names)], ["url", *names]))
    assert got.columns == ["url", *names, "host", "path", "rule", "verdict", "matched"]
    assert tuple(got.first())[:9] == ("http://example.net/x", *names, "example.net", "/x")


def test_fit_samples_stay_bounded_with_repeated_rows(spark, monkeypatch):
    """A text that most rows share counts as one row of the sample."""
    from weekgrain.llm import quality, toxicity

    rows = [(5, "the same text in most rows " * 20)] * 3_000 + [(i, f"text number {i} with some words of its own {'vile ' * (i % 2)}") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    taken = []
    real = quality.trained
    monkeypatch.setattr(quality, "trained", lambda x, q, w: taken.append((len(x), w.sum())) or real(x, q, w))
    quality.fit(docs, max_sample=20_000)
    assert taken == [(301, 3_300)]
    labels = spark.createDataFrame([(i, i % 2) for i in [5, *range(100, 200)]], "doc_id long, toxic int")
    sizes = []
    fitted = toxicity.nnpu
    monkeypatch.setattr(toxicity, "nnpu", lambda r, c, y, u, *a: sizes.append(len(y)) or fitted(r, c, y, u, *a))
    toxicity.fit(docs, labels, max_labelled=50, max_unlabelled=100)
    assert sizes and max(sizes) <= 301


def test_op10_keeps_good_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").collect()
    good, bad = [r for r in rows if r.good], [r for r in rows if not r.good]
    assert sum(r.keep for r in good) >= 0.98 * len(good) and sum(r.keep for r in bad) <= 0.1 * len(bad)


def test_pipeline_equals_its_stages_by_brute_force(spark, docs):
    keep = {r.doc_id for r in catalog.op10_quality(spark, SF).where("keep").collect()}
    left = {i: t for i, t in docs.items() if i in keep}
    near = linked(left, 5, 80)
    left = {i: t for i, t in left.items() if near[i][1] == i}
    left = {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in repeated(left, 200).items()}
    items = [tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    number = defaultdict(lambda: len(number) + 1)
    ids = [[number[w] for w in it] for it in items]
    grams = [{tuple(it[k:k + 5]) for k in range(len(it) - 4)} for it in items]

    def clean(text):
        words = tokens(text)
        mine = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
        return all(not (g & mine) or decontamination.coverage([number[w] for w in words], it) < 0.8 for it, g in zip(ids, grams))

    want = {i for i, t in left.items() if clean(t)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want
    assert all(s.decoded for r in rows for s in r.samples)
    # the texts that reach the last stage are those of the brute-force way
    model = catalog.tokenizer("piece_bpe_32k.model")
    same = spark.createDataFrame([(i, left[i]) for i in want], "doc_id long, text string")
    again = {r.doc_id: [s.ids_crc32 for s in r.samples] for r in piece_sampling.sampled(same, model, k=2, with_ids=False).collect()}
    assert {r.doc_id: [s.ids_crc32 for s in r.samples] for r in rows} == again

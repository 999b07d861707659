"""Repeated passages: common-prefix intervals of enhanced suffix arrays, built bucket by bucket.

Two equal strings of ``length`` bytes hold the same least ``CORE``-byte span at the same place, so every window of that length is
owned by one anchor, chosen from its content alone (a window minimizer), and equal windows meet in the bucket of their anchor's
core. An anchor owns a run of consecutive windows; its context is the stretch of text that they cover.

1. Anchors whose core stands nowhere else are dropped after a count per core. Where only coverage is asked for, equal contexts of one block
   of texts go on as one row with their number: they are known to be repeated, and the stretches that they cover are noted where they are found.
2. Anchors with equal contexts form a class. A class of two or more is a repeated stretch as it is, with all members as its occurrences.
3. Of each class one context goes to its core's bucket. The contexts of a bucket are joined and their windows sorted as suffixes by
   prefix doubling; ranks of all rounds give common prefixes. A stack scan over them yields the common-prefix intervals of at least ``length``
   bytes, and an interval whose suffixes are preceded by different bytes (or stand at the start of a context) cannot be extended to the
   left: it is a maximal repeat within its contexts, reported with all its occurrences. Longer repeats come out as overlapping groups.
4. Buckets with more than ``HOT`` classes compare hashes of single windows instead, which needs no bucket in one task.

Null and empty texts and texts below ``length`` bytes have no windows. :func:`without_repeats` takes any rows: repeated rows are
occurrences of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrain.llm.common import INVERSE, few_parts, may_be_member, member_bits, mixed, powers, prefix_hash, span_hash, stored, strings, text_blocks

CORE = 64
HOT = 2_000
STRETCH = 1 << 23
PLACE_BITS = 24
JOINED = 1 << 19  # bytes of contexts that one suffix array holds
ANCHORS = "h long, u long, doc_id long, loc long, c long, spans array<struct<start:long,n_bytes:long>>"


def unpacked(loc):
    """(first window, distance from it to the anchor, number of further windows) of an anchor."""
    return loc >> 16, loc >> 8 & 255, loc & 255


def anchors_of(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, anchor, last window, core hash, context hash) of all anchors of a block; places are relative to the block."""
    width = length - CORE + 1
    parts = []
    prefix = prefix_hash(data)
    back = powers(len(prefix), INVERSE)
    tail = np.uint64((1 << PLACE_BITS) - 1)
    for begin in range(0, max(len(data) - length + 1, 0), STRETCH):
        n = min(STRETCH, len(data) - length + 1 - begin)  # windows of this stretch
        end = begin + n + length - 1
        core = mixed((prefix[begin + CORE:end + 1] - prefix[begin:end + 1 - CORE]) * back[begin:end + 1 - CORE] + np.uint64(CORE))
        least = (core & ~tail) | np.arange(len(core), dtype=np.uint64)
        w = 1
        while 2 * w <= width:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if w < width:
            least = np.minimum(least[:n], least[width - w:width - w + n])
        valid = np.ones(n + 2, bool)
        valid[0] = valid[-1] = False
        for e in borders[1:].tolist():  # windows that would leave their text
            a, b = max(e - length + 1, begin), min(e, begin + n)
            if a < b:
                valid[a - begin + 1:b - begin + 1] = False
        ok = valid[1:-1]
        change = least[1:] != least[:-1]
        first = ok & (~valid[:-2] | np.append(True, change))
        last = ok & (~valid[2:] | np.append(change, True))
        s1, s2 = np.flatnonzero(first), np.flatnonzero(last)
        p = (least[s1] & tail).astype(np.int64)
        parts.append((s1 + begin, p + begin, s2 + begin, core[p]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    s1, p, s2, h = (np.concatenate(x) for x in zip(*parts))
    u = mixed(span_hash(prefix, s1, s2 + length) + ((p - s1) << 8 | (s2 - s1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.searchsorted(borders, s1, side="right") - 1, s1, p, s2, h, u


def anchors(docs: DataFrame, length: int, every_copy: bool = True) -> DataFrame:
    """(core hash, context hash, doc_id, packed place, 1, no spans) of every anchor of ``docs`` (doc_id, text).

    With ``every_copy`` false, anchors of one class that stand in one block go out as one: the least (doc_id, place) and their number. Each of
    their contexts stands elsewhere too, so the stretches that they cover go out as (start, size) in one more row per text, without hashes.
    """

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("n_bytes", pa.int64())]))

    def batch(h, u, ids, loc, c, cover=()):
        none = [None] * len(cover)
        numbers = [pa.concat_arrays([pa.array(x), pa.array(none, pa.int64())]) for x in (h.view(np.int64), u.view(np.int64), loc, c)]
        owners = pa.concat_arrays([pa.array(ids), pa.array([d for d, _ in cover], pa.int64())])
        spans = pa.concat_arrays([pa.nulls(len(h), spans_type), pa.array([[{"start": a, "n_bytes": n} for a, n in x] for _, x in cover], spans_type)])
        return pa.RecordBatch.from_arrays([*numbers[:2], owners, *numbers[2:], spans], ["h", "u", "doc_id", "loc", "c", "spans"])

    def run(batches):
        for b in batches:
            ids = np.array(b.column(0).cast(pa.int64()))
            for row, _, data, borders in text_blocks(b.column(1)):
                rows, s1, p, s2, h, u = anchors_of(data, borders, length)
                if len(rows) == 0:
                    continue
                loc = (s1 - borders[rows]) << 16 | (p - s1) << 8 | (s2 - s1)
                if every_copy:
                    yield batch(h, u, ids[row + rows], loc, np.ones(len(rows), np.int64))
                    continue
                order = np.lexsort((loc, ids[row + rows], u, h))
                hs, us = h[order], u[order]
                first = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (us[1:] != us[:-1])))
                c = np.diff(np.append(first, len(order)))
                copies = np.sort(order[np.repeat(c > 1, c)])
                begin, size = s1 - borders[rows], s2 - s1 + length
                cover = []
                for some in np.split(copies, np.flatnonzero(np.diff(rows[copies])) + 1) if len(copies) else ():
                    spans = joined_spans(zip(begin[some].tolist(), size[some].tolist()))
                    cover.append((int(ids[row + rows[some[0]]]), [(a, e - a) for a, e in spans]))
                at = order[first]
                yield batch(h[at], u[at], ids[row + rows[at]], loc[at], c, cover)

    return docs.select("doc_id", "text").mapInArrow(run, ANCHORS)


# ---------------------------------------------------------------- enhanced suffix array of one batch of buckets


def suffix_ranks(data: np.ndarray, ends: np.ndarray, reach: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 7, 14, 28, ... bytes until ``reach``; a suffix stops at ``ends[i]``, where a shorter one sorts first."""
    n = len(data)
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(7):
        inside = at + j < ends
        key = key * 257 + np.where(inside, data[np.minimum(at + j, n - 1)].astype(np.int64) + 1, 0)
    rank = np.unique(key, return_inverse=True)[1]
    out, size = [(7, rank.astype(np.int32))], 7
    while size < reach:
        nxt = np.where(at + size < ends, rank[np.minimum(at + size, n - 1)] + 1, 0)
        rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1]
        size *= 2
        out.append((size, rank.astype(np.int32)))
    return out


def common_prefixes(data: np.ndarray, ends: np.ndarray, ranks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, from the ranks of all rounds."""
    n = len(data)
    out = np.zeros(len(a), np.int64)
    left = np.minimum(ends[a] - a, ends[b] - b)
    for size, rank in reversed(ranks):
        open_ = out + size <= left
        same = open_ & (rank[np.minimum(a + out, n - 1)] == rank[np.minimum(b + out, n - 1)])
        out[same] += size
    for _ in range(6):
        same = (out < left) & (data[np.minimum(a + out, n - 1)] == data[np.minimum(b + out, n - 1)])
        out[same] += 1
    return out


def intervals(lcp: np.ndarray, least: int):
    """(first, last, common prefix) of all common-prefix intervals of at least ``least``; lcp[i] belongs to entries i and i+1."""
    hot = np.append(False, np.append(lcp >= least, False))
    begin, end = np.flatnonzero(hot[1:] & ~hot[:-1]), np.flatnonzero(~hot[1:] & hot[:-1])
    one = end - begin == 1
    for i, v in zip(begin[one].tolist(), lcp[begin[one]].tolist()):  # two suffixes: one interval
        yield i, i + 1, v
    for x, y in zip(begin[~one].tolist(), end[~one].tolist()):
        stack: list[tuple[int, int]] = []  # (common prefix, first entry), values rise
        for i in range(x, y + 1):
            v = int(lcp[i]) if i < y else 0
            first = i
            while stack and stack[-1][0] > v:
                top, first = stack.pop()
                yield first, i, top
            if v >= least and (not stack or stack[-1][0] < v):
                stack.append((v, first))


def repeats_of(contexts: list[bytes], windows: np.ndarray, length: int):
    """Maximal repeats among the windows of contexts: yields (common prefix, context of each occurrence, start in it).

    ``windows[i]`` counts the windows of context i, which start at its first bytes.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    ends = (base + sizes)[owner]
    ranks = suffix_ranks(data, ends, int(sizes.max()))
    starts = np.repeat(base, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    array = starts[np.argsort(ranks[-1][1][starts], kind="stable")]
    lcp = common_prefixes(data, ends, ranks, array[:-1], array[1:])
    # at the start of a context: a number that no other has
    previous = np.where(array == base[owner[array]], -1 - owner[array], data[np.maximum(array - 1, 0)].astype(np.int64))
    # entries i..j are preceded by one byte only if no step between them changes it
    changes = np.append(0, np.cumsum(previous[1:] != previous[:-1]))
    for first, last, size in intervals(lcp, length):
        if changes[first] != changes[last]:
            at = array[first:last + 1]
            yield size, owner[at], at - base[owner[at]]


# ---------------------------------------------------------------- distributed


def occurrences(docs: DataFrame, length: int = 200, every_copy: bool = True) -> DataFrame:
    """(group, n_bytes, doc_id, start): the occurrences of maximal repeats of at least ``length`` bytes. ``docs``: doc_id (unique), text.

    Buckets of more than ``HOT`` classes give windows of ``length`` bytes in place of maximal repeats.
    With ``every_copy`` false the suffix arrays give only what their repeats cover: joined spans of one context of each class, without groups (0).
    """
    found = anchors(docs, length, every_copy)
    if not every_copy:
        found = stored(few_parts(found), "found")
    repeated = found.where("h is not null").groupBy("h").agg(F.sum("c").alias("n")).where("n > 1").select("h")
    kept = stored(few_parts(found.drop("spans").join(repeated, "h", "left_semi")), "anchors")
    classes = kept.groupBy("h", "u").agg(F.sum("c").alias("c"), F.min(F.struct("doc_id", "loc")).alias("r"))
    classes = stored(few_parts(classes.select("h", "u", "c", "r.doc_id", "r.loc")), "classes")
    first, reach, more = unpacked_columns()
    # what stands twice in one block is known to; the others are looked up
    whole = kept.where("c = 1").join(classes.where("c > 1").select("h", "u"), ["h", "u"], "left_semi")
    whole = whole.select(F.col("u").alias("group"), (more + length).cast("long").alias("n_bytes"), "doc_id", first.alias("start"))
    if not every_copy:
        known = found.where("h is null").select("doc_id", F.inline("spans"))
        whole = whole.union(known.select(F.lit(0).cast("long").alias("group"), "n_bytes", "doc_id", "start"))
    # buckets of several classes; where only coverage is asked for, those in which a class stands alone: copies cover the others
    several = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1")
    mixed_up = (several if every_copy else several.where("least = 1")).select("h", "k")
    wanted = stored(few_parts(classes.join(mixed_up, "h")), "wanted")
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "u", "c", "k", "loc")).alias("need"))
    near = may_be_member(docs.select("doc_id", "text"), member_bits(wanted.select("doc_id")))

    def cut(batches):
        for b in batches:
            rows = []
            for d, s, need in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist()):
                raw = s.as_buffer().to_pybytes()
                for r in need:
                    a, _, m = unpacked(r["loc"])
                    rows.append((r["h"], r["u"], r["c"], r["k"], d, a, m + 1, raw[a:a + m + length]))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "u", "c", "k", "doc_id", "first", "windows", "context"])

    kind = "h long, u long, c long, k long, doc_id long, first long, windows int, context binary"
    contexts = stored(few_parts(near.join(by_doc, "doc_id").mapInArrow(cut, kind)), "contexts")

    def scan(batches):
        held, size, last = [], 0, None

        def done():
            names = [r[1] for r in held]
            rows = []
            windows = np.array([r[3] for r in held])
            found = repeats_of([r[4] for r in held], windows, length)
            if not every_copy:
                # each window's longest repeat; of nested groups the inner ones cover the same bytes and more
                base = np.cumsum(windows) - windows
                best = np.zeros(int(windows.sum()), np.int64)
                for n, owner, start in found:
                    at = base[owner] + start
                    best[at] = np.maximum(best[at], n)
                for i in np.unique(np.repeat(np.arange(len(held)), windows)[best > 0]).tolist():
                    mine = best[base[i]:base[i] + windows[i]]
                    at = np.flatnonzero(mine)
                    rows += [(0, y - x, names[i], held[i][2] + x, held[i][0], held[i][5]) for x, y in joined_spans(zip(at.tolist(), mine[at].tolist()))]
                found = ()
            for n, owner, start in found:
                head = held[owner[0]][4][start[0]:start[0] + n]
                group = int.from_bytes(hashlib.blake2b(head, digest_size=8).digest(), "little", signed=True)
                rows += [(group, n, names[i], held[i][2] + s, held[i][0], held[i][5]) for i, s in zip(owner.tolist(), start.tolist())]
            cols = list(zip(*rows)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["group", "n_bytes", "doc_id", "start", "u", "c"])

        for b in batches:
            for h, *row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if h != last and size >= JOINED:  # a bucket is never cut
                    yield done()
                    held, size = [], 0
                held.append(tuple(row))  # u, doc_id, first, windows, context, c
                size += len(row[4])
                last = h
        if held:
            yield done()

    cold = contexts.where(F.col("k") <= HOT).select("h", "u", "doc_id", "first", "windows", "context", "c")
    cold = cold.repartition("h").sortWithinPartitions("h").mapInArrow(scan, "group long, n_bytes long, doc_id long, start long, u long, c long")

    def single(batches):
        for b in batches:
            for d, first, windows, context, u, c in zip(*(b.column(i).to_pylist() for i in range(6))):
                prefix = prefix_hash(np.frombuffer(context, np.uint8))
                at = np.arange(windows)
                yield pa.RecordBatch.from_arrays([pa.array(span_hash(prefix, at, at + length).view(np.int64)), pa.array(np.full(windows, d)), pa.array(first + at), pa.array(np.full(windows, u)),
                                                  pa.array(np.full(windows, c))], ["group", "doc_id", "start", "u", "c"])

    hot = contexts.where(F.col("k") > HOT).select("doc_id", "first", "windows", "context", "u", "c").mapInArrow(single, "group long, doc_id long, start long, u long, c long")
    again = hot.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    hot = hot.join(again, "group", "left_semi").select("group", F.lit(length).cast("long").alias("n_bytes"), "doc_id", "start", "u", "c")
    groups = cold.union(hot)
    if not every_copy:
        return whole.union(groups.where("c = 1").select("group", "n_bytes", "doc_id", "start"))
    groups = stored(few_parts(groups), "groups")
    one = groups.where("c = 1").select("group", "n_bytes", "doc_id", "start")
    # a place in a class's context stands in every member's context
    ours = groups.where("c > 1").join(classes.where("c > 1").select("u", F.shiftright("loc", 16).alias("own")), "u")
    ours = ours.select("group", "n_bytes", "u", (F.col("start") - F.col("own")).alias("shift"))
    copies = ours.join(kept.select("u", "doc_id", first.alias("first")), "u").select("group", "n_bytes", "doc_id", (F.col("first") + F.col("shift")).alias("start"))
    return whole.union(one).union(copies).distinct()


def unpacked_columns():
    loc = F.col("loc")
    return F.shiftright(loc, 16), F.shiftright(loc, 8).bitwiseAND(255), loc.bitwiseAND(255)


def joined_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs covered by (start, size) pairs."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, length: int = 200, text: str = "text", as_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and the remaining bytes (``kept``) to ``docs`` (doc_id, text, ...); input columns of these names are replaced.

    A byte is removed if a string of ``length`` bytes over it starts anywhere else as well. With ``as_text`` the rest is a string without the
    broken characters at the cuts, null where the text is.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    docs = docs.select(names)
    at = names.index(text)
    # rows that share a doc_id but not a text are apart; equal rows have the same spans
    docs = docs.withColumn("_key", F.xxhash64("doc_id", text))
    spans = occurrences(docs.select(F.col("_key").alias("doc_id"), F.col(text).alias("text")), length, every_copy=False)
    spans = stored(few_parts(spans.select(F.col("doc_id").alias("_key"), "start", "n_bytes")), "spans")
    by_doc = spans.groupBy("_key").agg(F.collect_set(F.struct("start", "n_bytes")).alias("_spans"))
    bits = member_bits(spans.select("_key"), "_key")
    hit = may_be_member(docs, bits, "_key").join(by_doc, "_key", "left").select(*names, "_spans")
    clean = may_be_member(docs, bits, "_key", keep=False).select(*names, F.lit(None).cast(hit.schema["_spans"].dataType).alias("_spans"))

    def run(batches):
        for b in batches:
            rows = []
            for s, spans_ in zip(strings(b.column(at)), b.column(len(names)).to_pylist()):
                raw = s.as_buffer().to_pybytes()
                cover = joined_spans((x["start"], x["n_bytes"]) for x in spans_ or ())
                kept, last = [], 0
                for x, y in cover:
                    kept.append(raw[last:x])
                    last = y
                kept.append(raw[last:])
                rest = b"".join(kept)
                rows.append((len(raw), sum(y - x for x, y in cover), len(cover), rest.decode("utf-8", "ignore") if as_text else rest))
            cols = [pa.array(c, k) for c, k in zip(list(zip(*rows)) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))]
            if as_text:
                cols[3] = pc.if_else(b.column(at).is_valid(), cols[3], pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], *cols],
                                             [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([*docs.select(names).schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return few_parts(hit.unionByName(clean)).mapInArrow(run, schema)


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs.select("doc_id", "text"), length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

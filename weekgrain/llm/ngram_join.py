"""Grouped prefix join: all links of texts whose n-gram sets have a Jaccard similarity of at least a threshold, as components.

Words are runs of bytes other than white space, A-Z lower-cased; a text's set holds its distinct shingles of ``size`` words (all its words
as one, if they are fewer) as 64-bit hashes. Two texts link when ``100 * intersection >= percent * union``.

1. One pass counts shingles in a fixed number of hash buckets. (bucket count, hash) orders shingles from rare to common; any order
   that all texts share gives right results, and this one keeps shared passages out of the prefixes.
2. Texts with equal sets fall together by a 128-bit signature, before anything is shuffled by content. Of each set the prefix is kept: if two
   sets reach the threshold, the larger one's first ``n - need + 1`` shingles meet the smaller one's first few.
3. Sets with identical prefixes and size form one group; postings are (shingle, group, size, position). Shingles that one group alone holds
   are dropped. Group pairs that meet under a shingle must pass the size filter and the position filter: what follows their
   first common shingle must suffice.
4. Members of the remaining pairs are verified on their whole texts.

Only connectedness is asked for, so pairs inside one component are never listed. A shingle that more than ``HOT`` groups share first
links each with one of them; then groups meet pairwise under it, with the same filters, unless all members of both are in one component already.

Null texts and texts without words have an empty set and no links; their component is their own id, as is that of texts without an id. Rows of one doc_id count as one
text if equal; of different texts under one doc_id each links for it. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import WHITE, few_parts, lowered, may_be_member, member_bits, mixed, prefix_hash, small_batches, span_hash, stored, text_blocks, word_spans
from weekgrain.llm.components import components

BUCKETS = 1 << 19
CHUNK = 1 << 13
HOT = 16
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 17)]


def shingle_sets(column, size: int):
    """Yields (row, sorted distinct shingle hashes) for every row of a text column, in order."""
    for row, end, data, borders in text_blocks(column):
        low = lowered(data)
        a, b, rows = word_spans(low, borders, WHITE)
        h = span_hash(prefix_hash(low), a, b)
        cuts = np.searchsorted(rows, np.arange(end - row + 1))
        grams = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for k in range(size):
            grams += h[k:k + len(grams)] * _STEP[k]
        grams = mixed(grams)
        for i in range(end - row):
            x, y = cuts[i], cuts[i + 1]
            if y - x >= size:
                s = np.sort(grams[x:y - size + 1])
                yield row + i, s[np.append(True, s[1:] != s[:-1])]
            elif y > x:
                yield row + i, mixed(np.array([sum(int(v) * int(_STEP[k]) for k, v in enumerate(h[x:y])) % (1 << 64)], np.uint64) + np.uint64(y - x))
            else:
                yield row + i, np.zeros(0, np.uint64)


def need(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(45)).astype(np.int64) & (BUCKETS - 1)


def bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Distinct shingles per bucket, summed over texts: BUCKETS numbers, whatever the corpus holds."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            waiting, n = [], 0
            for _, s in shingle_sets(b.column(0), size):
                waiting.append(s)
                n += len(s)
                if n > 1 << 20:
                    total += np.bincount(bucket_of(np.concatenate(waiting)), minlength=BUCKETS)
                    waiting, n = [], 0
            if waiting:
                total += np.bincount(bucket_of(np.concatenate(waiting)), minlength=BUCKETS)
        parts = total.reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(some.astype(np.int32)), "counts": pa.array([parts[i].astype("<u4").tobytes() for i in some], pa.binary())})

    def add(key, rows):
        total = np.zeros(CHUNK, np.int64)
        for c in rows.column("counts"):
            total += np.frombuffer(c.as_py(), "<u4")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})

    out = np.zeros(BUCKETS, np.int64)
    summed = docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    for r in summed.collect():
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<u8")
    # what lies together in order of count needs no exact number: few bits per bucket travel with the tasks
    return np.minimum(np.log2(1 + out) * 8, 255).astype(np.uint8)


def signed(docs: DataFrame, size: int, percent: int, order: np.ndarray) -> DataFrame:
    """doc_id, n, signature (s1, s2), prefix and the prefix's hash of each text."""

    def run(batches):
        for b in batches:
            out = []
            for _, s in shingle_sets(b.column(1), size):
                n = len(s)
                keep = n - -(-percent * n // 100) + 1 if n else 0
                rank = order[bucket_of(s)]
                if keep < n:
                    low = np.partition(rank, keep - 1)[keep - 1]
                    s_low = s[rank <= low]
                    first = s_low[np.lexsort((s_low, rank[rank <= low]))][:keep]
                else:
                    first = s[np.lexsort((s, rank))]
                with np.errstate(over="ignore"):
                    sums = mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                raw = first.tobytes()
                out.append((n, *(int(x.view(np.int64)) for x in sums), hashlib.blake2b(raw, digest_size=16).digest(), raw))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n", "s1", "s2", "p", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, p binary, prefix binary")


def postings(groups: DataFrame) -> DataFrame:
    """(token, g, np): np packs the set's size and the position of the token in its prefix."""

    def run(batches):
        for b in batches:
            g, n, p = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            sizes = [len(x) // 8 for x in p]
            total = np.repeat(np.array(n, np.int64), sizes)
            at = np.arange(len(total)) - np.repeat(np.cumsum([0, *sizes])[:-1], sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(p), np.int64)), pa.array(np.repeat(np.array(g, np.int64), sizes)), pa.array(total << 32 | at)],
                                             ["token", "g", "np"])

    return groups.select("g", "n", "prefix").mapInArrow(run, "token long, g long, np long")


def _filters(percent: int):
    """Conditions on a pair under a common shingle: x the larger set, y the smaller one."""
    xn, yn = F.shiftright("x.np", 32), F.shiftright("y.np", 32)
    xp, yp = F.col("x.np").bitwiseAND(0xFFFFFFFF), F.col("y.np").bitwiseAND(0xFFFFFFFF)
    in_order = (yn < xn) | ((yn == xn) & (F.col("y.g") < F.col("x.g")))
    left = F.least(xn - xp, yn - yp)
    return in_order & (yn * 100 >= xn * percent) & (left * (100 + percent) >= (xn + yn) * percent)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the written pairs (a, b) of doc_ids, those that link on their whole texts. ``docs`` has one row per doc_id that occurs."""
    many = pairs.count()
    if many == 0:
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    # a bit map of fixed size keeps the texts of others from being shuffled; what passes by chance finds no pair
    some = may_be_member(docs.select("doc_id", "text"), member_bits(ids))
    rows = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches):
        for b in batches:
            left, right = shingle_sets(b.column(1), size), shingle_sets(b.column(3), size)
            ok = []
            for (_, x), (_, y) in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(len(x) > 0 and len(y) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # a pair of whole texts is as much work as some fifty rows of numbers
    return stored(few_parts(rows.select("a", "ta", "b", "tb").mapInArrow(check, "a long, b long"), 50 * many), "links")


def with_component(df: DataFrame, node: str, labels: DataFrame, name: str) -> DataFrame:
    """Adds the component of ``node``; a node without links is its own."""
    found = df.join(labels.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left")
    return found.withColumn(name, F.coalesce(name, node))


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), one row per row of ``docs``."""
    # all jobs that hand rows to Python end in here; what is returned reads written tables
    with small_batches(docs.sparkSession):
        return _similar(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), size, percent)


def _similar(docs: DataFrame, size: int, percent: int) -> DataFrame:
    order = bucket_counts(docs, size)
    sets = signed(docs, size, percent, order)
    sets = stored(few_parts(sets), "sets")
    linked = sets.where("n > 0 and doc_id is not null")
    # tables of a row per text at most are small, and a file written costs memory
    many = sets.count()
    # equal sets: one representative, the smallest id
    classes = stored(few_parts(linked.groupBy("s1", "s2", "n", "p").agg(F.min("doc_id").alias("rep")), many), "classes")
    # identical prefix and size: one group, named by its smallest member; only here prefixes are shuffled
    groups = stored(few_parts(linked.groupBy("p", "n").agg(F.min("doc_id").alias("g"), F.min("prefix").alias("prefix")), 4 * many), "groups")
    crowd = classes.groupBy("p", "n").agg(F.count("*").alias("size")).where("size > 1").join(groups.select("p", "n", "g"), ["p", "n"])
    members = stored(few_parts(classes.join(crowd, ["p", "n"]).select("g", "rep", "n"), many), "members")
    all_postings = postings(groups)
    shared = all_postings.groupBy("token").agg(F.count("*").alias("c"), F.min("g").alias("hub")).where("c > 1")
    kept = stored(few_parts(all_postings.join(shared, "token"), 4 * many), "postings")
    # members of a group meet under the group itself
    inside = members.join(members.groupBy("g").agg(F.count("*").alias("c")), "g")
    inside = inside.select(F.col("g").alias("token"), F.col("rep").alias("g"), F.shiftleft("n", 32).alias("np"), "c", F.col("g").alias("hub"))
    kept_in = stored(few_parts(inside, many), "inside")

    def meeting(rows: DataFrame, *more) -> DataFrame:
        """Pairs under common shingles that pass the filters."""
        x = rows.alias("x")
        at, n = F.col("np").bitwiseAND(0xFFFFFFFF), F.shiftright("np", 32)
        # the smaller set of a pair is met within a shorter prefix
        y = rows.where((n - at) * (100 + percent) >= n * 2 * percent).alias("y")
        on = reduce(lambda p, q: p & q, [F.col("x.token") == F.col("y.token"), _filters(percent), *more])
        return x.join(y, on).select(F.col("y.g").alias("a"), F.col("x.g").alias("b"))

    def toward_hub(rows: DataFrame) -> DataFrame:
        return rows.where((F.col("c") > HOT) & (F.col("g") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("g").alias("b"))

    cold = stored(few_parts(meeting(kept.where(F.col("c") <= HOT)).distinct(), many), "meetings")
    first = cold.union(toward_hub(kept)).union(meeting(kept_in.where(F.col("c") <= HOT))).union(toward_hub(kept_in)).distinct()
    first = stored(few_parts(first, many), "pairs")
    links = verified(first, docs, size, percent)
    labels = components(links)
    # what may still join different components: groups under frequent shingles, and members of groups that met by their names only
    own = with_component(members.select("g", "rep"), "rep", labels, "comp").groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    hot = with_component(kept.where(F.col("c") > HOT), "g", labels, "comp").join(own, "g", "left")
    hot = hot.withColumns({"lo": F.coalesce("lo", "comp"), "hi": F.coalesce("hi", "comp")})
    hot_in = with_component(kept_in.where(F.col("c") > HOT), "g", labels, "comp").withColumns({"lo": F.col("comp"), "hi": F.col("comp")})
    # a pair of groups is done with only if all members of both are in one component: lo = hi on both sides
    apart = (F.col("x.lo") != F.col("y.hi")) | (F.col("x.hi") != F.col("y.lo"))
    late = meeting(stored(few_parts(hot.unionByName(hot_in), 4 * many), "hot"), apart)
    several = members.select("g", F.col("rep").alias("m"))
    met = cold.union(late)
    spread = met.join(several.select(F.col("g").alias("a"), F.col("m").alias("ma")), "a", "left").join(several.select(F.col("g").alias("b"), F.col("m").alias("mb")), "b", "left")
    spread = spread.select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    rest = with_component(with_component(spread, "a", labels, "ca"), "b", labels, "cb").where("ca != cb").select("a", "b").distinct()
    rest = stored(few_parts(rest.join(first, ["a", "b"], "left_anti"), many), "pairs")
    more = verified(rest, docs, size, percent)
    if more.take(1):
        labels = components(links.union(more))
    # ids that share a class link as well: a text of the class stands for all
    of_class = linked.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("doc_id", "n", "rep")
    found = with_component(of_class, "rep", labels, "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

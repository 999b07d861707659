"""Prefix trie of conversations by van Emde Boas recursion on depth: who shares which first turns, and what sharing them saves.

A conversation is rebuilt (see :func:`rebuilt`) into a sequence of turns; each distinct sequence of first turns is a node. The recursion cuts depths in
half: a cut prefix is named from the name of the prefix at the upper end of its interval and the name of the segment between, so one job names the cuts of
all intervals of one size, and the upper trie and all lower forests go on at once; log2(depth) jobs name every prefix. Names are SHA-256 digests of
digests, made per conversation without looking at any other; segments are paired up the same way. Each node is then one group, combined before the shuffle.

Totals are grafted upward through the same intervals, smallest first: totals of a lower forest are summed per cut node and added to the nodes of
the upper half on the path to it, which its least member knows. A level handles at most every turn once. Conversations that are the least member of no node
(copies) take no part in it.

Nothing is gathered per conversation, node or first turn: turns are numbered by a range shuffle with counts per range; members of a node are
counted with map-side combine; nodes with a thousandth of all turns, at most a thousand, are broadcast, others meet their members by a shuffled join. The digest
of a node's ends reads them sorted, as a stream of pieces.

Turns are ordered by turn, null first, then by SHA-256 of role and text. Null role or text is empty. Rows without conv_id belong to no conversation and are
left out. Repeated rows are turns of their own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain.llm.common import stored

HUBS = 1000  # nodes that hold at least this share of all turns are broadcast
PIECE = 1 << 16  # ids in one piece of a digest


def _sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def numbered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, part, at, x, bytes) in order of ``at``, and per (conv, part) its first ``at`` and how many turns of the conversation come before.

    ``x`` is the digest of role and text. Parts are ranges of the shuffle, so a conversation of any length is spread.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = _sha(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    turns = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("x"), F.octet_length(t).cast("long").alias("bytes"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("x")]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    turns = stored(turns.select("conv", F.shiftright("at", 33).alias("part"), "at", "x", "bytes"), "turns")
    parts = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns, stored(parts.withColumn("before", before), "parts")


def rebuilt(rows: DataFrame, group: int = 5, heads: int = 9, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(conv, d, x, bytes) with d from 1, and (conv, length): the first h turns of conversation c - c % group, then c's own turns after its first h, h = crc32(c) % heads."""
    turns, parts = numbered_turns(rows, **columns)
    convs = parts.groupBy("conv").agg(F.sum("n").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads, "base": F.col("conv") - F.col("conv") % group})
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    placed = turns.join(parts.drop("n").join(convs, "conv"), ["conv", "part"]).withColumn("k", F.col("before") + F.col("at") - F.col("first"))
    own = placed.where("k >= h").select("conv", (F.col("m") + F.col("k") - F.col("h") + 1).alias("d"), "x", "bytes")
    first = turns.join(parts.where(F.col("before") < heads), ["conv", "part"]).withColumn("k", F.col("before") + F.col("at") - F.col("first")).where(F.col("k") < heads)
    head = first.select(F.col("conv").alias("base"), "k", "x", "bytes").join(convs.select("conv", "base", "h"), "base").where("k < h")
    return stored(own.unionByName(head.select("conv", (F.col("k") + 1).alias("d"), "x", "bytes")), "rebuilt"), convs.select("conv", "length")


def prefix_names(turns: DataFrame, depth: int) -> DataFrame:
    """(conv, d, name) for every prefix of every conversation; equal prefixes, and no others, have equal names."""
    segments = [turns.select("conv", (F.col("d") - 1).alias("j"), "x")]  # segments[i]: turns (j 2^i, (j + 1) 2^i] of a conversation that has them all
    while 2 << (len(segments) - 1) <= depth:
        half = [F.max(F.when(F.col("j") % 2 == side, F.col("x"))) for side in (0, 1)]
        both = segments[-1].groupBy("conv", F.expr("j div 2").alias("j")).agg(half[0].alias("l"), half[1].alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
        segments.append(stored(both.select("conv", "j", _sha(F.concat("l", "r")).alias("x")), "segments"))
    names = None
    for i in reversed(range(len(segments))):
        size = 1 << i
        cut = segments[i].where("j % 2 = 0").select("conv", (F.col("j") * size).alias("lo"), "x")  # named up to lo, cut at lo + size
        top = cut.where("lo = 0").select("conv", F.lit(size).cast("long").alias("d"), _sha(F.concat(F.lit(b""), "x")).alias("name"))
        found = top
        if names is not None:
            below = cut.where("lo > 0").join(names.select("conv", F.col("d").alias("lo"), "name"), ["conv", "lo"])
            found = top.unionByName(below.select("conv", (F.col("lo") + size).alias("d"), _sha(F.concat("name", "x")).alias("name")))
        found = stored(found, "names")
        names = found if names is None else names.unionByName(found)
    return names


def with_node(members: DataFrame, nodes: DataFrame, turns: int) -> DataFrame:
    """Members (conv, d, name) with the least member of their node as ``node``; nodes of many members are broadcast, at most HUBS of them."""
    hubs = nodes.where(F.col("n_convs") * HUBS >= turns).select("d", "name", F.col("conv").alias("hub"))
    rest = nodes.where(F.col("n_convs") * HUBS < turns).select("d", "name", F.col("conv").alias("node"))
    marked = members.join(F.broadcast(hubs), ["d", "name"], "left")
    far = marked.where("hub IS NOT NULL").select("conv", "d", F.col("hub").alias("node"))
    return far.unionByName(marked.where("hub IS NULL").select("conv", "d", "name").join(rest, ["d", "name"]).select("conv", "d", "node"))


def grafted(nodes: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """Nodes (conv, d, up, saved, leaves) with ``saved`` and ``leaves`` summed over their subtrees; ``paths`` (conv, d, node) leads from least members to ancestors."""
    sums = nodes.select("conv", "d", "up", "saved", "leaves")
    size = 1
    while size < depth:
        tops = sums.where((F.col("d") - 1) % (2 * size) == size)  # tops of the lower forests
        cuts = tops.groupBy(F.col("up").alias("conv"), (F.col("d") - 1).alias("cut")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        cuts = cuts.withColumn("at", F.expr(f"(cut - 1) div {size}"))
        above = paths.withColumn("at", F.expr(f"(d - 1) div {size}")).join(cuts, ["conv", "at"]).where("d <= cut")
        more = above.groupBy(F.col("node").alias("conv"), "d").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
        joined = sums.join(more, ["conv", "d"], "left")
        total = lambda own, c: (F.col(own) + F.coalesce(F.col(c), F.lit(0))).alias(own)
        sums = stored(joined.select("conv", "d", "up", total("saved", "s"), total("leaves", "l")), "sums")
        size *= 2
    return sums


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv, d, ends_sha256) from members (conv, d, member): SHA-256 of the decimal members in ascending order, comma-joined."""

    def pieces(batches):
        key, ids = None, []

        def piece():
            cells = [[key[0]], [key[1]], [ids[0]], [",".join(map(str, ids)).encode()]]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["conv", "d", "first", "piece"])

        for b in batches:
            for conv, d, member in zip(*(c.to_pylist() for c in b.columns)):
                if ids and (key != (conv, d) or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = (conv, d)
                ids.append(member)
        if ids:
            yield piece()

    def digests(batches):
        key, state, rows = None, None, []
        for b in batches:
            for conv, d, raw in zip(*(b[c].to_pylist() for c in ("conv", "d", "piece"))):
                if key == (conv, d):
                    state.update(b",")
                else:
                    if state:
                        rows.append((*key, state.hexdigest()))
                    key, state = (conv, d), hashlib.sha256()
                state.update(raw)
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv", "d", "ends_sha256"])
            rows = []
        if state:
            yield pa.record_batch([pa.array([x], k) for x, k in zip((*key, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], ["conv", "d", "ends_sha256"])

    order = ["conv", "d", "member"]
    cut = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "conv long, d long, first long, piece binary")
    return cut.repartition("conv", "d").sortWithinPartitions("conv", "d", "first").mapInArrow(digests, "conv long, d long, ends_sha256 string")


def trie(rows: DataFrame, group: int = 5, heads: int = 9, **columns: str) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(rows, group, heads, **columns)
    size = convs.agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.max("length").alias("depth"), F.sum("length").alias("turns")).first()
    spark, empty = rows.sparkSession, F.sha2(F.lit(b""), 256)
    out = ["conv_id long", "depth long", "parent_conv_id long", "n_convs long", "n_children long", "n_leaves long", "saved_tokens long", "ends_sha256 string"]
    if not size["n"]:
        return spark.createDataFrame([], ", ".join(out))
    least, depth = size["least"], size["depth"]

    names = prefix_names(turns, depth) if depth else turns.select("conv", "d", F.col("x").alias("name"))
    nodes = names.join(turns.select("conv", "d", "bytes"), ["conv", "d"]).groupBy("d", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = stored(nodes, "nodes")
    leading = nodes.select("conv").distinct()
    paths = stored(with_node(names.join(leading, "conv"), nodes, size["turns"]), "paths")
    up = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("node").alias("up"))
    tree = nodes.join(up, ["conv", "d"], "left").withColumn("up", F.coalesce("up", F.lit(least)))  # above depth 1 is the root
    children = tree.groupBy(F.col("up").alias("conv"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    tree = tree.join(children.where("d > 0"), ["conv", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = tree.withColumns({"saved": (F.col("n_convs") - 1) * F.col("bytes"), "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")})
    tree = stored(tree.drop("name", "bytes"), "tree")
    sums = grafted(tree, paths, depth)

    first = sums.where("d = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = first.select(F.lit(least).alias("conv"), F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("up"), F.lit(size["n"]).cast("long").alias("n_convs"), "n_children",
                        F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    whole = tree.drop("saved", "leaves").join(sums.drop("up"), ["conv", "d"]).unionByName(root)

    last = convs.where("length > 0").select("conv", F.col("length").alias("d")).join(names, ["conv", "d"])
    ended = with_node(last.select("conv", "d", "name"), nodes, size["turns"]).select(F.col("node").alias("conv"), "d", F.col("conv").alias("member"))
    ended = ended.unionByName(convs.where("length = 0").select(F.lit(least).alias("conv"), F.lit(0).cast("long").alias("d"), F.col("conv").alias("member")))
    return whole.join(ends_digest(ended), ["conv", "d"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def sql(group: int = 5, heads: int = 9) -> str:
    """The same nodes from whole prefixes as lists, with every node added to each of its ancestors."""
    step = "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))"
    crc = (f"xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), "
           f"lambda c, b: list_reduce([xor(c, b)] || range(8), {step})), 4294967295)")
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, {crc} % {heads} AS h, c - c % {group} AS base FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT v.c, 0 AS part, k, role, text FROM v JOIN t ON t.c = v.base AND k < h UNION ALL SELECT v.c, 1, k, role, text FROM v JOIN t ON t.c = v.c AND k >= h),
l AS (SELECT v.c, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, k) FILTER (role IS NOT NULL), []) AS s FROM v LEFT JOIN b ON b.c = v.c GROUP BY v.c),
p AS (SELECT c, len(s) AS n, unnest(range(len(s) + 1)) AS d, s FROM l),
m AS (SELECT c, n, d, s[1:d] AS pre FROM p),
g AS (SELECT d, pre, min(c) AS node, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY d, pre),
a AS (SELECT m.c, m.d, g.node FROM m JOIN g ON g.d = m.d AND g.pre = m.pre),
u AS (SELECT g.*, a.node AS up FROM g LEFT JOIN a ON a.c = g.node AND a.d = g.d - 1),
k AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY ALL),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children, CASE WHEN u.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(pre[-1].text) END AS saved
      FROM u LEFT JOIN k ON k.up = u.node AND k.d = u.d),
s AS (SELECT a.node, a.d, sum(saved)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM w JOIN a ON a.c = w.node AND a.d <= w.d GROUP BY ALL)
SELECT w.node AS conv_id, w.d AS depth, up AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, s.saved AS saved_tokens, sha256(ends) AS ends_sha256
FROM w JOIN s ON s.node = w.node AND s.d = w.d"""

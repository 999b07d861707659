"""Language model scores by a weighted backoff automaton, trained on the texts that are not held out.

Tokens are the words of a text, A-Z lower-cased, and one end. Counts of n-grams up to ``order`` tokens are smoothed with a Dirichlet prior: with h' the
history h without its first token, p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), whose last share is
that of all unknown words. A state of the automaton is a history of at most ``order - 1`` tokens that has been seen, an arc an n-gram that has been seen; the
failure arc of a state leads to the state of its shorter history at weight mu / (c(h) + mu), so an n-gram that has not been seen costs the failure arcs on
the way and then the arc found. Every text is read from left to right: the state is carried from token to token and log10 weights are summed. A block reads its
texts side by side, a token of each at a time. The state before a token is its longest history that has been seen, whatever state the reading began in ``order - 1``
tokens earlier or more; so a text of more than ``PIECE`` tokens is read in several places at once, each reading beginning as many tokens early.

No part of the model is held whole anywhere. Texts are coded in blocks of about ``block_bytes`` (ids of the block's own words; a longer text is a block
alone), and a block asks for the counts of the distinct n-grams that it holds: words go out as words, longer n-grams as 64-bit fingerprints within a bucket
that is dealt by further hash bits. A bucket adds up its n-grams over all blocks, those of held-out texts with count 0, and answers each block
in the order asked. A frequent n-gram costs one entry per block, and buckets are even. Each block then builds the part of the automaton that its texts can
reach. The coded blocks are written once; everything after them can run again.

Null text is empty: the end alone. A null id has no remainder and is trained on. Repeated rows count and are scored one by one. With no training text N = V = 0
and any token has probability 1 under p(w). Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import mixed, stored, strings

END, START = b"", b" "  # neither can be a word
BLOCK_BYTES = 8 << 20
BUCKET_GRAMS = 1 << 22  # n-grams asked for in one bucket, about
PIECE = 512  # tokens of a text that are read one after another
CODED = "block long, ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary"
ASKED = "bucket int, block long, size int, grams binary, counts binary"
COUNTED = "block long, bucket int, size int, counts binary, n_distinct long"
_STEPS = np.random.default_rng(31).integers(1, 1 << 62, (8, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _packed(a: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; leading zero bytes cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


# ---------------------------------------------------------------- coding texts


def coded(docs: DataFrame, fold: int = 1, folds: int = 5, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: ids, whether held out, number of tokens per text, distinct words joined by line breaks, and the tokens as numbers of these words."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut_up(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            words, tokens, sizes = {}, [], []
            for t in texts:
                own = t.lower().split()
                own.append(END)
                sizes.append(len(own))
                tokens.extend(words.setdefault(w, len(words)) for w in own)
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids]
            cells = [[part << 32 | n], [ids], [held], [sizes], [b"\n".join(words)], [_packed(np.array(tokens, np.uint64))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds)], ["block", "ids", "held", "sizes", "words", "tokens"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), strings(b.column(1)).cast(pa.large_binary()).to_pylist()):
                if ids and size + len(t) > block_bytes:
                    yield row()
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield row()

    return docs.mapInArrow(cut_up, CODED)


class _Block:
    """Tokens of a coded block, and its distinct n-grams of each size with the numbers of their histories (``head``) and shorter forms (``tail``)."""

    def __init__(self, row: dict, order: int):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.words = row["words"].split(b"\n")
        self.sizes = np.array(row["sizes"], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = _unpacked(row["tokens"]).astype(np.int64)
        n = len(self.tokens)
        where = np.arange(n) - np.repeat(self.start[:-1], self.sizes)  # place of a token within its text
        trained = ~np.repeat(self.held, self.sizes)
        first = len(self.words)  # the number of START
        # grams[k]: number of the (k+1)-gram that ends at each token, -1 where the text is too short for it
        self.grams, self.last, self.head, self.tail, self.count = [self.tokens], [np.arange(first)], [None], [None], [np.bincount(self.tokens[trained], minlength=first)]
        history = np.concatenate([[first], self.tokens[:-1]])
        history[self.start[:-1]] = first
        for k in range(1, order):
            at = np.flatnonzero(where >= k - 1)
            key, inverse = np.unique(history[at] * np.int64(first + 1) + self.tokens[at], return_inverse=True)
            self.head.append(key // (first + 1))
            self.last.append(key % (first + 1))
            own = np.full(n, -1)
            own[at] = inverse
            some = np.zeros(len(key), np.int64)
            some[inverse] = self.grams[-1][at]
            self.tail.append(some)
            self.grams.append(own)
            self.count.append(np.bincount(inverse[trained[at]], minlength=len(key)))
            history = np.concatenate([[-1], own[:-1]])

    def asked(self, buckets: int):
        """(size, bucket of each n-gram, its fingerprint) by size; both follow from the words alone."""
        h = np.array([xxhash.xxh3_128_intdigest(w).to_bytes(16, "little") for w in [*self.words, START]], "S16")
        h = np.frombuffer(h.tobytes(), "<u8").reshape(-1, 2)
        before = h
        for size in range(1, len(self.grams) + 1):
            if size > 1:
                before = mixed(before[self.head[size - 1]] * _STEPS[size % 8] + h[self.last[size - 1]])
            own = before[:len(self.words)] if size == 1 else before
            yield size, (own[:, 1] % np.uint64(buckets)).astype(np.int64), own[:, 0]


def _blocks(batches, order: int):
    for b in batches:
        for row in b.to_pylist():
            yield row["block"], _Block(row, order)


def asked(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    """Rows (bucket, block, size, n-grams, their training counts in the block); fingerprints ascend within a row."""

    def ask(batches):
        for block, x in _blocks(batches, order):
            rows = []
            for size, bucket, mark in x.asked(buckets):
                by = np.lexsort((mark, bucket))
                cuts = np.flatnonzero(np.diff(bucket[by])) + 1
                for part in np.split(by, cuts) if len(by) else []:
                    grams = b"\n".join(x.words[i] for i in part) if size == 1 else mark[part].astype("<u8").tobytes()
                    rows.append((int(bucket[part[0]]), block, size, grams, _packed(x.count[size - 1][part])))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "block", "size", "grams", "counts"])

    return blocks.mapInArrow(ask, ASKED)


def _answered(bucket: pa.Table) -> pa.Table:
    """Adds up the counts of a bucket of n-grams of one size, and answers each block in the order asked; the first row also has the number of distinct n-grams."""
    size, blocks, parts = bucket["size"][0].as_py(), bucket["block"].to_pylist(), bucket["grams"].to_pylist()
    if size == 1:
        parts = [p.split(b"\n") for p in parts]
        numbers: dict[bytes, int] = {}
        marks = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in p), np.int64, len(p)) for p in parts]
    else:
        marks = [np.frombuffer(p, "<u8") for p in parts]
    _, which = np.unique(np.concatenate(marks), return_inverse=True)
    total = np.zeros(int(which.max()) + 1, np.int64)
    np.add.at(total, which, np.concatenate([_unpacked(c).astype(np.int64) for c in bucket["counts"].to_pylist()]))
    cuts = np.cumsum([len(m) for m in marks])[:-1]
    back = [_packed(x) for x in np.split(total[which], cuts)]
    distinct = [int((total > 0).sum())] + [0] * (len(blocks) - 1)
    columns = [pa.array(blocks, pa.int64()), pa.array([bucket["bucket"][0].as_py()] * len(blocks), pa.int32()), pa.array([size] * len(blocks), pa.int32())]
    return pa.table([*columns, pa.array(back, pa.binary()), pa.array(distinct, pa.int64())], ["block", "bucket", "size", "counts", "n_distinct"])


# ---------------------------------------------------------------- the automaton


class Automaton:
    """The part of the model that a block of texts can reach. State 0 has no history; arcs are keyed by state and word."""

    def __init__(self, x: _Block, counts: list[np.ndarray], texts: int, tokens: int, distinct: int, prior: float):
        self.width = len(x.words) + 1
        below = tokens + 0.5 * (distinct + 1)
        p = (counts[0] + 0.5) / below
        self.unknown = math.log10(0.5 / below)
        # states of the one-token histories are 1 .. width (START last, as often as there are texts), then those of longer ones
        seen = np.append(counts[0], texts)
        state, states = np.where(seen > 0, np.arange(self.width) + 1, 0), self.width + 1
        back, fail = [np.full(1, self.unknown), np.log10(prior / (seen + prior))], [np.zeros(self.width + 1, np.int64)]
        key, weight, target = [np.flatnonzero(counts[0])], [np.log10(p[counts[0] > 0])], [state[:-1][counts[0] > 0]]
        of_head, lower = seen, state  # counts and states of the histories one token shorter than the n-gram
        for k in range(1, len(counts)):
            head, tail, n = x.head[k], x.tail[k], counts[k]
            p = (n + prior * p[tail]) / (of_head[head] + prior)
            own = np.where(n > 0, np.arange(len(n)) + states, 0) if k < len(counts) - 1 else None
            hit = n > 0
            key.append(lower[head[hit]] * self.width + x.last[k][hit])
            weight.append(np.log10(p[hit]))
            shorter = lower[:-1][tail] if k == 1 else lower[tail]
            target.append((own if own is not None else shorter)[hit])
            if own is not None:
                back.append(np.log10(prior / (n + prior)))
                fail.append(shorter)
                of_head, lower, states = n, own, states + len(n)
        # keys ascend: states are numbered by level and n-gram, and so are the histories of the next level; the last key is that of no arc
        self.key = np.concatenate([*key, [np.iinfo(np.int64).max]])
        self.weight, self.target = np.concatenate([*weight, [0.0]]), np.concatenate([*target, [0]])
        self.back, self.fail = np.concatenate(back), np.concatenate(fail)
        self.start, self.reach = int(state[-1]) if len(counts) > 1 else 0, len(counts) - 1
        if len(counts) == 1:
            self.target[:] = 0

    @cached_property
    def arcs(self) -> dict[int, int]:
        return dict(zip(self.key[:-1].tolist(), range(len(self.key) - 1)))

    def _step(self, state: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reading a word in each state costs, and the states after it: failure arcs are taken until there is an arc for the word, or state 0 has none."""
        cost, after, left = np.zeros(len(words)), np.zeros(len(words), np.int64), np.arange(len(words))
        while len(left):
            key = state * self.width + words[left]
            arc = np.searchsorted(self.key, key)
            found = self.key[arc] == key
            cost[left] += np.where(found, self.weight[arc], self.back[state])
            after[left] = np.where(found, self.target[arc], 0)
            failed = ~found & (state > 0)
            left, state = left[failed], self.fail[state[failed]]
        return cost, after

    def scores(self, x: _Block) -> list[float]:
        """log10 probability of each text of the block: :func:`score` of its tokens, for all texts side by side."""
        size = max(PIECE, self.reach, 1)
        pieces = -(-x.sizes // size)
        text = np.repeat(np.arange(len(x.sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = x.start[text] + nth * size
        begin, end = np.where(nth > 0, own - self.reach, own), np.minimum(own + size, x.start[text + 1])
        by = np.argsort(begin - end, kind="stable")  # the longest first: those still read are always the first ones
        early, first, long = (own - begin)[by], begin[by], (end - begin)[by]
        state = np.where(first == x.start[text[by]], self.start, 0)
        each = np.zeros(len(x.tokens))
        for k, n in enumerate(np.searchsorted(-long, -np.arange(long.max(initial=0))).tolist()):
            at = first[:n] + k
            cost, state = self._step(state[:n], x.tokens[at])
            counted = early[:n] <= k
            each[at[counted]] = cost[counted]
        return [math.fsum(each[i:j].tolist()) for i, j in zip(x.start[:-1].tolist(), x.start[1:].tolist())]

    def score(self, tokens: list[int]) -> float:
        """log10 probability of the tokens, read once from left to right."""
        arcs, weight, target, back, fail, width = self.arcs.get, self.weight, self.target, self.back, self.fail, self.width
        state, parts = self.start, []
        for w in tokens:
            arc = arcs(state * width + w)
            while arc is None and state:
                parts.append(back[state])
                state = fail[state]
                arc = arcs(state * width + w)
            if arc is None:
                parts.append(self.unknown)
            else:
                parts.append(weight[arc])
                state = target[arc]
        return math.fsum(parts)


def scored(docs: DataFrame, order: int = 2, prior: float = 4.0, fold: int = 1, folds: int = 5, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words alone) and score (the automaton); both are log10 probabilities."""
    blocks = stored(coded(docs, fold, folds, doc_id, text, block_bytes), "coded")
    texts = blocks.select(F.explode(F.arrays_zip("held", "sizes")).alias("t")).select("t.*")
    sums = texts.agg(F.sum("sizes").alias("all"), F.sum(F.when(~F.col("held"), F.col("sizes"))).alias("trained"), F.count_if(~F.col("held")).alias("texts")).first()
    total, trained, n_texts = (sums[c] or 0 for c in ("all", "trained", "texts"))
    buckets = 1 + total * order // BUCKET_GRAMS
    answers = asked(blocks, buckets, order).groupBy("bucket", "size").applyInArrow(_answered, COUNTED)
    answers = stored(answers, "answers")
    distinct = answers.where("size = 1").agg(F.sum("n_distinct").alias("n")).first()["n"] or 0

    def read(block: pa.Table, back: pa.Table) -> pa.Table:
        x = _Block(block.to_pylist()[0], order)
        got = {(s, b): _unpacked(c) for b, s, c in zip(*(back[c].to_pylist() for c in ("bucket", "size", "counts")))}
        counts = []
        for size, bucket, mark in x.asked(buckets):
            by = np.lexsort((mark, bucket))
            own = np.zeros(len(by), np.int64)
            if len(by):
                own[by] = np.concatenate([got[size, int(b)] for b in np.unique(bucket)]).astype(np.int64)
            counts.append(own)
        model = Automaton(x, counts, n_texts, trained, distinct, prior)
        base = np.log10((counts[0] + 0.5) / (trained + 0.5 * (distinct + 1)))[x.tokens].tolist()
        known = np.add.reduceat((counts[0] > 0)[x.tokens].astype(np.int64), x.start[:-1])
        cuts = zip(x.start[:-1].tolist(), x.start[1:].tolist())
        columns = {
            "doc_id": pa.array(x.ids, pa.int64()), "held_out": pa.array(x.held), "n_tokens": pa.array(x.sizes), "n_known": pa.array(known),
            "train_tokens": pa.array([trained] * len(x.ids), pa.int64()), "base_score": pa.array([math.fsum(base[i:j]) for i, j in cuts]),
            "score": pa.array(model.scores(x)),
        }
        return pa.table(columns)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.select("block", "bucket", "size", "counts").groupBy("block")).applyInArrow(read, schema)


def sql(prior: float = 4.0, fold: int = 1, folds: int = 5) -> str:
    """The same scores for pairs of tokens, every token looked up in tables of all words and pairs."""
    step = "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))"
    crc = (f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), "
           f"lambda c, b: list_reduce([xor(c, b)] || range(8), {step})), 4294967295)")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({crc} % {folds} = {fold}, false) AS held_out,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') || [''] AS words FROM documents),
t AS (SELECT r, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM d),
u AS (SELECT r, held_out, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY k), ' ') AS h FROM t),
one AS (SELECT w, count(*) AS c FROM u WHERE NOT held_out GROUP BY w),
two AS (SELECT h, w, count(*) AS c FROM u WHERE NOT held_out GROUP BY ALL),
past AS (SELECT h, sum(c) AS c FROM two GROUP BY h),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, coalesce(sum(c), 0) + 0.5 * (count(*) + 1)::DOUBLE AS below FROM one),
s AS (SELECT r, one.c AS known, (coalesce(one.c, 0) + 0.5) / below AS p, coalesce(two.c, 0) AS c, coalesce(past.c, 0) AS m
      FROM u CROSS JOIN n LEFT JOIN one ON one.w = u.w LEFT JOIN two ON two.h = u.h AND two.w = u.w LEFT JOIN past ON past.h = u.h),
z AS (SELECT r, count(*) AS n_tokens, count(known) AS n_known, kahan_sum(log10(p)) AS base_score, kahan_sum(log10((c + {prior} * p) / (m + {prior}))) AS score FROM s GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN z USING (r) CROSS JOIN n"""

"""Token-id store: ids of all texts in one stream, in blocks coded by a static range asymmetric numeral system (rANS).

Format: a folder with three tables.

- ``model``: (token, freq), scaled frequencies that sum to 2^``SCALE``; one table shared by all blocks.
- ``blocks``: one row per block of at most ``BLOCK_IDS`` ids. ``part`` and ``first`` place it in the stream, ``n`` counts its ids.
  Id k belongs to lane k mod ``lanes``; the lanes are interleaved rANS coders with 64-bit states and 32-bit
  renormalisation. ``words`` has the 32-bit words in the order in which the decoder reads them, ``states`` the state of every
  lane at the start, and ``checks`` a checkpoint each ``EVERY`` steps: (word offset, all lane states), from which a decoder can
  start inside the block. ``crc`` is the crc32 of the ids as little-endian unsigned 32-bit integers. ``doc_ids`` and
  ``doc_sizes`` list the texts that begin in the block; ``inside`` and ``inside_first`` name the text that it goes on with.
- ``parts``: (part, base), how many ids stand before each part.

Writing: texts are range-partitioned and sorted by doc_id; each partition tokenizes and codes its own stretch of the
stream, and a count per partition turns its positions into those of the whole. Blocks end at text borders unless one text
alone is longer, so a reader finds almost all texts whole in one block. Uncoded blocks are written to a work table first;
from it the frequencies are counted, and each block is coded where it is read.

Null texts count as empty: they hold only the end id. Repeated rows each keep a place; rows of one doc_id are ordered by
their text's hash. An empty table gives empty tables. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.keys import shared_dir
from weekgrain.llm.common import prefix_hash, span_hash, text_list

SCALE = 20  # frequencies sum to 2^20
LOW = 1 << 31  # states stay in [2^31, 2^63)
LANES = 64
EVERY = 256  # steps between checkpoints
BLOCK_IDS = 1 << 16
GROUP = 64  # blocks coded side by side, so that numpy steps over GROUP * LANES states at once
BLOCKS = ("part int, first long, n int, lanes int, words binary, states binary, checks binary, crc long, doc_ids array<long>, "
          "doc_sizes array<long>, inside long, inside_first long")

# ---------------------------------------------------------------- tokens

# The published pattern by which the vocabulary's library splits a text before it merges lets a piece begin with one space but
# never lets one go on across it. White space beside a space (here: of one byte, or of several in UTF-8) is the exception.
ODD_SPACE = (b"  ", b" \n", b"\n ", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")
CONTROLS = bytes(range(10)) + bytes(range(11, 32))
CACHE = 800_000
GATHERED = 1 << 20  # bytes
LONGEST = 256
# no apostrophe: the pattern splits before and behind some of them
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_MARK, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[[*MARKS]] = True
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LATIN = "\u0250"  # letters below it have been letters in every version of Unicode since the pattern was published
# the published characters that stand for bytes in the vocabulary's strings; byte 0 parts words here
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_OTHERS = [b for b in range(256) if b not in _SHOWN]
_SIGN = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
SIGNS = np.array([0, *(ord(_SIGN[b]) for b in range(1, 256))], "<u2")


class Encoder:
    """The tokenizers library behind a cache of words.

    A text may be cut before every single space, before a mark of ``MARKS`` behind an ASCII letter, and around a single line break (see
    ``ODD_SPACE``), so equal parts are encoded once. Parts are told apart by 64-bit hashes. Texts with other white space beside a space, with
    a part of over ``LONGEST`` bytes, or with an added token of the vocabulary go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        # the same merges without the pattern, and without the library's step from bytes to characters
        self.merges = Tokenizer(self.lib.model)
        self.line = self.merges.token_to_id(_SIGN[10])
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose string begins with a space
        for token, i in vocab.items():
            self.opens[i] = token.startswith("\u0120")
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Hashes of the known parts in order, and where the ids of each stand."""
        self.known, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, names: np.ndarray, data: np.ndarray, a: np.ndarray, e: np.ndarray) -> None:
        """Parts of plain letters, one word of the library's pattern each, are encoded together without it. Other parts that begin with a space are
        encoded joined. Both are told apart by the ids that begin with a space."""
        size = e - a
        begin = np.cumsum(size + 1) - (size + 1)
        raw = np.zeros(int((size + 1).sum()), np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        raw[np.repeat(begin, size) + step] = data[np.repeat(a, size) + step]
        words = raw[:-1].tobytes().decode().split("\0")
        signs = SIGNS[raw[:-1]].tobytes().decode("utf-16-le").split("\0")
        letters, lines, spaced, rest = [], [], [], []
        for i, w in enumerate(words):
            spacy = w[0] == " "
            body = w[1:] if spacy else w
            if body.isalpha() and (body.isascii() or max(body) < LATIN):
                (letters if spacy else lines).append(i)
            elif body and spacy:
                spaced.append(i)
            else:
                rest.append(i)
        done = []
        for some, shown, encode in ((letters, signs, self._spaced_letters), (lines, signs, self._letters), (spaced, words, self._joined)):
            for k in range(0, len(some), 512):
                batch = some[k:k + 512]
                ids, at = encode([shown[i] for i in batch])
                if len(at) == len(batch):
                    done.append((batch, ids, np.diff(np.append(at, len(ids)))))
                else:
                    rest += batch
        each = [self.whole(words[i]) for i in rest]
        done.append((rest, np.concatenate([*each, np.zeros(0, "<u4")]).astype("<u4"), np.array([len(x) for x in each], np.int64)))
        order = np.concatenate([np.array(b, np.int64) for b, _, _ in done])
        count = np.concatenate([n for _, _, n in done])
        start = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, *(x for _, x, _ in done)])
        names = names[order]
        order = np.argsort(names)
        at = np.searchsorted(self.known, names[order])
        self.known = np.insert(self.known, at, names[order])
        self.start, self.count = np.insert(self.start, at, start[order]), np.insert(self.count, at, count[order])

    def _joined(self, batch: list[str]):
        ids = np.array(self.lib.encode_batch_fast(["".join(batch)], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.flatnonzero(self.opens[ids])

    def _merged(self, words: list[str]) -> np.ndarray:
        return np.array(self.merges.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")

    def _spaced_letters(self, batch: list[str]):
        ids = self._merged(batch)
        return ids, np.flatnonzero(self.opens[ids])

    def _letters(self, batch: list[str]):
        """Nothing shows where these begin, so a line break goes behind each."""
        ids = self._merged([x for w in batch for x in (w, _SIGN[10])])
        behind = np.flatnonzero(ids == self.line) if self.line is not None else np.zeros(0, np.int64)
        return np.delete(ids, behind), np.append(0, behind - np.arange(len(behind)))[:len(behind)]

    def parts_of(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Starts of the parts of texts that stand behind one another."""
        cut = data == 0x20
        cut[1:] |= _IS_LETTER[data[:-1]] & _IS_MARK[data[1:]]
        line = np.append(data == 0x0A, False)
        alone = line[1:-1] & ~line[:-2] & ~line[2:]
        cut[1:] |= alone
        cut[2:] |= alone[:-1]
        inner = borders[:-1]
        cut[inner[inner < len(data)]] = True
        return np.flatnonzero(cut)

    def encode_all(self, texts):
        """Yields the ids of each text as little-endian unsigned 32-bit integers; the words of about GATHERED bytes are looked up together."""
        held, size = [], 0

        def done():
            data = np.frombuffer(b"".join([r for r, odd in held if not odd]), np.uint8)
            borders = np.cumsum([0] + [len(r) for r, odd in held if not odd])
            start = self.parts_of(data, borders) if len(data) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(data))[:len(start)]
            first = np.searchsorted(start, borders)  # part of each text
            long_ = np.flatnonzero(end - start > LONGEST)
            alone = {*(np.searchsorted(borders, start[long_], side="right") - 1).tolist()}
            code, name = pd.factorize(span_hash(prefix_hash(data), start, end))
            one = np.empty(len(name), np.int64)
            one[code[::-1]] = np.arange(len(code))[::-1]
            new = np.flatnonzero((end - start)[one] <= LONGEST)
            new = new[~self.find(name[new])[1]]
            if len(self.known) + len(new) > CACHE:
                self.forget()
                new = np.flatnonzero((end - start)[one] <= LONGEST)
            if len(new):
                self.learn(name[new], data, start[one[new]], end[one[new]])
            at, hit = self.find(name)
            at = np.where(hit, at, 0)[code] if len(self.known) else code
            count = np.where(hit[code], self.count[at], 0) if len(self.known) else np.zeros(len(code), np.int64)
            stop = np.append(0, np.cumsum(count))
            ids = self.ids[np.repeat(self.start[at] - stop[:-1], count) + np.arange(stop[-1])] if stop[-1] else self.ids[:0]
            stop = stop[first].tolist()
            k = 0
            for raw, odd in held:
                if odd:
                    yield self.whole(raw.decode()).tobytes()
                    continue
                yield self.whole(raw.decode()).tobytes() if k in alone else ids[stop[k]:stop[k + 1]].tobytes()
                k += 1

        for text in texts:
            raw = text.encode()
            odd = len(raw.translate(None, CONTROLS)) != len(raw) or any(o in raw for o in ODD_SPACE) or any(a in raw for a in self.added)
            held.append((raw, odd))
            size += len(raw)
            if size >= GATHERED:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, names)
        return at, self.known[np.minimum(at, len(self.known) - 1)] == names if len(self.known) else np.zeros(len(names), bool)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


# ---------------------------------------------------------------- coding


def scaled(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 for every token that occurs, summing to 2^bits."""
    total, size = int(counts.sum()), 1 << bits
    seen = np.flatnonzero(counts)
    if len(seen) > size:
        raise ValueError(f"more than 2^{bits} distinct tokens")
    freq = np.zeros(len(counts), np.int64)
    if total == 0:
        return freq
    freq[seen] = np.maximum(1, counts[seen].astype(np.float64) * (size / total)).astype(np.int64)
    gap = size - int(freq.sum())
    order = seen[np.argsort(-freq[seen], kind="stable")]
    while gap:  # the most frequent tokens give or take the difference
        if gap > 0:
            freq[order[0]] += gap
            break
        room = np.minimum(freq[order] - 1, -gap)
        take = np.minimum(room, np.maximum(0, -gap - (np.cumsum(room) - room)))
        freq[order] -= take
        gap += int(take.sum())
    return freq


class Coder:
    """Shared tables of one model; encodes and decodes many blocks side by side."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.zeros(len(freq) + 1, np.uint64)
        np.cumsum(self.freq, out=self.cum[1:])
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list[np.ndarray], lanes: int = LANES, every: int = EVERY) -> list[tuple[bytes, bytes, bytes]]:
        """(words, states, checks) of each block. All lanes of all blocks step together, from the last id to the first."""
        steps = max((-(-len(b) // lanes) for b in blocks), default=0)
        ids = np.zeros((steps, len(blocks), lanes), np.uint32)
        live = np.zeros((steps, len(blocks), lanes), bool)
        for j, b in enumerate(blocks):
            k = -(-len(b) // lanes)
            flat = np.zeros(k * lanes, np.uint32)
            flat[:len(b)] = b
            ids[:k, j] = flat.reshape(k, lanes)
            live[:k, j] = (np.arange(k * lanes) < len(b)).reshape(k, lanes)
        state = np.full((len(blocks), lanes), LOW, np.uint64)
        sent = np.zeros((steps, len(blocks)), np.int64)  # words sent by each block at each step
        out, marks = [], {}
        for t in range(steps - 1, -1, -1):
            f, c, on = self.freq[ids[t]], self.cum[ids[t]], live[t]
            # a lane sends its low word when the next state would not fit: x >= freq * 2^(63 - SCALE)
            full = on & (state >= (f << np.uint64(63 - SCALE)))
            out.append(state[full].astype("<u4"))
            sent[t] = full.sum(1)
            state = np.where(full, state >> np.uint64(32), state)
            g = np.where(on, f, np.uint64(1))
            q = state // g
            state = np.where(on, (q << np.uint64(SCALE)) + (state - q * g) + c, state)
            if t and t % every == 0:
                marks[t] = state
        flat = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        # words of one block behind one another, in the order of the steps
        owner = np.repeat(np.tile(np.arange(len(blocks), dtype=np.uint16), steps), sent.reshape(-1))
        flat = flat[np.argsort(owner, kind="stable")]
        border = np.append(0, np.cumsum(sent.sum(0)))
        before = np.vstack([np.zeros((1, len(blocks)), np.int64), np.cumsum(sent, 0)]) if steps else np.zeros((1, len(blocks)), np.int64)
        done = []
        for j, b in enumerate(blocks):
            mine = [before[t, j].astype("<u8").tobytes() + marks[t][j].astype("<u8").tobytes() for t in sorted(marks) if t < -(-len(b) // lanes)]
            done.append((flat[border[j]:border[j + 1]].tobytes(), state[j].astype("<u8").tobytes(), b"".join(mine)))
        return done

    def decode(self, blocks: list[tuple[int, int, bytes, bytes]], at: int = 0) -> list[np.ndarray]:
        """Ids of each block (n, lanes, words, states), all blocks of one call with equal lanes, side by side."""
        if not blocks:
            return []
        lanes = blocks[0][1]
        count = np.array([b[0] for b in blocks])
        steps = int(-(-count.max() // lanes)) if len(count) else 0
        words = [np.frombuffer(b[2], "<u4") for b in blocks]
        base = np.cumsum([0] + [len(w) for w in words])[:-1]
        stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
        state = np.stack([np.frombuffer(b[3], "<u8") for b in blocks]).astype(np.uint64)
        out = np.empty((steps, len(blocks), lanes), np.uint32)
        lane = np.arange(lanes)
        low = np.uint64((1 << SCALE) - 1)
        at = base.copy()
        for t in range(steps):
            on = (t * lanes + lane)[None, :] < count[:, None]
            part = state & low
            s = self.slot[part.astype(np.int64)]
            out[t] = s
            nxt = self.freq[s] * (state >> np.uint64(SCALE)) + part - self.cum[s]
            need = on & (nxt < LOW)
            # words stand in lane order within a step
            pos = at[:, None] + np.cumsum(need, 1) - need
            word = stream[np.where(need, pos, 0)]
            nxt = np.where(need, (nxt << np.uint64(32)) | word, nxt)
            state = np.where(on, nxt, state)
            at = at + need.sum(1)
        return [out[:-(-n // lanes), j].reshape(-1)[:n] for j, n in enumerate(count.tolist())]

    def decode_from(self, n: int, lanes: int, words: bytes, checks: bytes, mark: int, every: int = EVERY) -> np.ndarray:
        """The ids of one block from checkpoint ``mark`` (1, 2, ...) to its end."""
        width = 8 * (lanes + 1)
        row = checks[(mark - 1) * width:mark * width]
        skip = int(np.frombuffer(row[:8], "<u8")[0])
        left = n - mark * every * lanes
        return self.decode([(left, lanes, words[4 * skip:], row[8:])])[0]


def crc32_joined(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings joined, from theirs and the length of the second."""
    if length == 0:
        return first

    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit appended
    for _ in range(3):
        step = [times(step, r) for r in step]
    while length:
        if length & 1:
            first = times(step, first)
        length >>= 1
        step = [times(step, r) for r in step]
    return first ^ second


# ---------------------------------------------------------------- writing and reading


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encodes every text and writes the three tables under ``path``; uncoded ids stand in a work table meanwhile."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def cut_up(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        kind = "<u2" if len(enc.opens) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        first = 0  # position within this partition
        rows, held, names, sizes, size = [], [], [], [], 0

        def cut():
            nonlocal first, held, names, sizes, size
            ids = np.frombuffer(b"".join(held), "<u4")
            begin = first
            for i in range(0, len(ids), BLOCK_IDS):  # only one text alone is longer than a block
                some = ids[i:i + BLOCK_IDS]
                texts = (names, sizes, None, None) if i == 0 else ([], [], names[0], begin)
                rows.append((part, first, len(some), np.dtype(kind).itemsize, some.astype(kind).tobytes(), b"", b"", zlib.crc32(some.tobytes()), *texts))
                first += len(some)
            held, names, sizes, size = [], [], [], 0

        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), enc.encode_all(text_list(b.column(1)))):
                n = len(raw) // 4 + 1
                if held and size + n > BLOCK_IDS:
                    cut()
                held += [raw, end]
                names.append(d)
                sizes.append(n)
                size += n
                if len(rows) >= GROUP:
                    yield rows_batch(rows)
                    rows = []
        if held:
            cut()
        yield rows_batch(rows)

    ordered.mapInArrow(cut_up, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/work")
    work = spark.read.schema(BLOCKS).parquet(f"{path}/work")

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for r in b.to_pylist():
                got = np.bincount(np.frombuffer(r["words"], f"<u{r['lanes']}"))
                if len(got) > len(total):
                    got, total = total, got
                total[:len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    # at most one row per id of the vocabulary reaches the driver
    rows = work.select("lanes", "words").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["token"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    freq = scaled(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "token int, freq int").coalesce(1).write.parquet(f"{path}/model")

    def code(batches):
        coder = Coder(freq)
        for b in batches:
            rows = b.to_pylist()
            for i in range(0, len(rows), GROUP):
                some = rows[i:i + GROUP]
                coded = coder.encode([np.frombuffer(r["words"], f"<u{r['lanes']}") for r in some])
                yield rows_batch([(r["part"], r["first"], r["n"], LANES, *c, r["crc"], r["doc_ids"], r["doc_sizes"], r["inside"], r["inside_first"])
                                  for r, c in zip(some, coded)])

    work.mapInArrow(code, BLOCKS).write.parquet(f"{path}/blocks")
    # positions inside a partition become positions in the stream; one row per partition reaches the driver
    counted = blocks(spark, path).groupBy("part").agg(F.sum("n").alias("n")).collect()
    bases, total = [], 0
    for r in sorted(counted):
        bases.append((r["part"], total))
        total += r["n"]
    spark.createDataFrame(bases, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")


BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()),
               pa.list_(pa.int64()), pa.int64(), pa.int64()]


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(BLOCK_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, BLOCK_TYPES)], names)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def load_model(spark: SparkSession, path: str) -> np.ndarray:
    """The shared frequencies, as many as the vocabulary has ids."""
    rows = spark.read.schema("token int, freq int").parquet(f"{path}/model").collect()
    freq = np.zeros(max([r["token"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        freq[r["token"]] = r["freq"]
    return freq


def decoded_blocks(freq: np.ndarray, batches):
    """Yields (row of the batch as a dict, ids) for every block, and fails on a wrong checksum. Blocks decode side by side."""
    coder = Coder(freq)
    for b in batches:
        rows = b.to_pylist()
        for i in range(0, len(rows), GROUP):
            some = rows[i:i + GROUP]
            for lanes in sorted({r["lanes"] for r in some}):
                same = [r for r in some if r["lanes"] == lanes]
                for r, ids in zip(same, coder.decode([(r["n"], lanes, r["words"], r["states"]) for r in same])):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != r["crc"]:
                        raise ValueError(f"block {r['part']}:{r['first']} does not match its checksum")
                    yield r, ids


def texts_of(row: dict, ids: np.ndarray):
    """(doc_id, first position in the part, offset in the text, ids) for each text or piece of one in a decoded block."""
    if row["inside"] is not None or row["inside_first"] is not None:
        yield row["inside"], row["inside_first"], row["first"] - row["inside_first"], ids
        return
    at = 0
    for d, n in zip(row["doc_ids"], row["doc_sizes"]):
        yield d, row["first"] + at, 0, ids[at:at + n]
        at += n


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the whole store: doc_id, start, n_tokens and the crc32 of each text's ids."""
    freq = load_model(spark, path)

    def check(batches):
        for b in batches:
            rows = [(row["part"], d, first, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for row, block in decoded_blocks(freq, [b]) for d, first, at, ids in texts_of(row, block)]
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] + [pa.int64()] * 5)], ["part", "doc_id", "first", "at", "n", "crc"])

    pieces = blocks(spark, path).mapInArrow(check, "part int, doc_id long, first long, at long, n long, crc long")

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        def one(p):
            out = 0
            for r in p:
                out = crc32_joined(out, r["crc"], 4 * r["n"])
            return out

        return parts.map(lambda p: p[0]["crc"] if len(p) == 1 else one(p))

    whole = pieces.groupBy("part", "first", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("p"))
    base = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    # one row per partition of the writer
    return whole.join(F.broadcast(base), "part").select("doc_id", (F.col("first") + F.col("base")).alias("start"), "n_tokens", joined("p").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the whole store: doc_id, start, offset of the piece in its text, ids as an array. Long texts come in pieces."""
    freq = load_model(spark, path)

    def ids_of(batches):
        for b in batches:
            rows = [(row["part"], d, first, at, ids.astype(np.int64)) for row, block in decoded_blocks(freq, [b]) for d, first, at, ids in texts_of(row, block)]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["part", "doc_id", "first", "at", "ids"])

    base = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    out = blocks(spark, path).mapInArrow(ids_of, "part int, doc_id long, first long, at long, ids array<long>")
    return out.join(F.broadcast(base), "part").select("doc_id", (F.col("first") + F.col("base")).alias("start"), F.col("at").alias("offset"), "ids")


def store_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes a store beside the session's checkpoints, reads it back whole and returns :func:`read_checks`."""
    path = shared_dir(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id)
    return read_checks(docs.sparkSession, path)

"""Distinct sampled segmentations of texts into pieces of a sentencepiece vocabulary: Gumbel top-k without replacement.

The lattice of a text has an edge for every vocabulary piece at every place it fits. Pieces get log-probabilities from their rank in
the vocabulary (Zipf's law), so every path has a probability. If each path's log-probability were perturbed by Gumbel noise, the k
best would be k distinct samples without replacement. A perturbed A-star search finds them without listing paths: a node is a set of paths
(those that share a beginning), its value the perturbed maximum of the set, drawn top-down so that the children of a node have its value
as their maximum. The best node is taken, split, and so on.

A text's lattice falls apart at word borders (no piece crosses them), so a node is: "as an emitted path up to word i, other than
certain segmentations at word i". Forward sums over the lattice of each distinct word give the masses. All texts of a block take their
next best node together: words after the split are sampled backwards from the sums at once, and the search inside the one split
word (:func:`unit_samples`) finds the next segmentation there. A text without spaces is one word, however long: every ``RESCALE`` characters the
sums start again near 1, and the pieces that cross that place carry the factor.

``inclusion`` of a sample is the chance that its perturbed value exceeds that of the best path left out (1 - exp(-exp(log_prob - threshold))); it is 1
where no path is left out. Random numbers are hashes of (seed, row key, round, word, step): the same row gets the same samples in any
partitioning and on every attempt. A text with fewer than k segmentations yields all of them. Null and empty texts have one empty
segmentation. Repeated rows get equal samples. Spaces become the space piece and one is put first, as the library does; decoding undoes both, and
characters without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrain.llm.common import BASE, INVERSE, mixed, powers, text_list

SPACE = 0x2581
RESCALE = 32
LONGEST = 16
MANY = 1 << 20  # of paths; more are not told apart
SCALE = 4.0
BYTE_LOG = -14.0  # log-probability of a character spelled in bytes
BLOCK_CHARS = 1 << 18
SLOTS = 1 << 19
INNER = 1 << 21
NO_PARTS = np.uint64(0x632BE59BD9B4E019)  # hash of no coordinates
SPLIT = np.uint64(1 << 30)
FIELDS = "n_pieces int, log_prob double, inclusion double, ids_crc32 long, decoded boolean"


class Vocabulary:
    """Pieces, their log-probabilities by rank, and a hash table from code points to ids."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.strings = [""] * size
        self.bytes_at = {}
        plain = []
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)) and len(piece) <= LONGEST:
                self.strings[i] = piece
                plain.append(i)
        self.raw = [x.replace(chr(SPACE), " ").encode() for x in self.strings]
        for b, i in self.bytes_at.items():
            self.raw[i] = bytes((b,))
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        rank = np.arange(len(plain)) + 2.7
        log = -np.log(rank)
        log -= np.log(np.exp(log).sum())
        self.log = np.full(size, -np.inf)
        self.log[plain] = log
        self.ids = {self.strings[i]: i for i in plain}
        # scaled by length, so that sums over long units stay within range; 0 for no piece
        self.weight = np.array([math.exp(x + SCALE * len(t)) if t else 0.0 for x, t in zip(self.log, self.strings)])
        self.hash = np.zeros(size, np.uint64)
        for n in range(1, LONGEST + 1):
            some = [i for i in plain if len(self.strings[i]) == n]
            if some:
                points = np.frombuffer("".join(self.strings[i] for i in some).encode("utf-32-le"), np.uint32)
                prefix = point_prefix(points)
                at = np.arange(len(some)) * n
                self.hash[some] = point_hash(prefix, at, at + n)
        # marks of the hashes of all ends of pieces
        self.inner = np.zeros(INNER, bool)
        for n in range(1, LONGEST):
            ends = sorted({self.strings[i][-n:] for i in plain if len(self.strings[i]) > n})
            if ends:
                at = np.arange(len(ends)) * n
                self.inner[point_hash(point_prefix(np.frombuffer("".join(ends).encode("utf-32-le"), np.uint32)), at, at + n) & np.uint64(INNER - 1)] = True
        # a few tables, each with one piece per slot; later ones hold what found its slot taken
        self.tables, left = [], np.array(plain)
        while len(left):
            t = np.zeros(SLOTS, np.int32)
            slot = (self.hash[left] % np.uint64(SLOTS)).astype(np.int64)
            taken, first = np.unique(slot, return_index=True)
            t[taken] = left[first]
            self.tables.append(t)
            left = np.delete(left, first)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, 0 where there is none."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.tables[0][slot]
        rest = np.flatnonzero(out)
        rest = rest[self.hash[out[rest]] != h[rest]]  # the slot holds another piece
        out[rest] = 0
        for t in self.tables[1:]:
            got = t[slot[rest]]
            hit = (got > 0) & (self.hash[got] == h[rest])
            out[rest[hit]] = got[hit]
        return out

    def may_go_on(self, h: np.ndarray) -> np.ndarray:
        """Whether the characters with each hash may be the end of a longer piece; false means that they surely are not."""
        return self.inner[(h & np.uint64(INNER - 1)).astype(np.int64)]

    def spelled_out(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces each -point - 1 by the byte pieces of that character; ``cuts`` are places in ``ids`` and come back as places in the result."""
        at = np.flatnonzero(ids < 0)
        if len(at) == 0:
            return ids, cuts
        codes, which = np.unique(ids[at], return_inverse=True)
        own = [[self.bytes_at[b] for b in chr(-int(c) - 1).encode()] for c in codes]
        size = np.ones(len(ids), np.int64)
        size[at] = np.array([len(o) for o in own])[which]
        out = np.repeat(ids, size)
        end = np.cumsum(size)
        begin = (end - size)[at]
        for k in range(max(map(len, own))):
            some = size[at] > k
            out[begin[some] + k] = np.array([o[k] if k < len(o) else 0 for o in own])[which[some]]
        return out, np.append(0, end)[cuts]

    def joined(self, ids: list[np.ndarray]) -> list[bytes]:
        """The pieces' bytes of each sequence of ids."""
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        size = self.raw_size[flat]
        end = np.append(0, np.cumsum(size))
        data = self.raw_flat[np.repeat(self.raw_start[flat] - end[:-1], size) + np.arange(end[-1])].tobytes()
        cuts = end[np.cumsum([0] + [len(x) for x in ids])].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids) -> str:
        """Text of a sequence of ids."""
        return shown(self.joined([np.asarray(ids, np.int32)])[0])


def shown(raw: bytes) -> str:
    """Text of the bytes of pieces, without the space that was put first."""
    text = raw.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def point_prefix(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * powers(len(points), BASE)[:len(points)], out=out[1:])
    return out


def point_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix), INVERSE)[start] + (end - start).astype(np.uint64))


def stirred(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The hash ``h`` of integer coordinates with one more of them."""
    return mixed((h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def uniform(*parts: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes of their integer coordinates."""
    h = NO_PARTS
    for p in parts:
        h = stirred(h, p)
    return _unit(h)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Lattices:
    """Lattices of the distinct units of a block, with forward sums.

    Places are numbered through; unit u has places base[u] .. base[u] + size[u]. ``edge[n-1, p]`` is the piece of n characters that ends
    at place p (0: none, -1: spelled in bytes), ``share[p]`` the running shares of the piece lengths among the paths that reach p.
    """

    def __init__(self, vocab: Vocabulary, points: np.ndarray, start: np.ndarray, size: np.ndarray):
        order = np.argsort(-size, kind="stable")
        self.renamed = np.empty(len(order), np.int64)
        self.renamed[order] = np.arange(len(order))
        start, size = start[order], size[order]
        self.size = size
        self.base = np.cumsum(size + 1) - (size + 1)
        total = int((size + 1).sum())
        unit = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size) + 1  # 1 .. size
        place = self.base[unit] + step
        text = start[unit] + step  # end of the character in the block
        spread = mixed(points.astype(np.uint64) + np.uint64(1))
        self.vocab = vocab
        self.edge = np.zeros((LONGEST, total), np.int32)
        weight = np.zeros((LONGEST, total))
        ends: list[np.ndarray] = [np.zeros(0, np.int64)] * LONGEST  # places where a piece of each length ends
        left, here = text, place
        sum_ = np.zeros(len(text), np.uint64)  # as in point_hash(), with one character more in front each time
        for n in range(1, LONGEST + 1):
            if len(here) == 0:
                break
            sum_ *= np.uint64(BASE)
            sum_ += spread.take(left - n)
            h = mixed(sum_ + np.uint64(n))
            got = vocab.find(h)
            some = np.flatnonzero(got)
            ends[n - 1] = here[some]
            self.edge[n - 1, ends[n - 1]] = got[some]
            weight[n - 1, ends[n - 1]] = vocab.weight[got[some]]
            # longer pieces end here only if one has these characters as its end
            far = np.flatnonzero(vocab.may_go_on(h) & (step > n))
            step, left, here, sum_ = step.take(far), left.take(far), here.take(far), sum_.take(far)
        alone = self.edge[0, place] == 0
        self.edge[0, place[alone]] = -1
        weight[0, place[alone]] = math.exp(BYTE_LOG + SCALE)
        ends[0] = place
        self.point = np.zeros(total, np.uint32)
        self.point[place] = points[text - 1]
        sums = np.zeros(total)
        sums[self.base] = 1.0
        longest = int(size[0]) if len(size) else 0
        back = np.arange(1, LONGEST + 1)[:, None]
        for t in range(1, longest + 1):
            live = int(np.searchsorted(-size, -t, side="right"))  # units of t characters or more come first
            p = self.base[:live] + t
            if t > LONGEST:
                s = (weight[:, p] * sums[p - back]).sum(0)
            else:
                s = np.zeros(live)
                for n in range(1, t + 1):
                    w = weight[n - 1].take(p)
                    w *= sums.take(p - n)
                    s += w
            sums[p] = s
            if t % RESCALE == 0 and longest > t:
                # a power of two changes no share; what reaches over place t takes it from here on
                longer = p[:int(np.searchsorted(-size, -t, side="left"))]
                factor = np.ldexp(1.0, -np.frexp(sums[longer])[1])
                for j in range(1, LONGEST + 1):
                    here = size[:len(longer)] >= t + j
                    longer, factor = longer[here], factor[here]
                    weight[j - 1:, longer + j] *= factor
        # single characters reach every place, so any longer piece makes a second path
        longer = np.zeros(total, bool)
        for at in ends[1:]:
            longer[at] = True
        self.several = np.logical_or.reduceat(longer, self.base) if len(size) else longer
        self.ways: dict[int, tuple] = {}  # of units that were split, with their numbers of paths
        self.paths: dict[int, int] = {}
        some_sum = np.where(sums > 0, sums, 1.0)
        whole = 1.0 / some_sum
        share = np.empty((LONGEST, total), np.float32)
        running = np.zeros(total)
        for n in range(1, LONGEST + 1):
            at = ends[n - 1]
            mass = weight[n - 1].take(at) * sums.take(at - n)
            upto = running.take(at) + mass
            running[at] = upto
            share[n - 1] = share[n - 2] if n > 1 else 0.0
            share[n - 1, at] = upto * whole.take(at)
            weight[n - 1, at] = mass / some_sum.take(at)
        # few pieces are longer than half of LONGEST
        self.share, self.share_of_long = (np.ascontiguousarray(share[a:a + LONGEST // 2].T) for a in (0, LONGEST // 2))
        self.part = weight  # by length - 1 and place: share of the paths to a place that end with a piece of that length

    def draw(self, units: np.ndarray, noise: np.ndarray):
        """A random path for each item, from its hash, sampled backwards: (number of pieces, log-probability, pieces of all items joined)."""
        at = self.base[units] + self.size[units]
        items = np.arange(len(units))
        log, n = np.zeros(len(units)), np.zeros(len(units), np.int64)
        product = np.ones(len(units))  # of the open items
        steps = []
        active, pos, step = items, at.copy(), 0
        low, total = self.base[units], self.edge.shape[1]
        edge, part = self.edge.reshape(-1), self.part.reshape(-1)
        while len(active):
            r = _unit(mixed(noise + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))).astype(np.float32)
            row = self.share.take(pos, axis=0)
            length = np.bitwise_count((row < r[:, None]).view(np.uint64)[:, 0]).astype(np.int64)  # eight flags in a number
            far = np.flatnonzero(length == LONGEST // 2)
            if len(far):
                row = self.share_of_long.take(pos.take(far), axis=0)
                length[far] = np.minimum(length[far] + np.bitwise_count((row < r.take(far)[:, None]).view(np.uint64)[:, 0]), LONGEST - 1)
            cell = length * total + pos
            length += 1
            piece = edge.take(cell)
            if not piece.all():  # rounding at the end of a row: the longest edge there is
                for i in np.flatnonzero(piece == 0):
                    length[i] = int(np.flatnonzero(self.edge[:, pos[i]])[-1]) + 1
                cell = (length - 1) * total + pos
                piece = edge.take(cell)
            before = pos - length
            product *= part.take(cell)
            if step % 16 == 15:  # long before products of probabilities could vanish
                log[active] += np.log(product)
                product[:] = 1.0
            spelled = np.flatnonzero(piece < 0)
            piece[spelled] = -self.point[pos[spelled]].astype(np.int32) - 1
            steps.append((active, piece))
            step += 1
            ended = before <= low
            done = np.flatnonzero(ended)
            if len(done):
                who = active.take(done)
                n[who] = step
                log[who] += np.log(product.take(done))
                open_ = np.flatnonzero(~ended)
                active, before, low, noise, product = (x.take(open_) for x in (active, before, low, noise, product))
            pos = before
        begin = np.cumsum(n) - n
        pieces = np.zeros(int(n.sum()), np.int32)
        for k, (who, piece) in enumerate(steps):
            pieces[begin[who] + n[who] - 1 - k] = piece
        return n, log, pieces

    def list_ways(self, units: np.ndarray) -> None:
        """Lists the edges of units that are about to be split, of all at once: ``ways[u]`` has the first edge that ends at each place, then all their (length, share, piece)."""
        units = np.array([u for u in np.unique(units).tolist() if u not in self.ways], np.int64)
        if len(units) == 0:
            return
        size = self.size[units] + 1
        first = np.cumsum(size) - size
        places = np.repeat(self.base[units] - first, size) + np.arange(int(size.sum()))
        at, n = np.nonzero(self.edge[:, places].T)
        pos = places[at]
        piece = self.edge[n, pos]
        piece = np.where(piece > 0, piece, -self.point[pos].astype(np.int32) - 1)
        bounds = np.searchsorted(at, np.arange(len(places) + 1)).tolist()
        edges = list(zip((n + 1).tolist(), self.part[n, pos].tolist(), piece.tolist()))
        for u, a, m in zip(units.tolist(), first.tolist(), size.tolist()):
            self.ways[u] = bounds[a:a + m + 1], edges
            reach = [1]
            for x, y in zip(bounds[a + 1:a + m], bounds[a + 2:a + m + 1]):
                reach.append(sum([reach[-e[0]] for e in edges[x:y]]))
                if reach[-1] > MANY:  # never fewer at a later place
                    break
            self.paths[u] = reach[-1]

    def unit_samples(self, unit: int, key: int, turn: int, word: int):
        """Segmentations of one unit in the order of their perturbed log-probabilities (log-probability, pieces), by A-star from the end."""
        base, end = int(self.base[unit]), int(self.base[unit] + self.size[unit])
        heap = [(-1e300, 0, end, 0.0, None)]  # the root's own value does not matter for the order
        if unit not in self.ways:
            self.list_ways(np.array([unit]))
        bounds, edges = self.ways[unit]
        serial = 0
        draw, ln = random.Random(f"{key}-{turn}-{word}").random, math.log
        while heap:
            value, _, pos, log, tail = heapq.heappop(heap)
            if pos == base:
                own = []
                while tail is not None:
                    piece, tail = tail
                    own.append(piece)
                yield log, own
                continue
            kids, best = [], -math.inf
            for n, share, piece in edges[bounds[pos - base]:bounds[pos - base + 1]]:
                phi = log + ln(share)
                g = phi - ln(-ln(draw() or 0.5))
                kids.append((g, phi, n, piece))
                if g > best:
                    best = g
            top = -value
            for g, phi, n, piece in kids:
                # condition on the node's value being the maximum of its children
                if top > 1e299:
                    v = g
                elif g == best:
                    v = top
                else:
                    d = g - best
                    u = top - g + math.log1p(-math.exp(d)) if d > -700 else top - g
                    v = top - max(0.0, u) - math.log1p(math.exp(-abs(u)))
                serial += 1
                heapq.heappush(heap, (-v, serial, pos - n, phi, (piece, tail)))


def truncated(log_mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values located at ``log_mass``, given that they do not exceed ``top``."""
    g = log_mass - np.log(-np.log(u))
    return -np.logaddexp(-top, -g)


def block_samples(vocab: Vocabulary, keys: list[int], texts: list[str], k: int, seed: int):
    """For each text a list of (ids, log-probability, inclusion), best perturbed value first."""
    shaped = [(" " + t).replace(" ", chr(SPACE)) if t else "" for t in texts]
    points = np.frombuffer("".join(shaped).encode("utf-32-le"), np.uint32)
    cuts = np.cumsum([0] + [len(s) for s in shaped])
    begin = np.zeros(len(points), bool)
    begin[cuts[:-1][cuts[:-1] < len(points)]] = True
    if len(points):
        space = points == SPACE
        begin[1:] |= space[1:] & ~space[:-1]
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(points)))
    doc = np.searchsorted(cuts, start, side="right") - 1
    first = np.searchsorted(start, cuts)  # first unit of each text
    word = np.arange(len(start)) - first[doc]
    h = point_hash(point_prefix(points), start, start + size)
    _, one, unit = np.unique(h, return_index=True, return_inverse=True)
    lat = Lattices(vocab, points, start[one], size[one])
    unit = lat.renamed[unit]
    key = np.array([zlib.crc32(repr((seed, x)).encode()) for x in keys], np.uint64)
    several = lat.several[unit]

    def drawn(flat: np.ndarray, turn: int):
        """Random paths of these words, and the noise of leaving them; what depends on the text alone is hashed once a text."""
        text, mine = doc[flat], word[flat].astype(np.uint64)
        n, log, pool = lat.draw(unit[flat], mixed(mixed(key << np.uint64(8) | np.uint64(turn))[text] ^ mine))
        leave = stirred(stirred(NO_PARTS, key), turn)[text]
        return np.append(0, np.cumsum(n)), n, log, pool, _unit(stirred(stirred(leave, mine), SPLIT))

    def complements(turn: int, flat: np.ndarray, bounds: np.ndarray, logs: np.ndarray, noise: np.ndarray, sources: list[tuple]):
        """Nodes of the paths that leave those of ``sources`` (text, path, log-probability before, value) at a word of ``flat``; the best few are enough."""
        head = np.empty(len(logs))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            np.cumsum(logs[a:b], out=head[a:b])
        head = np.repeat(np.array([x[2] for x in sources]), np.diff(bounds)) + head - logs
        open_ = several[flat]
        with np.errstate(divide="ignore"):
            mass = head + np.log(np.where(open_, np.maximum(-np.expm1(np.minimum(logs, 0.0)), 1e-12), 0.0))
        g = mass - np.log(-np.log(noise))  # not yet cut at the value of the path
        best, of = [], []
        for x, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b - a > k:
                best.append(a + np.argpartition(g[a:b], b - a - k)[b - a - k:])
            else:
                best.append(np.arange(a, b))
            of += [x] * len(best[-1])
        at = np.concatenate([*best, np.zeros(0, np.int64)])
        top = np.array([sources[x][3] for x in of])
        value = -np.logaddexp(-top, -g[at])
        for x, v, w, ok, before in zip(of, value.tolist(), word[flat[at]].tolist(), open_[at].tolist(), head[at].tolist()):
            if ok:
                heapq.heappush(frontier[sources[x][0]], (-v, turn, w, sources[x][1], before))

    # per text: emitted paths with their words' ends among the ids and log-probabilities, frontier of nodes
    paths: list[list[dict]] = [[] for _ in texts]
    frontier: list[list] = [[] for _ in texts]
    value = (-np.log(-np.log(uniform(key, np.full(len(key), 1 << 40))))).tolist()  # the best path's: a standard Gumbel, as the whole mass is 1
    end, n, log, pool, noise = drawn(np.arange(len(start)), 0)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        paths[i].append({"ids": pool[end[a]:end[b]], "end": end[a:b + 1] - end[a], "log": log[a:b], "split": (-1, ())})
    complements(0, np.arange(len(start)), first, log, noise, [(i, 0, 0.0, value[i]) for i in range(len(texts))])
    for turn in range(1, k):
        chosen = []
        for i in range(len(texts)):
            if frontier[i] and len(paths[i]) == turn:
                g, _, at, parent, head = heapq.heappop(frontier[i])
                chosen.append((i, -g, at, parent, head))
        if not chosen:
            break
        # the words behind each split are drawn at once
        spans = [np.arange(first[i] + at + 1, first[i + 1]) for i, _, at, _, _ in chosen]
        bounds = np.cumsum([0] + [len(x) for x in spans])
        flat = np.concatenate(spans)
        end, n, log, pool, noise = drawn(flat, turn)
        lat.list_ways(unit[np.array([first[i] + at for i, _, at, _, _ in chosen])])
        sources, again = [], []
        for (i, g, at, parent, head), a, b in zip(chosen, bounds[:-1].tolist(), bounds[1:].tolist()):
            old = paths[i][parent]
            u = int(unit[first[i] + at])
            # what other paths with the same beginning hold at this word is excluded
            same = [old] + [q for q in paths[i] if q["split"] == (at, head)]
            seen = {tuple(q["ids"][q["end"][at]:q["end"][at + 1]].tolist()): float(q["log"][at]) for q in same}
            for log_u, own in lat.unit_samples(u, int(key[i]), turn, at):
                if tuple(own) not in seen:
                    break
            keep = int(old["end"][at])
            paths[i].append({"ids": np.concatenate([old["ids"][:keep], np.array(own, pool.dtype), pool[end[a]:end[b]]]),
                             "end": np.concatenate([old["end"][:at + 1], end[a:b + 1] + (keep + len(own) - end[a])]),
                             "log": np.concatenate([old["log"][:at], [log_u], log[a:b]]), "split": (at, head)})
            sources.append((i, turn, head + log_u, g))
            # the word of the split again, without what has been emitted there
            if lat.paths[u] > len(seen) + 1:
                mass = 1.0 - sum(math.exp(x) for x in {**seen, tuple(own): log_u}.values())
                again.append((i, at, parent, head, g, head + math.log(max(mass, 1e-12))))
        if again:
            text, at, _, _, top, mass = (np.array(x) for x in zip(*again))
            u = uniform(key[text], np.full(len(text), turn), at, np.full(len(text), (1 << 30) + 1))
            for v, (i, at, parent, head, _, _) in zip(truncated(mass, top, u).tolist(), again):
                heapq.heappush(frontier[i], (-v, turn, at, parent, head))
        complements(turn, flat, bounds, log, noise, sources)
    every = [p["ids"] for mine in paths for p in mine]
    ids, cuts = vocab.spelled_out(np.concatenate([*every, np.zeros(0, np.int32)]), np.cumsum([0] + [len(x) for x in every]))
    results, done = [], 0
    for mine, nodes in zip(paths, frontier):
        left = -nodes[0][0] if nodes else -math.inf
        found = []
        for p in mine:
            total = float(p["log"].sum())
            inclusion = 1.0 if left == -math.inf else -math.expm1(-math.exp(min(total - left, 700.0)))
            found.append((ids[cuts[done]:cuts[done + 1]], total, inclusion))
            done += 1
        results.append(found)
    return results


def sampled(docs: DataFrame, model: str, k: int = 3, seed: int = 1, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_samples and samples: structs of n_pieces, log_prob, inclusion, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    decoded (whether the ids decode to the text) and, if asked for, the ids. Columns named in ``keep`` are handed on; none may be called like a result column."""
    kind = pa.list_(pa.struct([("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("decoded", pa.bool_()),
                               *([("ids", pa.list_(pa.int32()))] if with_ids else [])]))
    schema = f"doc_id long, n_samples int, samples array<struct<{FIELDS.replace(' int', ':int').replace(' double', ':double').replace(' long', ':long').replace(' boolean', ':boolean')}"
    schema += ",ids:array<int>>>" if with_ids else ">>"
    schema = T.StructType([*T._parse_datatype_string(schema).fields, *(docs.schema[c] for c in keep)])

    def run(batches):
        vocab = vocabulary(model)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), text_list(b.column(1))
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
                    size += len(texts[end])
                    end += 1
                rows = []
                drawn = block_samples(vocab, keys[at:end], texts[at:end], k, seed)
                raw = iter(vocab.joined([ids for found in drawn for ids, _, _ in found]))
                for t, found in zip(texts[at:end], drawn):
                    rows.append([{"n_pieces": len(ids), "log_prob": log, "inclusion": inclusion, "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "decoded": shown(next(raw)) == t,
                                  **({"ids": ids.tolist()} if with_ids else {})} for ids, log, inclusion in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:end], pa.int64()), pa.array([len(r) for r in rows], pa.int32()), pa.array(rows, kind), *(c.slice(at, end - at) for c in b.columns[2:])], ["doc_id", "n_samples", "samples", *keep])
                at = end

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep).mapInArrow(run, schema)

"""Language-model scores by logistic context mixing, beside an exact unigram model.

A text is words and the gaps of white space between them. Three layers code it, the score is the log10 of their product:

* Bits. A unit (word or gap) is coded byte by byte with an end mark, each symbol as the binary decisions on its way down a
  Huffman tree of the corpus's bytes, which are half as many as those of eight bits. Hashed contexts predict each bit; their stretched probabilities are mixed by weights that a gate selects (place, bit, how often the
  context was seen) and refined by an adaptive probability map. A unit's first byte has contexts across the boundary: how the word
  before it began and ended, and whether a line ended; the others have two and four bytes back and the whole unit so far.
* Words. A document's own words so far predict the next one, too. The share of the two predictions adapts within each document:
  it is a Bayesian mixture over SHARES, so every word that is coded moves the weights of the next.
* Passages. Texts are cut into passages at content-defined words. Whether a passage is one that another training text holds is
  one more bit, predicted by how many of the document's were so far; if it is, the passage is named, not spelled. A text that is
  itself in training is scored without its own passages.

All training texts are counted, each distinct unit, first byte in its context and passage once with its number. Weights and maps
are learnt online over all distinct steps of all units, weighted by their numbers: each task goes over its part of the vocabulary
in random order from common weights, and the results are averaged by weight, in ROUNDS rounds. What the corpus's vocabulary and
passages hold is never collected: the counted tables have a fixed size, all else stays in tables of Spark.

The unigram counts are exact: frequent units (at most FREQUENT, each in its own case) are broadcast with their counts and scores,
occurrences of all other words are joined by word, in lower case, once for each text. Spark can split that join.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property, reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.util import checkpointed, fold_ascii, lean, unpacked, with_fields

PIECE, FREQUENT, ROUNDS, KEPT = 1 << 14, 1_200_000, 1, 250_000
#: A task that counts has tables of a fixed size, so it should count many units.
UNITS_IN_A_TASK = 400_000
#: Bits of each predictor's table, and where it begins in the one array of all.
WIDTHS = (20, 22, 22)
STARTS = tuple(sum(1 << b for b in WIDTHS[:k]) for k in range(len(WIDTHS)))
SLOTS, MODELS = sum(1 << b for b in WIDTHS), len(WIDTHS)
#: Gates: place in the unit, depth of the bit, and how often the last context was seen.
LEVELS, DEPTHS = (1, 3, 20), 9
GATES, BUCKETS = 4 * DEPTHS * (len(LEVELS) + 1), 33
#: Bytes of a unit that are coded in one go; a longer one is coded in pieces.
LONG, AT_ONCE = 1024, 1 << 18
#: Contexts of a first byte: for words how the word before ended, whether a line ended and the word's first byte; for gaps the word's last byte.
ENDINGS, WORD_STARTS, FIRSTS = 8, 4096, 4096 + 256
#: Shares of the document's own words; bytes that a passage has at least, and words that it has about.
SHARES, LEAST_PASSAGE, ABOUT = (0.02, 0.25), 48, 64
HELD_OUT = 1
_GAP = b" \t\n\r\x0b\x0c"
_IS_GAP = np.isin(np.arange(256), list(_GAP))
_ENDING = np.full(256, 4, dtype=np.int32)
for _k, _bytes in enumerate((b".!?", b",;:", b"0123456789")):
    _ENDING[list(_bytes)] = _k + 1
_ENDING[128:], _ENDING[33:48] = 5, np.where(_ENDING[33:48] == 4, 6, _ENDING[33:48])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, dtype=np.uint64))


def _pieces(units: list[bytes], ends: bool) -> tuple[list[bytes], list[int]]:
    """Units cut into pieces of LONG bytes, the last of which is shorter, and the unit of each."""
    if max(map(len, units), default=0) < LONG:
        return units, range(len(units))
    cut = [(u[k : k + LONG], n) for n, u in enumerate(units) for k in range(0, len(u) + ends, LONG)]
    return [u for u, _ in cut], [n for _, n in cut]


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, number of each key among the distinct, places in order where a new one begins)"""
    order = np.argsort(key)
    line = key[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = line[1:] != line[:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order, number, np.nonzero(fresh)[0]


def steps(units: list[bytes], begins: bool = True, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct steps of the units: contexts (models, steps), place, symbol (256: the end); for each step taken: its unit, its number among the distinct.

    A step codes one byte, or the end, after what the unit holds so far. A unit's first byte isn't a step, see Firsts.
    begins and ends: false for a part of a unit that goes on before or after it; such a part has whole pieces.
    """
    pieces, owner = _pieces(units, ends)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    data = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    lasting = sizes < LONG  # a full piece goes on
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, sizes + 1)
    is_end = place == np.repeat(sizes, sizes + 1)
    unit = np.repeat(np.asarray(owner, dtype=np.int64), sizes + 1)
    first = np.concatenate([[True], np.diff(np.asarray(owner)) > 0]) if len(pieces) else np.empty(0, bool)
    wide = data.astype(np.uint64)
    gap = np.repeat(_IS_GAP[data[starts]] & (sizes > 0), sizes + 1).astype(np.uint64)
    back = [np.where(place >= k, np.roll(wide, k) + np.uint64(1), np.uint64(0)) for k in range(1, 5)]
    # hash of the unit so far: a running sum of place-dependent terms, less what stood before the unit
    term = (wide + np.uint64(1)) * (_M1 ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    term ^= term >> np.uint64(31)
    total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])[:-1]
    whole = (total - np.repeat(total[starts], sizes + 1)) * np.uint64(3) + gap + np.uint64(1)
    symbol = np.where(is_end, 256, data.astype(np.int64))
    used = ~(is_end & np.repeat(~lasting, sizes + 1)) & ~((place == 0) & np.repeat(first & (sizes > 0) & begins, sizes + 1))
    key = (whole * _M1) ^ (symbol.astype(np.uint64) * _M2)
    order, number, first = ranked(key[used])
    at = np.nonzero(used)[0][order[first]]
    orders = [gap[at] * np.uint64(257)]
    for x in back:
        orders.append((orders[-1] * _M1) ^ (orders[-1] >> np.uint64(31)) ^ (x[at] * _M2))
    contexts = np.stack([orders[2], orders[4], whole[at]])
    return contexts, place[at], symbol[at], unit[used], number


class Tree:
    """A Huffman tree over bytes and the end (symbol 256): the way to each symbol as nodes and bits."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(n) + 1.0, k, (k,)) for k, n in enumerate(counts)]
        heapify(heap)
        ways: list[list[tuple[int, int]]] = [[] for _ in counts]
        for node in range(len(counts) - 1):
            left, right = heappop(heap), heappop(heap)
            for bit, side in enumerate((left, right)):
                for k in side[2]:
                    ways[k].append((node, bit))
            heappush(heap, (left[0] + right[0], len(counts) + node, left[2] + right[2]))
        self.depth = np.array([len(w) for w in ways])
        self.nodes, self.bits = np.zeros((len(counts), self.depth.max()), dtype=np.uint64), np.zeros((len(counts), self.depth.max()), dtype=np.int8)
        for k, way in enumerate(ways):
            for d, (node, bit) in enumerate(reversed(way)):
                self.nodes[k, d], self.bits[k, d] = node + 1, bit

    def bits_of(self, contexts: np.ndarray, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each bit of each step: (step, slot in each model, gate without its level, bit)."""
        depth = self.depth[symbol]
        row = np.repeat(np.arange(len(symbol)), depth)
        column = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
        code = np.repeat(symbol, depth)
        node, bit = self.nodes[code, column] * _M2, self.bits[code, column]
        slots = np.empty((MODELS, len(row)), dtype=np.int32)
        for m in range(MODELS):
            h = ((contexts[m] * (_M1 + np.uint64(2 * m))) ^ (contexts[m] >> np.uint64(29))) * _M2
            slots[m] = ((np.repeat(h, depth) + node) * _M1 >> np.uint64(64 - WIDTHS[m])).astype(np.int32) + STARTS[m]
        gate = np.repeat(np.minimum(place, 3) * DEPTHS, depth) + np.minimum(column, DEPTHS - 1)
        return row, slots, gate.astype(np.int32), bit


def batches_of(units: list[bytes], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of units that hold about ``most`` bytes, one unit at least."""
    first, held = 0, 0
    for k, u in enumerate(units):
        if k > first and held + len(u) > most:
            yield first, k
            first, held = k, 0
        held += len(u) + 1
    if first < len(units):
        yield first, len(units)


def parts_of(unit: bytes) -> Iterator[tuple[bytes, bool, bool]]:
    """A very long unit, a bounded number of bytes at a time: (part, whether it begins the unit, whether it ends it)."""
    for k in range(0, len(unit) + 1, AT_ONCE):
        yield unit[k : k + AT_ONCE], k == 0, k + AT_ONCE > len(unit)


def weighted_steps(units: list[bytes], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(contexts, place, symbol, weight) of the distinct steps, a bounded number of bytes at a time."""
    for x, y in batches_of(units):
        for own in parts_of(units[x]) if len(units[x]) > AT_ONCE else [(units[x:y],)]:
            contexts, place, symbol, unit, number = steps([own[0]], *own[1:]) if len(own) > 1 else steps(*own)
            yield contexts, place, symbol, np.bincount(number, weights[x:y][unit], len(symbol))


def count_tables(units: list[bytes], weights: np.ndarray, tree: Tree, tables: np.ndarray) -> None:
    """Add the units to tables[bit, slot]."""
    for contexts, place, symbol, weight in weighted_steps(units, weights):
        row, slots, _, bit = tree.bits_of(contexts, place, symbol)
        w, one = weight[row].astype(tables.dtype), bit.astype(bool)
        for m in range(MODELS):
            np.add.at(tables[0], slots[m][~one], w[~one])
            np.add.at(tables[1], slots[m][one], w[one])


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + np.float32(0.02)) / (n0 + np.float32(0.02))), -12, 12)


class Mixer:
    """Weights by gate, and the adaptive map that refines what they mix."""

    def __init__(self, gates: int, models: int):
        self.weights = np.full((gates, models), 0.2, dtype=np.float64)
        grid = (np.arange(BUCKETS) - (BUCKETS - 1) / 2) / 2
        self.map = np.tile(1 / (1 + np.exp(-grid)), (gates, 1))
        self.bend, self.held = np.zeros_like(self.weights), np.zeros_like(self.map)

    @staticmethod
    def cells(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(z * 2 + (BUCKETS - 1) / 2, 0, BUCKETS - 1.01)
        low = at.astype(np.int32)
        return low, at - low.astype(z.dtype)

    def learn(self, s: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One step online: mix, code, then move the weights and the map. s: stretched predictions (models, bits).

        Each gate's step is the gradient over the curvature that it has seen so far, so that steps shrink as evidence
        grows, whatever the numbers that bits stand for; the map's cells are means of the bits that they have seen.
        """
        gates, models = self.weights.shape
        z = np.zeros(len(gate), dtype=np.float32)
        for x, w in zip(s, np.ascontiguousarray(self.weights.T, dtype=np.float32)):
            z += x * w[gate]
        p = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
        error, bend = (bit - p) * weight, p * (1 - p) * weight
        self.bend += np.stack([np.bincount(gate, bend * x * x, gates) for x in s], axis=1)
        self.weights += np.stack([np.bincount(gate, error * x, gates) for x in s], axis=1) / (models * (self.bend + 500))
        low, share = self.cells(z)
        flat, held = self.map.reshape(-1), self.held.reshape(-1)
        for cell, part in ((low, (1 - share) * weight), (low + 1, share * weight)):
            at = gate * BUCKETS + cell
            hit = np.bincount(at, part, gates * BUCKETS)
            held += hit
            flat += (np.bincount(at, part * bit, gates * BUCKETS) - hit * flat) / (held + 20)
        np.clip(self.map, 1e-5, 1 - 1e-5, out=self.map)

    def probability(self, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """That the bit is one; mix and map have equal parts. Single precision."""
        z = np.zeros(len(gate), dtype=np.float32)
        for x, w in zip(s, np.ascontiguousarray(self.weights.T, dtype=np.float32)):
            z += x * w[gate]
        low, share = self.cells(z)
        flat, at = self.map.astype(np.float32).reshape(-1), gate * BUCKETS + low
        at0 = flat[at]
        refined = at0 + (flat[at + 1] - at0) * share
        return np.clip(np.float32(0.5) / (1 + np.exp(-np.clip(z, -20, 20))) + np.float32(0.5) * refined, np.float32(1e-6), np.float32(1 - 1e-6))

    def state(self) -> np.ndarray:
        return np.concatenate([self.weights.reshape(-1), self.map.reshape(-1)])

    def restore(self, state: np.ndarray) -> Mixer:
        n = self.weights.size
        self.weights, self.map = state[:n].reshape(self.weights.shape).copy(), state[n:].reshape(self.map.shape).copy()
        return self


class Firsts:
    """log10 of the probability of each first byte in each context, from counts (FIRSTS, 256)."""

    def __init__(self, counts: np.ndarray):
        words, gaps = counts[:WORD_STARTS].reshape(ENDINGS * 2, 256, 256), counts[WORD_STARTS:]
        blurred = [np.concatenate([np.repeat(words.sum(axis=1), 256, axis=0), np.repeat(gaps.sum(axis=0)[None], 256, axis=0)])]
        blurred.append(np.concatenate([np.tile(words.sum(axis=0), (ENDINGS * 2, 1)), np.repeat(gaps.sum(axis=0)[None], 256, axis=0)]))
        rows = np.nonzero(counts.any(axis=1))[0]  # all others are alike
        some = np.append(rows, -1)
        models = [np.concatenate([c[rows], (c[:WORD_STARTS:256].sum(axis=0) if c is not blurred[1] else c[:256].sum(axis=0))[None]]) for c in (counts, *blurred)]
        gate_of, mixer = np.searchsorted(LEVELS, models[0].sum(axis=1), side="right"), Mixer(8 * (len(LEVELS) + 1), 3)
        left = [c.astype(np.float64) for c in models]
        tree = []  # for each bit: zeros and ones of each node, in each model
        for b in range(8):
            halves = [c.reshape(len(some), 1 << b, 2, -1).sum(axis=3) for c in left]
            tree.append((np.stack([h[:, :, 0] for h in halves]), np.stack([h[:, :, 1] for h in halves])))
        gates = [np.repeat(gate_of * 8 + b, 1 << b) for b in range(8)]
        rng = np.random.default_rng(3)
        for _ in range(6):
            for b in rng.permutation(8).tolist():
                n0, n1 = (x.reshape(3, -1) for x in tree[b])
                for bit, weight in ((0, n0[0]), (1, n1[0])):
                    at = np.nonzero(weight)[0]
                    s = stretch(np.maximum(0, n0[:, at] - (1 - bit)), np.maximum(0, n1[:, at] - bit))
                    mixer.learn(s, gates[b][at], np.full(len(at), bit), weight[at])
        log = np.zeros((len(some), 256))
        for b in range(8):
            p = mixer.probability(stretch(*(x.reshape(3, -1) for x in tree[b])), gates[b]).reshape(len(some), 1 << b)
            both = np.stack([np.log10(1 - p), np.log10(p)], axis=2).reshape(len(some), -1)
            log += np.repeat(both, 256 >> (b + 1), axis=1)
        self.log10 = np.tile(log[-1].astype(np.float32), (FIRSTS, 1))
        self.log10[rows] = log[:-1]


class Model:
    """The counted tables as stretched predictions, the mixer and the first bytes."""

    def __init__(self, tables: np.ndarray, tree: Tree, mixer: Mixer, firsts: np.ndarray):
        self.tree, self.mixer, self.firsts = tree, mixer, firsts
        n0, n1 = tables
        self.levels = np.searchsorted(LEVELS, n0[STARTS[-1] :] + n1[STARTS[-1] :], side="right").astype(np.uint8)
        self.stretched = np.empty(SLOTS, np.float32)
        for k in range(0, SLOTS, 1 << 18):
            self.stretched[k : k + (1 << 18)] = stretch(n0[k : k + (1 << 18)], n1[k : k + (1 << 18)])

    def rest(self, units: list[bytes]) -> np.ndarray:
        """log10 of the probability of each unit after its first byte."""
        out = np.zeros(len(units))
        for x, y in batches_of(units):
            if len(units[x]) > AT_ONCE:
                out[x] = sum(self._rest([part], *rest)[0] for part, *rest in parts_of(units[x]))
            else:
                out[x:y] = self._rest(units[x:y])
        return out

    def _rest(self, units: list[bytes], begins: bool = True, ends: bool = True) -> np.ndarray:
        contexts, place, symbol, unit, number = steps(units, begins, ends)
        row, slots, gate, bit = self.tree.bits_of(contexts, place, symbol)
        gate = gate * (len(LEVELS) + 1) + self.levels[slots[-1] - STARTS[-1]]
        p = self.mixer.probability(self.stretched[slots], gate)
        log = np.bincount(row, np.log10(np.where(bit == 1, p, 1 - p)), len(symbol))
        return np.bincount(unit, log[number], len(units))


class Units:
    """The words and gaps of some texts, as arrays over all units in order.

    data holds the texts' bytes one after the other, begins where each starts, and at last the end.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        self.data, self.begins = data, begins
        space = _IS_GAP[data]
        new = np.empty(len(data) + 1, dtype=bool)
        new[1:-1] = space[1:] != space[:-1]
        new[begins] = True
        self.starts = np.nonzero(new[:-1])[0]
        self.ends = np.append(self.starts[1:], len(data)) if len(self.starts) else self.starts
        self.doc = np.repeat(np.arange(len(begins) - 1), np.diff(np.searchsorted(self.starts, begins)))
        self.gap = space[self.starts]
        self.size = self.ends - self.starts

    @classmethod
    def of(cls, texts: list[bytes]) -> Units:
        return cls(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)), dtype=np.int64)]))

    @cached_property
    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each unit, the bytes of each number)"""
        offsets = pa.py_buffer(np.append(self.starts, len(self.data)).astype(np.int64))
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, offsets, pa.py_buffer(self.data)])
        coded = whole.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary

    @cached_property
    def hashes(self) -> np.ndarray:
        """A hash of each distinct unit's bytes."""
        return hashed(self.distinct[1])

    def contexts(self) -> np.ndarray:
        """The context of each unit's first byte."""
        first, last, n = self.data[self.starts], self.data[self.ends - 1], len(self.starts)
        out = np.zeros(n, dtype=np.int32)
        line = np.zeros(n, dtype=np.int32)  # a gap that ends a line stands before
        alike = self.doc[1:] == self.doc[:-1]
        line[1:] = (last[:-1] == 10) & alike
        out[2:] = np.where(self.doc[2:] == self.doc[:-2], _ENDING[last[:-2]] * 512 + first[:-2], 0)
        out += line << 8
        gaps = np.nonzero(self.gap)[0]
        out[gaps] = WORD_STARTS
        after = gaps[gaps > 0]
        out[after] += np.where(alike[after - 1], last[after - 1], 0)
        return out

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first unit, one after the last unit) of each passage, in order; all units of a text are in one."""
        n = len(self.starts)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        h = self.hashes[self.distinct[0]]
        word = np.nonzero(~self.gap)[0]
        before = np.where(np.diff(self.doc[word], prepend=-1) == 0, np.roll(h[word], 1), np.uint64(0))  # the text's word before
        pair = (h[word] + before * np.uint64(3)) * _M2
        new = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        cut = word[(pair >> np.uint64(64 - ABOUT.bit_length() + 1)) == 0] + 1  # after a word, whatever stands around
        new[cut[cut < n]] = True
        first = np.nonzero(new)[0]
        rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        term = h * (_POWERS[rank & 4095] + (rank >> 12).astype(np.uint64) * _M2)
        total = np.add.reduceat(term ^ (term >> np.uint64(29)), first)
        return ((total ^ (total >> np.uint64(32))) * _M1).view(np.int64), first, np.append(first[1:], n)


def hashed(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value's bytes: of the first and the last eight, and for longer values of all."""
    ends = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], dtype=np.uint8)[: ends[-1]] if len(names) else np.empty(0, np.uint8)
    starts, ends = ends[:-1], ends[1:]
    size = ends - starts
    out = size.astype(np.uint64)
    for x in range(0, len(data), AT_ONCE):
        y = min(len(data), x + AT_ONCE)
        eight = np.concatenate([data[x : y + 7], np.zeros(7, np.uint8)]).astype(np.uint64)
        for step in (1, 2, 4):
            eight[:-step] |= eight[step:] << np.uint64(8 * step)  # eight bytes from each place on
        a, b = np.searchsorted(starts, (x, y))
        out[a:b] += (eight[starts[a:b] - x] & _MASKS[np.minimum(size[a:b], 8)]) * _M1
        a, b = np.searchsorted(ends - 8, (x, y))
        long = np.nonzero(size[a:b] > 8)[0] + a
        last = eight[ends[long] - 8 - x]
        out[long] += (last ^ (last >> np.uint64(33))) * _M2
    long = np.nonzero(size > 16)[0]
    for k in range(0, len(long), 1 << 10):
        group = long[k : k + (1 << 10)]
        for some in [group] if size[group].sum() < 4 * AT_ONCE else group.reshape(-1, 1):
            for x in range(0, int(size[some].max()), AT_ONCE) if len(some) == 1 else (0,):  # one very long value a bounded number of bytes at a time
                n = np.minimum(size[some] - x, AT_ONCE) if len(some) == 1 else size[some]
                place = x + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                term = (data[np.repeat(starts[some], n) + place].astype(np.uint64) + np.uint64(1)) * (_POWERS[place & 4095] + (place >> 12).astype(np.uint64) * _M2)
                out[some] += np.add.reduceat(term ^ (term >> np.uint64(29)), np.cumsum(n) - n)
    return (out ^ (out >> np.uint64(31))) * _M1


def units_of(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, Units]]:
    """(first row, one after the last, their units) of a column of texts, about ``most`` bytes at a time; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    begins = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if begins[-1] else np.empty(0, np.uint8)
    x = 0
    while x < len(column):
        y = max(x + 1, int(np.searchsorted(begins, begins[x] + most, side="right")) - 1)
        yield x, y, Units(data[begins[x] : begins[y]], begins[x : y + 1] - begins[x])
        x = y


def gathered(training: DataFrame, text: str) -> DataFrame:
    """(kind, unit, h, n): what all training texts hold, with its number.

    kind 0: units, words in their own case and gaps; 1: passages by their hash; 2: first bytes of units by context * 256 + byte;
    3: bytes after the first by their value, and ends of units, 256.
    """

    def rows(kind: int, units: pa.ChunkedArray | None, h: np.ndarray | None, n) -> pa.RecordBatch:
        n = n.combine_chunks() if isinstance(n, pa.ChunkedArray) else pa.array(n, pa.int64())
        unit = pa.nulls(len(n), pa.string()) if units is None else units.combine_chunks().cast(pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), unit, pa.nulls(len(n), pa.int64()) if h is None else pa.array(h, pa.int64()), n], names=["kind", "unit", "h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[pa.Table] = []
        waiting = 0
        firsts, symbols = np.zeros(FIRSTS * 256, dtype=np.int64), np.zeros(257, dtype=np.int64)
        for batch in batches:
            for _, _, u in units_of(batch.column(0)):
                number, names = u.distinct
                held.append(pa.table({"unit": names, "n": np.bincount(number, minlength=len(names))}))
                waiting += len(names)
                if waiting > 5 * KEPT:
                    held = [pa.concat_tables(held).group_by("unit", use_threads=False).aggregate([("n", "sum")]).rename_columns(["unit", "n"])]
                    waiting = held[0].num_rows
                    if waiting > 2 * KEPT:
                        yield rows(0, held[0]["unit"], None, held[0]["n"])
                        held, waiting = [], 0
                np.add.at(firsts, u.contexts() * 256 + u.data[u.starts], 1)
                symbols[:256] += np.bincount(u.data, minlength=256) - np.bincount(u.data[u.starts], minlength=256)
                symbols[256] += len(u.starts)
                h, a, b = u.passages()
                if len(h):
                    yield rows(1, None, *np.unique(h[u.ends[b - 1] - u.starts[a] >= LEAST_PASSAGE], return_counts=True))
        if held:
            units = pa.concat_tables(held).group_by("unit", use_threads=False).aggregate([("n", "sum")])
            yield rows(0, units["unit"], None, units["n_sum"])
        for kind, counts in ((2, firsts), (3, symbols)):
            some = np.nonzero(counts)[0]
            yield rows(kind, None, some, counts[some])

    return training.select(text).mapInArrow(count, "kind int, unit string, h bigint, n bigint").groupBy("kind", "unit", "h").agg(F.sum("n").alias("n"))


def train(units: DataFrame, firsts: np.ndarray, symbols: np.ndarray) -> Model:
    """Tables over all units, summed by slices; then the mixer over all units, in rounds of tasks whose weights are averaged."""
    spark, tree = units.sparkSession, Tree(symbols)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own = np.zeros((2, SLOTS), dtype=np.float32)
        for batch in batches:
            count_tables(batch.column(0).cast(pa.binary()).to_pylist(), np.asarray(batch.column(1), dtype=np.float64), tree, own)
        flat = own.reshape(-1, PIECE)
        some = np.nonzero(flat.any(axis=1))[0]
        for k in some.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(flat[k].tobytes(), 1)], pa.binary())], names=["piece", "counts"])

    def total(key, pieces):
        import pandas as pd

        out = np.zeros(PIECE)
        for x in pieces["counts"]:
            out += np.frombuffer(zlib.decompress(x), dtype=np.float32)
        return pd.DataFrame({"piece": [key[0]], "counts": [zlib.compress(out.astype(np.float32).tobytes(), 1)]})

    parts = units.mapInArrow(tables, "piece bigint, counts binary")
    summed = np.zeros((2 * SLOTS // PIECE, PIECE), dtype=np.float32)
    for r in parts.groupBy("piece").applyInPandas(total, "piece bigint, counts binary").collect():  # of a fixed size in all
        summed[r["piece"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.float32)
    summed = summed.reshape(2, SLOTS)
    shared, mixer = spark.sparkContext.broadcast(summed), Mixer(GATES, MODELS)
    for turn in range(ROUNDS):
        state = mixer.state()

        def learn(batches: Iterator[pa.RecordBatch], state=state, turn=turn) -> Iterator[pa.RecordBatch]:
            lean()
            n0, n1 = shared.value
            own, rng, learnt = Mixer(GATES, MODELS).restore(state), np.random.default_rng(turn), 0.0
            for batch in batches:
                for contexts, place, symbol, weight in weighted_steps(batch.column(0).cast(pa.binary()).to_pylist(), np.asarray(batch.column(1), dtype=np.float64)):
                    order = rng.permutation(len(symbol))
                    for k in range(0, len(order), 8192):
                        at = order[k : k + 8192]
                        row, slots, gate, bit = tree.bits_of(contexts[:, at], place[at], symbol[at])
                        zeros, ones = np.maximum(0, n0[slots] - (bit == 0)), np.maximum(0, n1[slots] - (bit == 1))  # without their own occurrence
                        gate = gate * (len(LEVELS) + 1) + np.searchsorted(LEVELS, zeros[-1] + ones[-1], side="right")
                        own.learn(stretch(zeros, ones), gate, bit, weight[at][row])
                    learnt += float(weight.sum())
            if learnt:
                yield pa.RecordBatch.from_arrays([pa.array([learnt]), pa.array([own.state().tolist()], pa.list_(pa.float64()))], names=["weight", "state"])

        # a state has GATES * (MODELS + BUCKETS) numbers; those of all tasks are summed before they come to the driver
        each = units.mapInArrow(learn, "weight double, state array<double>").select("weight", F.posexplode("state").alias("k", "x"))
        mean = each.groupBy("k").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x")).toArrow()
        if mean.num_rows:
            state[mean["k"].to_numpy()] = mean["x"].to_numpy()
            mixer.restore(state)
    shared.unpersist()
    return Model(summed, tree, mixer, Firsts(firsts).log10)


def _least_count(df: DataFrame, count: str) -> int:
    """The least count from which on at most FREQUENT rows lie; large counts are told apart by powers of two."""
    step = F.when(F.col(count) < 4096, F.col(count)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(count))).cast("bigint"))
    cut, have = 1 << 62, 0
    for c, k in sorted(((r["c"], r["k"]) for r in df.groupBy(step.alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True):
        if have + k > FREQUENT:
            break
        cut, have = c, have + k
    return cut


class Words:
    """Frequent units in the order of their hashes, with the counts of their lower case and their scores; others are scored as they come."""

    def __init__(self, model: Model, scale: float, names: pa.Array, counts: np.ndarray, rests: np.ndarray):
        h = hashed(names)
        order = np.argsort(h)
        self.model, self.hashes, self.names = model, h[order], names.take(pa.array(order))
        self.rests, self.base = rests[order].astype(np.float32), np.log10((counts[order] + 0.5) / scale)

    def look_up(self, names: pa.Array, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of some units: log10 of the probability after its first byte, of its base, and whether it is a frequent one."""
        rest, base, known = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names), dtype=bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            some = np.nonzero(self.hashes[at] == h)[0]
            at = at[some]
            alike = pc.equal(names.take(pa.array(some)), self.names.take(pa.array(at))).to_numpy(zero_copy_only=False)  # hashes only find them
            some, at = some[alike], at[alike]
            rest[some], base[some], known[some] = self.rests[at], self.base[at], True
        new = np.nonzero(~known)[0]
        if len(new):
            values = names.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()
            order = sorted(range(len(new)), key=values.__getitem__)  # units in order share their steps
            rest[new[order]] = self.model.rest([values[k] for k in order])
        return rest, base, known


_WORDS: dict[str, Words] = {}


def _words(model, shared) -> Words:
    """What a worker process has looked up for this model, kept from task to task."""
    key, scale, names, counts, rests = shared.value
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(model.value, scale, names, counts, rests)
    return _WORDS[key]


def own_words(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: how often its document held it before, and how many words it held before."""
    n = len(ids)
    before = np.zeros(n, dtype=np.int64)
    if not n:
        return before, before
    bits, names = n.bit_length(), int(ids.max()) + 1
    if (int(doc[-1]) + 1) * names >= 1 << (62 - bits):  # numbers too great for one key: they are made small first
        ids = ranked(ids)[1]
        names = int(ids.max()) + 1
    line = np.sort((doc * names + ids << bits) | np.arange(n))
    place, key = line & ((1 << bits) - 1), line >> bits
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    before[place] = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    begins = np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.arange(n), 0))
    return before, np.arange(n) - begins


def unit_logs(u: Units, model: Model, rest: np.ndarray) -> np.ndarray:
    """log10 of the probability of each unit, for each of SHARES (shares, units)."""
    number, _ = u.distinct
    log = model.firsts[u.contexts(), u.data[u.starts]] + rest[number]
    word = np.nonzero(~u.gap)[0]
    before, held = own_words(u.doc[word], number[word])
    out = np.tile(log, (len(SHARES), 1))
    seen, some = np.nonzero(before)[0], (held > 0).astype(np.float64)
    own, plain = before[seen] / held[seen], 10.0 ** np.maximum(log[word[seen]], -300)
    for k, share in enumerate(SHARES):
        part = log[word] + some * math.log10(1 - share)
        part[seen] = np.log10(share * own + (1 - share) * plain)
        out[k, word] = part
    return out


_PART = "n_tokens bigint, n_known bigint, base_score double, n_bytes bigint, n_passages bigint, n_big bigint, logs array<double>, rare array<struct<word:string,k:bigint>>, passages array<struct<h:bigint,k:bigint,logs:array<double>>>"


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Values, in order of their owners, as one list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


def _measured(u: Units, table: Words, end_known: int, go_on: float) -> list[pa.Array]:
    """The columns of _PART, without the end of the text, for a slice of texts."""
    n, kinds = len(u.begins) - 1, len(SHARES)
    number, names = u.distinct
    rest, base, frequent = table.look_up(names, u.hashes)
    logs = unit_logs(u, table.model, rest) + go_on  # and the text goes on
    word_doc = u.doc[~u.gap]
    whole = np.stack([np.bincount(u.doc, x, n) for x in logs])
    number = number[~u.gap]
    known = frequent[number]
    # words to be looked up in the table of all words
    at = np.nonzero(~known)[0]
    pair, k = np.unique(word_doc[at] * np.int64(1 << 32) + number[at], return_counts=True)
    folded = [x.lower() for x in names.take(pa.array(pair & 0xFFFFFFFF)).to_numpy(zero_copy_only=False).tolist()]
    rare = pa.StructArray.from_arrays([pa.array(folded, pa.binary()).cast(pa.string()), pa.array(k, pa.int64())], names=["word", "k"])
    # passages that may be found elsewhere
    h, a, b = u.passages()
    sums = np.add.reduceat(logs, a, axis=1) if len(a) else np.empty((kinds, 0))
    doc = u.doc[a] if len(a) else np.empty(0, np.int64)
    big = u.ends[b - 1] - u.starts[a] >= LEAST_PASSAGE if len(a) else np.empty(0, bool)
    order = np.nonzero(big)[0][np.lexsort((h[big], doc[big]))]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    first = np.nonzero(fresh)[0]
    own = np.add.reduceat(sums[:, order], first, axis=1) if len(first) else np.empty((kinds, 0))
    many = np.diff(np.append(first, len(order)))
    each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(first) * kinds + 1, kinds, dtype=np.int32)), pa.array(own.T.reshape(-1)))
    passages = pa.StructArray.from_arrays([pa.array(h[order][first]), pa.array(many, pa.int64()), each], names=["h", "k", "logs"])
    return [
        pa.array(np.bincount(word_doc, minlength=n) + 1), pa.array(np.bincount(word_doc, known, n).astype(np.int64) + end_known), pa.array(np.bincount(word_doc, base[number], n)),
        pa.array(np.diff(u.begins), pa.int64()), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, big, n).astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(np.arange(0, n * kinds + 1, kinds, dtype=np.int32)), pa.array(whole.T.reshape(-1))), _lists(pair >> 32, n, rare), _lists(doc[order][first], n, passages),
    ]


def scored(docs: DataFrame, training: F.Column, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but for the text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    The model and the counts come from the rows where ``training`` holds. A null text is empty: it has the
    end token only, its score is that of the end, and it has null bits per byte. Without any training row all counts are
    zero. Rows stay, repeated ones too; columns of the new names are replaced, any others stay.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")]
    taught = docs.where(training).select(F.col(text).alias("text"))
    counted = checkpointed(gathered(taught, "text"))
    units = counted.where("kind = 0").select("unit", "n")
    n_units, n_distinct = units.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = units.where(~F.substring("unit", 1, 1).isin(*_GAP.decode())).groupBy(fold_ascii(F.col("unit")).alias("word")).agg(F.sum("n").alias("c"))
    words = checkpointed(words)
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = taught.count()
    n_all, distinct = n_words + ends, distinct + (ends > 0)
    scale = n_all + 0.5 * (distinct + 1)
    firsts, symbols = np.zeros(FIRSTS * 256), np.zeros(257)
    for kind, counts in ((2, firsts), (3, symbols)):
        found = counted.where(F.col("kind") == kind).toArrow()  # FIRSTS * 256, or 257, at most
        counts[found["h"].to_numpy()] = found["n"].to_numpy()
    held = counted.where("kind = 1").select("h", F.col("n").alias("c"))
    all_passages = held.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    model = spark.sparkContext.broadcast(train(units.coalesce(1 + n_distinct // UNITS_IN_A_TASK).sortWithinPartitions("unit"), firsts.reshape(FIRSTS, 256), symbols))
    often = units.where(F.col("n") >= _least_count(units, "n")).select("unit", fold_ascii(F.col("unit")).alias("word")).join(words, "word", "left")
    often = often.select("unit", F.coalesce("c", F.lit(0)).alias("c")).sortWithinPartitions("unit")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rest = model.value.rest(batch.column(0).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rest.astype(np.float32))], names=["unit", "c", "rest"])

    often = often.mapInArrow(score, "unit string, c bigint, rest float").toArrow()  # FREQUENT rows at most; gaps have no count
    names = often["unit"].combine_chunks().cast(pa.binary()).cast(pa.large_binary())
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, scale, names, often["c"].to_numpy().astype(np.float64), often["rest"].to_numpy()))
    stop = (ends + 0.5) / (n_units + ends + 1.0)
    end_lm, go_on, which = math.log10(stop), math.log10(1 - stop), math.log10(0.5)
    end_base = math.log10((ends + 0.5) / scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table = _words(model, shared)
        for batch in batches:
            for x, y, u in units_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), batch.column(2).slice(x, y - x), *_measured(u, table, int(ends > 0), go_on)], names=names)

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("")).alias("row"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("taught"))
    schema = with_fields(packed.select("row", "taught"), _PART)
    names = schema.fieldNames()
    part = checkpointed(packed.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()))
    rare = part.select("id", F.explode("rare").alias("r")).select("id", "r.word", "r.k")
    joined = rare.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = joined.groupBy("id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(scale))).alias("more_base"),
    )
    own = part.select("id", "taught", "n_big", F.explode("passages").alias("p")).select("id", "taught", "n_big", "p.h", "p.k", "p.logs")
    others = own.join(held, "h").withColumn("c", F.col("c") - F.when(F.col("taught"), F.col("k")).otherwise(F.lit(0))).where("c > 0")
    named = F.col("k") * F.log10(F.col("c") / (F.lit(all_passages) - F.when(F.col("taught"), F.col("n_big")).otherwise(F.lit(0))))
    copied = others.groupBy("id").agg(F.sum("k").alias("copied"), F.sum(named).alias("named"), *(F.sum(F.col("logs")[k]).alias(f"spelled{k}") for k in range(len(SHARES))))
    out = part.drop("rare", "passages").join(more, "id", "left").join(copied, "id", "left").fillna(0, ["more_known", "more_base", "copied", "named", *(f"spelled{k}" for k in range(len(SHARES)))])
    # the bits that tell copies: the document's copies so far predict the next, beforehand 0.02 against 1
    beta = lambda x, y: _log_gamma(x) + _log_gamma(y) - _log_gamma(x + y)
    told = (beta(F.col("copied") + 0.02, F.col("n_passages") - F.col("copied") + 1.0) - F.lit(math.lgamma(0.02) + math.lgamma(1.0) - math.lgamma(1.02))) / math.log(10)
    spelled = [F.col("logs")[k] - F.col(f"spelled{k}") for k in range(len(SHARES))]
    best = F.greatest(*spelled)
    mixed = best + F.log10(reduce(lambda x, y: x + y, (F.pow(F.lit(10.0), x - best) for x in spelled)) / len(SHARES))
    score = F.when(F.col("n_bytes") > 0, mixed + told + F.col("named") + F.col("copied") * go_on + which).otherwise(F.lit(0.0)) + end_lm
    return unpacked(
        out.withColumn("score", score), "row", rest, "n_tokens", (F.col("n_known") + F.col("more_known")).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("more_base") + end_base).alias("base_score"), "score", F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _log_gamma(x: F.Column) -> F.Column:
    """The logarithm of the gamma function for x > 0: Stirling's series at x + 8, then down again."""
    y, low = x + 8.0, reduce(lambda a, b: a * b, (x + float(k) for k in range(8)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - F.log(low)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    from sheaf.llm.util import fold_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs, fold_of("doc_id") != HELD_OUT)
    return found.withColumn("held_out", fold_of("doc_id") == HELD_OUT).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")

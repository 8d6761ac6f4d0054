"""Language-model scores by online logistic context mixing."""

from __future__ import annotations

import heapq
import math
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.functions.positions import assign_ids
from tillspark.llm.common import Shipped, fold_of, mix64
from tillspark.session import materialize, shuffle_width

SLICE_BYTES = 3_000_000
SLICE_TEXTS = 4_096
#: Words that are hashed at once, and bits that are mixed at once.
HASHED = 1 << 13
MIXED = 1 << 14
#: Contexts of a unit that its tables begin with room for.
KEYS = 1 << 17
#: Bytes of distinct words that are predicted together.
UNIT_BYTES = 1 << 17
#: Text characters for each range of words, as long as that makes no more than twice the shuffle's
#: partitions; ranges follow the first bytes of a word.
RANGE_CHARS = 1 << 23
LEAST_RANGES = 24
RANGE_PREFIX = 24
#: Words that wait in a task of the lexicon, and rows it hands over at once.
LEXICON_WORDS = 400_000
LEXICON_ROWS = 20_000
#: The weights pass over one unit in so many, then go on from there over the next part; the last is all.
ROUNDS = (4, 1)
#: Predictors of a bit. Contexts: 3 bytes back and the class of the text so far; 4 bytes back; the
#: word so far; the word so far and the class.
PREDICTORS = 4
#: Places of the two small predictors of repeats, which have no collisions.
PLACES = 256
LEVELS = 8
GATES = LEVELS * LEVELS
STEPS = 33
RATE = 0.02
BATCH = 4_096
DELTA = 0.4
BLOCK = 64
LOG2 = math.log(2)
SEED = 977
PAIRS = 511
CLASSES = 6
MARKERS = 512
#: A text with fewer markers is no start of a class.
LEAST_MARKED = 20
CLASS_ROUNDS = 15
LEVELS_OF_PLACE = 32
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KINDS = CLASSES + 1
_U32 = np.uint32
_U64 = np.uint64


def _paths(counts: np.ndarray) -> list[list[int]]:
    """A prefix code for symbols 0 .. n-1: of each the steps, inner node times two plus bit."""
    heap = [(float(c), k, (k,)) for k, c in enumerate(counts)]
    paths: list[list[int]] = [[] for _ in counts]
    heapq.heapify(heap)
    node = 0
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, one), (1, two)):
            for symbol in side[2]:
                paths[symbol].append(2 * node + bit)
        heapq.heappush(heap, (one[0] + two[0], min(one[1], two[1]), one[2] + two[2]))
        node += 1
    return [path[::-1] for path in paths]


class Coder:
    """The byte code, the classes of texts, the bounds of ranges, and tables for hashing.

    After each of the PAIRS commonest pairs of bytes a byte has a prefix
    code of its own, with an escape to the common one. Any prefix code gives
    valid probabilities; a fitted one means fewer predictions a byte.
    Classes are clusters of texts by the MARKERS commonest words. All of
    this is fitted on counts over the training texts, see `fit_code` and
    `fit_classes`; given texts, the code is fitted on them alone.
    """

    def __init__(self, texts: list[bytes] | None = None):
        rng = np.random.default_rng(SEED)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.turn = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.powers = np.ones(1, np.uint64)
        self.markers, self.odds = np.zeros(0, np.uint64), np.zeros((1, CLASSES), np.float32)
        self.bounds = np.zeros(0, f"S{RANGE_PREFIX}")  # where ranges of words begin
        if texts:
            words = Words(texts, self)
            spelling = Spelling(words.flat, words.start[1:], words.size[1:])
            count = np.bincount(words.codes, minlength=len(words.hashes))[1:]
            first = byte_counts(spelling, count)
            self.fit_code(first, byte_counts(spelling, count, commonest_pairs(first)))

    def fit_code(self, first: np.ndarray, after: np.ndarray) -> None:
        """By the counts that `byte_counts` gives without and with the commonest pairs."""
        common = first[:256] + 0.1
        common[:32] = 0.01
        plain = _paths(common)
        pairs = commonest_pairs(first)
        self.pair = np.zeros(1 << 16, np.int64)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        after = after.reshape(len(pairs) + 1, 256)
        steps: list[int] = []
        self.size = np.zeros((len(pairs) + 1, 256), np.int64)
        self.first = np.zeros((len(pairs) + 1, 256), np.int64)
        for k in range(len(pairs) + 1):
            seen = np.flatnonzero(after[k]) if k else np.zeros(0, np.int64)
            own = _paths(np.append(after[k][seen], 0.5)) if k else [[]]
            place = {int(b): i for i, b in enumerate(seen)}
            for byte in range(256):
                path = own[place[byte]] if byte in place else own[-1] + [512 + x for x in plain[byte]]
                self.first[k, byte], self.size[k, byte] = len(steps), len(path)
                steps += path
        self.steps = np.array(steps, np.uint32)

    def fit_classes(self, marked: DataFrame) -> None:
        """Spherical k-means of all texts of `marked`, begun with texts far from each other.

        The driver sees a candidate a task for each start, and sums of CLASSES x MARKERS numbers.
        """
        width = len(self.markers)
        picked: list[np.ndarray] = []
        while len(picked) < CLASSES:
            found = marked.mapInPandas(_start(picked, width), "score double, a binary")
            best = found.orderBy("score", "a").limit(1).collect()
            if not best:
                self.markers = self.markers[:0]
                return
            picked.append(_unit(np.frombuffer(best[0]["a"], "<u4")))
        centre = np.stack(picked)
        for _ in range(CLASS_ROUNDS):
            sums, held = _total(marked.mapInPandas(_near(centre), "part long, a binary"), "part").reshape(2, CLASSES, width)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            before, centre = centre, np.where(length > 0, sums / np.maximum(length, 1e-9), centre)
            if np.array_equal(before, centre):
                break
        held = held.T + 0.5
        self.odds = np.vstack([np.log(held / held.sum(0)), np.zeros((1, CLASSES))]).astype(np.float32)

    def power(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            steps = np.full(max(n, 1024), self.turn, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
        return self.powers

    def classes(self, words: Words) -> np.ndarray:
        """Class of the text before each word: 0 early on, else 1 + the likeliest by its words.

        Looked at after 4, 8, 16, ... words, so that it seldom changes.
        """
        n = len(words.codes)
        if not len(self.markers):
            return np.zeros(n, np.int64)
        at = np.minimum(np.searchsorted(self.markers, words.hashes), len(self.markers) - 1)
        row = np.where(self.markers[at] == words.hashes, at, len(self.markers))
        place = _places(words.lengths)
        level = np.frexp(np.arange(place.max(initial=0) + 1).astype(np.float32))[1].astype(np.int64)
        step = words.text * LEVELS_OF_PLACE + level[place]
        marked = np.flatnonzero(row[words.codes] < len(self.markers))
        odds, at = self.odds[row[words.codes[marked]]], step[marked]
        shape = len(words.lengths), LEVELS_OF_PLACE
        sums = np.stack([np.bincount(at, o, shape[0] * shape[1]) for o in odds.T], 1).reshape(*shape, -1)
        best = 1 + np.cumsum(sums, axis=1).argmax(2)  # by the words of this level and before
        likely = np.zeros(shape, np.int64)
        likely[:, 3:] = best[:, 2:-1]
        return likely.ravel()[step]


class Words:
    """The words of several texts: codes in order with an end after each text, and every distinct word.

    Code 0 is the end; a word's bytes are those of its first occurrence.
    """

    def __init__(self, texts: list[bytes], coder: Coder):
        flat = coder.lower[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        blank = coder.blank[flat]
        before = np.ones(len(flat), bool)
        before[1:] = blank[:-1]
        start = np.flatnonzero(~blank & before)
        after = np.ones(len(flat), bool)
        after[:-1] = blank[1:]
        size = np.flatnonzero(~blank & after) + 1 - start
        edges = np.cumsum([len(t) + 1 for t in texts])
        count = np.diff(np.searchsorted(start, edges), prepend=0)
        hashes = np.zeros(len(start), np.uint64)
        for low in range(0, len(start), HASHED):
            begin, long = start[low:low + HASHED], size[low:low + HASHED]
            own = flat[begin[0]:begin[-1] + long[-1]]
            begin = begin - begin[0]
            place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
            terms = coder.letters[own]
            terms *= coder.power(int(place.max()) + 1)[place]
            sums = np.append(np.uint64(0), np.cumsum(terms))
            hashes[low:low + HASHED] = mix64(sums[begin + long] - sums[begin] + long.astype(np.uint64))
        codes, self.hashes = pd.factorize(hashes)
        self.hashes = np.append(np.uint64(0), self.hashes.astype(np.uint64))
        first = np.zeros(len(self.hashes), np.int64)
        first[codes[::-1] + 1] = np.arange(len(codes))[::-1]
        self.flat, self.start = flat, start[first] if len(start) else first
        self.size = size[first] if len(start) else first
        self.size[0] = 0
        self.lengths = count + 1
        ends = np.cumsum(self.lengths) - 1
        self.codes = np.zeros(len(codes) + len(texts), np.int64)
        inner = np.ones(len(self.codes), bool)
        inner[ends] = False
        self.codes[inner] = codes + 1
        self.text = np.repeat(np.arange(len(texts)), self.lengths)


def _index(n: int) -> type:
    """Numbers for places among n, as short as they may be."""
    return np.int32 if n < 1 << 31 else np.int64


def _places(lengths: np.ndarray) -> np.ndarray:
    """The place of every word in its text."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _prefixes(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first RANGE_PREFIX bytes of words, in an array that sorts as the words do."""
    out = np.zeros((len(start), RANGE_PREFIX), np.uint8)
    for k in range(RANGE_PREFIX):
        long = np.flatnonzero(size > k)
        out[long, k] = flat[start[long] + k]
    return out.view(f"S{RANGE_PREFIX}").ravel()


def _shared_lengths(words: Spelling, at: int) -> np.ndarray:
    """How many first bytes each word has in common with one of them."""
    length = np.zeros(len(words.size), np.int64)
    alike = np.arange(len(words.size))
    for k in range(int(words.size[at])):
        alike = alike[words.size[alike] > k]
        alike = alike[words.flat[words.start[alike] + k] == words.flat[words.start[at] + k]]
        length[alike] = k + 1
    return length


@dataclass
class Marks:
    """Of texts with a marker: the markers that each holds, how often, and the text's direction."""

    start: np.ndarray
    held: np.ndarray
    marker: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, row) -> Marks:
        held = _unplanes(row.a).astype(np.int64)
        return cls(np.cumsum(held) - held, held, _unplanes(row.b, 2).astype(np.int64), _unplanes(row.c).astype(np.float64))

    def sums(self) -> np.ndarray:
        return np.add.reduceat(self.count, self.start)

    def units(self) -> np.ndarray:
        return np.sqrt(self.count) / np.repeat(np.sqrt(self.sums()), self.held)

    def likeness(self, unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Cosines, rounded, so that they do not depend on how texts lie in slices."""
        return np.round(np.stack([np.add.reduceat(unit * c[self.marker], self.start) for c in centre], 1), 9)

    def rows(self, texts: np.ndarray, width: int) -> np.ndarray:
        """Counts of all markers in some texts."""
        out = np.zeros((len(texts), width), "<u4")
        for counts, low, n in zip(out, self.start[texts], self.held[texts]):
            counts[self.marker[low:low + n]] = self.count[low:low + n]
        return out


def _unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts.astype(np.float64) / counts.sum())


def _marked(coded: Shipped):
    """Of every text with a marker how often it holds each, by slice."""

    def run(frames):
        markers = coded.value.markers
        for frame in frames:
            for _, texts in _slices(frame):
                words = Words(texts, coded.value)
                at = np.minimum(np.searchsorted(markers, words.hashes), len(markers) - 1)
                at = np.where(markers[at] == words.hashes, at, -1)[words.codes]
                used = at >= 0
                counts = np.bincount(words.text[used] * len(markers) + at[used], minlength=len(texts) * len(markers))
                place = np.flatnonzero(counts)
                if len(place):
                    held = np.bincount(place // len(markers))
                    yield pd.DataFrame({"a": [_planes(held[held > 0])], "b": [_planes(place % len(markers), 2)], "c": [_planes(counts[place])]})

    return run


def _start(picked: list[np.ndarray], width: int):
    """A task's text with most markers, or, given picked ones, that least like any of them."""

    def run(frames):
        best = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                marks = Marks.of(row)
                sums = marks.sums()
                score = marks.likeness(marks.units(), np.stack(picked)).max(1) if picked else -sums
                score = np.where(sums >= LEAST_MARKED, score, np.inf)
                low = score.min()
                if low == np.inf or best and best[0] < low:
                    continue
                one = float(low), min(r.tobytes() for r in marks.rows(np.flatnonzero(score == low), width))
                best = one if best is None else min(best, one)
        if best:
            yield pd.DataFrame({"score": [best[0]], "a": [best[1]]})

    return run


def _near(centre: np.ndarray):
    """Sums of the texts nearest to each centre, of their directions and of their counts.

    Directions are whole numbers here, so that sums do not depend on their order.
    """

    def run(frames):
        sums = np.zeros((2, centre.size))
        for frame in frames:
            for row in frame.itertuples(index=False):
                marks = Marks.of(row)
                unit = marks.units()
                near = marks.likeness(unit, centre).argmax(1)
                place = np.repeat(near * centre.shape[1], marks.held) + marks.marker
                sums[0] += np.bincount(place, np.rint(unit * (1 << 20)), centre.size)
                sums[1] += np.bincount(place, marks.count, centre.size)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 64], "a": [sums.tobytes()]})

    return run


def _lexicon(coded: Shipped):
    """Distinct words: hash, first bytes, and how often they occur.

    A task adds up its slices until LEXICON_WORDS words wait, so that Spark gets most of its words once.
    """

    def merged(waiting):
        hashes, count, spelt = (np.concatenate(x) for x in zip(*waiting))
        hashes, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        return hashes, np.bincount(code, count, len(hashes)).astype(np.int64), spelt[first]

    def handed(hashes, count, spelt):
        for low in range(0, len(hashes), LEXICON_ROWS):
            now = slice(low, low + LEXICON_ROWS)
            yield pd.DataFrame({"hash": hashes[now].view(np.int64), "n": count[now], "spelt": spelt[now].tolist()})

    def run(frames):
        waiting = []
        for frame in frames:
            for _, texts in _slices(frame):
                words = Words(texts, coded.value)
                count = np.bincount(words.codes, minlength=len(words.hashes))
                waiting.append((words.hashes[1:], count[1:], _prefixes(words.flat, words.start[1:], words.size[1:])))
                if sum(len(x[0]) for x in waiting) > LEXICON_WORDS:
                    waiting = [merged(waiting)]
                    if len(waiting[0][0]) > LEXICON_WORDS // 2:
                        yield from handed(*waiting.pop())
        if waiting:
            yield from handed(*merged(waiting))

    return run


def _bounds(lexicon: DataFrame, ranges: int) -> np.ndarray:
    """Where ranges of words begin, so that the distinct training words fill them alike."""
    total = lexicon.count()
    at = sorted({k * total // ranges + 1 for k in range(1, ranges)})
    # Words of one beginning are in any order, which does not change what stands at a place.
    numbered = assign_ids(lexicon.select("spelt"), ["spelt"], "place")
    # At most one row a range.
    found = numbered.filter(F.col("place").isin(at)).select("spelt").collect() if total else []
    return np.sort(np.array([bytes(r["spelt"]) for r in found], f"S{RANGE_PREFIX}"))


def byte_counts(words: Spelling, weight: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Counts of the bytes of words and the blank after each, every word as often as its weight says.

    Of bytes (256) and of the two bytes before each (65,536); given pairs, of each byte after each pair,
    row 0 for all others.
    """
    size = words.size + 1
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    at = np.minimum(np.repeat(words.start, size) + place, len(words.flat) - 1)
    byte = words.flat[at].astype(np.int64)
    byte[begin + size - 1] = 32
    one = np.where(place >= 1, np.append(0, byte)[: len(byte)], 0)
    two = np.where(place >= 2, np.append([0, 0], byte)[: len(byte)], 0)
    often = np.repeat(weight, size)
    if pairs is None:
        return np.append(np.bincount(byte, often, 256), np.bincount(one + 256 * two, often, 1 << 16))
    row = np.zeros(1 << 16, np.int64)
    row[pairs] = np.arange(1, len(pairs) + 1)
    return np.bincount(row[one + 256 * two] * 256 + byte, often, (len(pairs) + 1) * 256)


def commonest_pairs(first: np.ndarray) -> np.ndarray:
    held = first[256:]
    order = np.argsort(-held, kind="stable")[:PAIRS]
    return np.sort(order[held[order] > 0])


def _unit_bytes(pairs: np.ndarray | None):
    """`byte_counts` of a task's units."""

    def run(frames):
        total = 0.0
        for frame in frames:
            for _, row in frame.iterrows():
                size, held = _unplanes(row["b"]).astype(np.int64), _unplanes(row["c"], 1)
                weight = np.bincount(np.repeat(np.arange(len(size)), held), _unplanes(row["e"], 8), len(size))
                words = Spelling(np.append(_unplanes(row["a"], 1), np.uint8(0)), np.cumsum(size) - size, size)
                total = total + byte_counts(words, weight, pairs)
        if np.ndim(total):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 64], "a": [total.tobytes()]})

    return run


@dataclass
class Spelling:
    """The bytes of distinct words."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray


def bit_rows(words: Words | Spelling, which: np.ndarray, kind: np.ndarray, coder: Coder) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The coded bits of some words in texts of some class: word position, 64-bit keys of (context, node) per predictor, bit."""
    return placed_bit_rows(words, which, kind, coder)[:3]


def placed_bit_rows(words: Words | Spelling, which: np.ndarray, kind: np.ndarray, coder: Coder) -> tuple:
    """`bit_rows`, and how many bytes of the word came before each bit."""
    size = words.size[which] + 1
    owner = np.repeat(np.arange(len(which)), size)
    begin = np.cumsum(size) - size
    place = np.arange(len(owner)) - np.repeat(begin, size)
    byte = words.flat[np.minimum(np.repeat(words.start[which] - begin, size) + np.arange(len(owner)), len(words.flat) - 1)].astype(np.int64)
    byte[begin + size - 1] = 32
    back = [np.where(place >= k, np.concatenate([np.zeros(k, np.int64), byte])[: len(byte)], 0) for k in (1, 2, 3, 4)]
    terms = coder.letters[byte] * coder.power(int(place.max(initial=0)) + 1)[place]
    so_far = np.cumsum(terms) - terms
    so_far = so_far - np.repeat(so_far[begin], size) + place.astype(_U64)
    pair = back[0] + (back[1] << 8)
    three = pair + (back[2] << 16)
    own = kind[owner].astype(_U64)
    contexts = [
        three.astype(_U64) + (own << _U64(40)), (three + (back[3] << 24)).astype(_U64) + _U64(1 << 50),
        so_far + _U64(1 << 60), so_far + (own + _U64(1)) * _U64(0x9E3779B97F4A7C15),
    ]
    code = coder.pair[pair]
    bits = coder.size[code, byte]
    edge = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(byte), dtype=_index(len(byte))), bits)
    steps = coder.steps[np.repeat(coder.first[code, byte] - edge, bits) + np.arange(len(of))]
    node = (steps >> _U32(1)).astype(_U64) * _U64(0xD6E8FEB86659FD93)
    keys = [np.add(key := mix64(context)[of], node, out=key) for context in contexts]
    return owner.astype(_index(len(which)))[of], keys, (steps & _U32(1)).astype(np.int8), place.astype(_index(len(byte)))[of]


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _level(n: np.ndarray) -> np.ndarray:
    """How much was counted: 0, 1, 2, 3 to 4, up to 10, 30, 100, more."""
    return np.searchsorted(np.array([0.5, 1.5, 2.5, 4.5, 10.5, 30.5, 100.5]), n).astype(np.int64)


def _first_weights() -> np.ndarray:
    """Weights to start from: the word so far by how much it was seen, the rest to the bytes back."""
    whole = np.array([0.0, 0.2, 0.4, 0.5, 0.65, 0.75, 0.85, 0.95])
    classed, plain = whole[:, None], whole[None, :] * 0.9
    rest = (1 - classed) * (1 - plain)
    return np.stack([0.55 * rest, 0.55 * rest, (1 - classed) * plain, classed + 0 * plain], 2).reshape(GATES, -1)


def _mixed(inputs: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = weights[:, 0].take(gate)
    total *= inputs[0]
    for k in range(1, len(inputs)):
        term = weights[:, k].take(gate)
        term *= inputs[k]
        total += term
    return np.clip(total, -12, 12, out=total)


def _steps(score: np.ndarray) -> np.ndarray:
    return np.rint((score + 12) * ((STEPS - 1) / 24)).astype(np.int64)


@dataclass
class Sequence:
    """The words of a slice's texts by rank, without their bytes."""

    codes: np.ndarray
    lengths: np.ndarray
    size: np.ndarray
    text: np.ndarray


class Repeats:
    """For every word of a sequence: whether and how often its text had it before, and the contexts of that."""

    def __init__(self, words: Words | Sequence):
        n = len(words.codes)
        # Text, word and place in one number: a slice has either few texts and bytes or one text.
        bits = n.bit_length()
        key = np.sort((words.text * len(words.size) + words.codes << bits) + np.arange(n))
        order = key & ((1 << bits) - 1)
        key >>= bits
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        rank = np.arange(n) - np.flatnonzero(new)[group] if n else np.zeros(0, np.int64)
        self.seen = np.empty(n, np.int64)
        self.seen[order] = rank
        self.place = _places(words.lengths)
        self.flag = (self.seen > 0).astype(np.uint8)
        runs = np.zeros(n, np.uint8)
        for k in range(4):  # whether the words 1 to 4 places back were repeats
            runs[k + 1:] += (self.flag[:max(0, n - k - 1)] << k) * (self.place[k + 1:] > k)
        before = np.where(self.place >= 1, np.concatenate([[0], words.codes[:-1]]), 0) if n else words.codes
        deep = np.minimum(np.log2(np.arange(1, self.place.max(initial=0) + 2)).astype(np.int64), 15)[self.place]
        length = np.minimum(words.size[before], 15)
        self.before = before  # the word before, the first predictor of the odds
        self.slots = [deep * 16 + runs, length * 16 + deep]  # places of the others


class Learner:
    """Counts of a task's training words: of each slice by word and class, of all slices for the places of repeats."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.bounds = coder.bounds
        self.repeats = np.zeros((2, PLACES, 2))
        self.words = 0.0

    def ranges(self, words: Words) -> np.ndarray:
        """The range of every distinct word by its first bytes; the end is in the first."""
        return np.searchsorted(self.bounds, _prefixes(words.flat, words.start, words.size), side="right")

    def learn(self, words: Words, training: np.ndarray) -> tuple[np.ndarray, ...]:
        """`training` marks the texts to learn from.

        Returns the words' order by range and hash, their ranges in that order, the slice's (rank, class) pairs, the pair of each place,
        training counts of pairs, and how often a text's new and repeated words followed each word.
        """
        bucket = self.ranges(words)
        order = np.argsort(words.hashes)
        order = order[np.argsort(bucket[order].astype(np.min_scalar_type(len(self.bounds))), kind="stable")]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at, pairs = pd.factorize(rank[words.codes] * _KINDS + self.coder.classes(words))
        by = np.argsort(pairs)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        at, pairs = place[at], pairs[by]
        mine = np.repeat(training, words.lengths)
        count = np.bincount(at[mine], minlength=len(pairs))
        repeats = Repeats(words)
        rest = np.flatnonzero(mine & (repeats.place > 0))
        for table, slot in zip(self.repeats, repeats.slots):
            table += np.bincount(slot[rest] * 2 + repeats.flag[rest], minlength=2 * PLACES).reshape(PLACES, 2)
        after = np.bincount(rank[repeats.before[rest]] * 2 + repeats.flag[rest], minlength=2 * len(rank)).reshape(-1, 2)
        self.words += float(mine.sum())
        return order, bucket[order], pairs, at, count, after


def _stretched(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + DELTA) / (zero + DELTA))


class Mixer:
    """Mixing weights that learn as bits pass."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = _first_weights() if weights is None else weights.copy()
        self.refined = np.zeros((GATES, STEPS, 2))
        self.mass = 0.0

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """Steps on bits, each with what its predictors say and their gate by the counts of all other bits."""
        step = np.empty(len(bit), np.int16)
        for low in range(0, len(bit), BATCH):
            now = slice(low, low + BATCH)
            g, x, w = gate[now], [i[now] for i in inputs], weight[now]
            score = _mixed(x, g, self.weights)
            slope = (bit[now] - _squash(score)) * w
            mass = np.bincount(g, w, GATES) + 100
            step[now] = _steps(score)
            for k, values in enumerate(x):
                self.weights[:, k] += RATE * np.bincount(g, slope * values, GATES) / mass
        self.refined += np.bincount((gate.astype(np.int32) * STEPS + step) * 2 + bit, weight, self.refined.size).reshape(self.refined.shape)
        self.mass += float(weight.sum())

    def state(self) -> np.ndarray:
        return np.concatenate([(self.weights * self.mass).ravel(), self.refined.ravel(), [self.mass]])


def averaged(state: np.ndarray) -> np.ndarray:
    """The weights out of the summed states of all units."""
    weights = state[:GATES * PREDICTORS] / state[-1] if state[-1] else _first_weights()
    return weights.reshape(GATES, -1).copy()


class Model:
    """The weights, and the counts of the small predictors of repeats. Counts of contexts stay in tables."""

    def __init__(self, state: np.ndarray, repeats: np.ndarray):
        self.weights = averaged(state)
        refined = state[GATES * PREDICTORS:-1].reshape(GATES, STEPS, 2)
        prior = _squash(np.linspace(-12, 12, STEPS))[None, :]
        # Where the mixed score was seen often, the share of ones that followed it refines it.
        self.refined = (refined[:, :, 1] + 20 * prior) / (refined.sum(2) + 20)
        self.repeats = _stretched(repeats[:, :, 0], repeats[:, :, 1])

    def word_bits(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Bits of n words, from those of their coded bits."""
        out = np.empty(len(bit))
        for low in range(0, len(bit), MIXED):
            now = slice(low, low + MIXED)
            score = _mixed([x[now] for x in inputs], gate[now], self.weights)
            p = 0.5 * (_squash(score) + self.refined[gate[now], _steps(score)])
            p = np.clip(np.where(bit[now] == 1, p, 1 - p), 2.0**-16, 1)
            out[now] = -np.log2(p)
        return np.bincount(owner, out, n)

    def score(self, words: Sequence, spelled: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Bits of every text, from those of the words in place and the odds of repeats after each word.

        A word is taken from the text so far or spelled. The odds of that
        are mixed from the repeat predictors by weights that start alike in
        every text and learn after each block of BLOCK words.
        """
        follow = Repeats(words)
        texts = len(words.lengths)
        inputs = np.stack([after[follow.before], *(t[s] for t, s in zip(self.repeats, follow.slots))], 1)
        weights = np.full((texts, inputs.shape[1]), 0.4, np.float32)
        share = follow.seen / np.maximum(1, follow.place)
        spell = np.exp2(-spelled)
        bits = np.zeros(texts)
        block = follow.place // BLOCK
        if block.max(initial=0) < 1 << 16:
            block = block.astype(np.uint16)  # sorted by its digits
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(int(block.max()) + 2 if len(block) else 1))
        for a, b in zip(edges, edges[1:]):
            now = order[a:b]
            text, x = words.text[now], inputs[now]
            repeat = _squash(np.clip((weights[text] * x).sum(1), -9, 9))
            repeat[follow.place[now] == 0] = 0
            p = repeat * share[now] + (1 - repeat) * spell[now]
            bits += np.bincount(text, np.where(p > 0, -np.log2(np.maximum(p, 1e-300)), 0), texts)
            low = p <= 1e-290  # too long a word for a product: its bits add up instead
            if low.any():
                bits += np.bincount(text[low], spelled[now[low]] + np.log2(np.maximum(p[low], 1e-300)) * (p[low] > 0), texts)
            slope = follow.flag[now] - repeat
            for k in range(x.shape[1]):
                weights[:, k] += RATE / 4 * np.bincount(text, slope * x[:, k], texts).astype(np.float32)
        return bits


def _planes(values: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers, compressed with the lowest bytes of all first; bytes that are 0 in all are left out."""
    n = len(values)
    used = max(1, -(-int(values.max()).bit_length() // 8)) if n else 1
    if used == 1:
        data = values.astype(np.uint8).tobytes()
    else:
        data = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[:, :used].T.tobytes()
    return bytes([used]) + n.to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unplanes(data: bytes, width: int = 4) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:9], "little")
    raw = pa.decompress(memoryview(data)[9:], decompressed_size=used * n, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(used, n)
    if used == width > 2:
        return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
    out = planes[0].astype(f"<u{width}")
    for k in range(1, used):
        out |= planes[k].astype(out.dtype) << out.dtype.type(8 * k)
    return out


def _slices(frame: pd.DataFrame):
    """(rows, texts as bytes) of about SLICE_BYTES; one longer text is a slice of its own."""
    texts, low, size = [], 0, 0
    for at, text in enumerate(frame["text"]):
        data = (text or "").encode("utf-8", "surrogatepass")
        if texts and (size + len(data) > SLICE_BYTES or len(texts) == SLICE_TEXTS):
            yield frame.iloc[low:at], texts
            texts, low, size = [], at, 0
        texts.append(data)
        size += len(data)
    if texts:
        yield frame.iloc[low:], texts


_PARTS = "part string, bucket long, chunk long, " + ", ".join(f"{c} binary" for c in "abcdefgh")
_COLUMNS = [c.split()[0] for c in _PARTS.split(", ")]
_COUNTED = "unit long, bucket long, a binary, b binary, c binary"
_BACK = "chunk long, bucket long, bits binary, value binary, after binary"


def _row(part: str, bucket: int, chunk: int, *data: bytes) -> tuple:
    return (part, int(bucket), int(chunk), *data, *[b""] * (8 - len(data)))


def _gather(coded: Shipped):
    """Each slice's texts as places of words, its words by range of their hash, and a task's counts of repeats."""

    def run(frames):
        learner = Learner(coded.value)
        task = TaskContext.get().partitionId()
        chunk = task << 32
        for frame in frames:
            for rows, texts in _slices(frame):
                words = Words(texts, learner.coder)
                training = ~rows["held_out"].to_numpy(bool)
                order, bucket, pairs, at, count, after = learner.learn(words, training)
                out = _word_parts(words, order, bucket, pairs, count, after, chunk)
                out.append(_row(
                    "text", 0, chunk, _planes(rows["doc_id"].to_numpy(np.int64), 8), rows["no_id"].to_numpy(np.uint8).tobytes(),
                    training.astype(np.uint8).tobytes(), _planes(at), _planes(words.lengths), _planes(np.diff(pairs // _KINDS, prepend=0)),
                    _planes(words.size[order]),
                ))
                yield pd.DataFrame(out, columns=_COLUMNS)
                chunk += 1
        if learner.words:
            yield pd.DataFrame([_row("repeat", task % 64, 0, learner.repeats.tobytes())], columns=_COLUMNS)

    return run


def _word_parts(words: Words, order, bucket, pairs, count, after, chunk: int) -> list[tuple]:
    """A slice's distinct words by range: hashes, classes, training counts, what followed, and bytes."""
    hashes, size, start = words.hashes[order], words.size[order], words.start[order]
    held = np.bincount(pairs // _KINDS, minlength=len(hashes))
    kind = (pairs % _KINDS).astype(np.uint8)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    pair_edges = np.append(0, np.cumsum(held))
    out = []
    for a, b in zip(edges, edges[1:]):
        own = slice(pair_edges[a], pair_edges[b])
        out.append(_row(
            "words", bucket[a], chunk, _planes(np.diff(hashes[a:b], prepend=_U64(0)), 8), _planes(held[a:b], 1), _planes(kind[own], 1),
            _planes(count[own]), _planes(after[a:b].T.ravel()), _planes(size[a:b]), _planes(_pieces(words.flat, start[a:b], size[a:b]), 1),
        ))
    return out


def _pieces(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The named stretches of an array, joined."""
    begin = np.cumsum(size) - size
    return flat[np.repeat(start - begin, size) + np.arange(int(size.sum()))]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> _U64(32)) * _U64(buckets)) >> _U64(32)).astype(np.int64)


class Bucket:
    """All slices' words of one range of hashes: corpus counts, and where each slice's words are among them."""

    def __init__(self, frame: pd.DataFrame):
        hashes = [np.cumsum(_unplanes(a, 8), dtype=_U64) for a in frame["a"]]
        held = [_unplanes(b, 1).astype(np.int64) for b in frame["b"]]
        self.hashes, code = np.unique(np.concatenate(hashes), return_inverse=True)
        pair = np.repeat(code, np.concatenate(held)) * _KINDS + np.concatenate([_unplanes(c, 1) for c in frame["c"]])
        self.pairs, place = np.unique(pair, return_inverse=True)
        self.count = np.bincount(place, np.concatenate([_unplanes(d) for d in frame["d"]]), len(self.pairs))
        self.total = np.bincount(self.pairs // _KINDS, self.count, len(self.hashes))
        after = [_unplanes(e).reshape(2, -1) for e in frame["e"]]
        self.after = [np.bincount(code, np.concatenate([x[k] for x in after]), len(self.hashes)) for k in (0, 1)]
        self.words = np.split(code, np.cumsum([len(h) for h in hashes])[:-1])
        self.places = np.split(place, np.cumsum([int(h.sum()) for h in held])[:-1])
        self.code = code


def _vocabulary(frame: pd.DataFrame) -> pd.DataFrame:
    """One range's distinct words in units of about UNIT_BYTES to predict, and how many were trained on.

    Units follow the spelling, so all words with a common beginning lie in
    one unit or in neighbouring ones.
    """
    own, bucket = Bucket(frame), int(frame["bucket"].iloc[0])
    size = np.concatenate([_unplanes(f) for f in frame["f"]]).astype(np.int64)
    start = np.cumsum(size) - size
    flat = np.concatenate([_unplanes(g, 1) for g in frame["g"]])
    first = np.zeros(len(own.hashes), np.int64)
    first[own.code[::-1]] = np.arange(len(own.code))[::-1]
    start, size = start[first], size[first]
    data = flat.tobytes()
    spelt = [data[a:a + n] for a, n in zip(start.tolist(), size.tolist())]
    order = np.array(sorted(range(len(spelt)), key=spelt.__getitem__), np.int64)
    held = np.bincount(own.pairs // _KINDS, minlength=len(size))
    first_pair = np.cumsum(held) - held
    start, size, held, first_pair = start[order], size[order], held[order], first_pair[order]
    load = np.cumsum((size + 1) * held)
    edges = np.flatnonzero(np.diff((load - (size + 1) * held) // UNIT_BYTES, prepend=-1))
    out = [_row("size", bucket, 0, np.array([own.total.sum(), (own.total > 0).sum()]).tobytes())]
    for k, (a, b) in enumerate(zip(edges, np.append(edges[1:], len(size)))):
        begin = np.cumsum(held[a:b]) - held[a:b]
        pairs = np.repeat(first_pair[a:b] - begin, held[a:b]) + np.arange(int(held[a:b].sum()))
        out.append(_row(
            "unit", bucket, (bucket << 24) + k, _planes(_pieces(flat, start[a:b], size[a:b]), 1), _planes(size[a:b]), _planes(held[a:b], 1),
            _planes(own.pairs[pairs] % _KINDS, 1), _planes(own.count[pairs], 8), _planes(pairs),
        ))
    return pd.DataFrame(out, columns=_COLUMNS)


class Unit:
    """The coded bits of a unit's words, and the keys behind their predictors.

    A word so far that is no beginning of the unit's first or last word
    occurs in this unit alone, so its counts are here whole. All other keys
    are shared: they are listed in order, and the corpus's counts of them
    are given from outside.
    """

    def __init__(self, row, coder: Coder):
        size = _unplanes(row["b"]).astype(np.int64)
        held = _unplanes(row["c"], 1)
        flat = np.append(_unplanes(row["a"], 1), np.uint8(0))
        kind = _unplanes(row["d"], 1)
        self.count = _unplanes(row["e"], 8).astype(np.float64)
        which = np.repeat(np.arange(len(size)), held)
        words = Spelling(flat, np.cumsum(size) - size, size)
        self.owner, keys, self.bit, place = placed_bit_rows(words, which, kind, coder)
        reach = np.maximum(_shared_lengths(words, 0), _shared_lengths(words, len(size) - 1))
        self.edge = place <= reach[which[self.owner]]
        self.weight = self.count[self.owner]
        self._longer = keys[2:]
        shared = [*keys[:2], *(k[self.edge] for k in self._longer)]
        edges = np.cumsum([len(k) for k in shared])[:-1]
        del keys, place
        shared = np.concatenate(shared)
        codes, names = pd.factorize(shared, size_hint=KEYS)
        del shared
        order = np.argsort(names)
        rank = np.empty(len(order), _index(len(order)))
        rank[order] = np.arange(len(order))
        self.keys = names[order]
        self.places = np.split(rank[codes], edges)

    @cached_property
    def local(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """Zeros and ones behind the unit's own contexts; of every bit the places of its contexts among
        the shared keys and, behind them, those."""
        counts, places, first, own = [], self.places[:2], len(self.keys), np.flatnonzero(~self.edge)
        weight, ones = self.weight[own], (self.weight * self.bit)[own]
        for keys, shared in zip(self._longer, self.places[2:]):
            code, name = pd.factorize(keys[own], size_hint=KEYS)
            every = np.bincount(code, weight, len(name))
            one = np.bincount(code, ones, len(name))
            counts.append((every - one, one))
            place = np.empty(len(self.bit), _index(4 * len(self.bit)))
            place[self.edge], place[own] = shared, first + code
            places.append(place)
            first += len(name)
        del self._longer
        return counts, places

    @property
    def contexts(self) -> list[np.ndarray]:
        return self.local[1]

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones that this unit's training words put behind each shared key."""
        one, every = np.zeros(len(self.keys)), np.zeros(len(self.keys))
        ones = self.weight * self.bit
        edge = self.weight[self.edge], ones[self.edge]
        for k, place in enumerate(self.places):
            weight, bits = (self.weight, ones) if k < 2 else edge
            one += np.bincount(place, bits, len(self.keys))
            every += np.bincount(place, weight, len(self.keys))
        return every - one, one

    def context_counts(self, row) -> tuple[np.ndarray, np.ndarray]:
        """The corpus's zeros and ones behind every shared key and the unit's own ones."""
        given = [_unplanes(row[c], 8).astype(np.float64) for c in "gh"]
        zero, one = (np.concatenate([x, *(own[k] for own in self.local[0])]) for k, x in enumerate(given))
        return zero, one

    def corpus_counts(self, row) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each predictor the corpus's zeros and ones behind every bit."""
        zero, one = self.context_counts(row)
        return [(zero[place], one[place]) for place in self.contexts]

    def inputs(self, row) -> tuple[list[np.ndarray], np.ndarray]:
        """What the corpus's counts say of every bit, by predictor, and their gate; worked out once a context."""
        zero, one = self.context_counts(row)
        said, level = _stretched(zero, one), _level(zero + one).astype(np.int16)
        return [said[place] for place in self.contexts], level[self.contexts[3]] * LEVELS + level[self.contexts[2]]

    def inputs_of_others(self, row, used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """`inputs` of some bits that were counted, by the counts without the bit itself."""
        zero, one = self.context_counts(row)
        level = _level(zero + one - 1).astype(np.int16)
        # Where no such bit was counted the numbers go unused.
        said = np.stack([_stretched(np.maximum(zero - 1, 0), one), _stretched(zero, np.maximum(one - 1, 0))], 1).ravel()
        gate = level[self.contexts[3][used]] * LEVELS + level[self.contexts[2][used]]
        bit = self.bit[used]
        return [said[2 * place[used].astype(np.int64) + bit] for place in self.contexts], gate


def _key_parts(buckets: int, coded: Shipped):
    def run(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                unit = Unit(row, coded.value)
                zero, one = unit.own_counts()
                bucket = _bucket(unit.keys, buckets)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
                out = [
                    (row["chunk"], bucket[a], _planes(np.diff(unit.keys[a:b], prepend=_U64(0)), 8), _planes(zero[a:b], 8), _planes(one[a:b], 8))
                    for a, b in zip(edges, edges[1:])
                ]
                del unit, zero, one  # or it would lie beside the next one
                yield pd.DataFrame(out, columns=["unit", "bucket", "a", "b", "c"])

    return run


def _add_keys(frame: pd.DataFrame) -> pd.DataFrame:
    """The corpus's counts of one range of keys, handed back to every unit in the order of its keys."""
    keys = [np.cumsum(_unplanes(a, 8), dtype=_U64) for a in frame["a"]]
    codes, names = pd.factorize(np.concatenate(keys))
    zero, one = (np.bincount(codes, np.concatenate([_unplanes(x, 8) for x in frame[c]]), len(names)) for c in "bc")
    parts = np.split(codes, np.cumsum([len(k) for k in keys])[:-1])
    out = [(u, b, _planes(zero[p], 8), _planes(one[p], 8), b"") for u, b, p in zip(frame["unit"], frame["bucket"], parts)]
    return pd.DataFrame(out, columns=["unit", "bucket", "a", "b", "c"])


def _with_counts(units: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """A unit with the corpus's counts of its keys, which come by range."""
    given = given.sort_values("bucket")
    zero, one = (_planes(np.concatenate([_unplanes(x, 8) for x in given[c]]), 8) for c in "ab")
    return units.assign(g=[zero], h=[one])


def _teach(coded: Shipped, weights: np.ndarray | None):
    """What training words teach the weights, each bit with the corpus's counts without itself."""

    def run(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                unit, mixer = Unit(row, coded.value), Mixer(weights)
                used = np.flatnonzero(unit.weight > 0)
                given = *unit.inputs_of_others(row, used), unit.bit[used], unit.weight[used]
                del unit, used  # or they would lie beside the steps
                mixer.learn(*given)
                del given
                yield pd.DataFrame({"part": [int(row["chunk"]) % 64], "a": [mixer.state().tobytes()]})

    return run


def _spell(coded: Shipped, shared: Shipped):
    """Bits of every word and class of a unit."""

    def run(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                unit = Unit(row, coded.value)
                given = *unit.inputs(row), unit.bit, unit.owner, len(unit.count)
                del unit
                bits = shared.value.word_bits(*given)
                del given
                yield pd.DataFrame({"unit": [row["chunk"]], "bucket": [row["bucket"]], "a": [bits.astype(np.float32).tobytes()], "b": [row["f"]]})

    return run


def _hand_back(frame: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
    """Of one range's words what each slice needs: bits, counts, counts of new and repeated words after them."""
    own = Bucket(frame)
    bits = np.zeros(len(own.pairs), np.float32)
    for spelled, pairs in zip(units["a"], units["b"]):
        bits[_unplanes(pairs)] = np.frombuffer(spelled, np.float32)
    return pd.DataFrame([
        (chunk, bucket, bits[p].tobytes(), _planes(own.total[w], 8), _planes(np.concatenate([x[w] for x in own.after]), 8))
        for chunk, bucket, p, w in zip(frame["chunk"], frame["bucket"], own.places, own.words)
    ], columns=["chunk", "bucket", "bits", "value", "after"])


def _score(shared: Shipped):
    """The texts of one slice."""

    def run(texts: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        row, given = texts.iloc[0], given.sort_values("bucket")
        at, lengths = _unplanes(row["d"]).astype(np.int64), _unplanes(row["e"]).astype(np.int64)
        rank = np.cumsum(_unplanes(row["f"]), dtype=np.int64)
        size = _unplanes(row["g"]).astype(np.int64)
        bits = np.frombuffer(b"".join(given["bits"]), np.float32).astype(np.float64)
        total = np.concatenate([_unplanes(v, 8) for v in given["value"]]).astype(np.float64)
        value = np.where(total > 0, np.log10(total + 1), -1.0)
        followed = np.concatenate([_unplanes(v, 8).reshape(2, -1) for v in given["after"]], 1).astype(np.float64)
        after = _stretched(*followed)
        words = Sequence(rank[at], lengths, size, np.repeat(np.arange(len(lengths)), lengths))
        score = shared.value.score(words, bits[at], after)
        own, n = value[words.codes], len(lengths)
        return pd.DataFrame({
            "doc_id": pd.Series(_unplanes(row["a"], 8).astype(np.int64)).astype("Int64").mask(np.frombuffer(row["b"], np.uint8) > 0),
            "held_out": np.frombuffer(row["c"], np.uint8) == 0, "n_tokens": lengths,
            "n_known": np.bincount(words.text[own >= 0], minlength=n), "logs": np.bincount(words.text, np.maximum(own, 0), n),
            "score": -score * (LOG2 / math.log(10)), "bits_per_byte": score / np.bincount(words.text, size[words.codes] + 1, n),
        })

    return run


def _add_states(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"a": [sum(np.frombuffer(a) for a in frame["a"]).tobytes()]})


def _total(parts: DataFrame, by: str) -> np.ndarray | float:
    """The sum of arrays; tasks add up first, so that at most 64 are collected."""
    added = parts.groupBy(by).applyInPandas(_add_states, "a binary").collect()
    return sum((np.frombuffer(r["a"]) for r in added), 0.0)


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Queries made here drop the files of their shuffles when they end, not when the driver next collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
) -> DataFrame:
    """Log probabilities and bits per byte of every whole text.

    A word's bytes and the blank after it are coded by a prefix code, which
    follows the counts of bytes over all training words.
    Each coded bit is predicted from four contexts (see PREDICTORS; the
    class of a text comes from its words so far); their stretched
    probabilities are mixed by weights that the counts behind the two
    longest contexts select, and the mix is refined by what followed such
    mixes before. Counts cover all training texts. They are a table by
    (context, node) that grows with the corpus. The corpus's distinct words
    lie in units by spelling, so most words so far are counted within one
    unit; of the contexts that several units share, each unit brings its
    counts to the range of the key and gets the sums back. The weights learn
    online while a unit's words pass, each as often as the corpus has it and
    each bit with the corpus's counts but its own; they are averaged over
    units of a first round over a part of them, and again in the round over
    all, which goes on from there. So input partitions and
    slices do not change what is learnt. In every text, the
    odds that a word repeats one of the text are mixed online from three
    more predictors.
    Words are lower-case (A-Z only) and blanks count as one.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (log10 of an add-one unigram model), score (log10 of this model),
    bits_per_byte (of the words and the blank after each).

    Null texts count as empty and hold the end alone. Rows without an id
    train. Repeated rows each train and are each reported. With no training
    text the tables are empty and every bit is even. Words and contexts are
    told apart by 64-bit hashes. Other columns are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, folds) == held).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    with _shuffles_dropped(spark):
        size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(LEAST_RANGES, min(2 * shuffle_width(spark), size // RANGE_CHARS))
        coder = Coder()
        learnt = rows.filter("not held_out").select("text")
        lexicon = learnt.mapInPandas(_lexicon(Shipped(spark, coder)), "hash long, n long, spelt binary")
        # A hash has one spelling; as part of the key it needs no sort, which the smallest of strings would.
        lexicon = materialize(lexicon.groupBy("hash", "spelt").agg(F.sum("n").alias("n")), "lexicon")
        coder.bounds = _bounds(lexicon, buckets)
        top = lexicon.orderBy(F.desc("n"), "hash").limit(MARKERS).select("hash").collect()
        coder.markers = np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64))
        if top:
            coder.fit_classes(materialize(learnt.mapInPandas(_marked(Shipped(spark, coder)), "a binary, b binary, c binary"), "marked"))
        plain = rows.select("held_out", "text", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"))
        gathered = materialize(plain.mapInPandas(_gather(Shipped(spark, coder)), _PARTS), "gathered", by=["part"])
        words = gathered.filter(F.col("part") == "words")
        vocabulary = materialize(words.groupBy("bucket").applyInPandas(_vocabulary, _PARTS), "vocabulary", by=["part"])
        units = vocabulary.filter(F.col("part") == "unit").select("bucket", "chunk", *"abcdef")
        first = _total(units.mapInPandas(_unit_bytes(None), "part long, a binary"), "part") + np.zeros(256 + (1 << 16))
        pairs = commonest_pairs(first)
        after = _total(units.mapInPandas(_unit_bytes(pairs), "part long, a binary"), "part")
        coder.fit_code(first, after + np.zeros((len(pairs) + 1) * 256))
        coded = Shipped(spark, coder)
        counted = units.mapInPandas(_key_parts(2 * buckets, coded), _COUNTED).groupBy("bucket").applyInPandas(_add_keys, _COUNTED)
        known = materialize(
            units.groupBy("chunk").cogroup(counted.select("unit", "bucket", "a", "b").groupBy("unit"))
            .applyInPandas(_with_counts, "bucket long, chunk long, " + ", ".join(f"{c} binary" for c in "abcdefgh")),
            "known",
        )
        repeats = _total(gathered.filter(F.col("part") == "repeat").select("bucket", "a"), "bucket")
        weights = None
        for one_in in ROUNDS:
            chosen = known.filter(F.pmod(F.xxhash64("chunk"), F.lit(one_in)) == 0)
            state = _total(chosen.mapInPandas(_teach(coded, weights), "part long, a binary"), "part")
            state = state + np.zeros(GATES * PREDICTORS + GATES * STEPS * 2 + 1)
            weights = averaged(state)
    model = Model(state, (repeats + np.zeros(4 * PLACES)).reshape(2, PLACES, 2))
    # One row for each bucket of words.
    sizes = [np.frombuffer(r["a"]) for r in vocabulary.filter(F.col("part") == "size").select("a").collect()]
    tokens, types = (int(x) for x in sum(sizes, np.zeros(2)))
    shared = Shipped(spark, model)  # the weights, of fixed size
    bits = known.mapInPandas(_spell(coded, shared), "unit long, bucket long, a binary, b binary")
    back = words.select("bucket", "chunk", *"abcde").groupBy("bucket").cogroup(bits.groupBy("bucket")).applyInPandas(_hand_back, _BACK)
    texts = gathered.filter(F.col("part") == "text").select("chunk", *"abcdefg")
    scored = texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(
        _score(shared),
        "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, bits_per_byte double",
    )
    spread = math.log10(tokens + types + 1)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * spread).alias("base_score"), "score", "bits_per_byte",
    )

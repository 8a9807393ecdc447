"""Tokens of a text as bits of a code, each predicted from the text before it.

The frequent tokens, the end of a text and an escape for all other tokens are the
leaves of a Huffman tree over the training counts.  A token is the bits on the way
to its leaf; a bit's predictors are the counts of that tree node

* in the corpus,
* in the corpus after the last very frequent token (it tells the language and the
  kind of text),
* in the corpus after the token before,
* so far in this text (learned online, from every bit that went before).

The corpus counts are hashed tables summed over all training texts.  The log-odds
are mixed by weights that a gate selects (how well each context is known) and an
adaptive map refines the result.  Weights and map are fitted to every bit of every
training text, read from tables of the other half of the texts, as a text's own
bits foretell it too well: bits of one gate with alike log-odds are counted in one
cell, the cells are summed over all tasks, and the fit reads the sums.  The bits of
all nodes sum to a probability over the leaves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

from . import words as W

LEAVES = 1 << 16  # tokens with a leaf of their own
ANCHORS = 256  # the most frequent ones, which the second context remembers
BITS_ANCHOR, BITS_BEFORE = 18, 18
BITS_HOME = 18  # of the look-up of leaves
SEGMENT = 1 << 17  # tokens handled at once
RUN = 1 << 15  # bits mixed at once: they stay in the caches
END, ESCAPE = 0, 1  # leaf numbers; tokens follow
INPUTS = 5
GATES = 4 * 4 * 4
STEPS = 33
FINE = 1 << 10  # steps at which the refined log-odds are read
NODE_BINS, BINS = 8, 16  # of a node's and of each other log-odds in a cell
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Code:
    hashes: np.ndarray  # of the tokens with a leaf, sorted
    leaf: np.ndarray  # their leaf numbers
    first: np.ndarray  # leaf l has the steps first[l]:first[l + 1]
    node: np.ndarray
    bit: np.ndarray
    step: np.ndarray  # 4 node + 2 bit + whether another step follows
    home: np.ndarray  # open addressing by a hash's first bits: place in ``hashes`` + 1, or 0

    @property
    def nodes(self) -> int:
        return len(self.first)

    def leaves_of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), ESCAPE, np.int64)
        left, at = np.arange(len(hashes)), _home(hashes)
        while len(left):
            found = pick(self.home, at)
            some = np.flatnonzero(found)
            left, at, found = left[some], at[some], found[some] - 1
            same = pick(self.hashes, found) == hashes[left]
            out[left[same]] = pick(self.leaf, found[same])
            left, at = left[~same], at[~same] + 1
        return out


def _home(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS_HOME)).view(np.int64)


def _homes(hashes: np.ndarray) -> np.ndarray:
    """The table of sorted hashes: each at the first free place from its home on."""
    place = np.arange(len(hashes))
    at = np.maximum.accumulate(_home(hashes) - place) + place if len(hashes) else place
    table = np.zeros((1 << BITS_HOME) + len(hashes) + 1, np.int32)
    table[at] = place + 1
    return table


def build_code(hashes: np.ndarray, counts: np.ndarray, ends: int, others: int) -> Code:
    """Huffman code over the tokens (most frequent first), the end and the escape."""
    weights = [max(ends, 1), max(others, 1), *counts.tolist()]
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((x, y))
        heapq.heappush(heap, (a + b, len(weights) + len(children) - 1))
    paths: list[list[tuple[int, int]]] = [[] for _ in weights]
    above: dict[int, tuple[tuple[int, int], ...]] = {len(weights) + len(children) - 1: ()}
    for k in range(len(children) - 1, -1, -1):
        path = above.pop(len(weights) + k)
        for bit, child in enumerate(children[k]):
            if child < len(weights):
                paths[child] = [*path, (k, bit)]
            else:
                above[child] = (*path, (k, bit))
    steps = [s for p in paths for s in p]
    first = np.cumsum([0, *map(len, paths)])
    by = np.argsort(hashes)
    node, bit = np.array(steps, np.int32).T
    step = node * 4 + bit * 2 + 1
    step[first[1:] - 1] -= 1
    return Code(hashes[by], (by + 2).astype(np.int64), first, node, bit.astype(np.int8), step, _homes(hashes[by]))


@dataclass
class Run:
    """Tokens of a run of texts, text after text: leaves[first[i]:first[i + 1]]."""

    leaves: np.ndarray
    first: np.ndarray
    anchor: np.ndarray  # hash of the last very frequent token before each, and of the token before
    before: np.ndarray
    held: np.ndarray | None  # what the only text had earlier, at 2 node + bit
    text: int  # number of the first text


@dataclass
class Bits:
    """The next bit of every token that is still on its way; those of one text and node stand together, in the text's order."""

    first: np.ndarray  # text i has the bits first[i]:first[i + 1]
    node: np.ndarray
    bit: np.ndarray
    zeros: np.ndarray  # how often the text had a 0 and a 1 at the node before
    ones: np.ndarray
    anchor: np.ndarray  # slot of (last very frequent token, node)
    before: np.ndarray  # slot of (token before, node)


def pick(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at] for places that are inside; numpy's check of each costs more than the reading."""
    return table.take(at, mode="clip")


def _spread(node: np.ndarray) -> np.ndarray:
    return (node.astype(np.uint64) + np.uint64(1)) * _C2


def _context(context: np.ndarray, salt: int) -> np.ndarray:
    return W.mix((context.astype(np.uint64) + np.uint64(salt)) * _C1)


def _slot(context: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
    h = context ^ spread
    h ^= h >> np.uint64(32)
    h *= _C1
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


def _run(leaves: np.ndarray, first: np.ndarray, text: int, before: int = -1, anchor: int = -1, held: np.ndarray | None = None) -> Run:
    """``before`` and ``anchor`` are the contexts the first text begins with."""
    n = len(leaves)
    begins = first[:-1][np.diff(first) > 0]
    previous = np.empty(n, np.int64)
    previous[1:] = leaves[:-1]
    previous[begins] = -1
    if n:
        previous[0] = before
    # The last anchor up to the token before: the place of it, carried on inside each text.
    is_anchor = (leaves >= 2) & (leaves < 2 + ANCHORS)
    place = np.where(is_anchor, np.arange(n), -1)
    last = np.maximum.accumulate(place) if n else place
    shifted = np.concatenate([[-1], last[:-1]]) if n else last
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = shifted >= first[owner] if n else np.zeros(0, bool)
    anchors = np.where(inside, leaves[np.maximum(shifted, 0)], -1) if n else previous
    if n:
        anchors[(owner == owner[0]) & ~inside] = anchor
    return Run(leaves, first, _context(anchors, 7), _context(previous, 11), held, text)


def walk(code: Code, run: Run) -> Iterator[Bits]:
    """The bits of a run, one level of the tree after the other.

    The tokens of a text at a node are parted, each side in its order, when they go
    on to the next level; so what the text had at a node is a running sum, and
    nothing is sorted.
    """
    at, first, size, anchor, before = pick(code.first, run.leaves), run.first, np.diff(run.first), run.anchor, run.before
    begin, end = np.repeat(first[:-1], size), np.repeat(first[1:], size)  # of the text's tokens at the node
    while len(at):
        place = np.arange(len(at))
        step = pick(code.step, at).astype(np.int64)
        going = (step & 1).view(bool)[::8]
        step >>= 1
        bit = step & 1
        node = step >> 1
        sums = np.zeros(len(at) + 1, np.int64)
        np.cumsum(bit, out=sums[1:])
        earlier = pick(sums, begin)
        ones = sums[:-1] - earlier
        zeros = place - begin
        zeros -= ones
        middle = end - pick(sums, end)
        middle += earlier
        # The zeros go to begin:middle, the ones to middle:end; by masks, which are faster than where.
        mask = -bit
        begin ^= (begin ^ middle) & mask
        end ^= middle
        end &= mask
        end ^= middle
        goal = (zeros ^ ones) & mask
        goal ^= zeros
        goal += begin
        if run.held is not None:
            zeros += run.held[node * 2]
            ones += run.held[node * 2 + 1]
            np.add.at(run.held, step, 1)
        spread = _spread(node)
        yield Bits(first, node, bit, zeros, ones, _slot(anchor, spread, BITS_ANCHOR), _slot(before, spread, BITS_BEFORE))
        at += 1
        order = np.empty(len(at), np.int64)
        order[goal] = place
        going = pick(going, order)
        if not going.all():  # the tokens at a leaf are all there, and all their text's
            order = pick(order, np.flatnonzero(going))
            gone = np.zeros(len(at) + 1, np.int64)
            np.cumsum(~going, out=gone[1:])
            begin -= pick(gone, begin)
            end -= pick(gone, end)
            first = first - gone[first]
        at, begin, end, anchor, before = (pick(a, order) for a in (at, begin, end, anchor, before))


@dataclass
class Tables:
    node: np.ndarray  # slot x bit, as the others
    anchor: np.ndarray
    before: np.ndarray

    @classmethod
    def empty(cls, nodes: int) -> "Tables":
        return cls(*(np.zeros((n, 2), np.int32) for n in (nodes, 1 << BITS_ANCHOR, 1 << BITS_BEFORE)))

    def add(self, code: Code, run: Run) -> None:
        sizes = np.diff(code.first)
        for lo in range(0, len(run.leaves), RUN // 8):
            part = slice(lo, lo + RUN // 8)
            leaves = run.leaves[part]
            size = pick(sizes, leaves)
            at = np.repeat(pick(code.first, leaves) - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            step = pick(code.step, at) >> 1
            step = step.astype(np.int64)
            bit, spread = step & 1, _spread(step >> 1)
            np.add.at(self.node.reshape(-1), step, np.int32(1))
            for table, context, bits in ((self.anchor, run.anchor, BITS_ANCHOR), (self.before, run.before, BITS_BEFORE)):
                slot = _slot(np.repeat(context[part], size), spread, bits)
                slot *= 2
                slot += bit
                np.add.at(table.reshape(-1), slot, np.int32(1))


_ADD = (0.1, 0.2, 0.2)  # added to the corpus counts of a node, after an anchor, after a token
_LEVELS = ((3, 30, 300), (0, 3, 30), (0, 3, 20))  # borders of how well a context is known


def _level(known: np.ndarray, borders: tuple[int, int, int]) -> np.ndarray:
    a, b, c = borders
    return (known > a).astype(np.int8) + (known > b) + (known > c)


def _log_odds(zeros: np.ndarray, ones: np.ndarray, add: float) -> np.ndarray:
    add = np.float32(add)
    return np.clip(np.log((ones + add) / (zeros + add)), -9, 9)


def _with_level(odds: np.ndarray, level: np.ndarray) -> np.ndarray:
    return (odds.view(np.int32) & np.int32(-4) | level).view(np.float32)


def _plain(odds: np.ndarray) -> np.ndarray:
    return (odds.view(np.int32) & np.int32(-4)).view(np.float32)


@dataclass
class Read:
    """What the predictors need of one table, per slot: log-odds (NaN where nothing is known) and level.

    The level stands in the last two bits of the log-odds, so that one reading brings both.
    """

    odds: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, k: int) -> "Read":
        """``counts`` are (slot, bit), of table k: nodes, after an anchor, after a token."""
        known = counts.sum(axis=1)
        odds = _log_odds(counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32), _ADD[k])
        return cls(_with_level(np.where((known > 0) | (k == 0), odds, np.float32(np.nan)), _level(known, _LEVELS[k - 1]) if k else np.int8(0)))

    @property
    def level(self) -> np.ndarray:
        return self.odds.view(np.int32) & 3

    def at(self, slot: np.ndarray) -> "Read":
        return Read(pick(self.odds, slot))


def _own(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """What the text had so far, with its level as in ``Read``; 0 for nothing."""
    if len(zeros) and zeros.dtype.kind == "i" and max(zeros.max(), ones.max()) < _NEAR:
        at = zeros * _NEAR
        at += ones
        return pick(_near(), at)
    zeros, ones = zeros.astype(np.float32), ones.astype(np.float32)
    return _with_level(_log_odds(zeros, ones, 0.4), _level(zeros + ones, _LEVELS[2]))


_NEAR = 1 << 10  # counts in a text below this are looked up


@cache
def _near() -> np.ndarray:
    zeros, ones = (n.astype(np.float32) for n in np.divmod(np.arange(_NEAR * _NEAR), _NEAR))
    return _own(zeros, ones)


def inputs(corpus: list[Read], zeros: np.ndarray, ones: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(log-odds of each predictor and a constant, gate)."""
    base, own = corpus[0].odds, Read(_own(zeros, ones))
    x = [base, *(c.odds.copy() for c in corpus[1:]), own.odds, np.full(len(base), 0.3, np.float32)]
    for odds in x[1:3]:
        np.copyto(odds, base, where=np.isnan(odds))
    gate = corpus[1].level
    for read in (corpus[2], own):
        gate *= 4
        gate += read.level
    return x, gate.astype(np.int64)


@dataclass
class BitMixer:
    weights: np.ndarray  # gate x input
    refine: np.ndarray  # gate x bucket: log-odds
    read: tuple[np.ndarray, np.ndarray] | None = None  # gate x step of the mixed log-odds: refined ones, and log10 probability of each bit

    def __post_init__(self) -> None:
        z = (np.arange(FINE) + 0.5) * (20 / FINE) - 10
        at = (z + 10) / 20 * (STEPS - 1)
        low = at.astype(np.int64)
        refined = self.refine[:, low] + (self.refine[:, low + 1] - self.refine[:, low]) * (at - low)
        odds = np.clip((z + refined) / 2, -11.5, 11.5)
        by_bit = np.stack([-np.log1p(np.exp(odds)), -np.log1p(np.exp(-odds))], axis=2) / math.log(10)
        self.read = odds.astype(np.float32).ravel(), by_bit.astype(np.float32).ravel()

    def _steps(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        z = pick(weights[0], gate)
        z *= x[0]
        for k in range(1, INPUTS - 1):
            part = pick(weights[k], gate)
            part *= x[k]
            z += part
        z += pick(weights[INPUTS - 1] * np.float32(0.3) + np.float32(10), gate)
        z *= np.float32(FINE / 20)
        np.clip(z, 0, FINE - 1, out=z)
        step = z.astype(np.int64)
        step += gate * FINE
        return step

    def odds(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Log-odds of a one."""
        return pick(self.read[0], self._steps(x, gate))

    def log10(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 probability of each bit: of a one 1 / (1 + e^-odds), of a zero the rest."""
        step = self._steps(x, gate)
        step *= 2
        step += bit
        return pick(self.read[1], step)


def fit(x: np.ndarray, gate: np.ndarray, seen: np.ndarray, start: np.ndarray, steps: int, reach: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refining log-odds on ``steps`` points from -reach to reach) per gate.

    ``x`` are the inputs of each cell, ``seen`` its zeros and ones.  Newton's steps
    from ``start``, which weighs as much as a few bits and a thousandth of all; then the zeros and ones
    around each point, shared between the two nearest.
    """
    weights, grid = start.astype(float).copy(), np.linspace(-reach, reach, steps)
    refine = np.tile(grid, (len(start), 1))
    by = np.argsort(gate, kind="stable")
    borders = np.searchsorted(gate[by], np.arange(len(start) + 1))
    for g, (lo, hi) in enumerate(zip(borders[:-1], borders[1:])):
        if lo == hi:
            continue
        own, n0, n1 = x[by[lo:hi]].astype(float), *seen[by[lo:hi]].astype(float).T
        hold = 4 + 1e-3 * (n0.sum() + n1.sum())
        mixed = lambda w: np.clip(own @ w, -reach, reach)
        loss = lambda w: float(n1 @ np.logaddexp(0, -mixed(w)) + n0 @ np.logaddexp(0, mixed(w)) + hold / 2 * ((w - start[g]) ** 2).sum())
        w, now = weights[g], loss(weights[g])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-mixed(w)))
            slope = own.T @ ((n0 + n1) * p - n1) + hold * (w - start[g])
            bend = (own * ((n0 + n1) * p * (1 - p))[:, None]).T @ own + hold * np.eye(len(w))
            step = np.linalg.solve(bend, slope)
            while np.abs(step).max() > 1e-5 and loss(w - step) > now:
                step /= 2
            if np.abs(step).max() <= 1e-5:
                break
            w, now = w - step, loss(w - step)
        weights[g] = w
        at = (mixed(w) + reach) / (2 * reach) * (steps - 1)
        low = np.minimum(at.astype(np.int64), steps - 2)
        zeros, ones = (np.bincount(low, n * (1 - at + low), steps) + np.bincount(low + 1, n * (at - low), steps) for n in (n0, n1))
        p = 1 / (1 + np.exp(-grid))
        refine[g] = np.log((ones + 4 * p) / (zeros + 4 * (1 - p)))
    return weights, np.clip(refine, -reach, reach)


_START = np.tile(np.array([0.1, 0.6, 0.2, 0.1, 0.0]), (GATES, 1))


def learn(x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> BitMixer:
    """The mixer fitted to bits one by one."""
    x = np.stack(x, axis=1) if len(bit) else np.empty((0, INPUTS))
    return BitMixer(*fit(x, gate, np.stack([1 - bit, bit], axis=1), _START, STEPS, 10.0))


# A cell holds the bits of one gate whose four log-odds fall into the same bins.
_GATE = NODE_BINS * BINS**3
CELLS = GATES * _GATE
_HALF = np.array([0.25, 0.8, 1.5, 2.3, 3.2, 4.4, 6.0])
_BORDERS = np.concatenate([-_HALF[::-1], [0], _HALF])
_NODE_BORDERS = np.array([-0.9, -0.35, -0.12, 0, 0.12, 0.35, 0.9])  # a Huffman node is even, nearly
_PLACES = BINS ** np.arange(3, -1, -1)


def _own_cells(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = Read(_own(zeros, ones))
    odds = _plain(own.odds)
    return odds, np.searchsorted(_BORDERS, odds), own.level.astype(np.int64)


@cache
def _near_cells() -> np.ndarray:
    _, at, level = _own_cells(*np.divmod(np.arange(_NEAR * _NEAR), _NEAR))
    return (level * _GATE + at).astype(np.int32)


@dataclass
class Cells:
    """What each table adds to the cell of a bit, and what the text had; the tables are of other texts."""

    parts: list[np.ndarray]
    sums: list[np.ndarray]  # of each input's log-odds and of their bits, by level and bin

    @classmethod
    def of(cls, tables: Tables) -> "Cells":
        parts, sums = [], []
        for k, counts in enumerate((tables.node, tables.anchor, tables.before)):
            read = Read.of(counts, k)
            odds, level = np.nan_to_num(_plain(read.odds)), read.level.astype(np.int64)
            at = np.searchsorted(_BORDERS if k else _NODE_BORDERS, odds)
            parts.append((level * ((0, 16, 4)[k] * _GATE) + at * _PLACES[k]).astype(np.int32))
            sums.append(cls._sums(odds, level * BINS + at, counts.sum(axis=1)))
        zeros, ones = np.divmod(np.arange(1 << 16), 1 << 8)
        odds, at, level = _own_cells(zeros, ones)
        sums.append(cls._sums(odds, level * BINS + at, 1.0 / (1 + zeros + ones) ** 3))
        return cls(parts, sums)

    @staticmethod
    def _sums(odds: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(group, w, 4 * BINS) for w in (weight * odds, weight)])

    def count(self, code: Code, seen: np.ndarray, leaves: np.ndarray, first: np.ndarray) -> None:
        """Adds the bits of training texts to ``seen``, at 2 cell + bit."""
        for run in _runs(leaves, first, code.nodes):
            for bits in walk(code, run):
                n0, n1 = bits.zeros, bits.ones
                if max(n0.max(), n1.max()) < _NEAR:
                    cell = pick(_near_cells(), n0 * _NEAR + n1)
                else:
                    _, at, level = _own_cells(n0, n1)
                    cell = (level * _GATE + at).astype(np.int32)
                for part, slot in zip(self.parts, (bits.node, bits.anchor, bits.before)):
                    cell += pick(part, slot)
                np.add.at(seen, cell * np.int64(2) + bits.bit, seen.dtype.type(1))

    @staticmethod
    def learn(halves: list["Cells"], seen: np.ndarray) -> BitMixer:
        """The mixer fitted to all bits that were counted by the cells of either half."""
        seen = seen.reshape(-1, 2)
        cell = np.flatnonzero(seen.any(axis=1))
        gate = cell // _GATE
        levels = (np.zeros_like(gate), gate // 16, gate // 4 % 4, gate % 4)
        x = np.full((len(cell), INPUTS), 0.3)
        for k in range(4):
            odds, bits = sum(h.sums[k] for h in halves)
            x[:, k] = (odds / np.maximum(bits, 1e-9))[levels[k] * BINS + cell // _PLACES[k] % (BINS if k else NODE_BINS)]
            if k in (1, 2):
                x[:, k] = np.where(levels[k] == 0, x[:, 0], x[:, k])
        return BitMixer(*fit(x, gate, seen[cell], _START, STEPS, 10.0))


def _runs(leaves: np.ndarray, first: np.ndarray, nodes: int) -> Iterator[Run]:
    """Short texts together, a long one piece by piece; a piece's bits are added to ``held`` by walking it."""
    text = 0
    while text < len(first) - 1:
        end = max(text + 1, int(np.searchsorted(first, first[text] + SEGMENT, "right")) - 1)
        if first[end] - first[text] <= SEGMENT:
            yield _run(leaves[first[text] : first[end]], first[text : end + 1] - first[text], text)
        else:
            held, before, anchor = np.zeros(2 * nodes, np.int64), -1, -1
            for lo in range(first[text], first[end], SEGMENT):
                part = leaves[lo : min(lo + SEGMENT, first[end])]
                yield _run(part, np.array([0, len(part)]), text, before, anchor, held)
                before = int(part[-1])
                anchors = part[(part >= 2) & (part < 2 + ANCHORS)]
                anchor = int(anchors[-1]) if len(anchors) else anchor
        text = end


def count(code: Code, tables: Tables, leaves: np.ndarray, first: np.ndarray) -> None:
    for run in _runs(leaves, first, code.nodes):
        tables.add(code, run)


def describe(code: Code, tables: Tables, leaves: np.ndarray, first: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(inputs, gate, bits) of training texts, all at once: a bit's own occurrence is taken out of the tables."""
    found = []
    for bits in (bits for run in _runs(leaves, first, code.nodes) for bits in walk(code, run)):
        mine = np.stack([1 - bits.bit, bits.bit], axis=1)
        slots = zip((tables.node, tables.anchor, tables.before), (bits.node, bits.anchor, bits.before))
        corpus = [Read.of(np.maximum(t[s] - mine, 0), k) for k, (t, s) in enumerate(slots)]
        x, gate = inputs(corpus, bits.zeros, bits.ones)
        found.append((*x, gate, bits.bit))
    *x, gate, bit = (np.concatenate(part) for part in zip(*found))
    yield x, gate, bit


@dataclass
class Model:
    """The learned code: what the tasks need to score texts."""

    code: Code
    reads: list[Read]
    mixer: BitMixer

    @classmethod
    def of(cls, code: Code, tables: Tables, mixer: BitMixer) -> "Model":
        return cls(code, [Read.of(t, k) for k, t in enumerate((tables.node, tables.anchor, tables.before))], mixer)

    def log10(self, leaves: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of the leaves of each text."""
        out = np.zeros(len(first) - 1)
        for run in _runs(leaves, first, self.code.nodes):
            for bits in walk(self.code, run):
                found = np.empty(len(bits.bit))
                for lo in range(0, len(found), RUN):
                    part = slice(lo, lo + RUN)
                    corpus = [read.at(slot[part]) for read, slot in zip(self.reads, (bits.node, bits.anchor, bits.before))]
                    found[part] = self.mixer.log10(*inputs(corpus, bits.zeros[part], bits.ones[part]), bits.bit[part])
                text = np.flatnonzero(np.diff(bits.first))
                out[run.text + text] += np.add.reduceat(found, bits.first[text])
        return out

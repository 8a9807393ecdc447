"""Language-model scores: online logistic context mixing over hashed bit contexts.

A text is coded bit by bit.  Frequent tokens, the text's end and an escape are
leaves of a code; the bits on the way to a token's leaf are predicted from several
hashed contexts that reach across tokens, and from what this text had so far
(``code_bits``): mixed by gated weights, refined by an adaptive map.  All other
tokens follow an escape: of those seen in training by their counts, new ones
spelled, byte by byte, by a mixer of the same kind whose contexts are the last 1,
2, 3, 4 or 8 bytes of the token.  Both share an urn that goes on adapting: a token
that came k times among the n escaped ones of its text so far has probability
(k + A p) / (n + A).  The score is the log10 probability of the whole text.

Tokens seen once in training have no leaf: left out, they are new ones, so the
escapes of the training texts tell how often to expect those.

Counts, weights and maps cover all training texts: tokens are counted per task and
summed by shuffle, the bit tables summed from all of them.  Then the tasks count in
cells how the bits of every training text came out, read from the tables of the
other half of the texts, and those of every training token spelled once, its own
occurrence taken out; weights and maps are fitted to the cells' sums, which no
order or number of tasks changes.
Which tokens reach the tasks by broadcast (``COMMON``) and which by a join
changes the plan only: both use the same urn.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import code_bits
from . import words as W
from .base import keyed, stored
from .code_bits import pick

PIECE = 1 << 19  # bytes of texts whose bits are handled at once
COUNT_BLOCK = 1 << 12  # entries of a count table that travel together
COMMON = 1 << 18  # tokens broadcast with their counts: 6 MB, whatever the corpus
LOOKS_BACK = (1, 2, 3, 4, 8)  # bytes of the contexts; the sixth is the place alone
ORDERS = 1 + len(LOOKS_BACK)
TABLE_BITS = 18
BLOCK = 1 << 13  # slots of a table that travel together
ADAPT = 3000.0  # A: how many tokens the model's own probability weighs
_MASK = (1 << TABLE_BITS) - 1
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SALTS = np.arange(1, ORDERS + 1, dtype=np.uint64) * _C1
_END, _BLANK = b"\n", b" "


def trains(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(True))


# ---------------------------------------------------------------- bits


def _places(tokens: list[bytes], block: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(token, byte, context per order) of each byte of each token, in blocks of ``block`` bytes.

    A token of any length is thus bounded work in bounded memory.  An end is a
    single line feed; other tokens go on with a blank.
    """
    coded = [t if t == _END else t + _BLANK for t in tokens]
    size = np.array([len(t) for t in coded], np.int64)
    flat = np.frombuffer(b"".join(coded), np.uint8)
    owner = np.repeat(np.arange(len(coded)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    for lo in range(0, len(flat), block):
        at = np.arange(lo, min(lo + block, len(flat)))
        p = place[at]
        contexts, held = [np.minimum(p, 3).astype(np.uint64)], np.zeros(len(at), np.uint64)
        for k in range(1, LOOKS_BACK[-1] + 1):
            held = held * np.uint64(257) + np.where(p >= k, flat[np.maximum(at - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) + np.uint64(1)
            if k in LOOKS_BACK:
                contexts.append(held)
        yield owner[at], flat[at].astype(np.uint64), contexts


def _slots(byte: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(bit, slots per order) for each of the eight bits of the bytes."""
    contexts = [W.mix(c + salt) for c, salt in zip(contexts, _SALTS)]
    node = np.ones(len(byte), np.uint64)
    for shift in range(7, -1, -1):
        bit, spread, slots = (byte >> np.uint64(shift)) & np.uint64(1), node * _C1, []
        for c in contexts:
            slot = c ^ spread
            slot *= _C2
            slot >>= np.uint64(64 - TABLE_BITS)
            slots.append(slot.view(np.int64))
        yield bit.view(np.int64), slots
        node = node * np.uint64(2) + bit


def _bits(tokens: list[bytes], block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(token, bit, slots per order) for each bit of each byte, over all places of all tokens at once."""
    for owner, byte, contexts in _places(tokens, block):
        for bit, slots in _slots(byte, contexts):
            yield owner, bit, slots


def _alike(byte: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place's group, bytes, contexts): places with one byte after one longest context have the same bits."""
    _, first, group = np.unique(W.mix(contexts[-1]) + byte * _C1, return_index=True, return_inverse=True)
    return group, byte[first], [c[first] for c in contexts]


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit counts of a task's distinct tokens, as blocks of the tables (order, slot, bit).

    Each token counts once: the bits are there to spell tokens that are new.
    """
    tables = np.zeros((ORDERS, 2 << TABLE_BITS), np.int32)
    for batch in batches:
        tokens = batch.column(0).to_pylist()
        for _, byte, contexts in _places(tokens, 1 << 17):
            group, byte, contexts = _alike(byte, contexts)
            times = np.bincount(group).astype(np.int32)
            for bit, slots in _slots(byte, contexts):
                for k in range(ORDERS):
                    np.add.at(tables[k], slots[k] * 2 + bit, times)
    flat = tables.reshape(-1, 2 * BLOCK)
    used = np.flatnonzero(flat.any(axis=1))
    for lo in range(0, len(used), 64):
        part = used[lo : lo + 64]
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array([flat[i].tobytes() for i in part], pa.binary())], ["block", "counts"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen = np.frombuffer(counts.as_py(), np.int32).astype(np.int64)
            total[block] = total[block] + seen if block in total else seen
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.astype(np.float32).tobytes() for t in total.values()], pa.binary())], ["block", "counts"])


# ---------------------------------------------------------------- mixer


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.02) / (n0 + 0.02))


GATES = 4 * ORDERS
_STEPS_APM = 33
_FINE = 1 << 10  # steps at which the refined log-odds are read
_BORDERS = np.array([-5.0, -2.0, -0.4, 0.4, 2.0, 5.0])
_KINDS = 8  # bins of a cell's log-odds: unknown, and those between the borders
CELLS = 4 * _KINDS**ORDERS


def _read(counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, gate) of each slot of an order.

    The longest context with a count and whether it is certain make the gate of a
    bit: the greatest of the gates that its contexts name.
    """
    n0, n1 = counts[..., 0], counts[..., 1]
    known = n0 + n1 > 0.5
    gate = order * 4 + (np.minimum(n0, n1) < 0.5) * 2 + (n0 + n1 > 3.5)
    return np.where(known, _stretch(n0, n1), 0.0).astype(np.float32), np.where(known | (order == 0), gate, 0).astype(np.int8)


@dataclass
class Mixer:
    tables: np.ndarray  # order x slot x bit
    weights: np.ndarray  # gate x order
    refine: np.ndarray  # gate x bucket: log-odds of the refined probability

    def __post_init__(self) -> None:
        self.reads = [_read(t, k) for k, t in enumerate(self.tables)]
        z = (np.arange(_FINE) + 0.5) * (24 / _FINE) - 12
        at = (z + 12) / 24 * (_STEPS_APM - 1)
        low = at.astype(np.int64)
        refined = self.refine[:, low] * (1 - at + low) + self.refine[:, low + 1] * (at - low)
        p = np.clip(1 / (1 + np.exp(-(z + refined) / 2)), 1e-6, 1 - 1e-6)
        self.by_bit = np.log10(np.stack([1 - p, p], axis=2)).astype(np.float32).ravel()  # gate x step x bit

    def __reduce__(self):
        return Mixer, (self.tables, self.weights, self.refine)

    def bits_log10(self, bit: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """log10 probability of each bit."""
        gate = pick(self.reads[0][1], slots[0])
        for k in range(1, ORDERS):
            np.maximum(gate, pick(self.reads[k][1], slots[k]), out=gate)
        gate = gate.astype(np.int64)
        weights, z = self.weights.astype(np.float32), np.full(len(bit), 12, np.float32)
        for k in range(ORDERS):
            part = pick(np.ascontiguousarray(weights[:, k]), gate)
            part *= pick(self.reads[k][0], slots[k])
            z += part
        step = np.clip(z * np.float32(_FINE / 24), 0, _FINE - 1).astype(np.int64)
        step += gate * _FINE
        return pick(self.by_bit, step * 2 + bit)

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """log10 probability of each token, with the sign that ends it."""
        out = np.zeros(len(tokens))
        for owner, byte, contexts in _places(tokens, 1 << 17):
            group, byte, contexts = _alike(byte, contexts)
            log = np.zeros(len(byte))
            for lo in range(0, len(byte), 1 << 14):  # small enough for the caches
                part = slice(lo, lo + (1 << 14))
                for bit, slots in _slots(byte[part], [c[part] for c in contexts]):
                    log[part] += self.bits_log10(bit, slots)
            out += np.bincount(owner, log[group], len(tokens))
        return out


@dataclass
class Cells:
    """How the bits of tokens came out, by the bins of their log-odds and the gate's lower part.

    ``bins`` and ``gates`` are of each order's slots at 2 slot + bit, the bit's own
    occurrence taken out; ``mean`` is the mean log-odds of an order's bin.
    """

    bins: list[np.ndarray]
    gates: list[np.ndarray]
    mean: np.ndarray

    @classmethod
    def of(cls, tables: np.ndarray) -> "Cells":
        bins, gates, mean = [], [], np.zeros((ORDERS, _KINDS))
        for k, counts in enumerate(tables):
            left = np.maximum(counts[:, None, :] - np.eye(2, dtype=np.float32), 0)  # slot x bit taken out x counts
            odds, gate = (r.ravel() for r in _read(left, k))
            bin_ = np.where((left.sum(axis=2) > 0.5).ravel(), 1 + np.searchsorted(_BORDERS, odds), 0)
            total = np.bincount(bin_, counts.ravel(), _KINDS)
            mean[k] = np.bincount(bin_, counts.ravel() * odds, _KINDS) / np.maximum(total, 1e-9)
            bins.append((bin_ * _KINDS**k).astype(np.int32)), gates.append(gate)
        return cls(bins, gates, mean)

    def count(self, seen: np.ndarray, tokens: list[bytes]) -> None:
        """Adds each bit of the tokens to ``seen``, at 2 cell + bit."""
        for _, byte, contexts in _places(tokens, 1 << 17):
            group, byte, contexts = _alike(byte, contexts)
            times = np.bincount(group, minlength=len(byte)).astype(seen.dtype)
            for lo in range(0, len(byte), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                for bit, slots in _slots(byte[part], [c[part] for c in contexts]):
                    cell, gate = np.zeros(len(bit), np.int32), np.zeros(len(bit), np.int8)
                    for k in range(ORDERS):
                        at = slots[k] * 2 + bit
                        cell += pick(self.bins[k], at)
                        np.maximum(gate, pick(self.gates[k], at), out=gate)
                    np.add.at(seen, ((gate & 3) * np.int64(_KINDS**ORDERS) + cell) * 2 + bit, times[part])

    def learn(self, tables: np.ndarray, seen: np.ndarray) -> Mixer:
        """The mixer fitted to all bits that were counted."""
        seen = seen.reshape(-1, 2)
        cell = np.flatnonzero(seen.any(axis=1))
        bins = np.stack([cell // _KINDS**k % _KINDS for k in range(ORDERS)], axis=1)
        longest = np.where((bins > 0).any(axis=1), ORDERS - 1 - (bins[:, ::-1] > 0).argmax(axis=1), 0)
        x = np.stack([self.mean[k][bins[:, k]] for k in range(ORDERS)], axis=1)
        start = np.full((GATES, ORDERS), 0.3)
        return Mixer(tables, *code_bits.fit(x, longest * 4 + cell // _KINDS**ORDERS, seen[cell], start, _STEPS_APM, 12.0))


def learn_mixer(tables: np.ndarray, tokens: list[bytes]) -> Mixer:
    """The mixer of a few tokens."""
    cells, seen = Cells.of(tables), np.zeros(2 * CELLS, np.int64)
    cells.count(seen, tokens)
    return cells.learn(tables, seen)


# ---------------------------------------------------------------- counts


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _tokens(cut: W.Words, at: np.ndarray) -> pa.Array:
    """The words at these places, as a binary column."""
    starts, size = cut.starts[at], cut.ends[at] - cut.starts[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = cut.data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, occurrences in training texts) per chunk; tokens of other texts come with 0."""
    for batch in batches:
        counts_in = np.asarray(batch.column(1)).astype(np.int64)
        for lo, hi, data, offsets in W.chunks(batch, "text", 1 << 23):
            cut = W.cut(data, offsets, lower=True)
            if not len(cut.hashes):
                continue
            by = np.argsort(cut.hashes)
            kinds = _begins(cut.hashes[by])
            total = np.add.reduceat(np.repeat(counts_in[lo:hi], np.diff(cut.first))[by], kinds)
            yield pa.record_batch([_tokens(cut, by[kinds]), pa.array(total)], ["token", "c"])


def _log_gamma_ratio(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log of x (x + 1) ... (x + k - 1)."""
    return _log_gamma(x + k) - _log_gamma(x)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight shifts; x > 0."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def _urn(lp: np.ndarray, times: np.ndarray) -> np.ndarray:
    """log of A p (A p + 1) ... (A p + times - 1) for log10 probabilities, however small."""
    first = math.log(ADAPT) + lp * math.log(10)
    return first + np.where(times > 1, _log_gamma_ratio(np.exp(first) + 1, times - 1), 0.0)


@dataclass
class Common:
    hashes: np.ndarray  # sorted
    known: np.ndarray
    base: np.ndarray  # log10 of the base's probability
    lp: np.ndarray
    leaf_base: np.ndarray  # by leaf, of the end too


def _hashes(tokens: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b"".join(tokens), np.uint8)
    lengths = np.cumsum([0, *map(len, tokens)])
    return W._hash_ranges(joined, lengths[:-1], lengths[1:]) if tokens else np.empty(0, np.uint64)


def _leaves(code: code_bits.Code, cut: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, first): the leaf of every token and of every text's end."""
    size = np.diff(cut.first)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    leaves = np.full(first[-1], code_bits.END, np.int64)
    leaves[np.arange(len(cut.hashes)) + np.repeat(np.arange(len(size)), size)] = code.leaves_of(cut.hashes)
    return leaves, first


def _summed(rows: DataFrame, counted: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sum over the tasks of the flat counts that ``counted`` makes of a task's rows, added block by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = counted(batches).astype(np.int32, copy=False)
        over = -len(flat) % COUNT_BLOCK
        flat = (np.pad(flat, (0, over)) if over else flat).reshape(-1, COUNT_BLOCK)
        used = np.flatnonzero(flat.any(axis=1))
        for lo in range(0, len(used), 64):
            part = used[lo : lo + 64]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array([flat[i].tobytes() for i in part], pa.binary())], ["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_py(), np.int32).astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([t.tobytes() for t in sums.values()], pa.binary())], ["block", "counts"])

    blocks = rows.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(total, "block int, counts binary").toArrow()  # bounded: the tables' size
    flat = np.zeros((-(-size // COUNT_BLOCK), COUNT_BLOCK), np.int64)
    for block, counts in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist()):
        flat[block] = np.frombuffer(counts, np.int64)
    return flat.ravel()[:size]


def _learn_code(rows: DataFrame, code: code_bits.Code) -> code_bits.Model:
    """Bit counts of all training texts, and the mixer fitted to all their bits."""
    context = rows.sparkSession.sparkContext
    half = F.pmod(F.xxhash64("kd", "kh"), F.lit(2)).cast("int")
    train, sent = rows.filter("train = 1").select("text", half.alias("half")), context.broadcast(code)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            own = np.asarray(batch.column(1))
            for k in (0, 1):
                for _, _, data, offsets in W.chunks(batch.filter(pa.array(own == k)), "text", PIECE):
                    yield k, *_leaves(sent.value, W.cut(data, offsets, lower=True))

    def bits(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        tables = [code_bits.Tables.empty(sent.value.nodes) for _ in range(2)]
        for k, *part in leaves(batches):
            code_bits.count(sent.value, tables[k], *part)
        return np.concatenate([t.ravel() for both in tables for t in (both.node, both.anchor, both.before)])

    sizes = [t.size for t in vars(code_bits.Tables.empty(code.nodes)).values()]
    counted = _summed(train, bits, 2 * sum(sizes)).reshape(2, -1)
    tables_of = lambda flat: code_bits.Tables(*(p.reshape(-1, 2) for p in np.split(flat.astype(np.float32), np.cumsum(sizes)[:-1])))
    cells = [code_bits.Cells.of(tables_of(other)) for other in counted[::-1]]
    sent_cells = context.broadcast(cells)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros(2 * code_bits.CELLS, np.int32)
        for k, *part in leaves(batches):
            sent_cells.value[k].count(sent.value, seen, *part)
        return seen

    seen = _summed(train, outcomes, 2 * code_bits.CELLS)
    return code_bits.Model.of(code, tables_of(counted.sum(axis=0)), code_bits.Cells.learn(cells, seen))


_PARTS = "doc_id bigint, kd bigint, kh bigint, n bigint, n_bytes bigint, n_known bigint, n_rare bigint, base double, bits double, model double, rare array<struct<token:binary,tf:bigint>>"


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Tokens are lower-cased (A-Z) words without white space, and one end.  A NULL
    or empty text has the end only.  A NULL id counts as training.  Repeated rows
    are counted each.  With no training rows every count is 0 and the base has
    the probability 1 for each token (0.1 / 0.1).
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text).withColumn("train", trains(F.col("doc_id")).cast("bigint"))
    source = rows.select(F.col("text").cast("binary").alias("text"), "train")
    counted = source.select("text", "train").mapInArrow(_count_tokens, "token binary, c bigint")
    vocabulary = stored(counted.groupBy("token").agg(F.sum("c").alias("c")), "tokens")
    ends = rows.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    n, kinds = sums[0] + ends, sums[1] + (ends > 0)
    below = math.log10(n + 0.1 * (kinds + 1))

    # Bit tables: a fixed number of slots, summed block by block.
    known = vocabulary.filter("c > 0").select("token")
    blocks = known.mapInArrow(_count_bits, "block int, counts binary").repartition("block").mapInArrow(_add_blocks, "block int, counts binary").toArrow()
    flat = np.zeros((ORDERS * (1 << TABLE_BITS) // BLOCK, 2 * BLOCK), np.float32)
    for block, counts in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist()):
        flat[block] = np.frombuffer(counts, np.float32)
    tables = flat.reshape(ORDERS, 1 << TABLE_BITS, 2)
    for _, bit, slots in _bits([_END]):
        for k in range(ORDERS):
            tables[k, slots[k], bit] += min(ends, 1)
    cells = Cells.of(tables)
    sent_cells = spark.sparkContext.broadcast(cells)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros(2 * CELLS, np.int32)
        for batch in batches:
            sent_cells.value.count(seen, batch.column(0).to_pylist())
        return seen

    seen = _summed(known, outcomes, 2 * CELLS)
    if ends:
        cells.count(seen, [_END])
    mixer = spark.sparkContext.broadcast(cells.learn(tables, seen))

    # The code: tokens that came at least twice, the most frequent ones.
    top = vocabulary.filter("c > 1").orderBy(F.desc("c"), "token").limit(code_bits.LEAVES).toArrow()
    with_leaf = np.asarray(top.column("c")).astype(np.int64)
    others = int(sums[0] - with_leaf.sum())  # of training tokens, those without a leaf
    new = min(max(sums[2], 1) / others, 0.9) if others else 1.0
    code = code_bits.build_code(_hashes(top.column("token").to_pylist()), with_leaf, ends, others)
    learned = spark.sparkContext.broadcast(_learn_code(rows.withColumn("text", F.col("text").cast("binary")), code))

    def token_log10(tokens: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Of a token among those without a leaf."""
        spelled = math.log(new) + mixer.value.log10(tokens) * math.log(10)
        counted = np.log(np.maximum((1 - new) * counts / max(others, 1), 1e-300))
        return np.where(counts > 0, np.logaddexp(spelled, counted), spelled) / math.log(10)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(token_log10(tokens, counts))], ["token", "c", "lp"])

    mixed = stored(vocabulary.select("token", "c").mapInArrow(mix, "token binary, c bigint, lp double"), "mixed")
    top = mixed.orderBy(F.desc("c"), "token").limit(COMMON).toArrow()
    hashes, seen = _hashes(top.column("token").to_pylist()), np.asarray(top.column("c"))
    by = np.argsort(hashes)
    base_of = lambda counts: np.log10(counts + 0.1) - below
    leaf_base = base_of(np.concatenate([[ends, 0], with_leaf]))
    sent = spark.sparkContext.broadcast(Common(hashes[by], seen[by] > 0, base_of(seen)[by], np.asarray(top.column("lp"))[by], leaf_base))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, model_of_bits = sent.value, learned.value
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch, "text", PIECE):
                cut = W.cut(data, offsets, lower=True)
                leaves, first = _leaves(model_of_bits.code, cut)
                bits = model_of_bits.log10(leaves, first)
                leaf = leaves != code_bits.ESCAPE
                base = np.add.reduceat(np.where(leaf, pick(c.leaf_base, leaves), 0.0), first[:-1])
                n_known = np.add.reduceat(leaf.astype(np.int64), first[:-1]) - (ends == 0)
                # Tokens without a leaf, each kind of a text once.
                words = np.flatnonzero(~leaf)
                owner = np.repeat(np.arange(cut.texts), np.diff(first))[words]
                words -= owner  # a text's end is no word
                own = cut.hashes[words]
                by = np.lexsort((own, owner))
                kinds = _begins(owner[by], own[by])
                words, owner, own, tf = words[by[kinds]], owner[by[kinds]], own[by[kinds]], np.diff(np.append(kinds, len(by)))
                at = np.minimum(np.searchsorted(c.hashes, own), max(len(c.hashes) - 1, 0))
                hit = c.hashes[at] == own if len(c.hashes) else np.zeros(len(own), bool)
                of, times, at = owner[hit], tf[hit].astype(float), at[hit]
                base += np.bincount(of, times * c.base[at], cut.texts)
                n_known += np.bincount(of, times * c.known[at], cut.texts).astype(np.int64)
                model = np.bincount(of, _urn(c.lp[at], times), cut.texts).astype(float)  # counts, where nothing was hit
                rest = np.flatnonzero(~hit)
                tokens = pa.StructArray.from_arrays([_tokens(cut, words[rest]), pa.array(tf[rest])], ["token", "tf"])
                borders = np.searchsorted(owner[rest], np.arange(cut.texts + 1)).astype(np.int32)
                columns = [np.diff(first), np.diff(offsets), n_known, np.bincount(owner, tf, cut.texts).astype(np.int64), base, bits, model]
                ids = [batch.column(k).slice(lo, hi - lo) for k in range(3)]
                yield pa.record_batch([*ids, *map(pa.array, columns), pa.ListArray.from_arrays(borders, tokens)], ["doc_id", "kd", "kh", "n", "n_bytes", "n_known", "n_rare", "base", "bits", "model", "rare"])

    binary = rows.select("doc_id", "kd", "kh", F.col("text").cast("binary").alias("text"))
    partial = stored(binary.mapInArrow(parts, _PARTS), "texts")  # read twice, made once
    # The rest of the tokens meet their counts by a join.
    rare = partial.select("kd", "kh", F.explode("rare").alias("r")).select("kd", "kh", "r.token", "r.tf")
    first_log = F.lit(math.log(ADAPT)) + F.col("lp") * math.log(10)
    more = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("tf") - 1), F.lit(0.0), lambda a, j: a + F.log(F.exp(first_log) + j))
    urn = F.when(F.col("tf") == 1, first_log).otherwise(first_log + more)
    found = rare.join(mixed, "token").groupBy("kd", "kh").agg(
        F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) - below)).alias("rare_base"), F.sum(urn).alias("rare_model"), F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("rare_known")
    )
    whole = partial.drop("rare").join(found, ["kd", "kh"], "left").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("kd", "kh")))
    plus = lambda name, more: F.col(name) + F.coalesce(F.col(more), F.lit(0)) / F.col("same")
    final = whole.select(
        "doc_id", (~trains(F.col("doc_id"))).alias("held_out"), F.col("n").alias("n_tokens"), F.round(plus("n_known", "rare_known")).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), plus("base", "rare_base").alias("base_score"), plus("model", "rare_model").alias("ln"), "n_bytes", "bits", "n_rare",
    )
    # Below the product of urns stands A (A + 1) ... (A + n - 1).
    under = _urn_total(F.col("n_rare"))
    score = F.col("bits") + (F.col("ln") - under) / math.log(10)
    return final.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", score.alias("score"), (-score * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def _urn_total(n: Column) -> Column:
    """log gamma(A + n) - log gamma(A), by Stirling's series: A is large."""
    lg = lambda x: (x - 0.5) * F.log(x) - x + 1 / (12 * x) - 1 / (360 * x * x * x)
    a = F.lit(ADAPT)
    return lg(a + n) - lg(a)

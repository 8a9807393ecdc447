"""Quality classifier: a factorisation machine over words, structure and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pair sum in
linear time as half of (sum v x)^2 - sum (v x)^2, per factor.  Inputs are hashed
words (damped counts, unit length), statistics of the text's structure (value and
bin), and metadata columns the caller names (binned).  It is fitted on at most
``SAMPLE`` labelled rows, the first in the order of a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

SAMPLE = 6000  # labelled rows that the model is fitted on, at most
FACTORS = 8
WORD_SLOTS = 1 << 14
BINS = 12
EPOCHS = 6
THRESHOLD = 0.7

STATISTICS = ("chars", "words", "word length", "capitals", "digits", "marks", "other marks", "lines", "beyond ascii", "distinct", "bare words", "most frequent")
_SLOTS = WORD_SLOTS + len(STATISTICS) * (BINS + 1)
META_SLOTS = 64  # for each metadata column


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def _statistics(cut: W.Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, each value within 0 and 1."""
    edges = offsets - offsets[0]
    size = np.maximum(np.diff(edges), 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[edges])

    n = np.maximum(np.diff(cut.first), 1)
    upper, digit = (data - np.uint8(65)) < 26, (data - np.uint8(48)) < 10
    letter = upper | ((data - np.uint8(97)) < 26) | (data >= 0x80)
    blank = (data == 0x20) | ((data - np.uint8(9)) < 5)
    common = (data == 0x2E) | (data == 0x2C)
    bare = letter | digit
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(bare | common, out=inside[1:])
    plain = np.zeros(len(cut.starts) + 1, np.int64)
    np.cumsum(inside[cut.ends] - inside[cut.starts] == cut.ends - cut.starts, out=plain[1:])
    out = np.zeros((cut.texts, len(STATISTICS)))
    out[:, 0] = np.log2(size) / 30
    out[:, 1] = np.log2(n + 1) / 30
    out[:, 2] = np.minimum(size / n / 30, 1)
    letters = np.maximum(count(letter), 1)
    for k, mask in ((4, digit), (5, common), (6, ~(bare | common | blank)), (7, data == 0x0A), (8, data >= 0x80)):
        out[:, k] = count(mask) / size
    out[:, 3] = count(upper) / letters
    out[:, 10] = (plain[cut.first[1:]] - plain[cut.first[:-1]]) / n
    return np.minimum(out, 1)


def features(data: np.ndarray, offsets: np.ndarray, meta: Sequence[np.ndarray] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text.  ``meta``: for each metadata column the slot of each text."""
    cut = W.cut(data, offsets, lower=True)
    raw = data[offsets[0] : offsets[-1]]
    stats = _statistics(cut, raw, offsets)
    slots = (cut.hashes & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
    base = WORD_SLOTS + np.arange(len(STATISTICS)) * (BINS + 1)
    for t in range(cut.texts):
        own, often = np.unique(slots[cut.first[t] : cut.first[t + 1]], return_counts=True)
        total = max(int(often.sum()), 1)
        stats[t, 9] = len(own) / total
        stats[t, 11] = often.max() / total if len(often) else 0
        damped = 1 + np.log(often)
        damped /= np.sqrt((damped * damped).sum()) if len(often) else 1
        bins = np.minimum((np.sqrt(stats[t]) * BINS).astype(np.int64), BINS - 1)
        more = [WORD_SLOTS + len(STATISTICS) * (BINS + 1) + k * META_SLOTS + int(m[t]) for k, m in enumerate(meta)]
        yield (
            np.concatenate([own, base + 1 + bins, base, np.array(more, np.int64)]),
            np.concatenate([damped, np.full(len(base), 0.5), stats[t], np.full(len(more), 0.5)]),
        )


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, slots: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[slots] * values[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[slots] @ values + 0.5 * (s @ s - (v * v).sum()))

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(slots, values), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, slots: int, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Stochastic gradients with adaptive step sizes, in a fixed shuffled order."""
    chance = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(slots), chance.normal(0, 0.02, (slots, FACTORS)))
    seen_b, seen_w, seen_v = 1e-8, np.full(slots, 1e-8), np.full((slots, FACTORS), 1e-8)
    for _ in range(epochs):
        for i in chance.permutation(len(rows)):
            x, val = rows[i]
            v = model.factors[x]
            xv = v * val[:, None]
            s = xv.sum(axis=0)
            z = model.bias + model.linear[x] @ val + 0.5 * (s @ s - (xv * xv).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            gw = g * val + decay * model.linear[x]
            gv = g * val[:, None] * (s - xv) + decay * v
            seen_b += g * g
            seen_w[x] += gw * gw
            seen_v[x] += gv * gv
            model.bias -= rate * g / np.sqrt(seen_b)
            model.linear[x] -= rate * gw / np.sqrt(seen_w[x])
            model.factors[x] = v - rate * gv / np.sqrt(seen_v[x])
    return model


def _prepared(docs: DataFrame, text: str, meta: Sequence[str], *more: Column) -> DataFrame:
    """Text as bytes and metadata columns as bins of their logarithm; bin 0 for NULL and for a column that is not there."""
    log = lambda m: F.floor(F.log2(F.col(m).cast("double") + 1)) + 1 if m in docs.columns else F.lit(None).cast("bigint")
    bins = [F.coalesce(F.least(log(m), F.lit(META_SLOTS - 1)), F.lit(0)).cast("int").alias(f"__m{i}") for i, m in enumerate(meta)]
    return docs.select(*more, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__text"), *bins)


def _rows(batch: pa.RecordBatch, meta: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    extra = [np.asarray(batch.column(batch.schema.get_field_index(f"__m{k}"))) for k in range(meta)]
    for lo, hi, data, offsets in W.chunks(batch, "__text"):
        for i, (slots, values) in enumerate(features(data, offsets, [m[lo:hi] for m in extra]), lo):
            yield i, slots, values


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", meta: Sequence[str] = ("n_chars",), doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Machine:
    """Fits on labelled rows outside the held-out part; rows without a label do not count.

    With no labelled row there is nothing to reject by: every score is 0.73.
    """
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y")).filter("__id is not null and __y is not null")
    chosen = known.filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__y").limit(sample)
    joined = docs.join(chosen, docs[doc_id] == chosen["__id"])
    n = len(meta)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_rows(batch, n))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                ["id", "y", "slots", "values"],
            )

    ready = _prepared(joined, text, meta, F.col("__id"), F.col("__y"))
    # Bounded by ``sample``; sorted on the driver, so that reruns fit the same model.
    table = ready.mapInArrow(extract, "id bigint, y double, slots array<int>, values array<double>").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "y", "slots", "values"))), key=lambda r: (r[0], r[1], len(r[2]), r[3]))[:sample]
    if not rows:
        return Machine(1.0, np.zeros(_SLOTS + n * META_SLOTS), np.zeros((_SLOTS + n * META_SLOTS, FACTORS)))
    pairs = [(np.array(r[2], np.int64), np.array(r[3])) for r in rows]
    return train(pairs, np.array([r[1] for r in rows]), _SLOTS + n * META_SLOTS)


def score_documents(docs: DataFrame, model: Machine, meta: Sequence[str] = ("n_chars",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a NULL text is scored as an empty one."""
    sent, n = docs.sparkSession.sparkContext.broadcast(model), len(meta)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(s, v) for _, s, v in _rows(batch, n)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = _prepared(docs, text, meta, F.col(doc_id).cast("bigint").alias("doc_id")).mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, meta: Sequence[str] = ("n_chars",), text: str = "text") -> DataFrame:
    """The documents scored at the threshold or above, with the columns of ``docs``, where they lie."""
    sent, n, names = docs.sparkSession.sparkContext.broadcast(model), len(meta), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([sent.value.score(s, v) >= THRESHOLD for _, s, v in _rows(batch, n)], pa.bool_())
            yield batch.select(names).filter(mask)

    return _prepared(docs, text, meta, *[F.col(f"`{c}`") for c in names]).mapInArrow(keep, docs.schema)

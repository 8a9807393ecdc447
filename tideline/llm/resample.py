"""Importance resampling: documents drawn in proportion to how much they look like a target.

Features are all runs of 1 to ``max_n`` consecutive words, hashed into buckets.
A bucket's gain is the logarithm of its smoothed share in the target over that
in the documents; a document's weight is the sum of its features' gains.  Adding
Gumbel noise made from the id and keeping the highest sums draws without
replacement in proportion to exp(weight).

Inside the tasks the words are cut by Arrow kernels: lower-casing, splitting on a
pattern, flattening, dictionary encoding.  A run of n words is a pair (run of n-1
words, next word) of shifted dictionary indices; only distinct pairs are hashed,
each by carrying its prefix's CRC on.

Bounded memory: a batch is worked on in slices of about ``SLICE_BYTES`` (a longer
text is a slice of its own); a task sends at most ``buckets`` counts; the gains,
one number per bucket, are the only thing the driver holds.

Defined results: a NULL text has no words, weight 0.  A NULL id is hashed as an
empty one and comes after all others among equal scores.  Rows that repeat are
drawn on their own, each with a rank.  Without target texts every target count is
0 and the gains follow from the formula.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number
from .base import keyed, stored, with_row_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words of digits, a-z and everything above ASCII
BUCKETS = 10_000
MAX_N = 1
SLICE_BYTES = 4 << 20
SCALE = 1000  # gains and noise are whole thousandths


@dataclass
class Features:
    """Runs of words of a slice of texts: bucket of each, and where each text's words and runs lie."""

    words: np.ndarray  # words of each text
    buckets: list[np.ndarray]  # for n = 1, 2, ...: the bucket of every run, text after text
    firsts: list[np.ndarray]  # for n = 1, 2, ...: text i has runs firsts[i]:firsts[i + 1]


def features(texts: pa.Array, max_n: int, buckets: int) -> Features:
    """Cuts and hashes a slice of texts; NULL counts as empty."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), pattern=SEPARATORS)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")  # texts that begin or end with a separator
    encoded = flat.filter(real).dictionary_encode()
    word = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.as_py().encode() for w in encoded.dictionary]
    rows = np.arange(len(texts) + 1)
    first = np.searchsorted(owner, rows)
    found = Features(np.diff(first), [], [])
    run, codes = word, np.array([zlib.crc32(w) for w in spelled], np.int64)
    for n in range(1, max_n + 1):
        if n > 1:
            # A run of n words is the run of n - 1 that starts there and the word after it.
            here = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(owner) >= n else np.empty(0, np.int64)
            starts = np.searchsorted(start_of, here) if n > 2 else here
            pairs, which = np.unique(run[starts] * max(len(spelled), 1) + word[here + n - 1], return_inverse=True)
            prefix, last = pairs // max(len(spelled), 1), pairs % max(len(spelled), 1)
            codes = np.array([zlib.crc32(spelled[w], zlib.crc32(b" ", int(codes[p]))) for p, w in zip(prefix.tolist(), last.tolist())], np.int64)
            run, start_of = which.astype(np.int64), here
            found.firsts.append(np.searchsorted(owner[here], rows))
        else:
            found.firsts.append(first)
        found.buckets.append((codes % buckets)[run] if len(run) else np.empty(0, np.int64))
    return found


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of rows (from, to, texts) of about SLICE_BYTES of the column ``text``."""
    texts = batch.column(batch.schema.get_field_index("text"))
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield row, end, texts.slice(row, end - row)
        row = end


def bucket_counts(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in _slices(batch):
                for found in features(texts, max_n, buckets).buckets:
                    total += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    per_task = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(docs: DataFrame, target: DataFrame, max_n: int, buckets: int, text: str) -> np.ndarray:
    both = bucket_counts(docs, max_n, buckets, text).select("bucket", "n", F.lit(0).alias("side"))
    both = both.unionByName(bucket_counts(target, max_n, buckets, text).select("bucket", "n", F.lit(1).alias("side")))
    rows = both.toArrow()  # bounded: two numbers for each bucket
    counts = np.zeros((2, buckets), np.int64)
    side, bucket, n = (rows.column(c).to_numpy() for c in ("side", "bucket", "n"))
    counts[side, bucket] = n
    own, wanted = int(counts[0].sum()), int(counts[1].sum())
    share = lambda s, t: (t + 1.0) * (own + buckets) / ((s + 1.0) * (wanted + buckets))
    return np.array([math.floor(SCALE * math.log(share(s, t))) for s, t in zip(counts[0].tolist(), counts[1].tolist())], np.int64)


def weigh(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kd, kh, n_words, n_features, weight) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(_gains(docs, target, max_n, buckets, text))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value
        for batch in batches:
            words, sizes, weights = [], [], []
            for lo, hi, texts in _slices(batch):
                found = features(texts, max_n, buckets)
                size, weight = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for bucket, first in zip(found.buckets, found.firsts):
                    upto = np.concatenate([[0], np.cumsum(gains[bucket])])
                    size += np.diff(first)
                    weight += np.diff(upto[first])
                words.append(found.words)
                sizes.append(size)
                weights.append(weight)
            if words:
                own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "kd", "kh")]
                counted = [pa.array(np.concatenate(x), pa.int64()) for x in (words, sizes, weights)]
                yield pa.record_batch([*own, *counted], ["doc_id", "kd", "kh", "n_words", "n_features", "weight"])

    return keyed(docs, doc_id, text).mapInArrow(score, "doc_id bigint, kd bigint, kh bigint, n_words bigint, n_features bigint, weight bigint")


def rank_documents(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: str = "2024", max_n: int = MAX_N, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, kd, kh, n_words, n_features, weight, score, rank) of every document.

    ``rank`` is NULL for documents not drawn.  Drawn are ``percent`` of those with
    at least ``min_words`` words; the order is found by a range-partitioned sort
    over the numbers alone, in as many tasks as the session has.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = weigh(docs, target, max_n, buckets, doc_id, text).withColumn("score", F.col("weight") + noise)
    fixed = stored(scored, "resample-scores")  # a few numbers per document; the texts are not read again
    enough = fixed.filter(F.col("n_words") >= min_words)
    drawn = percent * enough.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("kh"), F.col("weight"), F.col("n_features")]
    placed = global_row_number(enough, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(fixed.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint")))


def draw(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings: object) -> DataFrame:
    """The drawn documents, with the columns of ``docs``.

    Rows with one id and text have one score; they are kept if any of them was drawn.
    """
    chosen = rank_documents(docs, target, doc_id=doc_id, text=text, **settings).filter(F.col("rank").isNotNull())
    keys = chosen.select(F.col("kd").alias("__kd"), F.col("kh").alias("__kh")).distinct()
    return with_row_key(docs, doc_id, text).join(keys, ["__kd", "__kh"], "left_semi").select(*docs.columns)

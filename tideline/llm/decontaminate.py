"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long: banded MinHash compares by resemblance,
which for 30 shingles inside 20,000 is 0.0015, so thousands of hash functions
would be needed.  The sketch here is the bottom of one MinHash order, cut by size:
items are partitioned by shingle count (powers of two), and an item of n shingles
keeps as many of its smallest hashes as the largest item of its partition needs
so that a document without any of them cannot hold ``threshold`` of the item.
Candidates lose nothing that way; each is verified on the exact shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .base import keyed

WIDTH = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 1 << 20  # item shingles sent to the tasks at once (8 MB); more items are searched block by block
_SIFT = 1 << 20


def sketch_size(n: int, threshold: float) -> int:
    """Hashes an item of n shingles keeps: enough for every item of its size partition."""
    top = 2 ** (int(n).bit_length()) - 1
    return min(n, top - math.ceil(threshold * top - 1e-9) + 1)


class Items:
    """A block of items: shingle sets and the sorted table of their sketch hashes."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], threshold: float):
        self.ids, self.sets, self.threshold = ids, sets, threshold
        kept = [s[: sketch_size(len(s), threshold)] for s in sets]  # sets are sorted: the smallest come first
        owner = np.repeat(np.arange(len(sets)), [len(k) for k in kept]) if sets else np.empty(0, int)
        flat = np.concatenate(kept) if kept else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], owner[order]
        self.sift = np.zeros(_SIFT, bool)
        self.sift[self.hashes & np.uint64(_SIFT - 1)] = True

    def found_in(self, words: W.Words) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of every text of ``words`` that holds an item."""
        if not len(self.hashes):
            return
        runs = W.windows(words.hashes, WIDTH)
        near = np.flatnonzero(self.sift[runs & np.uint64(_SIFT - 1)])
        if not len(near):
            return
        text = np.searchsorted(words.first, near, "right") - 1
        near, text = near[near + WIDTH <= words.first[text + 1]], text[near + WIDTH <= words.first[text + 1]]
        left, right = np.searchsorted(self.hashes, runs[near]), np.searchsorted(self.hashes, runs[near], "right")
        for t in np.unique(text[left < right]):
            own = np.unique(runs[words.first[t] : words.first[t + 1] - WIDTH + 1])
            mine = (text == t) & (left < right)
            for item in sorted({int(self.owner[k]) for lo, hi in zip(left[mine], right[mine]) for k in range(lo, hi)}):
                wanted = self.sets[item]
                place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                shared = int((own[place] == wanted).sum())
                if shared >= math.ceil(self.threshold * len(wanted) - 1e-9):
                    yield int(t), item, shared


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in W.chunks(batch, "text"):
            cut = W.cut(data, offsets, W.alnum_words, lower=True)
            longs = np.diff(cut.first) >= WIDTH
            sets = [W.signed(s) for s in W.shingle_sets(cut, WIDTH)]
            keep = [i for i in range(hi - lo) if longs[i]]
            yield pa.record_batch({
                "item_id": batch.column(0).slice(lo, hi - lo).take(pa.array(keep, pa.int32())),
                "n": pa.array([len(sets[i]) for i in keep], pa.int64()),
                "shingles": pa.array([sets[i] for i in keep], pa.list_(pa.int64())),
            })


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD) -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_SHINGLES``; no more than one block is on the driver at once.

    Items of fewer than five words have no shingle and are never found; a NULL text is empty.
    """
    source = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    sets = source.mapInArrow(_item_sets, "item_id bigint, n bigint, shingles array<bigint>")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = math.ceil(total / BLOCK_SHINGLES)
    for k in range(parts):
        block = sets.filter(F.pmod(F.hash("shingles"), F.lit(parts)) == k).orderBy("item_id").toArrow()
        yield Items(block.column("item_id").to_pylist(), [np.sort(np.array(s, np.int64).view(np.uint64)) for s in block.column("shingles").to_pylist()], threshold)


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document that holds an item.

    Words are lower-cased runs of letters and digits, shingles five words.
    Documents are scanned where they lie, once per block of items; nothing is
    shuffled.  Repeated rows are reported each; a NULL text holds nothing; no
    items, no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double"
    rows = keyed(docs, doc_id, text).select("doc_id", F.col("text").cast("binary").alias("text"))
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items, threshold=threshold):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                ids = batch.column(0)
                hits = [
                    (ids[lo + t].as_py(), known.ids[i], len(known.sets[i]), shared, shared / len(known.sets[i]))
                    for lo, _, data, offsets in W.chunks(batch, "text")
                    for t, i, shared in known.found_in(W.cut(data, offsets, W.alnum_words, lower=True))
                ]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                columns = list(zip(*hits)) or [()] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        found = found.unionByName(rows.mapInArrow(search, schema))
    return found


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with the columns of ``docs``; rows stay where they are."""
    clean = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    schema = clean.schema
    for block in item_blocks(items, threshold=threshold):
        sent = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in W.chunks(batch, "__text"):
                    for t, _, _ in sent.value.found_in(W.cut(data, offsets, W.alnum_words, lower=True)):
                        mask[lo + t] = False
                yield batch.filter(pa.array(mask))

        clean = clean.mapInArrow(keep, schema)
    return clean.drop("__text")

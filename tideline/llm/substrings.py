"""Substring dedup by difference-cover anchors.

Word positions modulo 21 that lie in a perfect difference set are cover
positions: for any two positions i and j some shift below 21 puts both on the
cover.  So two equal windows of 35 words share an aligned anchor, a run of 15
words starting at a cover position of both.  Anchors alone (5 of 21 positions)
are compared over the corpus; only around those that repeat are the windows
themselves hashed (96 bits) and compared.

Exact copies of a whole text are found first: their words all go, and one of
them stands for the group where others look for partners.

A hash that repeats inside an Arrow batch is sent once for the comparison, with
weight 2; its other places travel under keys of their own.  A hot passage thus
meets in one task as one row per batch, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .base import keyed

LENGTH = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # every difference modulo 21 occurs
ANCHOR = LENGTH - PERIOD + 1

_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_PLACES = "key bigint, key2 int, kd bigint, k32 int, place int"  # place holds its weight - 1 in the lowest bit: short rows
_GIVES_ONLY = -1  # a place that is compared but needs no answer


def _sent(hashes: np.ndarray, second: np.ndarray, kd: np.ndarray, k32: np.ndarray, place: np.ndarray, answer: np.ndarray) -> pa.RecordBatch | None:
    """Rows for the comparison.  ``answer`` is False at places that only stand for their text."""
    if not len(hashes):
        return None
    order = np.lexsort((second, hashes))
    hashes, second, kd, k32, place, answer = (x[order] for x in (hashes, second, kd, k32, place, answer))
    starts = np.ones(len(hashes), bool)
    starts[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
    group = np.cumsum(starts) - 1
    many = np.bincount(group)[group] > 1
    others = many & ~starts
    salt = W.mix(hashes ^ W.mix(kd.view(np.uint64) + place.astype(np.uint64)) ^ k32.astype(np.uint64))
    # First of its hash: an answer goes to its own row too, under a key of its own if it is already decided.
    key = np.where(others, salt, hashes)
    keep = ~others | answer
    packed = (np.where(answer, place, _GIVES_ONLY) * 2 + many).astype(np.int32)
    columns = [W.signed(key), second, kd, k32, packed]
    # Sent in text order again: neighbours share their row key, which the shuffle then compresses.
    back = np.flatnonzero(keep)[np.argsort(order[keep])]
    return pa.record_batch([pa.array(c[back]) for c in columns], ["key", "key2", "kd", "k32", "place"])


def _gather(batches: Iterator[pa.RecordBatch], places: Callable[[W.Words, pa.RecordBatch, int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[np.ndarray, ...]] = []
        kd, k32 = (np.asarray(batch.column(c)) for c in ("kd", "k32"))
        stands = np.asarray(batch.column("copies")) > 1
        for lo, _, data, offsets in W.chunks(batch, "text"):
            cut = W.cut(data, offsets)
            hashes, second, at = places(cut, batch, lo)
            if len(at):
                text = np.searchsorted(cut.first, at, "right") - 1
                found.append((hashes, second, kd[lo + text], k32[lo + text], (at - cut.first[text]).astype(np.int32), ~stands[lo + text]))
        if found and (rows := _sent(*(np.concatenate(c) for c in zip(*found)))) is not None:
            yield rows


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def places(cut: W.Words, batch: pa.RecordBatch, lo: int):
        runs = W.windows(cut.hashes, ANCHOR)
        size = np.diff(cut.first)
        place = np.arange(len(cut.hashes)) - np.repeat(cut.first[:-1], size)
        left = np.repeat(size, size) - place
        fits = _ON_COVER[place % PERIOD] & (left >= ANCHOR) & np.repeat(size >= LENGTH, size)
        at = np.flatnonzero(fits)
        return runs[at], np.zeros(len(at), np.int32), at

    yield from _gather(batches, places)


def _candidate_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def places(cut: W.Words, batch: pa.RecordBatch, lo: int):
        anchors = batch.column("places")
        near = np.zeros(len(cut.hashes) + 1, np.int32)
        for t in range(cut.texts):
            n = cut.first[t + 1] - cut.first[t]
            own = anchors[lo + t].values
            if n < LENGTH or own is None:
                continue
            p = np.asarray(own)
            from_, to = np.maximum(p - (PERIOD - 1), 0), np.minimum(p, n - LENGTH)
            from_, to = from_[from_ <= to], to[from_ <= to]
            np.add.at(near, cut.first[t] + from_, 1)
            np.add.at(near, cut.first[t] + to + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.int32), at
        second = W.windows(cut.hashes, LENGTH, 0x9FB21C651E98DF25)[at]
        return W.windows(cut.hashes, LENGTH)[at], (second >> np.uint64(32)).astype(np.uint32).view(np.int32), at

    yield from _gather(batches, places)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay, per row; with ``copies`` above 1 none stays, if the text has a window at all."""
    for batch in batches:
        texts, copies, places = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "copies", "places"))
        total, removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = texts[i].as_py().split()
            n, gone = len(words), 0
            own = places[i].values
            if copies[i].as_py() > 1 and n >= LENGTH:
                words, gone = [], n
            elif own is not None and len(own):
                p = np.asarray(own)
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + LENGTH, -1)
                stays = np.cumsum(edge)[:-1] == 0
                words = list(compress(words, stays.tolist()))
                gone = n - len(words)
            total.append(n), removed.append(gone), kept.append(b" ".join(words))
        columns = {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())}
        yield pa.record_batch([batch.column(0), batch.column(1), *columns.values()], ["kd", "k32", *columns])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _strip(batches):
        digests = pa.array([hashlib.sha256(k.as_py()).hexdigest() for k in batch.column(4)], pa.string())
        yield pa.record_batch([*batch.columns[:4], digests], ["kd", "k32", "n_words", "n_removed", "kept_sha256"])


def _repeating(places: DataFrame) -> DataFrame:
    """(kd, k32, places): for each row key the places whose hash repeats.

    A document's places are at most its words; a hash has one row per batch.
    """
    weight = F.sum(F.col("place").bitwiseAND(F.lit(1)) + 1).over(Window.partitionBy("key", "key2"))
    again = places.withColumn("total", weight).filter((F.col("total") > 1) & (F.col("place") >= 0))
    return again.groupBy("kd", "k32").agg(F.collect_list(F.shiftright("place", 1)).alias("places"))


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(kd, k32, text, copies, places) for every row: ``places`` are the starts of repeated windows."""
    rows = keyed(docs, doc_id, text)
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    # Where ids are unique they are the key.  Else half of the text hash is part of it (31 bits, the
    # lowest bit marks a NULL id) and the hash stands for NULL ids.
    kd = F.coalesce(F.col("doc_id"), F.col("kh"))
    part = F.shiftright("kh", 32).cast("int").bitwiseAND(F.lit(~1)).bitwiseOR(F.col("doc_id").isNull().cast("int"))
    k32 = F.lit(0) if ids["n"] == ids["d"] else part
    base = rows.select(kd.alias("kd"), k32.alias("k32"), F.col("text").cast("binary").alias("text"))

    whole = rows.select(kd.alias("kd"), k32.alias("k32"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    groups = whole.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("kd", "k32")).alias("rep")).filter("copies > 1")
    roles = whole.join(groups, "sha").groupBy("kd", "k32").agg(
        F.max("copies").cast("int").alias("copies"), F.max(F.struct("kd", "k32") == F.col("rep")).alias("stands")
    )
    joined = base.join(roles, ["kd", "k32"], "left")
    compared = joined.filter(F.coalesce("stands", F.lit(True))).select("kd", "k32", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
    anchors = compared.select("kd", "k32", "text", F.lit(1).alias("copies")).mapInArrow(_anchors, _PLACES)
    around = compared.join(_repeating(anchors), ["kd", "k32"])
    windows = around.mapInArrow(_candidate_windows, _PLACES)
    return joined.select("kd", "k32", "text", F.coalesce("copies", F.lit(1)).alias("copies")).join(_repeating(windows), ["kd", "k32"], "left")


_COUNTS = "kd bigint, k32 int, n_words bigint, n_removed bigint"


def _named() -> Column:
    return F.when(F.col("k32").bitwiseAND(F.lit(1)) == 0, F.col("kd")).alias("doc_id")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the words of repeated windows.

    Words are runs without white space, unchanged; the kept ones are joined by
    one space.  A NULL text has none.  A text of fewer than 35 words has no
    window and stays, repeated or not.  Repeated rows are copies of each other.
    """
    stripped = _marked(docs, doc_id, text).select("kd", "k32", "text", "copies", "places").mapInArrow(_strip, f"{_COUNTS}, kept binary")
    return stripped.select(_named(), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def repeat_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the kept text in its place."""
    marked = _marked(docs, doc_id, text).select("kd", "k32", "text", "copies", "places")
    return marked.mapInArrow(_digest, f"{_COUNTS}, kept_sha256 string").select(_named(), "n_words", "n_removed", "kept_sha256")

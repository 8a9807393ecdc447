"""Near-duplicate documents: MinHash bands, odd sketches, exact verification.

Documents with one shingle set are a class; classes are compared, not copies.
Each class has 256 MinHash samples: 100 make 20 band keys of 5, and all of them
are folded into a parity bitmap (odd sketch).  Classes that share a band are
candidates; the population count of the XOR of two odd sketches estimates a high
similarity precisely, and only pairs near enough go on to be confirmed on their
full shingle sets, read from the texts.  A pair at 0.85 shares no band with
probability 8e-6, and falls below the sketch bound (0.74) with about 1e-5.

Large families are joined by a star first: each member of a bucket against the
bucket's smallest id.  Then only pairs in different components are compared, at
the first band they share, and their sketches inside the join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .base import keyed, stored

WIDTH = 5
BANDS, ROWS, SAMPLES = 20, 5, 256
SKETCH_WORDS = 16  # of 64 bits
LINK = (85, 100)  # 100 * intersection >= 85 * union
MARGIN = 0.11  # how far below the link similarity an estimate may lie

_MULTIPLY = W.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = W.mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64))
_BLOCK = 2048


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of hashes."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), _BLOCK):
        values = np.multiply.outer(_MULTIPLY, shingles[lo : lo + _BLOCK])
        values += _ADD[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    grouped = samples[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, r])
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit."""
    bits = 64 * SKETCH_WORDS
    slots = (W.mix(samples + _ADD) >> np.uint64(40)) % np.uint64(bits)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


_FEATURES = "doc_id bigint, kd bigint, kh bigint, n bigint, set_key binary, bands array<bigint>, sketch array<bigint>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in W.chunks(batch, "text"):
            n, keys, bands, sketches = [], [], [], []
            for shingles in W.shingle_sets(W.cut(data, offsets, lower=True), WIDTH):
                n.append(len(shingles))
                if not len(shingles):
                    keys.append(None), bands.append(None), sketches.append(None)
                    continue
                samples = signature(shingles)
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(W.signed(band_keys(samples)))
                sketches.append(odd_sketch(samples))
            ids = [batch.column(c).slice(lo, hi - lo) for c in range(3)]
            more = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.record_batch(ids + more, ["doc_id", "kd", "kh", "n", "set_key", "bands", "sketch"])


def largest_difference(similarity: float) -> int:
    """XOR population count that sketches of the given estimated similarity have."""
    bits = 64 * SKETCH_WORDS
    return math.floor(bits / 2 * (1 - math.exp(-2 * 2 * SAMPLES * (1 - similarity) / bits)))


_BOUND = largest_difference(LINK[0] / LINK[1] - MARGIN)


def _difference(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for i in range(SKETCH_WORDS):
        total = total + F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i)))
    return total


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, text_a, b, text_b) whose full shingle sets are near enough."""
    least, of = LINK
    last, own = None, np.empty(0, np.uint64)
    for batch in batches:
        a, ta = batch.column(0), batch.column(1)
        keep = np.zeros(batch.num_rows, bool)
        for lo, _, data, offsets in W.chunks(batch, "text_b"):
            for i, other in enumerate(W.shingle_sets(W.cut(data, offsets, lower=True), WIDTH), lo):
                key = a[i].as_py()
                if key != last:
                    text = np.frombuffer(ta[i].as_py(), np.uint8)
                    last, own = key, next(W.shingle_sets(W.cut(text, np.array([0, len(text)]), lower=True), WIDTH))
                small, large = (own, other) if len(own) <= len(other) else (other, own)
                if of * len(small) < least * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep[i] = of * both >= least * (len(own) + len(other) - both)
        yield pa.record_batch([a, batch.column(2)], ["a", "b"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among candidate pairs of classes; texts are (set_key, text), one per class."""
    of = lambda side: texts.select(F.col("set_key").alias(side), F.col("text").alias(f"text_{side}"))
    ready = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "text_a", "b", "text_b")
    return stored(ready.mapInArrow(_confirm, "a binary, b binary"), "links")


def sketched_near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs whose odd sketches do not rule a link out."""
    of = lambda side: classes.select(F.col("set_key").alias(side), F.col("sketch").alias(f"sketch_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return stored(both.filter(_difference(F.col("sketch_a"), F.col("sketch_b")) <= _BOUND).select("a", "b"), "pairs")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large and small stars.

    Every round is two joins and two aggregates over the links, written to shared
    storage; stars form after a number of rounds that grows with the logarithm
    of the component size.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    print_ = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = print_(edges)
    while before[0]:
        ways = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        lowest = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = edges.join(lowest, "lo").select("hi", F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        met = large.join(smallest, "hi")
        small = met.select(F.col("hi").alias("x"), "m").union(met.filter("lo != m").select("lo", "m")).distinct()
        edges = stored(small.toDF("hi", "lo"), "edges")
        now = print_(edges)
        if now == before:
            break
        before = now
    return edges.toDF("node", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kd, kh, n_shingles, component_id, kept) for every row.

    Words are lower-cased (A-Z) runs without white space, shingles five words; a
    shorter text is one shingle, an empty or NULL one has none and no links.
    ``component_id`` is the smallest id of the component; NULL ids take part but
    name nothing, so a component of NULL ids only has NULL and its rows are kept.
    """
    rows = keyed(docs, doc_id, text)
    binary = rows.select("doc_id", "kd", "kh", F.col("text").cast("binary").alias("text"))
    features = stored(binary.mapInArrow(_features, _FEATURES), "features")
    full = features.filter(F.col("set_key").isNotNull())
    classes = stored(
        full.groupBy("set_key").agg(
            F.min(F.struct("kd", "kh")).alias("rep"), F.min("doc_id").alias("lowest"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    banded = classes.select("set_key", F.coalesce("lowest", F.lit(2**63 - 1)).alias("id"), F.posexplode("bands").alias("no", "band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("id", "set_key")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(banded.join(shared, "band").select("band", "no", "set_key", F.col("first.set_key").alias("leader")), "members")

    # Each member against the smallest id of its bucket: this alone joins most of a large family.
    first = members.filter("set_key != leader").select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
    first = sketched_near(first, classes)
    wanted = members.select("set_key").distinct().join(classes, "set_key").select("set_key", "rep.kd", "rep.kh")
    one = Window.partitionBy("kd", "kh", "set_key").orderBy(F.lit(1))  # repeated rows: one text for the class
    held = wanted.join(binary.select("kd", "kh", "text"), ["kd", "kh"]).withColumn("__one", F.row_number().over(one)).filter("__one = 1")
    texts = stored(held.select("set_key", "text"), "texts")
    links = confirmed(first, texts)

    # Then every pair of a bucket that is not yet in one component.
    roots = connected(links)
    placed = members.join(roots, members["set_key"] == roots["node"], "left").select("band", "no", "set_key", F.coalesce("root", "set_key").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("band")
    open_ = stored(placed.join(split, "band").join(classes.select("set_key", "sketch", "bands"), "set_key"), "open")
    other = open_.select("band", *[F.col(c).alias(f"{c}_b") for c in ("set_key", "root", "sketch", "bands")])
    near = _difference(F.col("sketch"), F.col("sketch_b")) <= _BOUND
    # A pair is met at the first band it shares, once.
    here = F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), True) == F.col("no") + 1
    met = open_.join(other, (open_["band"] == other["band"]) & (F.col("set_key") < F.col("set_key_b")) & (F.col("root") != F.col("root_b")) & near & here)
    second = met.select(F.col("set_key").alias("a"), F.col("set_key_b").alias("b"))
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = confirmed(second.join(known, ["a", "b"], "left_anti"), texts)

    stars = connected(links.union(more))
    rooted = classes.select("set_key", "lowest").join(stars, classes["set_key"] == stars["node"], "left").select("set_key", "lowest", F.coalesce("root", "set_key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    ids = rooted.join(named, "root").select("set_key", "component_id")
    placed_rows = features.select("doc_id", "kd", "kh", F.col("n").alias("n_shingles"), "set_key").join(ids, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed_rows.select("doc_id", "kd", "kh", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

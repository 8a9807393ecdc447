"""Document fingerprints: the k smallest hashes of a text's distinct word shingles.

Sketches are sorted arrays of longs.  The sketch of a union is the k smallest of
the united sketches, so parts can be sketched apart and merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number
from .base import NO_ID, WORD, keyed

K = 64
WIDTH = 5
_SIFT_ABOVE = 1024  # shingles above which the sort is spared most hashes; the sketch is the same
_LOWEST, _SPAN = -(2**63), 2.0**64


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds the sketch of a non-NULL text column.

    A text of fewer words than ``width`` has one shingle, all its words; a text
    without words has the empty sketch.  Texts of any length are read whole: of
    many hashes only those below a bound that about 4 k pass are sorted, and all
    of them if repeated shingles leave fewer than k.
    """
    n, w, s, few = (f"__{p}_{out}" for p in ("n", "w", "s", "few"))
    words = df.withColumn(w, F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), lambda x: F.xxhash64(x)))
    counted = words.withColumn(n, F.size(w))
    run = F.transform(F.sequence(F.lit(0), F.col(n) - width), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(width)]))
    one = F.array(F.xxhash64(F.col(w)))
    shingled = counted.withColumn(s, F.when(F.col(n) >= width, run).when(F.col(n) > 0, one).otherwise(F.array().cast("array<bigint>")))
    bound = (F.lit(float(_LOWEST)) + F.lit(_SPAN * 4 * k) / F.col(n)).cast("bigint")
    low = F.array_distinct(F.filter(F.col(s), lambda h: h <= bound))
    sifted = shingled.withColumn(few, F.when(F.col(n) > F.lit(max(_SIFT_ABOVE, 8 * k)), low))
    enough = F.col(few).isNotNull() & (F.size(few) >= k)
    chosen = F.when(enough, F.col(few)).otherwise(F.array_distinct(s))
    return sifted.withColumn(out, F.slice(F.sort_array(chosen), 1, k)).drop(n, w, s, few)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch: str, out: str, k: int = K, fan: int = 64) -> DataFrame:
    """One sketch per group from the sketches of its parts.

    A tree of merges: each level joins the parts of one of ``fan`` times fewer
    sub-groups, so that a hot group is never held by one task.
    """
    parts = df.select(*keys, F.col(sketch).alias("__s"), F.pmod(F.xxhash64(F.col(sketch)), F.lit(fan * fan)).alias("__g"))
    for _ in range(2):
        parts = parts.groupBy(*keys, "__g").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("__s")))), 1, k).alias("__s"))
        parts = parts.withColumn("__g", F.floor(F.col("__g") / fan))
    return parts.groupBy(*keys).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("__s")))), 1, k).alias(out))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; of two empty sketches 1."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    highest = F.element_at(a, -1).cast("double") - F.lit(float(_LOWEST))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * _SPAN) / highest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; of an empty a, 1."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def as_text(a: Column) -> Column:
    """The sketch as hexadecimal hashes, comma-joined."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ",")


def sketch_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, sketch, n_shingles_estimate) for every row; a NULL text is empty."""
    rows = keyed(docs, doc_id, text).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "text")
    return with_sketch(rows, "text", "sketch", k, width).select("doc_id", "n_chars", "sketch", distinct_shingles(F.col("sketch"), k).alias("n_shingles_estimate"))


def next_documents(rows: DataFrame) -> DataFrame:
    """(kd, kh, quarter, nkd, nkh): each distinct document, its quarter length, and the key of the next.

    The order is by id, NULL last, then by text hash; after the last comes the
    first.  Only keys are ordered; texts stay out of it.
    """
    keys = rows.select("kd", "kh", F.floor(F.length("text") / 4).cast("int").alias("quarter")).distinct()
    numbered = global_row_number(keys, [(F.col("kd") == NO_ID).asc(), F.col("kd").asc(), F.col("kh").asc()], "__n")
    total = numbered.count()
    follower = numbered.select(F.col("kd").alias("nkd"), F.col("kh").alias("nkh"), F.col("__n").alias("__m"))
    return numbered.join(follower, F.col("__m") == F.col("__n") % F.lit(max(total, 1)) + 1).select("kd", "kh", "quarter", "nkd", "nkh")


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of each text and of its edited text, and the likeness to it and to the next document.

    The edited text has its last quarter replaced by the start of the next
    document.  Rows that repeat (id, text) are one document in the order and
    each get its result.  Texts are shuffled once, by row key; what travels
    between neighbours is a quarter of a text and one sketch.
    """
    rows = keyed(docs, doc_id, text)
    texts = rows.select("kd", "kh", "text")
    after = next_documents(rows)
    # Both joins read the same exchange of texts.
    giving = texts.withColumnsRenamed({"kd": "nkd", "kh": "nkh"}).join(after, ["nkd", "nkh"])
    given = with_sketch(giving, "text", "next_sketch", k, width).select(
        "kd", "kh", "quarter", F.substr(F.col("text"), F.lit(1), F.col("quarter")).alias("head"), "next_sketch"
    ).dropDuplicates(["kd", "kh"])
    joined = texts.join(given, ["kd", "kh"]).withColumn("n_chars", F.length("text").cast("bigint"))
    own = with_sketch(joined, "text", "sketch", k, width)
    kept = F.substr(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("quarter")).cast("int"))
    edited = with_sketch(own.withColumn("edited", F.concat(kept, F.col("head"))), "edited", "edited_sketch", k, width)
    return edited.select(
        F.when(F.col("kd") != NO_ID, F.col("kd")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )

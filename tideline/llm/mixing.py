"""Mixing of sources to target weights.

One pass sizes each document.  Sources, one row each, get a target: a share of
all words by weight, at most ``most`` times the source, what is above shared
again among the others.  A document then is emitted floor(rate) times, and once
more with probability rate - floor(rate), decided by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number
from .base import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(19,0)")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code point order, NULL last, take the weights in turn.  The level
    (words per unit of weight) is a fraction of two integers; each round caps the
    sources above ``most`` times their size and shares the rest again.  There are
    as many rounds as caps appear in steps, each an aggregate over the sources.
    """
    ranked = global_row_number(sources, [F.col("source").asc_nulls_last()], "__n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__n") - 1) % len(weights) + 1).cast("int"))
    fixed = stored(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")

    def at_cap(num: int, den: int) -> Column:
        return F.col("source_size").cast("decimal(19,0)") * _whole(most * den) <= F.col("weight").cast("decimal(19,0)") * _whole(num)

    total, units = fixed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    num, den, capped = share.numerator * total, share.denominator * units, -1
    while den:
        held, free, n = fixed.agg(
            F.coalesce(F.sum(F.when(at_cap(num, den), F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~at_cap(num, den), F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(at_cap(num, den).cast("int")), F.lit(0)),
        ).first()
        if n == capped or not free:
            break
        capped = n
        num, den = share.numerator * total - share.denominator * most * held, share.denominator * free
    full = (F.col("source_size") * most).cast("double")
    shared = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den or 1))
    return fixed.select("source", "source_size", F.when(at_cap(num, den), full).otherwise(shared).alias("target"))


def chance(doc_id: Column, text_hash: Column) -> Column:
    """A number in [0, 1) from the id (of a NULL id, from the text): the same on every run."""
    seed = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text_hash.cast("string")))
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def mix_plan(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """One narrow row per document: (doc_id, kh, size, source_size, target, copies).

    A NULL text has size 0.  NULL is a source of its own, the last one.  A source
    without words has target 0 and its documents no copies.  Repeated rows with
    one id share their chance.  Rows with one (doc_id, text) but two sources are
    told apart by their source.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            F.xxhash64(whole).alias("kh"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text).cast("string")).alias("size"),
        ),
        "sized",
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    targets = stored(targets, "targets").withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = chance(F.col("doc_id"), F.col("kh")) < rate - F.floor(rate)
    return sized.join(targets, sized["source"].eqNullSafe(targets["__source"])).select(
        "doc_id", "kh", "source", "size", "source_size", "target", (F.floor(rate) + extra.cast("bigint")).alias("copies")
    )


def mix_documents(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """The mixed corpus: each document ``copies`` times, all its columns, and ``copy_no`` from 1.

    A column ``copy_no`` of the documents is replaced.  Only the source's rate is joined to the documents, never a list of documents,
    so texts are not shuffled by id.
    """
    plan = mix_plan(docs, source, text, doc_id, **options)
    rates = stored(plan.groupBy("source").agg(F.first("target").alias("__target"), F.first("source_size").alias("__size")), "rates")
    rates = rates.withColumnRenamed("source", "__source")
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(0.0)
    text_hash = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    copies = F.floor(rate) + (chance(F.col(doc_id).cast("bigint"), text_hash) < rate - F.floor(rate)).cast("bigint")
    joined = docs.join(rates, docs[source].cast("string").eqNullSafe(rates["__source"])).withColumn("__copies", copies).filter("__copies > 0")
    numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))).alias("copy_no")
    return joined.select(*[docs[c] for c in docs.columns if c != "copy_no"], numbers)

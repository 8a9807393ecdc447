"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``.  ``run`` writes each
stage's result as Parquet below the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm import decontaminate, mixing, neardup, pii, quality
from tideline.llm.base import stored, table, with_row_key

#: SQL can't express the learned stages (quality, personal data).
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id.

    Rows with that id that repeat are reduced to one.  Documents without words
    have no duplicates and stay.
    """
    found = neardup.near_duplicates(docs).filter("kept")
    one = found.groupBy("kd", "kh").agg(F.max("n_shingles").alias("__n")).withColumnsRenamed({"kd": "__kd", "kh": "__kh"})
    kept = with_row_key(docs).join(one, ["__kd", "__kh"])
    # The join has brought equal rows together; no further shuffle.
    place = F.row_number().over(Window.partitionBy("__kd", "__kh").orderBy(F.lit(1)))
    return kept.withColumn("__place", place).filter((F.col("__place") == 1) | (F.col("__n") == 0)).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; ``copy_no`` counts the copies of a document."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", keep_one_of_each),
    ("benchmark", drop_benchmark),
    ("personal data", redact),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

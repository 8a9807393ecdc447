"""What the operators share: the registry of their queries, row keys, tables on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

NO_ID = -(2**63)  # stands for a NULL id inside row keys
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"  # fixed: a word is a run without ASCII white space


def register(name: str, check: str | None = None):
    def add(function):
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, kd, kh): text without NULLs and the row key (id, text hash).

    Rows with one key have one text, so whatever depends on the text alone holds
    for each of them; NULL ids and repeated ids need no further care.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        whole.alias("text"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("kd"),
        F.xxhash64(whole).alias("kh"),
    )


def with_row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs and the row key under names that cannot clash."""
    return docs.select(
        "*",
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("__kd"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__kh"),
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


__all__ = ["CHECKS", "LOWER", "NO_ID", "QUERIES", "UPPER", "WORD", "ascii_lower", "keyed", "register", "shared_dir", "stored", "table", "with_row_key"]

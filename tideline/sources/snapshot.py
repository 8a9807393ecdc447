"""Snapshots of remote objects: full load and lookup by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.once import computed_once
from ..operators.apply import EVENT_ORDER
from ..operators.delta import DELETES, NO_RECORD, UNKNOWN_CHANGE, UPSERTS
from ..operators.schema import match_columns
from .json_docs import record_image

BODY_UNREADABLE = "body_unreadable"
NO_ORDER = "no_commit_time_or_replay_id"


def load_snapshot(df: DataFrame, described: Sequence[str], path: str) -> DataFrame:
    """Appends the described columns to the replica's files and reads them back."""
    wanted = match_columns(df, described)
    wanted.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(wanted.schema).parquet(path)


def lookup_records(keys: DataFrame, snapshot: DataFrame, key: str, snapshot_key: str) -> DataFrame:
    """Current image, all as text, of each record the keys name (once per record)."""
    ids = keys.select(F.col(key).cast("string").alias("_id")).distinct()
    image = record_image(snapshot)
    return image.join(ids, image[snapshot_key] == F.col("_id"), "left_semi")


def parse_bodies(lines: DataFrame, schema: str, key: Sequence[str], text: str = "value") -> DataFrame:
    """Webhook bodies as events: the columns of ``schema``, the ``body`` itself, and why one cannot be applied.

    ``schema`` has ``change_type`` and the columns of the event order.  A body that
    is no JSON object of that shape, names no record, no known change or no order
    is refused with a reason; every body gives one row.
    """
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    read = F.from_json(text, f"{schema}, _unread string", {"columnNameOfCorruptRecord": "_unread"})
    rows = computed_once(lines, "_b", read)
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(f"_b.{k}").isNull()
    unordered = F.lit(False)
    for o in EVENT_ORDER:
        unordered = unordered | F.col(f"_b.{o}").isNull()
    known = F.upper("_b.change_type").isin(*UPSERTS, *DELETES)
    reason = (
        F.when(F.col("_b").isNull() | F.col("_b._unread").isNotNull(), F.lit(BODY_UNREADABLE))
        .when(missing, F.lit(NO_RECORD))
        .when(~F.coalesce(known, F.lit(False)), F.lit(UNKNOWN_CHANGE))
        .when(unordered, F.lit(NO_ORDER))
    )
    return rows.select(*[F.col(f"_b.{n}").alias(n) for n in names], F.col(text).alias("body"), reason.alias("reason"))


def read_webhook_bodies(spark: SparkSession, path: str, schema: str, key: Sequence[str], max_files: int | None = None) -> DataFrame:
    """Stream over landed webhook bodies, one JSON body per line, as ``parse_bodies`` gives them."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_bodies(reader.load(path).select("value"), schema, key)

"""Newly submitted orders found in the stream, once each, whatever the batch borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.apply import EVENT_ORDER, finish_images
from ..operators.orders import SUBMITTED
from ..operators.ordering import HOT_ROWS, lag_within
from .apply import run_batches
from .replica import ReplicaLog


def entered_status(batch: DataFrame, before: DataFrame, key: str, status: str, wanted: str = SUBMITTED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Changes of a batch with ``is_late`` and ``entered``: whether they move their record to ``wanted``.

    ``before`` is the last status of each record (with its order) from earlier
    batches.  A change that is not after it comes late: it has no place in the
    sequence that was reported, so it moves nothing.
    """
    last = before.select(F.col(key).alias("_key"), F.struct(*EVENT_ORDER).alias("_at"), F.col(status).alias("_last"))
    met = batch.join(last, batch[key] == F.col("_key"), "left")
    met = met.withColumn("is_late", F.coalesce(F.struct(*EVENT_ORDER) <= F.col("_at"), F.lit(False)))
    on_time = met.filter(~F.col("is_late")).withColumn("_status", F.struct(F.col(status).alias("s")))  # a struct: a NULL status is one too
    lagged = lag_within(on_time, [key], [F.col(o) for o in EVENT_ORDER], {"_status": "_near"}, hot_rows)
    previous = F.when(F.col("_near").isNotNull(), F.col("_near.s")).otherwise(F.col("_last"))
    entered = (F.col(status) == wanted) & ~previous.eqNullSafe(F.lit(wanted))
    found = lagged.select(*batch.columns, "is_late", F.coalesce(entered, F.lit(False)).alias("entered"))
    return found.unionByName(met.filter("is_late").select(*batch.columns, "is_late", F.lit(False).alias("entered")))


def run_trigger(changes: DataFrame, statuses: ReplicaLog, path: str, checkpoint: str, key: str, status: str = "status", wanted: str = SUBMITTED, compact_every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Runs status changes through the trigger; returns (entered, late).

    ``statuses`` keeps the last status of every record (whole images: key and
    status).  A batch that runs again sees the statuses of the batches before it
    and writes the same rows.
    """
    spark, columns = changes.sparkSession, changes.schema

    def handle(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            statuses.compact(before=batch_id)
        before = finish_images(statuses.folded(before=batch_id), [key], [status], keep_deleted=True)
        found = entered_status(batch, before, key, status, wanted).persist()
        found.filter("entered").select(*columns.names).write.mode("overwrite").parquet(f"{path}/entered/batch={batch_id}")
        found.filter("is_late").select(*columns.names).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        statuses.append(found.filter("not is_late").withColumn("change_type", F.lit("UPDATE")), batch_id)
        found.unpersist()

    run_batches(changes, handle, checkpoint)
    read = lambda part: spark.read.schema(columns).parquet(f"{path}/{part}/batch=*")
    return read("entered"), read("late")

"""Outgoing messages with acknowledgements: a ledger of what was sent, and what is due again.

A message is known by a key made of its content, so the same message is sent once
however often it is handed over.  The ledger is a folder with a part per run: the
messages that run sent, with (message_key, attempt).  A run overwrites its own part,
so one that is run again sends the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..files import subfolders

LEDGER = "message_key string, attempt int"
RESULTS = "message_key string, attempt int, ok boolean, error string"  # what the receiver answered

ACKNOWLEDGED, FAILED, SENT, NEW = "acknowledged", "failed", "sent", "new"


def message_key(*parts: Column) -> Column:
    """Key of a message; a NULL part differs from an empty one, and parts do not run together."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def _packed(key: Column) -> Column:
    """A key as fewer bytes, to be shuffled: 01 and a digest's bytes, or 00 and any other key's."""
    return F.when(key.rlike("^[0-9a-f]{64}$"), F.concat(F.unhex(F.lit("01")), F.unhex(key))).otherwise(F.concat(F.unhex(F.lit("00")), key.cast("binary")))


def _unpacked(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _once(messages: DataFrame) -> DataFrame:
    """One row per message, its key packed as ``_key`` in place of ``message_key``."""
    return messages.withColumn("_key", _packed(F.col("message_key"))).drop("message_key").dropDuplicates(["_key"])


def sent_messages(spark, ledger: str, before: int | None = None) -> DataFrame:
    """(message_key, attempt) of the committed runs, or of those before a run."""
    runs = [r for r in subfolders(spark, ledger, "run", committed=True) if before is None or r < before]
    if not runs:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[f"{ledger}/run={r}" for r in runs])


def deliveries(sent: DataFrame, results: DataFrame) -> DataFrame:
    """(message_key, attempts, state, error): where every sent message stands.

    One success acknowledges a message for good, whichever attempt it answers and
    whatever else arrives.  Otherwise the answer to the last attempt counts; an
    answer without ``ok`` is a failure, and answers to messages never sent are left
    out.  Both sides come down to a row per message before they meet.
    """
    found = _deliveries(sent, results)
    return found.select(_unpacked(F.col("_known")).alias("message_key"), "attempts", "state", "error")


def _deliveries(sent: DataFrame, results: DataFrame) -> DataFrame:
    """The same by packed keys, ``_known``."""
    last = sent.groupBy(_packed(F.col("message_key")).alias("_known")).agg(F.max("attempt").alias("attempts"))
    ok = F.coalesce("ok", F.lit(False))
    answers = results.groupBy(_packed(F.col("message_key")).alias("_answered")).agg(
        F.max(ok).alias("_ok"), F.max(F.struct("attempt", F.coalesce("error", F.lit("")).alias("error"))).alias("_last")
    )
    joined = last.join(answers, F.col("_known") == F.col("_answered"), "left")
    failed = F.col("_last.attempt") >= F.col("attempts")
    state = F.when(F.col("_ok"), F.lit(ACKNOWLEDGED)).when(failed, F.lit(FAILED)).otherwise(F.lit(SENT))
    error = F.when(state == FAILED, F.nullif(F.col("_last.error"), F.lit("")))
    return joined.select("_known", "attempts", state.alias("state"), error.alias("error"))


def send_due(messages: DataFrame, ledger: str, results: DataFrame, run: int, max_attempts: int | None = None) -> DataFrame:
    """The messages a run sends, with ``attempt``, after noting them in the ledger.

    Due are messages no earlier run has sent, and those whose last attempt failed;
    what is acknowledged or still without an answer is not sent.  ``messages`` has
    ``message_key``; rows of one key are one message.  With ``max_attempts`` a
    message that failed that often stays failed.
    """
    spark = messages.sparkSession
    known = _deliveries(sent_messages(spark, ledger, run), results).drop("error")
    joined = _once(messages).join(known, F.col("_key") == F.col("_known"), "left").withColumn("message_key", _unpacked(F.col("_key")))
    again = F.col("state") == FAILED
    if max_attempts is not None:
        again &= F.col("attempts") < max_attempts
    attempt = (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt")
    due = joined.filter(F.col("_known").isNull() | again).select(*messages.columns, attempt)
    due.write.mode("overwrite").parquet(f"{ledger}/run={run}")
    # What was written is what goes out, also if results arrive meanwhile.
    return spark.read.schema(due.schema).parquet(f"{ledger}/run={run}")


def outbox_report(messages: DataFrame, ledger: str, results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every message with its attempts, its state and the last error; ``new`` before its first attempt."""
    known = _deliveries(sent_messages(messages.sparkSession, ledger), results)
    joined = _once(messages).join(known, F.col("_key") == F.col("_known"), "left").withColumn("message_key", _unpacked(F.col("_key")))
    return joined.select(*columns, F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("state", F.lit(NEW)).alias("state"), "error")

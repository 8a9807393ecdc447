"""Order detection, life cycle and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .export import element_xml
from .ordering import HOT_ROWS, lag_within, row_number_within

# The order statuses and the moves between them.
DRAFT = "Draft"
SUBMITTED = "Submitted to Manufacturing"
REVISION = "Revision Required"
IN_PRODUCTION = "In Production"
COMPLETED = "Completed"
ALLOWED_MOVES = (
    (DRAFT, SUBMITTED),
    (SUBMITTED, REVISION),
    (REVISION, SUBMITTED),
    (SUBMITTED, IN_PRODUCTION),
    (IN_PRODUCTION, COMPLETED),
)
ORDER_TABLE = "Order__c"
# What a document from the manufacturer does to the order.
STATUS_OF_DOCUMENT = {"855": IN_PRODUCTION, "810": COMPLETED}
SHIPPING_DOCUMENT = "856"


def submitted_orders(changes: DataFrame, status: str = "status", table: str = "table_name") -> DataFrame:
    """Changes of orders that stand at "submitted": every change counts (level trigger)."""
    return changes.filter((F.col(table) == ORDER_TABLE) & (F.col(status) == SUBMITTED))


def newly_submitted_orders(
    changes: DataFrame, key: str, order: Sequence[str], status: str = "status", table: str = "table_name", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Edge trigger: only the change that moves an order to "submitted"."""
    own = changes.filter(F.col(table) == ORDER_TABLE)
    lagged = lag_within(own, [key], [F.col(o) for o in order], {status: "_before"}, hot_rows)
    entered = (F.col(status) == SUBMITTED) & ~F.col("_before").eqNullSafe(F.lit(SUBMITTED))
    return lagged.filter(entered).drop("_before")


def is_allowed_move(before: Column, after: Column) -> Column:
    """A first status must be Draft; the same status again is no move and allowed."""
    allowed = (before.isNull() & (after == DRAFT)) | (before == after)
    for old, new in ALLOWED_MOVES:
        allowed = allowed | ((before == old) & (after == new))
    return F.coalesce(allowed, F.lit(False))


def order_transitions(history: DataFrame, key: str, order: Sequence[str], status: str = "status", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each status with the one before it and whether the move is in the life cycle."""
    lagged = lag_within(history, [key], [F.col(o) for o in order], {status: "from_status"}, hot_rows)
    return lagged.withColumnRenamed(status, "to_status").withColumn("allowed", is_allowed_move(F.col("from_status"), F.col("to_status")))


def status_after_documents(documents: DataFrame, key: str, order: Sequence[str], doc_type: str = "doc_type") -> DataFrame:
    """Status by the latest status document of each order, and whether it was shipped."""
    statuses = F.create_map(*[F.lit(x) for pair in STATUS_OF_DOCUMENT.items() for x in pair])
    marked = documents.withColumn("_status", F.try_element_at(statuses, F.col(doc_type)))
    latest = F.max(F.when(F.col("_status").isNotNull(), F.struct(*order, F.col("_status"))))
    shipped = F.max(F.when(F.col(doc_type) == SHIPPING_DOCUMENT, F.struct(*order)))
    return marked.groupBy(key).agg(latest.alias("_l"), shipped.alias("_s")).select(
        key, F.col("_l._status").alias("status"), F.col(f"_s.{order[0]}").alias("shipped_at")
    )


def order_documents(headers: DataFrame, lines: DataFrame, key: str, header: Sequence[Column], order: Sequence[Column], item: Sequence[Column]) -> DataFrame:
    """The XML document of every order as rows (key, seq_no, xml).

    Row 0 is the ``Order`` element with the header, so the control number stands
    once; rows 1 to n are its ``OrderItem`` elements in order.  The form is the
    same for orders of every size, and no row holds more than one item.  An
    order without lines has row 0 only.
    """
    heads = headers.select(key, F.lit(0).alias("seq_no"), element_xml(F.struct(*header), "Order").alias("xml"))
    placed = row_number_within(lines, [key], order, "_seq", hot_rows=None).withColumn("seq_no", F.col("_seq").cast("int"))
    first, *rest = item
    element = F.struct(first, F.col("seq_no").alias("_SeqNo"), *rest)
    return heads.unionByName(placed.select(key, "seq_no", element_xml(element, "OrderItem").alias("xml")))


def wrap_in_orders(xml: Column) -> Column:
    return F.concat(F.lit("<Orders>"), xml, F.lit("</Orders>"))

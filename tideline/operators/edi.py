"""Order documents on their way to an interchange: checks, header, items.

The work stops at the header table; no segment text is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import subfolders
from ..functions.casts import INTEGER_TEXT
from ..functions.once import computed_once
from .keys import drop_matching
from .ordering import HOT_ROWS, row_number_within

# Transaction sets that have a name.
SET_NAMES = {"850": "PO", "856": "ASN", "810": "INV", "997": "FA"}

ITEM_DDL = "struct<_Id:string,_SeqNo:int,Price:decimal(19,4),Quantity:int,Product_Id:string,Product_Name:string>"
ITEMS_DDL = f"struct<OrderItem:array<{ITEM_DDL}>>"
ACCOUNT_DDL = (
    "struct<_Id:string,AccountNumber:string,AccountName:string,AccountType:string,"
    "BillingStreet:string,BillingCity:string,BillingState:string,BillingPostalCode:string,BillingCountry:string,"
    "ShippingStreet:string,ShippingCity:string,ShippingState:string,ShippingPostalCode:string,ShippingCountry:string,"
    "Contact:struct<_Id:string,AccountId:string,Email:string,Title:string>>"
)
ORDER_DDL = (
    "struct<_Id:string,_Name:string,CreatedDate:timestamp_ntz,Status__c:string,EdiStatus:string,EDI_Seed:string,"
    f"Account:{ACCOUNT_DDL},OrderItem:array<{ITEM_DDL}>>"
)
PROLOG = r"^\ufeff?\s*<\?xml[^>]*\?>"
ENVELOPE_DDL = (
    "struct<Orders:array<struct<Order:array<struct<EDI_Seed:string>>,xs_any:array<string>>>,"
    "xs_any:array<string>,_VALUE:string,_bad:string>"
)

MANY_ROOTS = "more_than_one_document"
NOT_ORDERS = "not_an_orders_document"
NO_ORDER = "no_order"
BAD_SEED = "control_number_is_no_integer"
BROKEN = "not_well_formed"


def set_name(doc_type: Column) -> Column:
    """Name of a transaction set, NULL for one that is not supported."""
    names = F.create_map(*[F.lit(x) for pair in SET_NAMES.items() for x in pair])
    return F.try_element_at(names, doc_type)


def parse_order(xml: Column) -> Column:
    """The order in a bare ``Order`` element."""
    return F.from_xml(xml, ORDER_DDL, {"rowTag": "Order"})


def _count(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def validate_documents(df: DataFrame, xml: str) -> DataFrame:
    """Adds ``problem`` (NULL when the document can go out) and ``control_number``.

    The text is parsed once, inside an outer element: what follows the root
    shows up as a second root or as text, which the parser alone would not
    report.  Element names match in any case.
    """
    outer = F.concat(F.lit("<w>"), F.regexp_replace(xml, PROLOG, ""), F.lit("</w>"))
    parsed = F.from_xml(outer, ENVELOPE_DDL, {"rowTag": "w", "columnNameOfCorruptRecord": "_bad"})
    doc = computed_once(df, "_doc", parsed)
    roots = _count(F.col("_doc.Orders")) + _count(F.col("_doc.xs_any"))
    stray = F.trim(F.coalesce("_doc._VALUE", F.lit(""))) != ""
    broken = F.col("_doc").isNull() | F.col("_doc._bad").isNotNull() | (roots != 1) | stray
    orders = F.try_element_at("_doc.Orders", F.lit(1))
    # Children of another root are counted by a second parse, of those documents only.
    other = F.when(~broken & orders.isNull(), F.from_xml(xml, "struct<xs_any:array<string>>", {"rowTag": "w"}))
    children = F.when(orders.isNotNull(), _count(orders["Order"]) + _count(orders["xs_any"])).otherwise(_count(other["xs_any"]))
    seed = F.try_element_at(orders["Order"], F.lit(1))["EDI_Seed"]
    number = F.when(seed.rlike(INTEGER_TEXT), F.trim(seed).try_cast("int"))
    problem = (
        F.when(broken, F.lit(BROKEN))
        .when(children > 1, F.lit(MANY_ROOTS))
        .when(orders.isNull(), F.lit(NOT_ORDERS))
        .when(_count(orders["Order"]) == 0, F.lit(NO_ORDER))
        .when(number.isNull(), F.lit(BAD_SEED))
    )
    return doc.withColumns({"problem": problem, "control_number": number}).drop("_doc")


def interchange_headers(documents: DataFrame, sender: Column, receiver: Column, date: Column, is_production: bool = False) -> DataFrame:
    """Header columns of each document; ``documents`` has doc_type and control_number."""
    usage = "P" if is_production else "T"
    return documents.select(
        "*",
        date.alias("interchange_date"),
        F.lit(usage).alias("usage_indicator"),
        sender.alias("sender_id"),
        receiver.alias("receiver_id"),
        set_name(F.col("doc_type")).alias("set_name"),
    )


def allot_control_numbers(documents: DataFrame, pair: Sequence[str], key: Sequence[str], order: Sequence[Column], ledger: str, run: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``sequence`` and ``control_number``: gapless for every pair of partners, across runs.

    ``ledger`` is a folder with a part per run, (pair, key, sequence) of what it
    allotted.  A run goes on from the highest number of the runs before it, so one
    that is run again allots the same numbers; documents an earlier run has
    numbered keep theirs and take none.  Numbers of a crowded pair are its rows'
    places in a range-partitioned order, not a sort in one task.  The nine digits
    start again after 999,999,999.
    """
    spark = documents.sparkSession
    names = [*pair, *key]
    schema = T.StructType([*[documents.schema[n] for n in names], T.StructField("sequence", T.LongType())])
    earlier = [f"{ledger}/run={r}" for r in subfolders(spark, ledger, "run", committed=True) if r < run]
    used = spark.read.schema(schema).parquet(*earlier) if earlier else spark.createDataFrame([], schema)
    new = drop_matching(documents, used, names, null_safe=True)
    highest = used.groupBy(*[F.col(p).alias(f"_h_{p}") for p in pair]).agg(F.max("sequence").alias("_highest"))
    placed = row_number_within(new, pair, [*order, *[F.col(k) for k in key]], "_place", hot_rows)
    same = [placed[p].eqNullSafe(F.col(f"_h_{p}")) for p in pair]
    numbered = placed.join(highest, same, "left").withColumn("sequence", F.col("_place") + F.coalesce("_highest", F.lit(0)))
    numbered.select(*names, "sequence").write.mode("overwrite").parquet(f"{ledger}/run={run}")
    every = spark.read.schema(schema).parquet(*earlier, f"{ledger}/run={run}").select(*[F.col(n).alias(f"_l_{n}") for n in names], "sequence")
    match = [documents[n].eqNullSafe(F.col(f"_l_{n}")) for n in names]
    text = F.lpad(((F.col("sequence") - 1) % 999_999_999 + 1).cast("string"), 9, "0")
    return documents.join(every, match).select(*documents.columns, "sequence", text.alias("control_number"))


def document_items(df: DataFrame, xml: str, keys: list[str]) -> DataFrame:
    """Items of documents in rows, parsed once each; ``pos`` is the place in the whole order."""
    items = computed_once(df.filter("seq_no > 0"), "item", F.from_xml(xml, ITEM_DDL, {"rowTag": "OrderItem"}))
    return items.select(
        *keys,
        F.col("seq_no").alias("pos"),
        F.col("item._Id").alias("item_id"),
        F.col("item._SeqNo").alias("seq_no"),
        F.col("item.Price").alias("price"),
        F.col("item.Quantity").alias("quantity"),
        F.col("item.Product_Id").alias("product_id"),
        F.col("item.Product_Name").alias("product_name"),
    )

"""Deletes that follow child relations.

A described relation says which child records point at which parents and whether
deleting the parent deletes them.  The records a delete takes with it are the
closure over those relations, found frontier by frontier: each round follows the
relations of the records found last, whatever their number, and keeps the new
ones, so a cycle ends and the rounds are as many as the longest chain of types.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keys import drop_matching

KEYS = ("entity", "record_id")


@dataclass(frozen=True)
class Relation:
    """Records of ``child`` point by ``field`` at the id of ``parent``; with ``cascade`` they go with it, else the field is cleared."""

    parent: str
    child: str
    field: str
    cascade: bool = True


def relation_links(tables: Mapping[str, DataFrame], ids: Mapping[str, str], relations: Sequence[Relation]) -> DataFrame:
    """(parent, parent_id, child, child_id) of every pointer along a cascading relation; keys as text, NULL pointers left."""
    links = None
    for r in relations:
        if r.cascade:
            child = tables[r.child].filter(F.col(r.field).isNotNull())
            found = child.select(F.lit(r.parent).alias("parent"), F.col(r.field).cast("string").alias("parent_id"), F.lit(r.child).alias("child"), F.col(ids[r.child]).cast("string").alias("child_id"))
            links = found if links is None else links.unionByName(found)
    if links is None:
        raise ValueError("no relation cascades")
    return links


def cascaded(deletes: DataFrame, links: DataFrame) -> DataFrame:
    """(entity, record_id) of the deletes and of all records that go with them, each once.

    A parent with very many children is one key on the frontier's side; Spark splits
    the links' side of the join.  Each frontier is a reliable checkpoint.
    """
    reached = frontier = cut_lineage(deletes.select(*[F.col(k).cast("string").alias(k) for k in KEYS]).dropna().distinct())
    while not frontier.isEmpty():
        next_ = links.join(frontier, (links["parent"] == frontier["entity"]) & (links["parent_id"] == frontier["record_id"]), "left_semi")
        found = next_.select(F.col("child").alias("entity"), F.col("child_id").alias("record_id")).dropna().distinct()
        frontier = cut_lineage(drop_matching(found, reached, KEYS))
        reached = reached.unionByName(frontier)
    return reached


def delete_cascading(tables: Mapping[str, DataFrame], ids: Mapping[str, str], relations: Sequence[Relation], deletes: DataFrame) -> dict[str, DataFrame]:
    """The tables without the deleted records and those that go with them; other pointers at them are cleared."""
    gone = cascaded(deletes, relation_links(tables, ids, relations))
    left = {}
    for name, table in tables.items():
        rest = drop_matching(table.withColumn("_id", F.col(ids[name]).cast("string")), gone.filter(F.col("entity") == name), ["_id"], ["record_id"]).drop("_id")
        for r in relations:
            if r.child == name and not r.cascade:
                dead = gone.filter(F.col("entity") == r.parent).select(F.col("record_id").alias("_dead"))
                pointing = rest.join(dead, F.col(r.field).cast("string") == F.col("_dead"), "left")
                rest = pointing.withColumn(r.field, F.when(F.col("_dead").isNull(), F.col(r.field))).drop("_dead")
        left[name] = rest
    return left

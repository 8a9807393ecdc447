"""Projections, filters, counts and set operations on whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_row_number, row_number_within


def derive_column(df: DataFrame, source: str, new: str, rule) -> DataFrame:
    """Adds ``rule(source)`` under a new name and drops the source."""
    return df.withColumn(new, rule(F.col(source))).drop(source)


def columns_with_values(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns holding at least one value: one pass, one row back."""
    names = list(columns or df.columns)
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in names]).first()
    return [c for c in names if seen[c]]


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.select(*columns_with_values(df))


def exclude_columns(df: DataFrame, names: str | Iterable[str], case_sensitive: bool = False) -> DataFrame:
    """Drops the named columns; names are trimmed, and any case matches by default."""
    listed = names.split(",") if isinstance(names, str) else names
    trimmed = {n.strip() for n in listed if n.strip()}
    if not case_sensitive:
        lowered = {n.lower() for n in trimmed}
        return df.select(*[c for c in df.columns if c.lower() not in lowered])
    return df.select(*[c for c in df.columns if c not in trimmed])


def add_identity(df: DataFrame, order: Sequence[Column], name: str = "Id", seed: int = 1, step: int = 1, partitions: int | None = None) -> DataFrame:
    """Numbers the rows ``seed, seed + step, ...`` in an explicit order."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {name!r} already exists")
    numbered = global_row_number(df, order, name, partitions)
    return numbered.withColumn(name, F.lit(seed).cast("bigint") + (F.col(name) - 1) * step)


def row_to_pairs(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, ColumnName, Value) for every column of every row, NULLs kept."""
    text = df.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).cast("string").alias(c) for c in columns])
    pairs = text.unpivot([f"_k_{k}" for k in key], list(columns), "ColumnName", "Value")
    return pairs.withColumnsRenamed({f"_k_{k}": k for k in key})


def distinct_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def _listed(df: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """A list as rows: the values of each group in order, their places from 1, and how many there are."""
    placed = row_number_within(df, keys, [F.col(value)], "position")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return placed.join(sizes, list(keys)).select(*keys, "position", value, count)


def included_fields(fields: DataFrame, keys: Sequence[str], name: str, excluded: str) -> DataFrame:
    """Names not excluded (NULL counts as included): one row per name with its place, and the count of its group."""
    kept = fields.filter(~F.coalesce(F.col(excluded), F.lit(False)) & (F.coalesce(F.col(name), F.lit("")) != ""))
    return _listed(kept.select(*keys, name), keys, name, "n_fields")


def platform_events(objects: DataFrame, name: str = "name", triggerable: str = "triggerable") -> DataFrame:
    return objects.filter(F.col(name).endswith("__e") & F.coalesce(F.col(triggerable), F.lit(False)))


def count_by_key(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def row_count(df: DataFrame, out: str = "n_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, NULLs, any NULL, all NULL. One pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["_n"], list(columns), "column_name", "_filled")
    nulls = F.col("_n") - F.col("_filled")
    return long.select(
        "column_name",
        F.col("_n").alias("n_rows"),
        nulls.alias("n_null"),
        (nulls > 0).alias("any_null"),
        (F.col("_filled") == 0).alias("all_null"),
    )


def joined_list(df: DataFrame, keys: Sequence[str], label: str, value: str, out: str = "pair") -> DataFrame:
    """The distinct ``label=value`` pairs of each group in order: one row per pair with its place, and their count."""
    pair = F.concat(F.col(label).cast("string"), F.lit("="), F.col(value).cast("string"))
    pairs = df.select(*keys, pair.alias(out)).distinct()
    return _listed(pairs, keys, out, "n_pairs")


def scalars_or_default(df: DataFrame, **wanted: tuple[Column, object]) -> DataFrame:
    """One row of aggregates, each with the default where it is NULL or no row came in."""
    return df.agg(*[F.coalesce(aggregate, F.lit(default)).alias(name) for name, (aggregate, default) in wanted.items()])


def sort_by_name(df: DataFrame, name: str, out: str = "position") -> DataFrame:
    """Rows with their place in name order; the place outlives later shuffles."""
    return global_row_number(df, [F.col(name), *[F.col(c) for c in df.columns if c != name]], out)


def first_record(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def append_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of ``source`` under the target's columns; other columns are dropped."""
    known = {c.lower(): c for c in source.columns}
    matched = source.select(*[F.col(known[c.lower()]).alias(c) for c in target.columns if c.lower() in known])
    return target.unionByName(matched, allowMissingColumns=True)


def dedupe(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys) if keys else None)

"""Folders of a table on whatever file system Spark reads, by Hadoop's file API."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str, name: str, committed: bool = False) -> list[int]:
    """Numbers of the folders ``name=<number>`` below a path; none without the path.

    With ``committed`` only those whose job ended, as its marker file says.
    """
    where, system = _system(spark, path)
    if not system.exists(where):
        return []
    numbers = []
    for entry in system.listStatus(where):
        label, _, number = entry.getPath().getName().partition("=")
        if label != name or not entry.isDirectory() or not number.lstrip("-").isdigit():
            continue
        if not committed or system.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            numbers.append(int(number))
    return numbers


def remove(spark: SparkSession, path: str) -> None:
    where, system = _system(spark, path)
    system.delete(where, True)

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(seed: int, n: int) -> str:
    """n words that depend on the seed."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


PASSAGE = sentence(5, 60)
LONG = sentence(1, 30_000)


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and very long texts, ties and repeated rows."""
    near = sentence(2, 200)
    return [
        (1, sentence(2, 200), "en", "a", 1000),
        (2, near.replace("w1", "W1"), "en", "a", 1000),
        (3, near + " one more", None, "a", None),
        (4, None, "en", "b", 0),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "en", None, 4),
        (7, "Released under the MIT License. Mail ann.lee@example.com, ann.lee@example.com or +1 (132) 555-1352.", "en", "b", 99),
        (8, LONG, "en", "c", len(LONG)),
        (9, "mit", "en", "c", 3),
        (9, "MIT\t license x mit\nlicense", "en", "c", 27),
        (10, f"{sentence(11, 20)} {PASSAGE} {sentence(12, 20)}", "en", "d", 500),
        (11, f"{sentence(13, 9)} {PASSAGE}", None, "d", 400),
        (12, "one two three", "en", "d", 13),
        (12, "one two three", "en", "d", 13),
        (None, sentence(2, 200), "en", None, 1000),
        (None, "café \U0001f600 naïve 10.1.2.3 and 300.1.2.3 4111 1111 1111 1111", None, None, None),
        (13, "x" * 100_000, "en", "d", 100_000),
        (-5, "é" * 7 + " word", "en", "d", -1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(odd):
    """Columns whose names the operators use as well."""
    names = "kd kh n size words target copies copy_no score label sketch places token key set_key band rate base stands".split()
    return odd.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

"""URL filter: host and path rules, and logistic regression where no rule fits.

The model sees hashed character trigrams of host and path.  It is fitted on a
small labelled table of URLs (``LABELLED``, or any list of that form); scoring is
one expression with the weights as a constant array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower

SLOTS = 4096
GRAM = 3

#: Action, host, path.  A rule fits the host and its subdomains when the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The labelled URLs the model learns from.
LABELLED = tuple((u, "block") for u in """
http://casino-win.example.net/en/12
http://m.casino-win.example.com/slots
https://www.best-casino.example.com/bonus
http://online-poker.example.net/play
http://poker-room.example.org/free-chips
https://www.bet-now.example.com/odds
http://sports-bets.example.net/win
http://jackpot-slots.example.com/spin
http://lottery-win.example.org/prize
https://cheap-pills.example.com/buy
http://pills-online.example.net/order
http://viagra-store.example.com/buy-now
https://free-money.example.net/claim
http://fast-loans.example.com/apply
http://payday-loan.example.net/cash
http://xxx-videos.example.com/watch
http://hot-porn.example.net/clips
http://adult-cams.example.org/live
http://sexy-dates.example.com/join
http://crack-serials.example.net/download
http://warez-keygen.example.org/get
https://torrent-free.example.com/movie
http://replica-watches.example.net/sale
http://get-rich-quick.example.com/now
http://click-here-win.example.net/prize
http://spam-links.example.com/ads
""".split()) + tuple((u, "allow") for u in """
https://www.example.org/en/docs
https://docs.example.com/guide/intro
https://blog.example.net/2020/01/post
https://news.example.com/en/article/55
https://www.university.example.org/research
https://library.example.net/catalog
https://wiki.example.org/en/history
https://science.example.com/papers/812
https://m.example.com/en/4711
https://blog.example.com/en/3265
http://www.example.net/en/312.html
https://museum.example.org/fr/collection
https://weather.example.net/de/berlin
https://recipes.example.com/en/soup
https://travel.example.net/es/madrid
https://health.example.org/en/advice
https://school.example.com/fr/lesson
https://city.example.net/de/rathaus
https://music.example.com/en/lessons
https://forum.example.net/en/topic/9
https://shop.example.com/en/books
https://government.example.org/en/forms
https://code.example.com/project/readme
https://maps.example.net/en/region
https://film.example.org/es/review
https://garden.example.com/en/roses
""".split())


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for NULL and for a URL without ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or NULLs; of equally long ones the first listed."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered)], F.lit(None).cast("string"))
    action = F.coalesce(*[F.when(f, F.lit(a)) for f, (a, _, _) in zip(fits, ordered)], F.lit(None).cast("string"))
    return rule, action


def _grams(text: Column, kind: str) -> Column:
    marked = F.concat(F.lit("<"), text, F.lit(">"))
    places = F.sequence(F.lit(1), F.greatest(F.length(marked) - (GRAM - 1), F.lit(1)))
    return F.transform(places, lambda i: (F.crc32(F.concat(F.lit(kind), F.substr(marked, i, F.lit(GRAM)))) % SLOTS).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Distinct slots of the hashed trigrams of host and path."""
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def fit(spark, labelled: Sequence[tuple[str, str]] = LABELLED, epochs: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[float, list[float]]:
    """(bias, weights) of the probability of ``block``; the table is small by contract (a few thousand rows)."""
    host, path = url_parts(F.col("url"))
    table = spark.createDataFrame([(i, u, 1.0 if y == "block" else 0.0) for i, (u, y) in enumerate(labelled)], "i int, url string, y double")
    rows = [(r["x"], r["y"]) for r in table.select("i", features(host, path).alias("x"), "y").orderBy("i").collect()]
    bias, weights = 0.0, [0.0] * SLOTS
    for _ in range(epochs):
        for slots, label in rows:
            norm = math.sqrt(len(slots))
            z = bias + sum(weights[s] for s in slots) / norm
            step = rate * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += 0.1 * step
            for s in slots:
                weights[s] += step / norm - rate * decay * weights[s]
    return bias, weights


def block_probability(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    bias, weights = model
    table = F.split(F.lit(",".join(repr(round(w, 9)) for w in weights)), ",").cast("array<double>")  # folded to a constant
    slots = features(host, path)
    total = F.aggregate(slots, F.lit(0.0), lambda s, slot: s + F.get(table, slot))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(slots)))))


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, model=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every page.

    NULL ids are kept; repeated rows are judged one by one.  An empty host and
    path have no rule, and the model's bias decides.
    """
    model = model or fit(pages.sparkSession)
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("__action"), block_probability(F.col("host"), F.col("path"), model).alias("block_score"))
    learned = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__action", learned).alias("verdict"), "block_score")

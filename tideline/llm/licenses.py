"""License scans: fixed phrases, and notices by an exact set-similarity join.

A text block is a run of words that ends with a template's length divided by the
threshold: a longer one would hold more words of its own than the threshold
leaves room for.  A block meets a template if it holds at least ``need`` of the
template's n distinct tokens, its identifying tokens among them ("apache" tells
that notice from any other "licensed under").

The join finds them through wider blocks, so that no word is looked at once for
each block: a block of span s starts every s words and is 2 s long, with s the
power of two that the template's blocks fit into; each narrow block lies whole in
one of them.  Template tokens are ordered by how many documents have them, rarest
first.  A block with ``need`` of n tokens must hold one of the first
n - need + 1 (prefix filter); the length and position filters bound what can
still be shared; in the survivors every narrow block is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import computed_once
from .base import ascii_lower, keyed

#: What stands between words, the phrases and their labels.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, notice, tokens that a block must hold)
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "permission granted software sublicense",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache license"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache license",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "gnu general public redistribute",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-sa", "Licensed under Creative Commons Attribution-ShareAlike 4.0 International.", "commons sharealike"),
    ("bsd", "Released under the BSD License.", "bsd license"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "redistribution source binary permitted",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "permission software purpose fee granted",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mozilla public license",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    ("reserved", "All rights reserved.", "all rights reserved"),
)
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Words in order; cutting at what is no word takes a twentieth of the time of matching words."""
    return F.array_remove(F.split(ascii_lower(text), NO_WORD), "")


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def phrase_places(lowered: Column, words: Column, phrase: str) -> Column:
    """Word positions where the phrase stands; looked for only where the lower-cased text has all its words."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    stands = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    possible = reduce(lambda a, b: a & b, [lowered.contains(p) for p in parts]) & (last >= 0)
    return F.when(possible, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def find_phrases(rows: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, kd, kh, n_words, n_base, first_word, last_word, base) from keyed rows."""
    cut = computed_once(rows.withColumn("__low", F.lower("text")), "__words", words_of(F.col("text")))
    places = [f"__p{i}" for i in range(len(phrases))]
    found = cut.select(
        "doc_id", "kd", "kh", F.size("__words").cast("bigint").alias("n_words"),
        *[phrase_places(F.col("__low"), F.col("__words"), p).alias(c) for (p, _), c in zip(phrases, places)],
    )
    every = found.withColumn("__all", F.concat(*places))
    label = F.array(*[F.when(F.size(c) > 0, F.lit(name)) for (_, name), c in zip(phrases, places)])
    return every.select(
        "doc_id", "kd", "kh", "n_words", F.size("__all").cast("bigint").alias("n_base"),
        F.array_min("__all").cast("bigint").alias("first_word"), F.array_max("__all").cast("bigint").alias("last_word"),
        F.array_distinct(F.array_compact(label)).alias("base"),
    )


@dataclass(frozen=True)
class Notice:
    """One template, cut: its distinct tokens, those it needs, and the length of its blocks in words."""

    label: str
    tokens: tuple[str, ...]
    must: tuple[str, ...]
    need: int
    length: int

    @property
    def span(self) -> int:
        return 1 << (self.length - 1).bit_length()


def cut_templates(spark, templates: Sequence[tuple[str, str, str]], threshold: float) -> list[Notice]:
    """The templates cut as documents are; they are a short list of the caller's."""
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "i int, label string, notice string, must string")
    cut = table.select("i", "label", words_of(F.col("notice")).alias("words"), words_of(F.col("must")).alias("must")).orderBy("i").collect()
    notices = []
    for r in cut:
        tokens = tuple(dict.fromkeys(r["words"]))
        if tokens:
            need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            notices.append(Notice(r["label"], tokens, tuple(r["must"]), need, max(1, math.floor(len(r["words"]) / threshold + 1e-9))))
    return notices


def document_frequency(rows: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How many documents hold each template token, over all documents; one count per template token."""
    held = rows.select(F.explode(F.array_intersect(words_of(F.col("text")), _texts(vocabulary))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def token_places(rows: DataFrame, notices: Sequence[Notice], rank: dict[str, int]) -> DataFrame:
    """(kd, kh, at, rank): where template tokens stand, in documents that hold all a template asks for."""
    lowered = F.lower("text")  # lower-cases more than A-Z, but A-Z alike, so nothing is missed
    every = [reduce(lambda a, b: a & b, [lowered.contains(w) for w in n.must], F.lit(True)) for n in notices]
    hopeful = rows.filter(reduce(lambda a, b: a | b, every))
    ranks = rows.sparkSession.createDataFrame(list(rank.items()), "word string, rank int")
    words = hopeful.select("kd", "kh", F.posexplode(words_of(F.col("text"))).alias("at", "word"))
    return words.join(F.broadcast(ranks), "word").select("kd", "kh", "at", "rank")  # as many rows as the templates have words


def similar_blocks(rows: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(kd, kh, start, label, containment): blocks that meet a template, by the first template word they hold."""
    spark = rows.sparkSession
    notices = cut_templates(spark, templates, threshold)
    if not notices:
        return rows.select("kd", "kh", F.lit(0).alias("start"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    vocabulary = sorted({w for n in notices for w in n.tokens + n.must})
    often = document_frequency(rows, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index = []
    for n in notices:
        tokens, must = sorted(rank[w] for w in n.tokens), sorted({rank[w] for w in n.must})
        index += [(n.span, n.label, n.length, n.need, tokens, must, tokens[p], p) for p in range(len(tokens) - n.need + 1)]
    prefixes = spark.createDataFrame(index, "span int, label string, length int, need int, tokens array<int>, must array<int>, rank int, place int")

    spans = F.array(*[F.lit(s) for s in sorted({n.span for n in notices})])
    spread = token_places(rows, notices, rank).select("kd", "kh", "at", "rank", F.explode(spans).alias("span"))
    own = F.floor(F.col("at") / F.col("span")).cast("int")
    covered = spread.select("kd", "kh", "span", F.explode(F.array(own - 1, own)).alias("block"), F.struct("at", "rank").alias("held"))
    # At most 2 * span words: a block is never larger, whatever the document is.
    blocks = covered.filter("block >= 0").groupBy("kd", "kh", "span", "block").agg(F.sort_array(F.collect_set("held")).alias("held"))
    ranked = blocks.withColumn("ranks", F.sort_array(F.array_distinct("held.rank")))
    tokens = ranked.select("kd", "kh", "span", "block", "held", "ranks", F.posexplode("ranks").alias("place_here", "rank"))
    room = F.least(F.col("n") - F.col("place"), F.size("ranks") - F.col("place_here"))
    candidates = tokens.join(prefixes.withColumn("n", F.size("tokens")), ["span", "rank"]).filter(
        (F.size("ranks") >= F.col("need")) & (room >= F.col("need")) & (F.size(F.array_intersect("tokens", "ranks")) >= F.col("need"))
    )
    inside = lambda first: F.filter("held", lambda h: (h["at"] >= first["at"]) & (h["at"] < first["at"] + F.col("length")))["rank"]
    # From each word of the template on; what starts in the second half lies whole in the next block.
    firsts = F.filter("held", lambda h: (h["at"] < (F.col("block") + 1) * F.col("span")) & F.array_contains("tokens", h["rank"]))
    narrow = candidates.select(
        "kd", "kh", "label", "n", "need", "tokens", "must",
        F.explode(F.transform(firsts, lambda first: F.struct(first["at"].alias("start"), inside(first).alias("ranks")))).alias("b"),
    )
    shared = F.size(F.array_intersect("tokens", "b.ranks"))
    meets = (shared >= F.col("need")) & (F.size(F.array_except("must", "b.ranks")) == 0)
    return narrow.filter(meets).select("kd", "kh", F.col("b.start").alias("start"), "label", (shared / F.col("n")).alias("containment")).distinct()


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: phrase places and labels, labels by the join, and a score.

    The score is 1 where a phrase stands, else the best containment found, else 0.
    A NULL text is empty: no words, no labels (empty strings), NULL places.
    Repeated rows and NULL ids get the same result as any other.
    """
    rows = keyed(docs, doc_id, text)
    notices = similar_blocks(rows, templates, threshold).groupBy("kd", "kh").agg(
        F.collect_set("label").alias("__labels"), F.max("containment").alias("__best")  # at most one label per template
    )
    base = find_phrases(rows, phrases).join(notices, ["kd", "kh"], "left")
    labels = F.array_distinct(F.concat("base", F.coalesce("__labels", F.array().cast("array<string>"))))
    return base.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__best", F.lit(0.0))).alias("score"),
    )

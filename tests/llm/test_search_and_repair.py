"""Conversation repair, exact top-k search and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import resample, topk, turns

from .brute import ALNUM, lower
from .conftest import as_set

# ------------------------------------------------------------ 11 conversations


def cheapest(rows: str, entry: int, exits: tuple) -> tuple | None:
    """Least (cost, letters) by a plain table filled from the end."""

    def with_inserts(best):
        best = list(best)
        for _ in range(4):
            for q in range(turns.STATES):
                after = best[turns._AFTER[q, turns._DUE[q]]]
                if after is not None:
                    found = (after[0] + 5, "I" + after[1])
                    best[q] = found if best[q] is None else min(best[q], found)
        return best

    best = with_inserts([(c, "") if c < turns.INF else None for c in exits])
    for letter in reversed(rows):
        found = []
        for q in range(turns.STATES):
            ways = [(best[p][0] + c, e + best[p][1]) for e, before, p, c in turns._STEPS[letter] if before == q and best[p] is not None]
            found.append(min(ways) if ways else None)
        best = with_inserts(found)
    return best[entry]


@settings(max_examples=600, deadline=None)
@given(st.text("bdsuaxSUAXua", max_size=14), st.integers(0, 3), st.tuples(*[st.sampled_from([0, 1, 2, 5, 9, turns.INF])] * 4))
def test_search_from_both_sides_finds_the_least_letters(rows, entry, exits):
    assert turns.search(rows, entry, exits) == cheapest(rows, entry, exits)
    assert turns.search(rows) == cheapest(rows, 0, turns.END)


def repaired(rows):
    """rows: (conv_id, turn, role, text) of one conversation -> the digest of a plain repair."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:128], hashlib.md5(r[2].encode()).hexdigest()))
    seen, letters, counts = set(), "", Counter()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not body:
            letter, fault = "b", "blank"
        elif (role, text) in seen:
            letter, fault = "d", "duplicate"
        else:
            cut = body[-1] not in ".!?"
            letter, fault = (initial.upper(), "truncated") if cut else (initial, None)
        counts[fault] += 1
        seen.add((role, text))
        letters += letter
    cost, audit = cheapest(letters, 0, turns.END)
    lines, state, left = [], 0, list(rows)
    for edit in audit:
        if edit == "I":
            due = turns._DUE[state]
            state = turns._AFTER[state, due]
            lines.append(f"{turns.ROLES[due]}:")
            continue
        _, role, text = left.pop(0)
        if edit != "D":
            due = role[:1] if edit == "K" else turns._DUE[state]
            state = turns._AFTER[state, due]
            lines.append(f"{role if edit == 'K' else turns.ROLES[due]}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def talks():
    chance = random.Random(5)
    texts = ["Yes.", "Yes.", "No", "What?", "", " \t\n", "Well!", None, "x" * 200 + "1.", "x" * 200 + "2."]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(chance.choice([1, 2, 3, 6, 9, 40])):
            rows.append((conv, chance.choice([None, *range(12)]), chance.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), chance.choice(texts)))
    rows += [(99, i, "user" if i % 2 else "assistant", f"turn {i}" + (".", "")[i % 7 == 0]) for i in range(700)]  # one long conversation
    rows += [(98, 3, "user", "same again.")] * 300 + [(98, i, "user", "same again.") for i in range(300)]  # repeats in one turn and over many
    rows += [(97, 5, "user", "z" * 100_000 + "."), (97, 6, "assistant", "y" * 50_000)]
    return rows


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_repair_is_the_plain_one_at_every_piece_length(spark, talks, bits, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_BITS", bits)
    by_conv = defaultdict(list)
    for row in talks:
        by_conv[row[0]].append(row)
    got = turns.digest(turns.repair_conversations(spark.createDataFrame(talks, CONVERSATIONS).repartition(5))).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((c, *repaired(rows)) for c, rows in by_conv.items()), key=str)


def test_repaired_rows_are_kept_whole_and_alternate(spark, talks):
    edits = turns.repair_conversations(spark.createDataFrame(talks, CONVERSATIONS))
    assert edits.filter("conv_id = 97 and edit <> 'D'").count() in (0, 2)
    kept = edits.filter("edit = 'K'")
    assert kept.filter("role <> role_before").count() == 0
    assert edits.filter("edit <> 'I'").count() == len(talks)
    assert edits.filter("edit = 'I' and text <> ''").count() == 0


def test_conversations_without_rows_and_clashing_columns(spark):
    known = spark.createDataFrame([(1,), (2,), (None,), (2,)], "conv_id bigint")
    rows = spark.createDataFrame([(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")], CONVERSATIONS).select("*", *[F.lit(1).alias(c) for c in ("cid", "kind", "piece", "rows", "letters", "head", "digest", "place")])
    nothing = hashlib.sha256(b"").hexdigest()
    got = as_set(turns.digest(turns.repair_conversations(rows, known)), "conv_id", "cost", "audit", "repaired_sha256")
    assert got == sorted([(1, 0, "", nothing), (None, 0, "", nothing), (2, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())], key=str)
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert turns.digest(turns.repair_conversations(empty, empty)).count() == 0
    assert turns.damage(empty).count() == 0


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in [*range(30), None] for t in [None, 0, 1, 2]] + [(1, 0, None, None)]
    want = Counter()
    for c, t, r, x in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if what:
            want[c, t, "user" if what == 4 else r, "" if what == 1 else re.sub("[.!?]", "", x) if what == 2 else x] += 2 if what == 3 else 1
    assert Counter(tuple(r) for r in turns.damage(spark.createDataFrame(rows, CONVERSATIONS)).collect()) == want


# ------------------------------------------------------------ 12 exact search


def nearest(rows, asked, k):
    """rows: (vec_id, vector) -> sorted (query_id, rank, vec_id, score) by comparing all with all."""
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for n, (q, v) in enumerate(whole):
        if q is None or not asked(q):
            continue
        product = lambda w: max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(v, w))))  # noqa: B023, E731
        scores = sorted((-product(w), i is None, i or 0) for m, (i, w) in enumerate(whole) if m != n)
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


VECTORS = "vec_id bigint, embedding array<double>"


def vectors(n, width, seed, spread=1.0):
    chance = random.Random(seed)
    centres = [[chance.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + spread * chance.gauss(0, 0.3) for c in chance.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("settings_", [{}, {"pivots": 7, "block": 3, "part_rows": 40}, {"pivots": 1, "block": 1, "part_rows": 10_000}])
def test_search_is_exact(spark, settings_):
    rows = vectors(400, 8, 1) + [(1000 + i, [0.5] * 8) for i in range(40)] + [(2000 + i, [-0.25] * 8) for i in range(3)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(4), F.col("vec_id") % 10 == 0, 5, **settings_)
    assert as_set(got, *got.columns) == nearest(rows, lambda i: i % 10 == 0, 5)


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]),
        (10, None), (20, [None, 1.0]), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [-0.001, 0.001]), (60, []), (70, [1.0]), (80, [1.0, 2.0, 3.0]), (90, [1e306, 1.0]),
    ]
    df = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("v", "asked", "salt", "grp", "part", "qh", "rank")])
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 3, pivots=2, block=2, part_rows=3)
    assert as_set(got, *got.columns) == nearest(rows, lambda i: i % 10 == 0, 3)


def test_search_with_numbers_beyond_doubles(spark):
    rows = [(i, [float(2 ** (5 * i)), 3.0, -float(3**i)]) for i in range(14)] + [(20, [1e30, 1.0, 1.0]), (30, [-1e200, 0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 2 == 0, 4)
    assert as_set(got, *got.columns) == nearest(rows, lambda i: i % 2 == 0, 4)


def test_search_with_few_or_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert topk.top_k(empty, F.col("vec_id") % 2 == 0).count() == 0
    alone = spark.createDataFrame([(2, [1.0])], VECTORS)
    assert topk.top_k(alone, F.col("vec_id") % 2 == 0).count() == 0
    two = spark.createDataFrame([(2, [1.0]), (3, [2.0])], VECTORS)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 2 == 0).collect()] == [(2, 1, 3, 131072)]
    assert topk.top_k(two, F.col("vec_id") > 5).count() == 0


def test_bounds_spare_rows_where_vectors_form_clusters(spark):
    rows = vectors(2000, 8, 4, spread=0.02)
    data = spark.createDataFrame(rows, VECTORS).select("vec_id", topk.whole_components(F.col("embedding")).alias("v"))
    queries = data.filter("vec_id % 50 = 0").withColumn("qh", F.lit(0).cast("bigint"))
    space, n = topk._space(data, 32)
    cells = topk._query_cells(queries, space, topk._nearest_of_cells(data, space, 5), 5)
    groups = topk._pack(cells, space, 8)
    sent = topk._send_data(data, space, cells, groups, [1] * len(groups.size), 5).count()
    assert len(groups.size) > 3 and sent < 0.7 * n * len(groups.size)


# ------------------------------------------------------------ 13 resampling


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from("aAb\x00 1é.z\n"), max_size=30), max_size=5), st.integers(1, 4))
def test_features_are_those_of_the_joined_words(texts, max_n):
    found = resample.features(pa.array(texts, pa.string()), max_n, 10_000)
    for i, text in enumerate(texts):
        words = ALNUM.findall(lower(text))
        assert found.words[i] == len(words)
        for n in range(1, max_n + 1):
            own = found.buckets[n - 1][found.firsts[n - 1][i] : found.firsts[n - 1][i + 1]]
            assert own.tolist() == [zlib.crc32(" ".join(words[j : j + n]).encode()) % 10_000 for j in range(len(words) - n + 1)]


def ranked(rows, target, percent, min_words, max_n, buckets):
    """rows: (doc_id, text) -> sorted (doc_id, n_features, weight, score, rank)."""

    def features(text):
        words = ALNUM.findall(lower(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    own, wanted = Counter(), Counter()
    for _, text in rows:
        own.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s, t = sum(own.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s + buckets) / ((own[b] + 1.0) * (t + buckets))))
    out = []
    for doc, text in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in found)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, words])
    enough = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(enough[: percent * len(enough) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("max_n, percent", [(1, 10), (2, 50), (3, 100)])
def test_ranks_are_the_plain_ones(spark, odd, odd_rows, max_n, percent):
    target = ["w1 w2 w3 mit license", None, "", "w5 w7 w9"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resample.rank_documents(odd, benchmark, percent=percent, min_words=3, max_n=max_n, buckets=500)
    pairs = [(r[0], r[1]) for r in odd_rows]
    assert as_set(got, "doc_id", "n_features", "weight", "score", "rank") == ranked(pairs, target, percent, 3, max_n, 500)


def test_draw_keeps_columns_and_clashing_names(spark, crowded, empty):
    target = spark.createDataFrame([("w1 w2 mit",)], "text string")
    drawn = resample.draw(crowded, target, percent=50, min_words=1)
    assert drawn.columns == crowded.columns and 0 < drawn.count() < crowded.count()
    assert drawn.filter("score <> 'own score'").count() == 0
    assert resample.draw(empty, target).count() == 0
    assert resample.rank_documents(empty, target).count() == 0
    assert resample.rank_documents(crowded, target.limit(0)).count() == crowded.count()

"""The bits of the token code: a distribution, learned online, equal to a plain walk over the text."""

from __future__ import annotations

import math
import tracemalloc
import zlib

import numpy as np
import pytest

from tideline.llm import code_bits, lm_score


def code_and_tables(seed=1, tokens=40):
    random = np.random.default_rng(seed)
    hashes = random.integers(1, 2**63, tokens).astype(np.uint64)
    code = code_bits.build_code(hashes, np.sort(random.integers(2, 500, tokens))[::-1], 30, 60)
    tables = code_bits.Tables.empty(code.nodes)
    leaves = random.integers(0, tokens + 2, 3000)
    code_bits.count(code, tables, leaves, np.array([0, 1000, 1000, 3000]))
    return code, tables, leaves


def plain(code, tables, mixer, leaves):
    """log10 probability of one text, one bit after the other."""
    total, seen, anchor, before = 0.0, {}, -1, -1
    for leaf in leaves.tolist():
        for k in range(code.first[leaf], code.first[leaf + 1]):
            node, bit = int(code.node[k]), int(code.bit[k])
            spread, near = code_bits._spread(np.array([node])), lambda c, salt: code_bits._context(np.array([c]), salt)
            corpus = [
                code_bits.Read.of(tables.node[[node]], 0),
                code_bits.Read.of(tables.anchor[code_bits._slot(near(anchor, 7), spread, code_bits.BITS_ANCHOR)], 1),
                code_bits.Read.of(tables.before[code_bits._slot(near(before, 11), spread, code_bits.BITS_BEFORE)], 2),
            ]
            zeros, ones = (np.array([n], np.float32) for n in seen.get(node, [0, 0]))
            p = 1 / (1 + math.exp(-float(mixer.odds(*code_bits.inputs(corpus, zeros, ones))[0])))
            total += math.log10(p if bit else 1 - p)
            seen.setdefault(node, [0, 0])[bit] += 1
        before = leaf
        anchor = leaf if 2 <= leaf < 2 + code_bits.ANCHORS else anchor
    return total


@pytest.fixture(scope="module")
def learned():
    code, tables, leaves = code_and_tables()
    (x, gate, bit), = code_bits.describe(code, tables, leaves, np.array([0, 1000, 1000, 3000]))
    return code, tables, code_bits.learn(x, gate, bit)


@pytest.mark.parametrize("segment", [7, 64, 1 << 15])
def test_texts_score_as_bit_after_bit(learned, segment, monkeypatch):
    monkeypatch.setattr(code_bits, "SEGMENT", segment)
    code, tables, mixer = learned
    random = np.random.default_rng(4)
    sizes = [0, 1, 5, 90, 0, 3, 40]
    leaves, first = random.integers(0, 42, sum(sizes)), np.cumsum([0, *sizes])
    got = code_bits.Model.of(code, tables, mixer).log10(leaves, first)
    want = [plain(code, tables, mixer, leaves[a:b]) for a, b in zip(first[:-1], first[1:])]
    assert np.allclose(got, want, atol=1e-4)


def test_next_leaf_is_a_distribution(learned):
    code, tables, mixer = learned
    past = np.random.default_rng(8).integers(0, 42, 30)
    model = code_bits.Model.of(code, tables, mixer)
    score = lambda leaves: float(model.log10(np.array(leaves, np.int64), np.array([0, len(leaves)]))[0])
    held = score(past.tolist())
    assert abs(sum(10 ** (score([*past.tolist(), leaf]) - held) for leaf in range(42)) - 1) < 1e-3


def test_code_has_a_leaf_for_every_token_and_short_ways_to_frequent_ones():
    code, _, _ = code_and_tables(tokens=200)
    ways = {tuple(zip(code.node[a:b].tolist(), code.bit[a:b].tolist())) for a, b in zip(code.first[:-1], code.first[1:])}
    assert len(ways) == 202 and not any(w == () for w in ways)
    size = np.diff(code.first)
    assert size[2:12].mean() < size[-10:].mean()
    assert code.leaves_of(np.array([5], np.uint64)).tolist() == [code_bits.ESCAPE]
    only = code_bits.build_code(np.empty(0, np.uint64), np.empty(0, np.int64), 0, 0)
    assert np.diff(only.first).tolist() == [1, 1]


def test_model_is_ahead_of_the_base_on_held_out_texts(spark, sf_dir):
    """In sum; and on every text of some length without unknown tokens, which the base gives a fixed count of 0.1."""
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = lm_score.score_documents(docs).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    known = [r for r in rows if r["n_known"] == r["n_tokens"] and r["n_tokens"] > 20]
    assert len(known) > 5 and all(r["score"] > r["base_score"] for r in known)


def test_long_tokens_cost_what_they_are(spark):
    """No floor: twice the bytes of a new token cost about twice as much."""
    texts = [(i, "a b c d") for i in range(40)] + [(1000 + i, "q" * n) for i, n in enumerate((200, 2000, 20000))]
    held = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = {r["doc_id"]: r["score"] for r in lm_score.score_documents(held).filter("doc_id >= 1000").collect()}
    assert all(math.isfinite(s) for s in rows.values()) and rows[1002] < rows[1001] < rows[1000] < 0


def test_cells_hold_every_bit_and_no_order_changes_them(learned):
    code, tables, _ = learned
    leaves = np.random.default_rng(1).permutation(code_and_tables()[2])
    cells, whole, parts = code_bits.Cells.of(tables), *(np.zeros(2 * code_bits.CELLS, np.int64) for _ in range(2))
    cells.count(code, whole, leaves, np.array([0, 1000, 1000, 3000]))
    assert whole.sum() == np.diff(code.first)[leaves].sum()
    for lo, hi in ((1000, 3000), (0, 1000)):
        cells.count(code, parts, leaves[lo:hi], np.array([0, hi - lo]))
    assert (parts == whole).all()
    fitted, plain = code_bits.Cells.learn([cells], whole), code_bits.Cells.learn([cells], whole * 0)
    assert len(set(map(tuple, plain.weights))) == 1  # where nothing was counted, the weights it starts from
    score = lambda mixer: code_bits.Model.of(code, tables, mixer).log10(leaves, np.array([0, 3000]))[0]
    assert score(fitted) > score(plain)


def test_mixers_are_fitted_to_all_training_texts(spark, monkeypatch):
    """No sample: every bit of every training text and token is counted, one text longer than a piece included."""
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in random.zipf(1.5, 40) % 5000) for _ in range(400)] + [" ".join(f"w{k}" for k in range(40_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    train = [t.split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    found = {}
    learn_bits, learn_spelling, build = code_bits.Cells.learn, lm_score.Cells.learn, code_bits.build_code
    monkeypatch.setattr(code_bits.Cells, "learn", lambda halves, seen: found.update(bits=seen.sum()) or learn_bits(halves, seen))
    monkeypatch.setattr(lm_score.Cells, "learn", lambda self, tables, seen: found.update(spelled=seen.sum()) or learn_spelling(self, tables, seen))
    monkeypatch.setattr(code_bits, "build_code", lambda *a: found.setdefault("code", build(*a)))
    assert lm_score.score_documents(docs).filter("score < 0").count() == len(texts)
    code, size = found["code"], np.diff(found["code"].first)
    leaves = [code.leaves_of(lm_score._hashes([w.encode() for w in t])) for t in train]
    assert found["bits"] == sum(int(size[own].sum()) + size[code_bits.END] for own in leaves)
    assert found["spelled"] == 8 * (sum(len(w) + 1 for w in {w for t in train for w in t}) + 1)


@pytest.mark.parametrize("segment", [5, 1 << 17])
def test_walk_tells_what_a_text_had_before_each_bit(segment, monkeypatch):
    """Every bit of every token once, its text's earlier zeros and ones at the node, the slots of its contexts."""
    monkeypatch.setattr(code_bits, "SEGMENT", segment)
    code, _, _ = code_and_tables(tokens=400)
    random = np.random.default_rng(3)
    sizes = [0, 1, 4, 300, 0, 0, 2, 60, 0]
    leaves, first = random.integers(0, 402, sum(sizes)), np.cumsum([0, *sizes])
    got, want = [], []
    for run in code_bits._runs(leaves, first, code.nodes):
        for bits in code_bits.walk(code, run):
            owner = run.text + np.repeat(np.arange(len(bits.first) - 1), np.diff(bits.first))
            got += zip(*(a.tolist() for a in (owner, bits.node, bits.bit, bits.zeros, bits.ones, bits.anchor, bits.before)))
    for text, (a, b) in enumerate(zip(first[:-1], first[1:])):
        seen, before, anchor = {}, -1, -1
        for leaf in leaves[a:b].tolist():
            for k in range(code.first[leaf], code.first[leaf + 1]):
                node, bit = int(code.node[k]), int(code.bit[k])
                spread = code_bits._spread(np.array([node]))
                slots = (int(code_bits._slot(code_bits._context(np.array([c]), salt), spread, 18)[0]) for c, salt in ((anchor, 7), (before, 11)))
                want.append((text, node, bit, *seen.get(node, [0, 0]), *slots))
                seen.setdefault(node, [0, 0])[bit] += 1
            before, anchor = leaf, leaf if 2 <= leaf < 2 + code_bits.ANCHORS else anchor
    assert sorted(got) == sorted(want)


def test_leaves_are_found_where_hashes_share_their_first_bits():
    random = np.random.default_rng(2)
    hashes = np.unique(np.concatenate([random.integers(0, 50, 300).astype(np.uint64) + np.uint64(top) for top in (0, 7 << 40, 2**64 - 60, 2**63)]))
    random.shuffle(hashes)
    code = code_bits.build_code(hashes, np.full(len(hashes), 3), 1, 1)
    assert code.leaves_of(hashes).tolist() == list(range(2, len(hashes) + 2))
    others = np.setdiff1d(np.concatenate([hashes + np.uint64(50), random.integers(0, 2**63, 1000).astype(np.uint64)]), hashes)
    assert (code.leaves_of(others) == code_bits.ESCAPE).all()


def test_counting_a_piece_costs_its_bits_not_the_tables():
    """A short piece is added where its bits are: nothing of the tables' size is made for it."""
    code, tables, leaves = code_and_tables()
    tracemalloc.start()
    code_bits.count(code, tables, leaves[:20], np.array([0, 20]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < tables.anchor.nbytes / 10


def test_base_of_tokens_with_and_without_a_leaf(spark, monkeypatch):
    """Leaves meet their counts in the task, all but three of the other tokens by the join; empty texts have their end."""
    monkeypatch.setattr(lm_score, "COMMON", 3)
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(300)) + " same same") for i in range(30)] + [(100, ""), (101, None)]
    rows = {r["doc_id"]: r for r in lm_score.score_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    train = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 10]
    kinds, n = 300 * sum(i < 100 for i in train) + 2, 302 * sum(i < 100 for i in train) + len(train)
    below = math.log10(n + 0.1 * (kinds + 1))
    same, ends = 2 * sum(i < 100 for i in train), len(train)
    for i in range(30):
        c = 1 if i in train else 0
        want = 300 * (math.log10(c + 0.1) - below) + 2 * (math.log10(same + 0.1) - below) + math.log10(ends + 0.1) - below
        assert rows[i]["base_score"] == pytest.approx(want) and rows[i]["n_known"] == 300 * c + 3 and rows[i]["n_tokens"] == 303
    assert rows[101]["n_tokens"] == rows[100]["n_known"] == 1

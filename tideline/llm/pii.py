"""Personal data: patterns, and a skip-chain conditional random field around them.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
The field labels white-space tokens that hold a digit, ``@`` or ``+``; all other
tokens are observed as outside.  Neighbouring tokens are linked in a chain, and
distant tokens of a document with the same core, digits or mail name by skip
edges to their next occurrence, so the graph grows linearly.  Loopy message
passing gives each token's label; tokens that the field is sure of add spans
where no base span is, as when a number stands again without its prefix.

Potentials are fitted by pseudo-likelihood on the base spans of at most
``SAMPLE`` distinct documents, the first in the order of a hash of their ids.  The
base patterns know a number only with what stands before it, so their labels are
carried along the skip edges first: a token with the digits or mail name of a
labelled one is that kind.  Each such token of the sample, labelled or not, is
seen once more as it would stand later in its text, among plain words and linked
to where it stood: from these pairs the skip potential learns that like tokens
have like labels, and the others how much a token says without its prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: The kinds in their order and the patterns.  Possessive runs and
#: look-behinds give the same leftmost matches without trying a run again from its middle.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = frozenset("0123456789")
_EDGE = ".,;:!?\"'()[]{}<>"
PLAIN = ("aaaa", "aaaa")  # plain words before and after a token

SAMPLE = 2000
SLOTS = 1 << 12
ROUNDS = 6
SURE = 0.9
LABELS = 1 + len(KINDS)  # 0 is outside


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; matches that fail their test are dropped, without retries."""
    found, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _MAIL_NAME:
                start -= 1
            if start < at:
                end = m.end()
                found.append((start, 0, end))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in _DIGITS for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Tokens:
    """Candidate tokens of one text: code point places and their order among all tokens."""

    text: str
    starts: list[int]
    ends: list[int]
    order: list[int]
    around: list[tuple[str, str]]  # the tokens before and after


def _shape(token: str) -> str:
    out, last, run = [], "", 0
    for c in token[:64]:
        k = "9" if c in _DIGITS else "a" if c.islower() else "A" if c.isalpha() else c
        run = run + 1 if k == last else 1
        last = k
        if run <= 4:
            out.append(k)
    return "".join(out)


def _slot(name: str) -> int:
    value = 2166136261
    for b in name.encode():
        value = ((value ^ b) * 16777619) & 0xFFFFFFFF
    return (value ^ (value >> 15)) % SLOTS


def token_features(token: str, before: str, after: str) -> list[int]:
    core = token.strip(_EDGE)
    digits = "".join(c for c in core if c in _DIGITS)
    n = len(digits)
    parts = core.split(".")
    ip = len(parts) == 4 and all(0 < len(p) < 4 and _DIGITS.issuperset(p) and int(p) < 256 for p in parts)
    names = [
        "bias", "shape " + _shape(core), "digits " + str(min(n, 20)), "length " + str(min(len(core), 24)),
        f"mail {'@' in core} {core.count('@') == 1 and '.' in core.rpartition('@')[2]}", f"ip {ip}", f"dots {min(core.count('.'), 5)}",
        f"card {14 <= n <= 19} {14 <= n <= 19 and luhn(digits)}", "first " + core[:1], f"plus {core[:1] == '+'} {min(n, 4)}",
        "before " + _shape(before)[-6:], "after " + _shape(after)[:6], f"only digits {n == len(core)}",
    ]
    return [_slot(x) for x in names]


def link_keys(token: str) -> set[str]:
    """What makes distant tokens similar: the same core, the same six digits or more, the same mail name."""
    core = token.strip(_EDGE).lower()
    digits = "".join(c for c in core if c in _DIGITS)
    keys = {"t" + core} if len(core) >= 4 else set()
    if len(digits) >= 6:
        keys.add("d" + digits)
    if "@" in core and len(core.partition("@")[0]) >= 4:
        keys.add("m" + core.partition("@")[0])
    return keys


def strong_keys(token: str) -> set[str]:
    """The keys that say "the same number or mailbox", not just the same word."""
    return {k for k in link_keys(token) if k[0] in "dm"}


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[Tokens | None]:
    """The candidate tokens of each text, None where there is none (then no base span is either)."""
    cut = W.cut(data, offsets)
    raw = data[offsets[0] : offsets[-1]]
    sign = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(((raw - np.uint8(48)) < 10) | (raw == 0x40) | (raw == 0x2B), out=sign[1:])
    marked = sign[cut.ends] > sign[cut.starts]
    total = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=total[1:])
    for t in range(cut.texts):
        lo, hi = cut.first[t], cut.first[t + 1]
        if total[lo] == total[hi]:
            yield None
            continue
        from_, to = offsets[t] - offsets[0], offsets[t + 1] - offsets[0]
        own = raw[from_:to]
        place = np.zeros(len(own) + 1, np.int64)
        np.cumsum((own & 0xC0) != 0x80, out=place[1:])
        text = own.tobytes().decode("utf-8", "replace")
        s, e = place[cut.starts[lo:hi] - from_], place[cut.ends[lo:hi] - from_]
        at = np.flatnonzero(marked[lo:hi])
        word = lambda k: text[s[k] : min(e[k], s[k] + 64)] if 0 <= k < len(s) else ""
        yield Tokens(text, s[at].tolist(), e[at].tolist(), at.tolist(), [(word(k - 1), word(k + 1)) for k in at])


@dataclass
class Graph:
    """Tokens of many texts as one graph; edges go from an earlier to a later token."""

    slots: np.ndarray  # token x feature
    chain: np.ndarray  # edge x 2
    skip: np.ndarray


def graph_of(texts: list[Tokens]) -> Graph:
    slots, chain, skip, n = [], [], [], 0
    for t in texts:
        last: dict[str, int] = {}
        for i, (s, e) in enumerate(zip(t.starts, t.ends)):
            token = t.text[s:e]
            slots.append(token_features(token, *t.around[i]))
            if i and t.order[i] == t.order[i - 1] + 1:
                chain.append((n + i - 1, n + i))
            near = set()
            for key in link_keys(token):
                if key in last and last[key] not in near:
                    near.add(last[key])
                    skip.append((n + last[key], n + i))
                last[key] = i
        n += len(t.starts)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(slots, np.int64).reshape(n, -1), pairs(chain), pairs(skip))


@dataclass
class Field:
    unary: np.ndarray  # slot x label
    chain: np.ndarray  # label x label
    skip: np.ndarray  # label x label, symmetric


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit_field(graph: Graph, labels: np.ndarray, epochs: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: each label given the labels of its neighbours, by full-batch adaptive gradients."""
    f = Field(np.zeros((SLOTS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    if not len(labels):
        f.unary[_slot("bias"), 0] = 5.0
        return f
    truth = np.eye(LABELS)[labels]
    seen = [np.full_like(x, 1e-6) for x in (f.unary, f.chain, f.skip)]
    (ca, cb), (sa, sb) = graph.chain.T, graph.skip.T
    for _ in range(epochs):
        z = f.unary[graph.slots].sum(axis=1)
        np.add.at(z, cb, f.chain[labels[ca]])
        np.add.at(z, ca, f.chain.T[labels[cb]])
        np.add.at(z, sb, f.skip[labels[sa]])
        np.add.at(z, sa, f.skip[labels[sb]])
        g = (_softmax(z) - truth) / len(labels)
        gu = np.zeros_like(f.unary)
        for k in range(graph.slots.shape[1]):
            np.add.at(gu, graph.slots[:, k], g)
        gc = truth[ca].T @ g[cb] + g[ca].T @ truth[cb]
        gs = truth[sa].T @ g[sb] + g[sa].T @ truth[sb]
        for x, d, s in zip((f.unary, f.chain, f.skip), (gu, gc, gs + gs.T), seen):
            d = d + decay * x
            s += d * d
            x -= rate * d / np.sqrt(s)
    return f


def _through(x: np.ndarray, potential: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Messages over edges from their senders' beliefs, highest entry 0; in blocks, to bound memory."""
    out = np.empty_like(x)
    for lo in range(0, len(x), block):
        m = np.logaddexp.reduce(x[lo : lo + block, :, None] + potential, axis=1)
        out[lo : lo + block] = m - m.max(axis=1, keepdims=True)
    return out


def beliefs(graph: Graph, field: Field, rounds: int = ROUNDS, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of every token by loopy sum-product over all texts at once."""
    unary = field.unary[graph.slots].sum(axis=1)
    edges = [(graph.chain, field.chain), (graph.skip, field.skip)]
    forth, back = ([np.zeros((len(e), LABELS)) for e, _ in edges] for _ in range(2))

    def gathered() -> np.ndarray:
        total = unary.copy()
        for (e, _), f, b in zip(edges, forth, back):
            np.add.at(total, e[:, 1], f)
            np.add.at(total, e[:, 0], b)
        return total

    for _ in range(rounds):
        total = gathered()
        for k, (e, potential) in enumerate(edges):
            sent, other = total[e[:, 0]] - back[k], total[e[:, 1]] - forth[k]
            forth[k] = damping * forth[k] + (1 - damping) * _through(sent, potential)
            back[k] = damping * back[k] + (1 - damping) * _through(other, potential.T)
    return _softmax(gathered())


def _token_labels(t: Tokens, spans: list[tuple[int, int, int]]) -> list[int]:
    out = [0] * len(t.starts)
    for start, kind, end in spans:
        for i in range(len(out)):
            if t.starts[i] < end and t.ends[i] > start and not out[i]:
                out[i] = kind + 1
    return out


def _carried(t: Tokens, labels: list[int]) -> list[int]:
    """Labels, with those of labelled tokens given to the tokens of one strong key."""
    known: dict[str, int] = {}
    keys = [strong_keys(t.text[s:e]) for s, e in zip(t.starts, t.ends)]
    for own, label in zip(keys, labels):
        for key in own if label else ():
            known.setdefault(key, label)
    return [label or next((known[k] for k in sorted(own) if k in known), 0) for own, label in zip(keys, labels)]


def _seen_again(t: Tokens, graph: Graph, labels: list[int]) -> tuple[Graph, list[int]]:
    """The graph with each token of a strong key once more, among plain words and linked to where it stood."""
    again = [i for i, (s, e) in enumerate(zip(t.starts, t.ends)) if strong_keys(t.text[s:e])]
    if not again:
        return graph, labels
    n = len(labels)
    slots = np.array([token_features(t.text[t.starts[i] : t.ends[i]], *PLAIN) for i in again], np.int64)
    links = np.array([(i, n + k) for k, i in enumerate(again)], np.int64)
    return Graph(np.vstack([graph.slots, slots]), graph.chain, np.vstack([graph.skip, links])), labels + [labels[i] for i in again]


def added_spans(t: Tokens, probability: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of sure tokens that touch no base span; neighbours of one kind are one span."""
    out: list[tuple[int, int, int]] = []
    last = None
    edges = sorted((s, e) for s, _, e in base)
    for i, (s, e) in enumerate(zip(t.starts, t.ends)):
        kind = int(probability[i].argmax())
        token = t.text[s:e]
        s, e = s + len(token) - len(token.lstrip(_EDGE)), e - (len(token) - len(token.rstrip(_EDGE)))
        if not kind or probability[i, kind] < SURE or s >= e or any(a < e and b > s for a, b in edges):
            continue
        if last == (t.order[i] - 1, kind):
            out[-1] = (out[-1][0], kind - 1, e)
        else:
            out.append((s, kind - 1, e))
        last = (t.order[i], kind)
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """The field, from the base spans of a bounded sample of documents that have a candidate token."""
    marked = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), F.col(text).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@+]"))
    first = marked.select("h").distinct().orderBy("h").limit(sample)
    # One row of each hash, so that copies are neither a large part of the sample nor all sent.
    chosen = marked.join(first, "h", "left_semi").groupBy("h").agg(F.min("text").cast("binary").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, _, data, offsets in W.chunks(batch, "text"):
                for i, t in enumerate(candidates(data, offsets), lo):
                    if t:
                        g, labels = _seen_again(t, graph_of([t]), _carried(t, _token_labels(t, base_spans(t.text))))
                        out.append((batch.column(0)[i].as_py(), g.slots.ravel(), g.chain.ravel(), g.skip.ravel(), labels))
            lists = [pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in range(1, 5)]
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), *lists], ["h", "slots", "chain", "skip", "labels"])

    table = chosen.mapInArrow(describe, "h bigint, slots array<bigint>, chain array<bigint>, skip array<bigint>, labels array<bigint>").toArrow()
    rows = sorted(table.to_pylist(), key=lambda r: (r["h"], r["slots"]))[:sample]
    slots, chain, skip, labels, n = [], [], [], [], 0
    for r in rows:
        k = len(r["labels"])
        slots.append(np.array(r["slots"], np.int64).reshape(k, -1))
        chain.append(np.array(r["chain"], np.int64).reshape(-1, 2) + n)
        skip.append(np.array(r["skip"], np.int64).reshape(-1, 2) + n)
        labels += r["labels"]
        n += k
    none = np.empty((0, 2), np.int64)
    graph = Graph(np.concatenate(slots) if rows else np.empty((0, 1), np.int64), np.concatenate([none, *chain]), np.concatenate([none, *skip]))
    return fit_field(graph, np.array(labels, np.int64))


def spans_of(data: np.ndarray, offsets: np.ndarray, field: Field) -> Iterator[tuple[str | None, list, list]]:
    """(text, base spans, added spans) of each text; text is None where nothing can be."""
    texts = list(candidates(data, offsets))
    present = [t for t in texts if t]
    probability = beliefs(graph_of(present), field) if present else np.empty((0, LABELS))
    n = 0
    for t in texts:
        if t is None:
            yield None, [], []
            continue
        base = base_spans(t.text)
        yield t.text, base, added_spans(t, probability[n : n + len(t.starts)], base)
        n += len(t.starts)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal_data(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base_spans, spans, one count per kind of base spans) for every row.

    Spans are ``kind:start:end`` in code points, sorted by start, then kind.  A
    NULL or empty text has none (empty strings); repeated rows have the same.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs, doc_id, text))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, counts = [], [], []
            for _, _, data, offsets in W.chunks(batch, "text"):
                for _, own, added in spans_of(data, offsets, sent.value):
                    base.append(_joined(own))
                    every.append(_joined(own + added))
                    counts.append([sum(k == i for _, k, _ in own) for i in range(len(KINDS))])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.record_batch([batch.column(0), *columns, pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(find, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first names all."""
    out, end = [], 0
    for s, kind, e in sorted(spans):
        if s >= end:
            out += [text[end:s], f"<{KINDS[kind].upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, with personal data replaced in the text and its length put right."""
    sent, names = docs.sparkSession.sparkContext.broadcast(field or fit(docs, doc_id, text)), docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for lo, _, data, offsets in W.chunks(batch, "__text"):
                for i, (own, base, added) in enumerate(spans_of(data, offsets, sent.value), lo):
                    if base or added:
                        changed[i] = redacted(own, base + added)
            columns = {c: batch.column(k) for k, c in enumerate(names)}
            if changed:
                columns[text] = pa.array([changed.get(i, v.as_py()) for i, v in enumerate(columns[text])], columns[text].type)
                if n_chars in columns:
                    columns[n_chars] = pa.array([len(changed[i]) if i in changed else v.as_py() for i, v in enumerate(columns[n_chars])], columns[n_chars].type)
            yield pa.record_batch(list(columns.values()), list(columns))

    ready = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    return ready.mapInArrow(rewrite, docs.schema)

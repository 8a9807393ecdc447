"""Plain one-machine versions of the operators, to test them against."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = {k: k + 32 for k in range(65, 91)}


def lower(text):
    return (text or "").translate(TO_LOWER)


def shingles(words, width=5):
    if len(words) >= width:
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    return {tuple(words)} if words else set()


def notices(text, templates, threshold):
    """(first word, label, containment) of every block, from each template word on, that meets a template."""
    words, found = ALNUM.findall(lower(text)), []
    for label, notice, must in templates:
        own = ALNUM.findall(lower(notice))
        length, tokens = int(len(own) / threshold + 1e-9), set(own)
        for at, word in enumerate(words):
            held = tokens & set(words[at : at + length])
            if word in tokens and len(held) >= threshold * len(tokens) - 1e-9 and set(must.split()) <= held:
                found.append((at, label, len(held) / len(tokens)))
    return found


def near_duplicates(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(WORD.findall(lower(t))) for _, t in rows]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = collections.Counter()
    for places in where.values():
        for a in range(len(places)):
            for b in range(a):
                shared[places[b], places[a]] += 1
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (lowest.get(r), d) if x is not None]
        lowest[r] = min(known) if known else None
    return sorted(((d, len(sets[i]), lowest[find(i)], d == lowest[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def repeats(rows, length=35):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, kept_sha256)."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter()
    for w in words:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] += 1
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def contained(rows, items, threshold=0.8, width=5):
    """rows, items: (id, text) -> sorted (doc_id, item_id, n_item, n_shared)."""
    wanted = [(i, shingles(ALNUM.findall(lower(t)), width)) for i, t in items if len(ALNUM.findall(lower(t))) >= width]
    out = []
    for d, t in rows:
        own = ALNUM.findall(lower(t))
        own = shingles(own, width) if len(own) >= width else set()
        for i, s in wanted:
            both = len(s & own)
            if both >= threshold * len(s) - 1e-9:
                out.append((d, i, len(s), both))
    return sorted(out, key=str)

"""SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, THRESHOLD

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WHITE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    templates = ", ".join(f"({i}, {', '.join(map(_quoted, t))})" for i, t in enumerate(TEMPLATES))
    places, labels = [], []
    for phrase, label in PHRASES:
        test = " AND ".join(f"words[i + {k + 1}] = {_quoted(w)}" for k, w in enumerate(phrase.split()))
        places.append(f"[i FOR i IN range(0, len(words)) IF {test}]")
        labels.append(f"CASE WHEN len(p{len(labels)}) > 0 THEN {_quoted(label)} END")
    named = ", ".join(f"{p} AS p{i}" for i, p in enumerate(places))
    every = f"flatten([{', '.join(f'p{i}' for i in range(len(places)))}])"
    return f"""
WITH t AS (
  SELECT id, label, list_distinct(regexp_extract_all(lower(notice), '{ALNUM}')) AS tokens, string_split(must, ' ') AS must,
         floor(len(regexp_extract_all(notice, '[A-Za-z0-9]+')) / {THRESHOLD} + 1e-9)::INT AS length
  FROM (VALUES {templates}) v(id, label, notice, must)),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents),
b AS (SELECT doc_id, words, {named} FROM d),
x AS (SELECT *, {every} AS places, list_distinct([l FOR l IN [{', '.join(labels)}] IF l IS NOT NULL]) AS base FROM b),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
places AS (SELECT doc_id, id, pos, word FROM words JOIN (SELECT id, unnest(tokens) AS word FROM t) USING (word)),
hits AS (
  SELECT a.doc_id, any_value(label) AS label, count(DISTINCT b.word)::DOUBLE / any_value(len(tokens)) AS share
  FROM places a JOIN t USING (id) JOIN places b ON a.doc_id = b.doc_id AND a.id = b.id AND b.pos >= a.pos AND b.pos < a.pos + length
  GROUP BY a.doc_id, id, a.pos
  HAVING count(DISTINCT b.word) >= ceil({THRESHOLD} * any_value(len(tokens)) - 1e-9)
     AND len(list_intersect(any_value(must), list(DISTINCT b.word))) = any_value(len(must))),
n AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM hits GROUP BY doc_id)
SELECT x.doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, []::VARCHAR[])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM x LEFT JOIN n USING (doc_id)"""


LICENSES = _licenses()

MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WHITE}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, (CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS w FROM s),
p AS (
  SELECT *, s * (6 // w) AS r FROM w),
q AS (
  SELECT *, 3 * sum(s) OVER () - 4 * coalesce(sum(s) OVER (ORDER BY r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         2 * sum(w) OVER (ORDER BY r, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM p),
level AS (SELECT num, den FROM q WHERE 2 * s * den > w * num ORDER BY r, n LIMIT 1),
t AS (
  SELECT p.source, p.s, CASE WHEN level.num IS NULL OR 2 * p.s * level.den <= p.w * level.num THEN (2 * p.s)::DOUBLE
         ELSE p.w::DOUBLE * level.num::DOUBLE / level.den::DOUBLE END AS target
  FROM p LEFT JOIN level ON true),
r AS (
  SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target, (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM r"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WHITE}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WHITE}') AS w FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS i FROM d)),
again AS (SELECT x FROM p GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p JOIN again USING (x)),
g AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
o AS (SELECT d.doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d JOIN g USING (doc_id)),
kept AS (SELECT o.doc_id, string_agg(o.w[o.k], ' ' ORDER BY o.k) AS text FROM o ANTI JOIN gone ON gone.doc_id = o.doc_id AND gone.k = o.k GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

LEAKS = f"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS i FROM d)),
bs AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS i FROM b)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
k AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS k FROM ds JOIN bs USING (x) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, k AS n_shared, k::DOUBLE / n AS containment FROM k JOIN n ON n.id = item_id WHERE k >= ceil(0.8 * n - 1e-9)"""

# CRC-32 of a string: the remainders of all bytes, then one step per byte.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i))"


def _crc(text: str) -> str:
    """SQL for the CRC-32 of a string expression, where the column ``crcs`` is at hand."""
    octets = f"[('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT FOR k IN range(0, strlen({text}))]"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def _turns() -> str:
    none = "struct_pack(c := 1000000::BIGINT, a := '', t := []::VARCHAR[])"
    end = "struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[])"
    due = {"s": ("u", "user"), "y": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}  # where each state goes on: state, role
    keeps = {"s": {"s": "y", "u": "u"}, "y": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def edit(letter: str, to: str, cost: str, line: str | None) -> str:
        text = f"{to}.t" if line is None else f"list_prepend({line}, {to}.t)"
        return f"struct_pack(c := {to}.c + {cost}, a := '{letter}' || {to}.a, t := {text})"

    def row(q: str) -> str:
        options = [edit("D", f"dp.{q}", "2", None)]
        for initial, to in keeps[q].items():
            options.append(f"CASE WHEN NOT forced AND initial = '{initial}' THEN {edit('K', f'dp.{to}', 'more', chr(39).join(['role || ', ':', ' || text']))} END")
        to, role = due[q]
        options.append(f"CASE WHEN NOT forced THEN {edit('R', f'dp.{to}', '1 + more', chr(39) + role + ':' + chr(39) + ' || text')} END")
        return f"list_min([{', '.join(options)}]) AS {q}"

    def inserted(q: str, of: str) -> str:
        to, role = due[q]
        return f"list_min([{of}.{q}, {edit('I', f'{of}.{to}', '5', chr(39) + role + ':' + chr(39))}])"

    # At most two inserts follow each other: the first pair of states settles u and a, the second s and y.
    ua = lambda of: f"{inserted('u', of)} AS u, {inserted('a', of)} AS a"
    sy = lambda of: f"list_min([{of}.s, {edit('I', f'{of}.u', '5', chr(39) + 'user:' + chr(39))}]) AS s, list_min([{of}.y, {edit('I', f'{of}.u', '5', chr(39) + 'user:' + chr(39))}]) AS y"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
read_ AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
hit AS (SELECT read_.*, {_crc('place')} % 20 AS what FROM read_, crc),
dmg AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE what <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 128), md5(text)) AS n,
         regexp_extract(text, '[^\\x20\\x09-\\x0D]?[\\x20\\x09-\\x0D]*$')[1] AS last, left(role, 1) AS initial FROM dmg),
f AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
g AS (
  SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS cut, blank OR again AS forced FROM f),
h AS (SELECT *, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM g),
total AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank,
         sum(dup::INT)::BIGINT AS duplicate, sum(cut::INT)::BIGINT AS truncated, sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal
  FROM h GROUP BY conv_id),
dp AS (
  SELECT conv_id, n + 1 AS i, {end} AS s, struct_pack(c := 10::BIGINT, a := 'II', t := ['user:', 'assistant:']) AS y,
         struct_pack(c := 5::BIGINT, a := 'I', t := ['assistant:']) AS u, {end} AS a FROM total
  UNION ALL
  SELECT conv_id, i, {sy('z')}, z.u, z.a FROM (
    SELECT conv_id, i, b.s, b.y, {ua('b')} FROM (
      SELECT dp.conv_id, h.n AS i, {', '.join(row(q) for q in 'syua')} FROM dp JOIN h ON h.conv_id IS NOT DISTINCT FROM dp.conv_id AND h.n = dp.i - 1) b) z),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(dp.s.c, 0)::BIGINT AS cost, coalesce(dp.s.a, '') AS audit, sha256(coalesce(array_to_string(dp.s.t, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN total ON total.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM ids.conv_id AND dp.i = 1""".replace(none, "NULL")


TURNS = _turns()

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v, embedding FROM embeddings),
ok AS (SELECT * FROM v WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM ok q JOIN ok d ON q.r <> d.r AND q.vec_id % 50 = 0),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""

RESAMPLE = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
dw AS (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY ALL),
bw AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) GROUP BY ALL),
words AS (SELECT x, {_crc('x')} % 10000 AS bucket FROM (SELECT x FROM dw UNION SELECT x FROM bw), crc),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN words USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN words USING (x) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (z.s + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * (z.t + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), z),
m AS (SELECT r, sum(dw.n * gain)::BIGINT AS weight FROM dw JOIN words USING (x) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT *, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
o AS (
  SELECT h.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM h LEFT JOIN m USING (r)),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM o WHERE n_features >= 20),
q AS (SELECT (10 * count(*)) // 100 AS n FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= q.n THEN rank END::BIGINT AS rank FROM o LEFT JOIN p USING (r), q"""

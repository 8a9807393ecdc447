"""Conversation structure repair: the cheapest edits that make the turns alternate.

A repaired conversation is empty, or an optional system turn and then pairs of a
user and an assistant turn.  Rows are kept (0), given the other role (1), deleted
(2) or empty turns are inserted (5); blank rows and repeats have to go, and a
truncated row that stays costs 5 more.  The edits form a lattice of (rows read,
state of the alternation).  ``search`` finds the cheapest path by a bidirectional
Dijkstra: a forward and a reverse heap, both ordered by cost, run until no cheaper
or equal crossing can be left; of all crossings of the least cost the one whose
concatenated letters come first wins.

A conversation of any length is spread over tasks.  Its rows are reduced to one
letter each and range-partitioned by (conversation, turn, ...); pieces of at most 256
letters are searched by themselves.  A conversation of several pieces
takes three steps: costs between the states at both ends of every piece, the costs
from there to the end (a stream over 16 numbers a piece), then the best letters of
every piece for each state it may begin in, of which a stream picks the right ones.
Only the letters go this way; texts are shuffled once, at the end, and pass their
task as a stream.  That last stream is in order within a conversation, so one
conversation is written by one task, in bounded memory but for its letters.

Defined results: rows of a conversation are taken by turn (NULL first), then role,
the first 128 characters and the MD5 of the text.  NULL roles and texts read as one
space.  A NULL conversation id is a conversation of its own.  Rows that repeat are
duplicates; a conversation of nothing but faults becomes empty.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import NO_ID, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
INF = 1 << 60
END = (0, INF, INF, 0)  # a conversation may end before the first turn and after an assistant's
SPACES = " \t\n\x0b\x0c\r"
PIECE_BITS = 8
OUT_ROWS, OUT_BYTES = 2_000, 4 << 20

# Where a role leads from a state, and the role that is due in it.
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_DUE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}

# A row's letter: b blank, d duplicate, else the role's initial (x for any other), as a capital where the row is truncated.
BLANK, DUPLICATE = "b", "d"

Step = tuple[str, int, int, int]  # edit, state before, state after, cost


def _row_steps(letter: str) -> list[Step]:
    steps = [("D", q, q, DELETE) for q in range(STATES)]
    if letter not in (BLANK, DUPLICATE):
        more = TRUNCATED if letter.isupper() else 0
        for q in range(STATES):
            if (q, letter.lower()) in _AFTER:
                steps.append(("K", q, _AFTER[q, letter.lower()], KEEP + more))
            steps.append(("R", q, _AFTER[q, _DUE[q]], REROLE + more))
    return steps


_STEPS = {letter: _row_steps(letter) for letter in "bdsuaxSUAX"}
_INSERTS: list[Step] = [("I", q, _AFTER[q, _DUE[q]], INSERT) for q in range(STATES)]


def _by_state(steps: list[Step], at: int) -> list[list[Step]]:
    return [[s for s in steps if s[at] == q] for q in range(STATES)]


_OUT = {letter: _by_state(steps, 1) for letter, steps in _STEPS.items()}
_IN = {letter: _by_state(steps, 2) for letter, steps in _STEPS.items()}
_OUT_INSERT, _IN_INSERT = _by_state(_INSERTS, 1), _by_state(_INSERTS, 2)


class _Side:
    """One heap: tentative and settled (cost, letters) of the nodes.

    Free steps lead one row on, so nodes of one cost are settled in the order of
    their rows as seen from this side; a node's letters are then final with its cost.
    """

    def __init__(self, forward: bool):
        self.forward, self.heap, self.label, self.done = forward, [], {}, set()

    def offer(self, i: int, q: int, cost: int, letters: str) -> None:
        known = self.label.get((i, q))
        if known is None or (cost, letters) < known:
            self.label[i, q] = (cost, letters)
            heapq.heappush(self.heap, (cost, i if self.forward else -i, letters, i, q))

    def top(self) -> int | None:
        while self.heap and (self.heap[0][3:] in self.done or self.label[self.heap[0][3:]] != (self.heap[0][0], self.heap[0][2])):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple[int, int, int, str]:
        cost, _, letters, i, q = heapq.heappop(self.heap)
        self.done.add((i, q))
        return i, q, cost, letters


def _next(rows: str, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """Steps out of a node: (edit, row, state, cost)."""
    if i < len(rows):
        for edit, _, after, cost in _OUT[rows[i]][q]:
            yield edit, i + 1, after, cost
    for edit, _, after, cost in _OUT_INSERT[q]:
        yield edit, i, after, cost


def _previous(rows: str, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    if i:
        for edit, before, _, cost in _IN[rows[i - 1]][q]:
            yield edit, i - 1, before, cost
    for edit, before, _, cost in _IN_INSERT[q]:
        yield edit, i, before, cost


@lru_cache(1 << 16)
def search(rows: str, entry: int = START, exits: tuple[int, ...] = END) -> tuple[int, str] | None:
    """Least (cost, letters) from the state ``entry`` through all rows; ``exits`` is what each last state costs.  None without a way."""
    ahead, back = _Side(True), _Side(False)
    ahead.offer(0, entry, 0, "")
    for q, cost in enumerate(exits):
        if cost < INF:
            back.offer(len(rows), q, cost, "")
    best = INF
    while True:
        f, r = ahead.top(), back.top()
        # A side that ran dry counts as 0: the other goes on to the least cost itself.
        if (f is None and r is None) or (f or 0) + (r or 0) > best:
            break
        if r is None or (f is not None and f <= r):
            i, q, cost, letters = ahead.settle()
            if (i, q) in back.label:
                best = min(best, cost + back.label[i, q][0])
            for edit, j, p, more in _next(rows, i, q):
                ahead.offer(j, p, cost + more, letters + edit)
        else:
            i, q, cost, letters = back.settle()
            if (i, q) in ahead.label:
                best = min(best, cost + ahead.label[i, q][0])
            for edit, j, p, more in _previous(rows, i, q):
                back.offer(j, p, cost + more, edit + letters)
    if best == INF:
        return None
    # Every path of the least cost has a step from a node one side settled to one of the other's, or was settled by one side whole.
    found = []
    for i, q in ahead.done:
        cost, letters = ahead.label[i, q]
        if i == len(rows) and cost + exits[q] == best:
            found.append(letters)
        for edit, j, p, more in _next(rows, i, q):
            if (j, p) in back.done and cost + more + back.label[j, p][0] == best:
                found.append(letters + edit + back.label[j, p][1])
    return best, min(found)


def state_after(rows: str, entry: int, letters: str) -> int:
    """The state that the edits lead to."""
    i, q = 0, entry
    for edit in letters:
        steps = _OUT_INSERT[q] if edit == "I" else [s for s in _OUT[rows[i]][q] if s[0] == edit]
        q = steps[0][2]
        i += edit != "I"
    return q


# ------------------------------------------------------------ rows to letters


def _ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows' own columns under fixed names, without NULLs but for the turn."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(
        F.coalesce(F.col(conv_id).cast("bigint"), F.lit(NO_ID)).alias("cid"),
        F.col(turn).cast("bigint").alias("turn"),
        read(role).alias("role"),
        read(text).alias("text"),
    )


ORDER = ("cid", "turn", "role", "head", "digest")


def _with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.left("text", F.lit(128))).withColumn("digest", F.md5("text"))


def _pieces(rows: DataFrame) -> DataFrame:
    """(cid, piece, rows): the letters of the rows that do not just repeat the row before, in order."""
    last = F.rtrim("text", F.lit(SPACES))
    marked = _with_order(rows).select(
        *ORDER, (last == "").alias("blank"), (~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("cut")
    ).distinct()  # combined before the shuffle: a row that repeats is one
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = marked.groupBy("cid", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("blank"), BLANK).when(place > F.col("first"), DUPLICATE).when(F.col("cut"), F.upper(letter)).otherwise(letter)
    lettered = marked.join(firsts, ["cid", "role", "digest"], "left").select(*ORDER, letter.alias("letter"))
    # A total order over distinct rows: the places are the same whenever a task runs again.
    placed = lettered.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("cid", "letter", F.monotonically_increasing_id().alias("id"))
    grouped = placed.groupBy("cid", F.shiftright("id", PIECE_BITS).alias("piece"))  # at most 256 letters each
    letters = F.transform(F.sort_array(F.collect_list(F.struct("id", "letter"))), lambda x: x["letter"])
    return grouped.agg(F.array_join(letters, "").alias("rows"))


# ------------------------------------------------------------ the search over pieces


def _map(df: DataFrame, schema: str, work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """One small row in, some out."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for given in batch.to_pylist() for row in work(given)]
            yield _batch(out, names, schema)

    return df.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [_ARROW[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _stream(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """Rows of a sorted partition, one after the other, in bounded memory."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in work(row for batch in batches for row in batch.to_pylist()):
            out.append(row)
            size += sum(len(c) for c in row if isinstance(c, str))
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield _batch(out, names, schema)
                out, size = [], 0
        yield _batch(out, names, schema)

    return df.mapInArrow(run, schema)


def _border_costs(given: dict) -> Iterator[tuple]:
    costs = []
    for entry in range(STATES):
        for exit_ in range(STATES):
            found = search(given["rows"], entry, tuple(0 if q == exit_ else INF for q in range(STATES)))
            costs.append(INF if found is None else found[0])
    yield given["cid"], given["piece"], given["rows"], costs


def _costs_to_end(rows: Iterator[dict]) -> Iterator[tuple]:
    """Pieces from the last to the first: what each state after a piece costs to the end."""
    cid, ahead = None, END
    for given in rows:
        if given["cid"] != cid:
            cid, ahead = given["cid"], END
        yield cid, given["piece"], given["rows"], list(ahead)
        m = given["costs"]
        ahead = tuple(min(INF, *(m[entry * STATES + q] + ahead[q] for q in range(STATES))) for entry in range(STATES))


def _best_from_each(given: dict) -> Iterator[tuple]:
    """For each state a piece may begin in, its best letters and the state they lead to."""
    exits = tuple(given["exits"])
    found = [search(given["rows"], entry, exits) for entry in range(STATES)]
    letters = [f[1] if f else None for f in found]
    after = [state_after(given["rows"], entry, f[1]) if f else None for entry, f in enumerate(found)]
    yield given["cid"], given["piece"], given["rows"], letters, after


def _pick(rows: Iterator[dict]) -> Iterator[tuple]:
    """Pieces from the first to the last: the letters for the state the ones before lead to."""
    cid, state = None, START
    for given in rows:
        if given["cid"] != cid:
            cid, state = given["cid"], START
        yield cid, given["piece"], given["rows"], given["letters"][state]
        state = given["after"][state]


def _single(given: dict) -> Iterator[tuple]:
    yield given["cid"], given["piece"], given["rows"], search(given["rows"])[1]


PICKED = "cid bigint, piece bigint, rows string, letters string"


def _edits(pieces: DataFrame) -> DataFrame:
    """(cid, piece, rows, letters): the cheapest edits of every conversation, by piece."""
    several = pieces.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cid")
    alone = _map(pieces.join(several, "cid", "left_anti").select("cid", "piece", "rows"), PICKED, _single)
    long = pieces.join(several, "cid", "left_semi").select("cid", "piece", "rows")
    costs = _map(long, "cid bigint, piece bigint, rows string, costs array<bigint>", _border_costs)
    back = costs.repartition("cid").sortWithinPartitions("cid", F.col("piece").desc())
    ends = _stream(back, "cid bigint, piece bigint, rows string, exits array<bigint>", _costs_to_end)
    # Dealt by piece again: the search of one long conversation is many tasks.
    each = _map(ends.repartition("cid", "piece"), "cid bigint, piece bigint, rows string, letters array<string>, after array<bigint>", _best_from_each)
    picked = _stream(each.repartition("cid").sortWithinPartitions("cid", "piece"), PICKED, _pick)
    return alone.unionByName(picked)


# ------------------------------------------------------------ the repaired rows


EDITED = "conv_id bigint, edit string, fault string, turn bigint, role_before string, role string, text string"
_FAULTS = {BLANK: "blank", DUPLICATE: "duplicate"}


def _apply(rows: Iterator[dict]) -> Iterator[tuple]:
    """One conversation after the other: its edits first, then its rows in order."""
    cid, own, letters, done, read, state, last, empty = None, [], [], 0, 0, START, None, True

    def inserts(edits: str) -> Iterator[tuple]:
        nonlocal done, state
        while done < len(edits) and edits[done] == "I":
            due = _DUE[state]
            state = _AFTER[state, due]
            done += 1
            yield conv, "I", None, None, None, ROLES[due], ""

    def finish() -> Iterator[tuple]:
        if cid is not None:
            yield from inserts(edits)
            if empty:
                yield conv, None, None, None, None, None, None

    edits, marks, conv = "", "", None
    for given in rows:
        if given["cid"] != cid:
            yield from finish()
            cid, own, letters, done, read, state, last, empty = given["cid"], [], [], 0, 0, START, None, True
            edits, marks, conv = "", "", None if cid == NO_ID else cid
        if given["kind"] == 0:
            continue
        if given["kind"] == 1:
            own.append(given["rows"])
            letters.append(given["letters"])
            continue
        if empty:
            edits, marks, empty = "".join(letters), "".join(own), False
        here = (given["turn"], given["role"], given["digest"])
        if here == last:  # the very row again
            yield conv, "D", "blank" if marks[read - 1] == BLANK else "duplicate", given["turn"], given["role"], None, None
            continue
        last = here
        yield from inserts(edits)
        edit, mark = edits[done], marks[read]
        done, read = done + 1, read + 1
        fault = _FAULTS.get(mark) or ("truncated" if mark.isupper() else None)
        if edit == "D":
            yield conv, "D", fault, given["turn"], given["role"], None, None
            continue
        due = mark.lower() if edit == "K" else _DUE[state]
        state = _AFTER[state, due]
        yield conv, edit, fault, given["turn"], given["role"], given["role"] if edit == "K" else ROLES[due], given["text"]
    yield from finish()


def repair_conversations(rows: DataFrame, known: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, edit, fault, turn, role_before, role, text): every edit of every conversation.

    Rows of a conversation lie together and in order in one partition.  Deleted
    rows have no ``role`` and ``text``; inserted ones no ``role_before``.  A
    conversation of ``known`` (column ``conv_id``) without rows is one row whose
    ``edit`` is NULL.
    """
    taken = _ordered(rows, conv_id, turn, role, text)
    found = _edits(stored(_pieces(taken), "turn-letters"))
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = taken.select("cid", F.lit(2).alias("kind"), blank("bigint", "piece"), blank("string", "rows"), blank("string", "letters"), "turn", "role", "text")
    no_row = [blank("bigint", "turn"), blank("string", "role"), blank("string", "text")]
    both = both.unionByName(found.select("cid", F.lit(1).alias("kind"), "piece", "rows", "letters", *no_row))
    if known is not None:
        ids = known.select(F.coalesce(F.col(conv_id).cast("bigint"), F.lit(NO_ID)).alias("cid")).distinct()
        both = both.unionByName(ids.select("cid", F.lit(0).alias("kind"), blank("bigint", "piece"), blank("string", "rows"), blank("string", "letters"), *no_row))
    together = _with_order(both.repartition("cid")).sortWithinPartitions("cid", "kind", "piece", "turn", "role", "head", "digest")
    return _stream(together.drop("head"), EDITED, _apply)


_LEGAL = {"su", "ua", "au"}
DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _digest(rows: Iterator[dict]) -> Iterator[tuple]:
    conv, begun = None, False

    def result() -> tuple:
        gaps = high - low + 1 - turns if turns else 0
        return conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), sha.hexdigest()

    for given in rows:
        if not begun or given["conv_id"] != conv:
            if begun:
                yield result()
            conv, begun = given["conv_id"], True
            counts = {"blank": 0, "duplicate": 0, "truncated": 0}
            illegal, cost, audit, sha, lines, before = 0, 0, [], hashlib.sha256(), 0, None
            turns, low, high = 0, None, None
        edit = given["edit"]
        if edit is None:
            continue
        audit.append(edit)
        cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if given["fault"]:
            counts[given["fault"]] += 1
            cost += TRUNCATED if given["fault"] == "truncated" and edit != "D" else 0
        if edit != "I":
            initial = given["role_before"][:1]
            illegal += before is not None and before + initial not in _LEGAL
            before = initial
            if given["turn"] is not None and given["turn"] != high:  # rows come by turn
                turns, high = turns + 1, given["turn"]
                low = high if low is None else low
        if edit != "D":
            sha.update(("\n" if lines else "").encode() + f"{given['role']}:{given['text']}".encode())
            lines += 1
    if begun:
        yield result()


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost, the letters of the edits and the hash of what is left."""
    return _stream(edits, DIGEST, _digest)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC-32 of ``conv_id:turn``: 0 drops a row, 1 empties it, 2 takes its stops, 3 repeats it, 4 makes it the user's."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what: Column = F.crc32(F.concat_ws(":", read("conv_id"), read("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), what.alias("what")).filter("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("what") == 3, 2).otherwise(1)
    damaged = marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return damaged.drop("copy")

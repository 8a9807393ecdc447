"""Exact top-k search by inner product: a Voronoi join of queries and data.

An inner product is turned into a distance: with M the largest norm, data rows
get the further coordinate sqrt(M^2 - |x|^2) and queries 0, so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x and the nearest row is the one with the
highest product.  Then

1. a bounded number of data rows become pivots; data and queries belong to the
   cell of their nearest pivot;
2. summaries: of each data cell the k + 1 smallest distances to its pivot, which
   bound every query's k-th neighbour from above; of each query cell the largest
   such bound and, for every pivot, the least and largest distance of its queries;
3. cells of queries, packed to blocks of at most ``BLOCK`` queries, form groups.
   A data row is sent to a group only if the triangle inequality over all pivots
   leaves it a chance in one of the group's cells;
4. each (group, part of its data) is solved by itself, exactly, as a stream over
   its rows; the best of all parts are merged.

The bounds carry a margin for rounding, and equal scores are never pruned.  The
driver holds the pivots and the summaries: their size follows from ``PIVOTS``.
Parts are dealt by a hash of the row, so that a crowded cell or group is many
tasks; of equal vectors in a batch only the k + 1 smallest ids can count, the
others are not sent.  Vectors travel as the narrowest integers that hold them.

Defined results: vectors that are NULL or hold a NULL or non-finite component
(also after scaling) take no part.  Vectors of different length are compared
over the places both have.  A NULL id is no query; as a candidate it comes after
the others of equal score.  Rows that repeat are rows of their own: a query does
not find itself but finds its copies, and each copy has its own result.  Scores
beyond the range of a long are its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIVOTS = 64
BLOCK = 32_768  # queries of a group
PART_ROWS = 8_192  # data rows of a part, at least
MAX_PARTS = 4_096  # parts of a group, at most: bounds what the merge of one query reads
CHUNK = 1_024  # data rows multiplied at once
EXACT = float(1 << 53)  # sums of whole numbers below it are exact in doubles
LONG = (1 << 63) - 1
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as doubles holding whole numbers; NULL where one is NULL or not finite."""

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # larger ones are whole already

    components = F.transform(vector, whole)
    fit = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fit, F.lit(False)), components)


@dataclass(frozen=True)
class Space:
    """The pivots with their further coordinate, and what is known of all vectors."""

    width: int  # longest vector
    reach: float  # M^2, the largest squared norm
    kind: str  # numpy type that holds every component
    pivots: np.ndarray

    @property
    def margin(self) -> float:
        return 1e-5 * (1.0 + np.sqrt(self.reach))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        own = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.reach - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, own[:, None]])

    @property
    def bounded(self) -> bool:
        """Whether squares can be reckoned with; beyond it one cell holds everything and nothing is pruned."""
        return self.reach < 1e300

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distance of every row to every pivot."""
        if not self.bounded:
            return np.zeros((len(x), len(self.pivots)))
        lifted = self.lift(x, query)
        square = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to one length."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    if len(column) and np.all(np.diff(offsets) == width):
        return flat[offsets[0] : offsets[-1]].reshape(len(column), width).astype(np.float64)
    out = np.zeros((len(column), width))
    for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : hi - lo] = flat[lo:hi]
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _space(data: DataFrame, pivots: int) -> tuple[Space | None, int]:
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    widest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    row = data.agg(F.max(F.size("v")).alias("width"), F.max(squares).alias("reach"), F.max(widest).alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return None, 0
    kind = "<i2" if row["top"] < 2**15 else "<i4" if row["top"] < 2**31 else "<f8"
    # Bounded: ``pivots`` rows, the first by a hash, so the same at every run.
    chosen = data.select("v").orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(pivots).toArrow()
    points = _matrix(chosen.column("v").combine_chunks(), row["width"])
    space = Space(row["width"], row["reach"], kind, points[:1])
    if space.bounded:
        space = Space(row["width"], row["reach"], kind, np.unique(space.lift(points, False), axis=0))
    return space, row["n"]


def _nearest_of_cells(data: DataFrame, space: Space, k: int) -> np.ndarray:
    """The smallest distances between the pivots and the data of their cells: (cell, distance) rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        for batch in batches:
            far = space.distances(_matrix(_column(batch, "v"), space.width), False)
            cell = far.argmin(axis=1)
            own = far[np.arange(len(cell)), cell]
            for c in np.unique(cell).tolist():
                near[c] = np.sort(np.concatenate([near.get(c, np.empty(0)), own[cell == c]]))[: k + 1]
        yield pa.record_batch([pa.array(list(near), pa.int64()), pa.array([d.tolist() for d in near.values()], pa.list_(pa.float64()))], ["cell", "near"])

    per_task = data.select("v").mapInArrow(summarise, "cell bigint, near array<double>")
    merged = per_task.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    table = merged.toArrow()  # bounded: k + 1 numbers for each pivot
    pairs = [(c, d) for c, ds in zip(table.column("cell").to_pylist(), table.column("near").to_pylist()) for d in ds]
    return np.array(pairs, np.float64).reshape(-1, 2)


@dataclass(frozen=True)
class Cells:
    """Query cells: how many queries, how far the k-th neighbour can be, and the span of distances to every pivot."""

    counts: np.ndarray
    bound: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _query_cells(queries: DataFrame, space: Space, near: np.ndarray, k: int) -> Cells:
    at = near[:, 0].astype(np.int64)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(space.pivots)
        counts, bound = np.zeros(m, np.int64), np.full(m, -np.inf)
        least, most = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for batch in batches:
            far = space.distances(_matrix(_column(batch, "v"), space.width), True)
            # Some k + 1 rows, the query itself perhaps among them, are no farther than this.
            upper = np.partition(far[:, at] + near[:, 1], k, axis=1)[:, k] if len(at) > k else np.full(len(far), np.inf)
            cell = far.argmin(axis=1)
            counts += np.bincount(cell, minlength=m)
            np.maximum.at(bound, cell, upper)
            np.minimum.at(least, cell, far)
            np.maximum.at(most, cell, far)
        hit = np.flatnonzero(counts)
        lists = [pa.array([x.tolist() for x in side[hit]], pa.list_(pa.float64())) for side in (least, most)]
        yield pa.record_batch([pa.array(hit), pa.array(counts[hit]), pa.array(bound[hit]), *lists], ["cell", "n", "bound", "least", "most"])

    per_task = queries.select("v").mapInArrow(summarise, "cell bigint, n bigint, bound double, least array<double>, most array<double>")
    m = len(space.pivots)
    spans = [F.array(*[f(F.col(side)[j]) for j in range(m)]).alias(side) for side, f in (("least", F.min), ("most", F.max))]
    table = per_task.groupBy("cell").agg(F.sum("n").alias("n"), F.max("bound").alias("bound"), *spans).toArrow()  # bounded: 2 m + 2 numbers for each pivot
    counts, bound = np.zeros(m, np.int64), np.full(m, -np.inf)
    least, most = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    cell = table.column("cell").to_numpy()
    if len(cell):
        counts[cell], bound[cell] = table.column("n").to_numpy(), table.column("bound").to_numpy()
        least[cell], most[cell] = np.array(table.column("least").to_pylist()), np.array(table.column("most").to_pylist())
    return Cells(counts, bound, least, most)


@dataclass(frozen=True)
class Groups:
    """Groups of queries: cell c has the groups first[c] to first[c] + parts[c] - 1."""

    first: np.ndarray
    parts: np.ndarray
    size: np.ndarray  # queries of each group, about


def _pack(cells: Cells, space: Space, block: int) -> Groups:
    """Neighbouring cells together while they fit a block; a cell beyond a block is split."""
    m = len(cells.counts)
    first, parts, size = np.zeros(m, np.int64), np.ones(m, np.int64), []
    left, here = set(range(m)), 0
    while left:
        c = min(left, key=lambda j: (float(((space.pivots[j] - space.pivots[here]) ** 2).sum()), j))
        left.discard(c)
        here, n = c, int(cells.counts[c])
        if n > block:
            parts[c] = -(-n // block)
            first[c] = len(size)
            size += [-(-n // int(parts[c]))] * int(parts[c])
        elif size and size[-1] + n <= block:
            first[c] = len(size) - 1
            size[-1] += n
        else:
            first[c] = len(size)
            size.append(n)
    return Groups(first, parts, np.array(size, np.int64))


def _spread(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can count: of equal vectors the k + 1 with the smallest ids."""
    same = np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel() if v.shape[1] else np.zeros(len(v), np.int64)
    _, which = np.unique(same, return_inverse=True)
    order = np.lexsort((ids, which))
    first = np.searchsorted(which[order], which[order])
    return np.sort(order[np.arange(len(order)) - first <= k])


def _send_data(data: DataFrame, space: Space, cells: Cells, groups: Groups, parts: np.ndarray, k: int) -> DataFrame:
    """(grp, part, kind = 1, vec_id, v): each data row once for every group that may need it."""
    used = np.flatnonzero(cells.counts)
    low, high = cells.least[used] - cells.bound[used, None], cells.most[used] + cells.bound[used, None]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(_column(batch, "v"), space.width)
            ids = _column(batch, "vec_id")
            rows = _spread(x, ids.fill_null(LONG).to_numpy(), k)
            x, ids = x[rows], ids.take(pa.array(rows))
            salt = _column(batch, "salt").to_numpy()[rows]
            far = space.distances(x, False)
            packed = x.astype(space.kind)
            wanted = np.zeros((len(x), len(groups.size)), bool)
            for i, c in enumerate(used.tolist()):
                chance = np.all((far >= low[i] - space.margin) & (far <= high[i] + space.margin), axis=1)
                wanted[:, groups.first[c] : groups.first[c] + groups.parts[c]] |= chance[:, None]
            for g in range(len(groups.size)):
                at = np.flatnonzero(wanted[:, g])
                if len(at):
                    part = pa.array((salt[at] % parts[g]).astype(np.int64))
                    vectors = pa.array([row.tobytes() for row in packed[at]], pa.binary())
                    none = pa.array(np.zeros(len(at), np.int64))
                    yield pa.record_batch([pa.array(np.full(len(at), g, np.int64)), part, pa.array(np.ones(len(at), np.int32)), ids.take(pa.array(at)), none, vectors], list(_SENT))

    salted = data.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)).alias("salt"))
    return salted.mapInArrow(send, _SENT_DDL)


_SENT = ("grp", "part", "kind", "vec_id", "qh", "v")
_SENT_DDL = "grp bigint, part bigint, kind int, vec_id bigint, qh bigint, v binary"


def _send_queries(queries: DataFrame, space: Space, groups: Groups, parts: np.ndarray) -> DataFrame:
    """(grp, part, kind = 0, vec_id, qh, v): each query once for every part of its group."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(_column(batch, "v"), space.width)
            cell = space.distances(x, True).argmin(axis=1)
            qh = _column(batch, "qh")
            group = groups.first[cell] + qh.to_numpy() % groups.parts[cell]
            vectors = pa.array([row.tobytes() for row in x.astype(space.kind)], pa.binary())
            yield pa.record_batch([pa.array(group), pa.array(parts[group]), _column(batch, "vec_id"), qh, vectors], ["grp", "parts", "vec_id", "qh", "v"])

    placed = queries.select("vec_id", "qh", "v").mapInArrow(send, "grp bigint, parts bigint, vec_id bigint, qh bigint, v binary")
    return placed.select("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "vec_id", "qh", "v")


def _products(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; rows too large for doubles in Python's integers."""
    with np.errstate(over="ignore"):
        reach = np.sqrt((x * x).sum(axis=1)) * (np.sqrt((queries * queries).sum(axis=1).max()) if len(queries) else 0.0)
    safe = reach < EXACT / 2
    out = np.empty((len(x), len(queries)), np.int64)
    out[safe] = x[safe] @ queries.T
    if not safe.all():
        exact = [[int(c) for c in q] for q in queries]
        for i in np.flatnonzero(~safe).tolist():
            row = [int(c) for c in x[i]]
            out[i] = [max(-LONG, min(LONG, sum(a * b for a, b in zip(row, q)))) for q in exact]
    return out


class _Best:
    """The ``keep`` best rows of every query of one group, while data rows stream by."""

    def __init__(self, queries: np.ndarray, keep: int):
        self.queries, self.keep = queries, keep
        n = len(queries)
        self.query, self.score = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.without = np.empty(0, np.int64), np.empty(0, bool)
        self.least = np.full(n, -LONG - 1, np.int64)  # a row below it can't be among the best
        self.step = 32

    def add(self, x: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        row = 0
        while row < len(x):
            part = slice(row, row + self.step)
            found = _products(x[part], self.queries)
            at, query = np.nonzero(found >= self.least[None, :])
            self._merge(query, found[at, query], ids[part][at], without[part][at])
            row += self.step
            self.step = min(CHUNK, self.step * 2)  # short at first, while every row is among the best

    def _merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, without = np.concatenate([self.ids, ids]), np.concatenate([self.without, without])
        order = np.lexsort((ids, without, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < self.keep]
        self.query, self.score, self.ids, self.without = query[order], score[order], ids[order], without[order]
        last = np.flatnonzero(np.bincount(self.query, minlength=len(self.queries)) == self.keep)
        self.least[last] = self.score[np.searchsorted(self.query, last, "right") - 1]


def _solve(sent: DataFrame, space: Space, k: int) -> DataFrame:
    """(query_id, qh, own, score, vec_id): the k + 1 best of every part, as a stream over its sorted rows."""
    names = ["query_id", "qh", "own", "score", "vec_id"]

    def vectors(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), space.kind).reshape(len(column), space.width).astype(np.float64)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, best = None, [], None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.query):
                ids = np.concatenate([a[0] for a in asked])
                hashes = np.concatenate([a[1] for a in asked])
                own = np.concatenate([_own(a[2]) for a in asked])
                q = best.query
                yield pa.record_batch([pa.array(ids[q]), pa.array(hashes[q]), pa.array(own[q]), pa.array(best.score), pa.array(best.ids, mask=best.without)], names)

        for batch in batches:
            grp, part, kind = (_column(batch, c).to_numpy() for c in ("grp", "part", "kind"))
            borders = np.flatnonzero((np.diff(grp) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *borders.tolist()], [*borders.tolist(), len(grp)]):
                if lo == hi:
                    continue
                if (grp[lo], part[lo]) != here:
                    yield from result()
                    here, asked, best = (grp[lo], part[lo]), [], None
                rows = batch.slice(lo, hi - lo)
                ids, x = _column(rows, "vec_id"), vectors(_column(rows, "v"))
                if kind[lo] == 0:
                    asked.append((ids.to_numpy(), _column(rows, "qh").to_numpy(), x))
                elif asked:  # a part without queries has nothing to find
                    if best is None:
                        best = _Best(np.vstack([a[2] for a in asked]), k + 1)
                    best.add(x, ids.fill_null(LONG).to_numpy(), np.asarray(ids.is_null()))
        yield from result()

    dealt = sent.repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    return dealt.mapInArrow(solve, "query_id bigint, qh bigint, own bigint, score bigint, vec_id bigint")


def _own(x: np.ndarray) -> np.ndarray:
    """The product of every query with itself."""
    return np.concatenate([_products(x[i : i + 1], x[i : i + 1])[0] for i in range(len(x))]) if len(x) else np.empty(0, np.int64)


def top_k(vectors: DataFrame, asked: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asked`` holds for, its k best other rows.

    The k-th score decides; equal scores go to the smaller id.  A query with fewer
    other rows has all of them, one alone has none.
    """
    spark: SparkSession = vectors.sparkSession
    data = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), whole_components(F.col(vector)).alias("v"), asked.alias("asked")).filter("v is not null")
    queries = data.filter("asked and vec_id is not null").groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    queries = queries.withColumn("qh", F.pmod(F.xxhash64("v"), F.lit(1 << 62)))
    space, rows = _space(data, pivots)
    if space is None:
        return spark.createDataFrame([], RESULT)
    cells = _query_cells(queries, space, _nearest_of_cells(data, space, k), k)
    groups = _pack(cells, space, block)
    parts = np.minimum(MAX_PARTS, -(-rows // np.maximum(part_rows, 2 * groups.size)))
    sent = _send_data(data, space, cells, groups, parts, k).unionByName(_send_queries(queries, space, groups, parts))
    found = _solve(sent, space, k)
    # Of every part at most k + 1: the list of a query is bounded by the number of parts.
    entry = F.struct((-F.col("score")).alias("down"), F.col("vec_id").isNull().alias("without"), F.col("vec_id").alias("vec_id"))
    best = found.groupBy("query_id", "qh").agg(F.first("own").alias("own"), F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("best"))
    itself = F.struct((-F.col("own")).alias("down"), F.lit(False).alias("without"), F.col("query_id").alias("vec_id"))
    at = F.array_position("best", itself).cast("int")
    others = F.when(at > 0, F.concat(F.slice("best", F.lit(1), at - 1), F.slice("best", at + 1, F.lit(k + 1)))).otherwise(F.col("best"))
    others = best.select("query_id", "qh", F.slice(others, 1, k).alias("best"))
    copies = queries.select(F.col("vec_id").alias("query_id"), "qh", "copies")
    each = others.join(copies, ["query_id", "qh"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return each.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score")
    )

"""Nearest neighbours by largest inner product: stable projections in a kd-tree, verified until a chi-square test stops the search.

Inner products become distances by one more coordinate: x' = (x, sqrt(M^2 - |x|^2)), q' = (q, 0), M being the largest norm. Vectors
are projected on a few Gaussian (2-stable) directions; a squared projected distance is then the squared distance times a
chi-square variable. A query takes candidates in order of projected distance, verifies each on the original vectors, and stops
at the projected distance r beyond which a better neighbour than its k-th, at distance d, would lie with a probability of at most
1 - `certainty`: r^2 / d^2 at that quantile of chi-square. So every true neighbour is found with at least that probability.

On the cluster, the tree's upper levels are split planes from a sample of bounded size; its leaves are cells, cut into units of
bounded size. First each query searches its own cell, which gives it a k-th distance; then it goes to those other cells that lie
within the stopping radius of it. Within a unit, a small tree gives the leaves in order of projected distance. All vectors are
indexed; equal vectors, however many, are cut into units by a hash of their ids.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part. Null ids take no part as queries; as candidates they come last among equals. Repeated rows are candidates each. Fewer
candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradloom.llm.ranges import first_by_hash
from gradloom.llm.words import with_row_id
from gradloom.session import cut_lineage, stored

#: Projected dimensions; vectors in a unit; queries searched together in a unit; sampled vectors for the upper levels.
DIMENSIONS, UNIT, QUERIES, SAMPLE = 8, 8192, 2048, 20_000
CERTAINTY, CELLS = 0.97, 4096
LEAF = 128


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number m of degrees of freedom: the distribution is 1 - exp(-x/2) sum over i < m/2 of (x/2)^i / i!."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < p else (low, x)
    return (low + high) / 2


def directions(width: int, m: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((width + 1, m))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


class Planes:
    """The upper levels: planes by median over a sample, and each cell's box. Points on a plane go left."""

    def __init__(self, sample: np.ndarray, cells: int):
        m = sample.shape[1]
        self.planes: list[tuple[int, float, int, int]] = []  # axis, value, left, right; negative children are cells
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.root = self._split(sample, np.full(m, -np.inf), np.full(m, np.inf), cells)

    def _split(self, points, low, high, cells) -> int:
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(len(low))
        axis = int(spread.argmax())
        if cells < 2 or len(points) < 8 or spread[axis] == 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        value = float(np.median(points[:, axis]))
        left = points[:, axis] <= value
        if left.all():
            value = float(points[points[:, axis] < value, axis].max())
            left = points[:, axis] <= value
        here = len(self.planes)
        self.planes.append((axis, value, 0, 0))
        top, bottom = high.copy(), low.copy()
        top[axis] = bottom[axis] = value
        self.planes[here] = (axis, value, self._split(points[left], low, top, cells // 2), self._split(points[~left], bottom, high, cells - cells // 2))
        return here

    def cell(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                found[at] = -node - 1
            elif len(at):
                axis, value, left, right = self.planes[node]
                side = points[at, axis] <= value
                todo += [(left, at[side]), (right, at[~side])]
        return found

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        low, high = np.array(self.low), np.array(self.high)
        total = np.zeros((len(points), len(low)))
        for axis in range(points.shape[1]):
            x = points[:, axis, None]
            total += np.square(np.maximum(np.maximum(low[:, axis] - x, x - high[:, axis]), 0))
        return total


class Unit:
    """A small tree over a unit's vectors: leaves of equal size with their boxes."""

    def __init__(self, ids: np.ndarray, names: pa.Array, vectors: np.ndarray, projected: np.ndarray):
        order, todo, self.ends = np.arange(len(ids)), [(0, len(ids))], []
        while todo:
            begin, end = todo.pop()
            if end - begin <= LEAF:
                self.ends.append((begin, end))
                continue
            own = order[begin:end]
            axis = int(np.ptp(projected[own], axis=0).argmax())
            half = (end - begin) // 2
            order[begin:end] = own[np.argpartition(projected[own, axis], half)]
            todo += [(begin, begin + half), (begin + half, end)]
        self.ids, self.vectors = ids[order], vectors[order]
        # Place of each vector among equal scores: by name, nulls last, then by row.
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((ids, names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
        self.places = place[order]
        points = projected[order]
        self.low = np.array([points[b:e].min(0) for b, e in self.ends])
        self.high = np.array([points[b:e].max(0) for b, e in self.ends])

    def search(self, query: np.ndarray, point: np.ndarray, own: int, k: int, bound: float, far: float, quantile: float):
        """(scores, ids) of the k best. `far` is |q|^2 + M^2: squared distance = far - 2 score. `bound` is a score that k others reach already."""
        gaps = np.square(np.maximum(np.maximum(self.low - point, point - self.high), 0)).sum(1)
        order = np.argsort(gaps, kind="stable")
        scores, best = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 2
        while at < len(order):
            if gaps[order[at]] > quantile * max(far - 2 * bound, 0.0):
                break
            some = np.concatenate([np.arange(*self.ends[i]) for i in order[at:at + step]])
            # Not a matrix product, whose sums depend on a row's place: equal vectors have equal scores.
            found = np.einsum("ij,j->i", self.vectors[some], query)
            keep = (found >= bound) & (self.ids[some] != own)
            scores, best = np.concatenate([scores, found[keep]]), np.concatenate([best, some[keep]])
            if len(scores) > k:
                # Ties go to smaller names, as in the result.
                first = np.lexsort((self.places[best], -scores))[:k]
                scores, best = scores[first], best[first]
            if len(scores) == k:
                bound = max(bound, float(scores.min()))
            at, step = at + step, step * 2
        return scores, self.ids[best]


FOUND = "query long, vector long, score double"


def _searcher(k: int, quantile: float, largest: float):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            vectors, queries = vectors.combine_chunks(), queries.combine_chunks()
            unit = Unit(vectors["row_id"].to_numpy(), vectors["id"].combine_chunks(), matrix(vectors["vector"].combine_chunks()), matrix(vectors["point"].combine_chunks()))
            wanted, points = matrix(queries["wanted"].combine_chunks()), matrix(queries["aim"].combine_chunks())
            for row, query, point, bound in zip(queries["query"].to_pylist(), wanted, points, queries["bound"].to_pylist()):
                far = float(query @ query) + largest
                scores, ids = unit.search(query, point, row, k, bound, far, quantile)
                for column, values in zip(out, ([row] * len(ids), ids.tolist(), scores.tolist())):
                    column += values
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query", "vector", "score"])

    return search


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(row_id, id, vector as doubles) of the vectors that take part."""
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = with_row_id(df.select(F.col(id_column).cast("long").alias("id"), numbers.alias("vector"))).where(F.coalesce(fine, F.lit(False)))
    return rows.where(F.exists("vector", lambda x: x != 0))


def nearest(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, query_every: int = 20, dimensions: int = DIMENSIONS,
            certainty: float = CERTAINTY, unit: int = UNIT) -> DataFrame:
    """query_id, rank, vec_id and score: of each row whose id is divisible by `query_every`, the k other rows of largest inner product."""
    rows = stored(usable(df, id_column, vector), "vectors")
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    width = widths["width"]
    rows = rows.where(F.size("vector") == width)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    measured = rows.agg(F.max(norm).alias("largest"), F.count("*").alias("n")).first()
    largest, n = measured["largest"], measured["n"]
    quantile = chi_square_quantile(certainty, dimensions)
    matrix_ = directions(width, dimensions)

    # The upper levels come from a sample of bounded size; each row is in it by its id's hash, wherever it lies.
    sampled = first_by_hash(rows.withColumn("h", F.xxhash64("row_id")), n, SAMPLE).select("vector", norm.alias("norm"))
    picked = np.array([list(r[0]) + [np.sqrt(max(largest - r[1], 0.0))] for r in sampled.collect()])
    planes = Planes(picked @ matrix_, min(CELLS, max(1, n // (unit // 2))))
    sent = rows.sparkSession.sparkContext.broadcast((planes, matrix_))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, matrix_ = sent.value
        for batch in batches:
            values = matrix(batch.column("vector"))
            last = np.sqrt(np.maximum(largest - np.square(values).sum(1), 0))
            point = np.column_stack([values, last]) @ matrix_
            asked = values @ matrix_[:-1]
            cells = pa.array(planes.cell(point)), pa.array(planes.cell(asked))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                                                                for x in (point, asked)), *cells], names=[*batch.schema.names, "point", "asked", "cell", "home"])

    placed = stored(rows.select("row_id", "id", "vector").mapInArrow(
        place, "row_id long, id long, vector array<double>, point array<double>, asked array<double>, cell int, home int"), "placed-vectors")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most CELLS rows
    parts = {c: -(-s // unit) for c, s in sizes.items()}
    known = F.broadcast(rows.sparkSession.createDataFrame([(int(c), int(p)) for c, p in parts.items()], "cell int, parts int"))
    units = placed.join(known, "cell").select("cell", F.pmod(F.xxhash64("row_id"), "parts").cast("int").alias("part"), "row_id", "id", "vector", "point")
    queries = placed.where(F.col("id") % query_every == 0).select("row_id", "vector", F.col("asked").alias("point"), "home")

    def search(visits: DataFrame) -> DataFrame:
        """visits: (cell, row_id, vector, point, bound). Queries of a cell are dealt to lots of bounded size, each with a copy of the cell's units."""
        lots = visits.groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERIES).cast("int").alias("lots")).collect()  # at most CELLS rows
        lots = F.broadcast(rows.sparkSession.createDataFrame([(int(c), int(n_)) for c, n_ in lots], "cell int, lots int"))
        left = units.join(lots, "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "row_id", "id", "vector", "point")
        right = (visits.join(lots, "cell").join(known, "cell").withColumn("lot", F.pmod(F.xxhash64("row_id", F.lit(1)), "lots").cast("int"))
                 .select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "lot",
                         F.col("row_id").alias("query"), F.col("vector").alias("wanted"), F.col("point").alias("aim"), "bound"))
        keys = ["cell", "part", "lot"]
        right = right.withColumnsRenamed({c: f"{c}_" for c in keys})
        found = left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_" for c in keys])).applyInArrow(_searcher(k, quantile, largest), FOUND)
        return stored(found, "found-vectors")

    none = F.lit(float("-inf"))
    home = queries.where(F.col("home").isin([int(c) for c in parts])) if len(parts) < len(planes.low) else queries
    first = search(home.select(F.col("home").alias("cell"), "row_id", "vector", "point", none.alias("bound")))
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    bounds = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    bounded = queries.join(cut_lineage(bounds), F.col("row_id") == F.col("query"), "left").withColumn("bound", F.coalesce("kth", none))
    there = np.array(sorted(parts), np.int32)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, _ = sent.value
        for batch in batches:
            values, points = matrix(batch.column("vector")), matrix(batch.column("point"))
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            radius = quantile * np.maximum(np.square(values).sum(1) + largest - 2 * bound, 0)
            near = planes.distances(points)[:, there] <= radius[:, None]
            near &= there[None, :] != batch.column("home").to_numpy()[:, None]
            query, cell = np.nonzero(near)
            taken = batch.take(pa.array(query))
            yield pa.RecordBatch.from_arrays([pa.array(there[cell]), *(taken.column(c) for c in ("row_id", "vector", "point", "bound"))],
                                             names=["cell", "row_id", "vector", "point", "bound"])

    visits = bounded.select("row_id", "vector", "point", "home", "bound").mapInArrow(route, "cell int, row_id long, vector array<double>, point array<double>, bound double")
    second = search(stored(visits, "visits"))
    ids = placed.select("row_id", "id")
    named = (first.unionByName(second).join(ids.select(F.col("row_id").alias("vector"), F.col("id").alias("vec_id")), "vector")
             .join(ids.select(F.col("row_id").alias("query"), F.col("id").alias("query_id")), "query"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "vector")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

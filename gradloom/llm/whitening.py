"""Whitening of vectors by an incremental eigendecomposition.

A vector's entries become integers x = floor(1024 c) + 100000. The covariance of the x (divisor n) is decomposed without being formed:

1. Each task keeps (n, sums, eigenvectors, eigenvalues) of the scatter around its own mean. A vector is a centred rank-one update,
   n / (n + 1) (x - mean)(x - mean)^T; the new eigenvalues solve the secular equation, after deflation of entries that are nothing and of
   equal eigenvalues. Vectors arrive in blocks: an orthogonal reduction turns a block's centred vectors into as many as they have entries, with the
   same scatter, and these are the updates; blocks of no more vectors than entries go as they are.
2. Spectra of tasks are combined, a few at a time and level by level: one side's eigenpairs and the difference of the means are
   successive rank-one updates of the other.
3. The leading Ritz pairs are refined in distributed passes over all vectors: V Q by partial sums, Rayleigh-Ritz in its span, until
   the residual is that of rounding.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another length
than most have (of equally frequent lengths the longer), nor entries beyond 2^43, whose integers doubles cannot hold. Repeated
rows count each, null ids stay null. A component of no variance (eigenvalue below 1e-12 of the trace) cannot be whitened and is
left out, so that equal vectors alone give no rows. A deviation beyond 64 bits is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gradloom.session import stored

SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0 ** 43
#: Components, further Ritz vectors beside them, bytes of a block of vectors, spectra combined at a time, passes at most.
COMPONENTS, OVERSAMPLE, BLOCK_BYTES, FAN, PASSES = 8, 16, 16 << 20, 16, 30
EPS = np.finfo(float).eps


def secular(values: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(values) + z z^T: values ascending and distinct, no entry of z nothing.

    Each root lies between two poles (the last one below the sum); it is bisected as its distance to the nearer pole, so that no
    digits are lost, and the vectors come from a z that these roots fit exactly (Gu and Eisenstat), so that they are orthogonal.
    """
    n, square = len(values), z * z
    upper = np.append(values[1:], values[-1] + square.sum())
    middle = values + (upper - values) / 2
    f = 1 + (square / (values - middle[:, None])).sum(1)
    near_left = (f >= 0) | (np.arange(n) == n - 1)
    origin = np.where(near_left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    from_origin = values - values[origin][:, None]  # (root, pole)
    half = (upper - values) / 2
    low = np.where(near_left, 0.0, -half)
    high = np.where(near_left, np.where(np.arange(n) == n - 1, upper - values, half), 0.0)
    for _ in range(80):
        at = (low + high) / 2
        with np.errstate(divide="ignore"):
            rising = 1 + (square / (from_origin - at[:, None])).sum(1) > 0
        low, high = np.where(rising, low, at), np.where(rising, at, high)
    at = (low + high) / 2
    gap = from_origin - at[:, None]  # pole - root, exact to rounding
    gap[gap == 0] = np.finfo(float).tiny
    others = values - values[:, None] + np.eye(n)  # (i, j): pole j - pole i
    # |z_i|^2 = prod over roots k of (root k - pole i) / prod over other poles of (pole j - pole i)
    ratio = -gap.T / np.where(np.eye(n, dtype=bool), 1.0, others)
    fitted = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z)
    vectors = fitted[:, None] / gap.T
    return values[origin] + at, vectors / np.linalg.norm(vectors, axis=0)


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (ascending) of U diag(values) U^T + update update^T."""
    z = vectors.T @ update
    size = max(np.abs(values).max(initial=0.0), float(z @ z))
    if size == 0:
        return values, vectors
    tolerance = 8 * EPS * size
    values, vectors = values.copy(), vectors.copy()
    z = np.where(np.abs(z) * np.sqrt(float(z @ z)) <= tolerance, 0.0, z)
    # Of equal eigenvalues, a rotation leaves one with all of z.
    live = np.flatnonzero(z)
    for i, j in zip(live[:-1], live[1:]):
        if values[j] - values[i] <= tolerance:
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            vectors[:, [i, j]] = np.stack([c * vectors[:, i] - s * vectors[:, j], s * vectors[:, i] + c * vectors[:, j]], axis=1)
            z[i], z[j] = 0.0, r
    live = np.flatnonzero(z)
    if len(live):
        values[live], turned = secular(values[live], z[live])
        vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """(n, sums, eigenpairs) of the scatter of vectors around their mean. Sums are whole numbers, exact below 2^53 a block and as Python integers."""

    def __init__(self, width: int):
        self.n, self.sums = 0, [0] * width
        self.values, self.vectors = np.zeros(width), np.eye(width)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def _update(self, vector: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, vector)

    def add(self, rows: np.ndarray) -> None:
        """Take in a block of integer vectors."""
        n, own = len(rows), [int(s) for s in rows.sum(axis=0)]
        mean = np.array([s / n for s in own])
        centred = rows - mean
        if n > len(mean):
            centred = np.linalg.qr(centred, mode="r")
        for vector in centred:
            self._update(vector)
        self._join(n, own, mean)

    def _join(self, n: int, sums: list[int], mean: np.ndarray) -> None:
        if self.n and n:
            self._update(np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean))
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums)]

    def combine(self, other: "Spectrum") -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(np.sqrt(value) * vector)
        if other.n:
            self._join(other.n, other.sums, other.mean)

    FIELDS = "slot long, n long, sums array<string>, eigenvalues array<double>, eigenvectors array<double>"

    def row(self, slot: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([self.n], pa.int64()), pa.array([[str(s) for s in self.sums]]),
                                           pa.array([self.values]), pa.array([self.vectors.ravel()])], names=["slot", "n", "sums", "eigenvalues", "eigenvectors"])

    @classmethod
    def of(cls, row: dict) -> "Spectrum":
        made = cls(len(row["sums"]))
        made.n, made.sums = row["n"], [int(s) for s in row["sums"]]
        made.values, made.vectors = np.array(row["eigenvalues"]), np.array(row["eigenvectors"]).reshape(len(made.sums), -1)
        return made


def integers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors as whole numbers, (rows, width)."""
    column = batch.column("vector")
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE).astype(np.int64).reshape(-1, width) + SHIFT


def usable(vectors: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and their length."""
    entry = F.col("vector")
    finite = F.forall(entry, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(entry.isNotNull() & (F.size(entry) > 0) & finite)
    # One row leaves the aggregate for each length there is.
    lengths = rows.groupBy(F.size(entry).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    return rows.where(F.size(entry) == width), width


def block_rows(width: int) -> int:
    return max(1, BLOCK_BYTES // (8 * width))


def spectrum_of(rows: DataFrame, width: int, block: int | None = None) -> Spectrum | None:
    """The spectrum of all vectors: by task, then combined FAN at a time, level by level."""
    block = block or block_rows(width)

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, size = Spectrum(width), [], 0
        for batch in batches:
            x = integers(batch, width)
            at = 0
            while at < len(x):
                held.append(x[at:at + block - size])
                at, size = at + len(held[-1]), size + len(held[-1])
                if size == block:
                    found.add(np.concatenate(held))
                    held, size = [], 0
        if held:
            found.add(np.concatenate(held))
        if found.n:
            yield found.row(TaskContext.get().partitionId())

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, group = Spectrum(width), None
        for batch in batches:
            for row in batch.to_pylist():
                if group is not None and row["slot"] // FAN != group:
                    yield found.row(group)
                    found = Spectrum(width)
                group = row["slot"] // FAN
                found.combine(Spectrum.of(row))
        if group is not None:
            yield found.row(group)

    level = stored(rows.select("vector").mapInArrow(decompose, Spectrum.FIELDS), "spectra")
    most = level.agg(F.max("slot")).first()[0]
    if most is None:
        return None
    while most > 0:
        groups = most // FAN + 1
        spread = level.repartitionById(groups, F.floor(F.col("slot") / FAN).cast("int")).sortWithinPartitions("slot")
        level = stored(spread.mapInArrow(combine, Spectrum.FIELDS), "spectra")
        most = groups - 1
    return Spectrum.of(level.first().asDict())


def summed(rows: DataFrame, width: int, part, size: int) -> np.ndarray:
    """The sum over all vectors of `part(whole-number block)`, an array of `size` doubles: one partial sum a task, then one by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = integers(batch, width)
            for at in range(0, len(x), 4096):
                total += part(x[at:at + 4096])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["place", "value"])

    sums = rows.select("vector").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in doubles: the whole part of the mean is taken off exactly, the rest is below 1."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([s % n / n for s in sums])


@dataclass(frozen=True)
class Whitening:
    """What a table's vectors are whitened with. `vectors` are unit columns, `values` their eigenvalues, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact."""
        low, high = x.min(axis=0), x.max(axis=0)
        most = max(max(abs(self.n * int(a) - s), abs(self.n * int(b) - s)) for a, b, s in zip(low, high, self.sums))
        if most * most * x.shape[1] < 1 << 63 and self.n * int(np.abs(x).max()) < 1 << 63 and max(map(abs, self.sums)) < 1 << 63:
            apart = self.n * x - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def fit(rows: DataFrame, width: int, components: int = COMPONENTS, block: int | None = None) -> Whitening | None:
    """Incremental decomposition, then Rayleigh-Ritz passes until the residual is that of rounding."""
    found = spectrum_of(rows, width, block)
    if found is None:
        return None
    n, sums = found.n, found.sums
    p = min(width, components + OVERSAMPLE)
    basis = found.vectors[:, ::-1][:, :p]
    kept = None
    for _ in range(PASSES):
        basis = np.linalg.qr(basis)[0]

        def part(x: np.ndarray, basis=basis) -> np.ndarray:
            y = centred(x, n, sums)
            return np.append((y.T @ (y @ basis)).ravel(), (y * y).sum())

        total = summed(rows, width, part, width * p + 1) / n
        image, trace = total[:-1].reshape(width, p), total[-1]
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residual = float(np.linalg.norm(image @ turn - basis @ turn * values, axis=0)[:components].max())
        if kept is None or residual < kept[0]:
            kept = residual, values, basis @ turn, trace
        # The span of all entries is exact at once; else each pass shrinks what lies outside.
        if p == width or residual <= 4 * width * EPS * values[0] or residual > kept[0]:
            break
        basis = image @ turn
    _, values, vectors, trace = kept
    good = np.flatnonzero(values[:components] > 1e-12 * trace)
    return Whitening(n, sums, values[good], np.linalg.qr(vectors[:, :components])[0][:, good] if len(good) else vectors[:, good], trace)


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        z = model.apply(x)
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    total = summed(rows, width, part, k * k + k) / model.n
    mean = total[k * k:]
    return float(np.abs(total[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int | None = None) -> DataFrame:
    """A row for each vector and component (see RESULT); components are numbered from 1 by falling eigenvalue."""
    rows, width = usable(vectors, id_column, vector)
    model = fit(rows, width, components, block) if width else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    error = identity_error(rows, width, model) if len(model.values) else 0.0
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                m, x = some.num_rows, integers(some, width)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array([model.n] * (m * k), pa.int64()),
                     pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.apply(x).ravel()), pa.array(np.tile(model.values / model.trace, m)),
                     pa.array([error] * (m * k))], names=[f.split()[0] for f in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)

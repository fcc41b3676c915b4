"""Forward passes over a table: named blobs per row, keys kept."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from gradloom.operators.samples import bind_batch
from gradloom.operators.weights import MOMENTUM
from gradloom.operators.workers import worker_counts
from gradloom.plans.batches import Blobs, check_shapes, check_weights, feed, list_column, unpack
from gradloom.plans.kernels import forward_pass
from gradloom.plans.net import Net
from gradloom.session import shared_path, stored
from gradloom.sources.files import open_path


def shared_weights(net: Net, weights: DataFrame) -> Callable[[], Blobs]:
    """A function that gives tasks the net's weights.

    They never pass through the driver, whatever their size: they are written to the shared folder, where each Python
    worker reads them once.
    """
    weights = weights.filter(~F.col("layer").endswith(MOMENTUM))
    kept = stored(weights, "weights")
    shapes = kept.select("layer", "blob", "shape").distinct().collect()  # one row per blob
    check_shapes(net, {(r["layer"], r["blob"]): tuple(r["shape"]) for r in shapes})
    files = tuple(kept.inputFiles())

    def load() -> Blobs:
        blobs = load_published(files, net.dtype)
        check_weights(net, blobs)
        return blobs

    return load


def publish(weights: DataFrame) -> tuple[str, ...]:
    """Write weights to the shared folder; the files."""
    return tuple(stored(weights, "weights").inputFiles())


def published_by(weights: DataFrame, column: str) -> dict[int, tuple[str, ...]]:
    """Write weights apart by an integer column, such as the worker; each value's files."""
    path = shared_path(weights.sparkSession, "weights-by")
    weights.repartition(column).write.partitionBy(column).parquet(path)
    files: dict[int, list[str]] = {}
    for file in weights.sparkSession.read.parquet(path).inputFiles():
        files.setdefault(int(re.search(rf"/{column}=(\d+)/", file)[1]), []).append(file)
    return {value: tuple(names) for value, names in files.items()}


@functools.lru_cache(maxsize=2)
def load_published(files: tuple[str, ...], dtype: str) -> Blobs:
    """Weights from written files, read once per Python worker and net."""
    return unpack(pa.concat_tables(pq.read_table(open_path(f)) for f in files), dtype)


def score_batch(net: Net, weights: Blobs, columns: dict[str, pa.Array], rows: int, blobs: Sequence[str],
                element: pa.DataType, batch: int) -> list[pa.Array]:
    """Requested blobs of `rows` rows, `batch` rows at a time; the last batch is as long as what is left."""
    parts: list[list[pa.Array]] = [[] for _ in blobs]
    for low in range(0, rows, batch):
        out, _ = forward_pass(net, weights, feed(net, columns, slice(low, min(low + batch, rows))))
        for part, blob in zip(parts, blobs):
            part.append(list_column(out[blob], element))
    return [pa.concat_arrays(part) for part in parts]


def forward(df: DataFrame, net: Net, weights: DataFrame, blobs: Sequence[str] | None = None,
            keep: Sequence[str] = ("sample_id",), batch: int = 256, element: str = "float", round_no: int = 0) -> DataFrame:
    """`keep` columns plus one array column per blob, scored where the rows lie: no shuffle.

    Only the layers that the blobs depend on are run, and only their input columns are read. Preparations that draw, such as random
    crops, draw for `round_no`.
    """
    if blobs is None:
        blobs = [b for b in net.outputs() if net.label in df.columns or b not in net.label_blobs()]
    schema = net.output_schema(blobs, element)
    part = net.subnet(blobs)
    bound = bind_batch(df, part, keep, round_no)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in bound.schema if f.name in keep)
    value = pa.float32() if element == "float" else pa.float64()
    shared = shared_weights(net, weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                columns = {c: rows.column(c) for c in part.batch_columns()}
                out = score_batch(part, shared(), columns, rows.num_rows, blobs, value, batch)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *out], [*keep, *blobs])

    return bound.mapInArrow(score, kept + ", ".join(f"`{f.name}` array<{element}>" for f in schema))


def prepared_input(df: DataFrame, net: Net, name: str, keep: Sequence[str] = ("sample_id",), round_no: int = 0, batch: int = 256) -> DataFrame:
    """`keep` columns and one input as the net's first layer gets it in this round: converted, cropped, centred."""
    part = replace(net, inputs=tuple(i for i in net.inputs if i.name == name), layers=())
    bound = bind_batch(df, part, keep, round_no)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in bound.schema if f.name in keep)
    out = name if name not in keep else f"{name}_prepared"

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low in range(0, rows.num_rows, batch):
                some = rows.slice(low, batch)
                values = feed(part, {c: some.column(c) for c in part.batch_columns()})[name]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), list_column(values, pa.float64())], [*keep, out])

    return bound.mapInArrow(prepare, kept + f"`{out}` array<double>")


def featurize(df: DataFrame, net: Net, weights: DataFrame, blob: str, keep: Sequence[str] = ("sample_id",),
              **options) -> DataFrame:
    """One layer's activations per row, with the row's key."""
    return forward(df, net, weights, [blob], keep, **options)


def evaluate(df: DataFrame, net: Net, weights: DataFrame, test_batch: int | None = None, drop_remainder: bool = True, **options) -> DataFrame:
    """One row (accuracy, loss, n) over all rows, or the means over each worker's minibatches of `test_batch` rows.

    Minibatches need an assigned table (`worker_rows` and `pos`). With `drop_remainder` only full ones count, and the rows after a worker's
    last full one are not scored; without it the last one counts as one, however short. No batch is grouped: a row weighs one by
    its batch's size.
    """
    loss = net.loss_layer().top
    hit = next(layer.top for layer in net.layers if layer.kind == "accuracy")
    keep: tuple[str, ...] = ()
    weight = F.lit(1.0)
    if test_batch:
        if "worker_rows" not in df.columns:
            df = df.join(F.broadcast(worker_counts(df)), "worker")  # one row per worker
        if drop_remainder:
            df = df.where(F.col("pos") < F.floor(F.col("worker_rows") / test_batch) * test_batch)
        else:
            keep = ("pos", "worker_rows")
            weight = 1 / F.least(F.lit(test_batch), F.col("worker_rows") - F.floor(F.col("pos") / test_batch) * test_batch)
        options["batch"] = test_batch
    scored = forward(df, net, weights, [hit, loss], keep=keep, element="double", **options)
    mean = lambda blob: F.sum(F.col(blob)[0] * weight) / F.sum(weight)
    return scored.agg(mean(hit).alias("accuracy"), mean(loss).alias("loss"), F.count(F.lit(1)).alias("n"))

"""Gradients, solver steps and local-SGD rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gradloom.operators.samples import bind_batch
from gradloom.operators.score import load_published, publish, published_by, shared_weights
from gradloom.operators.weights import MOMENTUM, average_weights
from gradloom.plans.batches import WEIGHTS_SCHEMA, Blobs, feed, pack
from gradloom.plans.kernels import backward_pass, forward_pass, mean_loss
from gradloom.plans.net import Net
from gradloom.plans.solver import Solver

#: Layer name under which a round's mean loss travels with the weights.
LOSS = ":loss"
#: Keys whose gradients a task holds before it emits what it has.
HELD_KEYS = 16


def gradient(df: DataFrame, net: Net, weights: DataFrame, by: Sequence[str] = (), batch: int = 1024) -> DataFrame:
    """Mean gradient over all rows, per value of the `by` columns, as a weights table. The weights do not change.

    A task adds up its rows' gradients and emits them once, so the shuffle carries one gradient per task and key; with
    more than HELD_KEYS keys in a task, sorted or not, it carries several.
    """
    bound = bind_batch(df, net, by)
    shared = shared_weights(net, weights)
    key_types = [f.dataType.simpleString() for f in bound.schema if f.name in by]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Blobs, int]] = {}
        for rows in batches:
            for key, columns, n in _by_key(rows, by, net.batch_columns()):
                for low in range(0, n, batch):
                    inputs = feed(net, columns, slice(low, min(low + batch, n)))
                    size = len(inputs[net.inputs[0].name])
                    _, caches = forward_pass(net, shared(), inputs)
                    grads = backward_pass(net, shared(), caches)
                    total, count = held.get(key, ({}, 0))
                    held[key] = {b: total.get(b, 0.0) + g * size for b, g in grads.items()}, count + size
            if len(held) > HELD_KEYS:
                yield from _emit(held, rows.schema, by)
                held = {}
        if held:
            yield from _emit(held, rows.schema, by)

    names = "".join(f"`{name}` {kind}, " for name, kind in zip(by, key_types))
    partials = bound.mapInArrow(partial, names + "rows bigint, " + WEIGHTS_SCHEMA)
    return average_weights(partials, weight="rows", by=by)


def _by_key(rows: pa.RecordBatch, by: Sequence[str], inputs: Sequence[str]):
    """Split a batch by its key columns: (key, input columns, row count)."""
    if not by:
        yield (), {c: rows.column(c) for c in inputs}, rows.num_rows
        return
    keys = pa.Table.from_batches([rows.select(list(by))]).group_by(list(by)).aggregate([])
    for key in keys.to_pylist():
        mask = None
        for name in by:
            column = rows.column(name)
            # A null key is a group like any other.
            same = pc.is_null(column) if key[name] is None else pc.fill_null(pc.equal(column, pa.scalar(key[name], column.type)), False)
            mask = same if mask is None else pc.and_(mask, same)
        part = rows.select(list(inputs)).filter(mask)
        yield tuple(key[name] for name in by), {c: part.column(c) for c in inputs}, part.num_rows


def _emit(held: dict[tuple, tuple[Blobs, int]], schema: pa.Schema, by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for key, (total, count) in held.items():
        constants = {name: pa.scalar(value, schema.field(name).type) for name, value in zip(by, key)}
        means = {b: g / count for b, g in total.items()}
        yield from pack(means, **constants, rows=pa.scalar(count, pa.int64())).to_batches()


def _per_blob(net: Net, attribute: str) -> Column:
    pairs = [F.lit(x) for p in net.params() for x in (f"{p.layer}/{p.blob}", float(getattr(p, attribute)))]
    return F.element_at(F.create_map(*pairs), F.concat_ws("/", "layer", "blob"))


def sgd_step(weights: DataFrame, grads: DataFrame, net: Net, solver: Solver, step: int = 0, batch: int = 1,
             by: Sequence[str] = ()) -> DataFrame:
    """One solver step as a join of weights, momentum rows and gradient, value by value in the JVM.

    The result holds the new weights and, when the solver has momentum, the new momentum rows.
    """
    keys = ["layer", "blob", "chunk"]
    is_state = F.col("layer").endswith(MOMENTUM)
    state = weights.filter(is_state).select(F.regexp_replace("layer", MOMENTUM + "$", "").alias("layer"), "blob", "chunk",
                                            F.col("values").alias("v"))
    joined = (weights.filter(~is_state).join(grads.select(*by, *keys, F.col("values").alias("g")), keys)
              .join(state, keys, "left")
              .withColumn("v", F.coalesce("v", F.transform("values", lambda x: F.lit(0.0)))))
    lr, lr_mult = F.lit(solver.rate(step, batch)), _per_blob(net, "lr_mult")
    decay = F.lit(float(solver.decay)) * _per_blob(net, "decay_mult")
    g = F.zip_with("g", "values", lambda g, w: g + decay * w)
    m = F.lit(float(solver.momentum))
    if solver.form == "scaled":
        moved = joined.withColumn("v", F.zip_with("v", g, lambda v, g: m * v - lr * lr_mult * g))
        moved = moved.withColumn("values", F.zip_with("values", "v", lambda w, v: w + v))
    else:
        moved = joined.withColumn("v", F.zip_with("v", g, lambda v, g: m * v + g))
        moved = moved.withColumn("values", F.zip_with("values", "v", lambda w, v: w - lr * lr_mult * v))
    new = F.array(F.struct("layer", F.col("values").alias("values")))
    if solver.momentum:
        new = F.array(F.struct("layer", F.col("values").alias("values")),
                      F.struct(F.concat("layer", F.lit(MOMENTUM)).alias("layer"), F.col("v").alias("values")))
    return moved.select(*by, "blob", "shape", "chunk", F.explode(new).alias("new")).select(
        *by, "new.layer", "blob", "shape", "chunk", "new.values")


def local_sgd_round(window: DataFrame, weights: DataFrame, net: Net, solver: Solver, workers: int, tau: int, batch: int,
                    round_no: int = 0, seed: int = 0, state: DataFrame | None = None) -> DataFrame:
    """Every worker takes `tau` steps on its window from the same weights; returns (worker, weights...) rows.

    `window` comes from `round_window`. A worker's rows reach one task, sorted, and stream through it: a step is taken
    whenever `batch` rows are there, so a task holds a minibatch and the Arrow batch it comes from, never a window.
    Weights are written once and read by the tasks; nothing passes through the driver or is copied per worker. `state`
    holds per-worker momentum rows; a task reads those of its worker. Preparations that draw do so for this round, before
    the rows move, so that only what is drawn travels with the raw input.
    """
    rows = (bind_batch(window, net, ["worker", "offset"], round_no).repartitionById(workers, "worker")
            .sortWithinPartitions("worker", "offset"))
    common = publish(weights)
    own = published_by(state, "worker") if state is not None else {}

    def finish(worker: int, step: Callable, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, velocity, losses = step(parts)
        if solver.momentum and solver.momentum_state != "reset":
            local.update({(layer + MOMENTUM, b): v for (layer, b), v in velocity.items()})
        local[LOSS, 0] = np.array([np.mean(losses)])
        yield from pack(local, worker=pa.scalar(worker, pa.int32())).to_batches()

    def begin(worker: int) -> Callable:
        start = {**load_published(common, net.dtype), **(load_published(own[worker], net.dtype) if worker in own else {})}
        local = {name: w for name, w in start.items() if not name[0].endswith(MOMENTUM)}
        velocity = {(layer[:-len(MOMENTUM)], b): v for (layer, b), v in start.items() if layer.endswith(MOMENTUM)}
        losses: list[float] = []

        def step(parts: list[pa.RecordBatch]):
            k = len(losses)
            if parts and k < tau:
                table = pa.Table.from_batches(parts).combine_chunks()
                inputs = feed(net, {c: table.column(c).combine_chunks() for c in net.batch_columns()}, slice(0, table.num_rows))
                out, caches = forward_pass(net, local, inputs, train=True, rng=np.random.default_rng([seed, worker, round_no, k]))
                losses.append(mean_loss(net, local, out))
                grads = backward_pass(net, local, caches)
                solver.update(net, local, grads, velocity, round_no * tau + k, batch)
            return local, velocity, losses

        return step

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, step, held, size = None, None, [], 0
        for rows in batches:
            at = 0
            while at < rows.num_rows:
                now = rows.column("worker")[at].as_py()
                if now != worker:
                    if step:
                        yield from finish(worker, step, held)
                    worker, step, held, size = now, begin(now), [], 0
                end = int(np.searchsorted(rows.column("worker").to_numpy(), now, side="right"))
                part = rows.slice(at, min(end - at, batch - size))
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == batch:
                    step(held)
                    held, size = [], 0
        if step:
            yield from finish(worker, step, held)

    return rows.mapInArrow(train, "worker int, " + WEIGHTS_SCHEMA)

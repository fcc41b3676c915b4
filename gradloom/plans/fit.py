"""Training over several rounds."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gradloom.operators.score import evaluate
from gradloom.operators.train import LOSS, local_sgd_round
from gradloom.operators.weights import MOMENTUM, average_weights, init_weights
from gradloom.operators.workers import SampleFiles, Segments, position_window, round_window, segment_window, worker_counts
from gradloom.plans.net import Net
from gradloom.plans.solver import Solver
from gradloom.session import cut_lineage, lifetime
from gradloom.sources.weights import HISTORY_SCHEMA, append_history


@dataclass(frozen=True)
class FitResult:
    weights: DataFrame
    history: DataFrame


def fit(samples: DataFrame, net: Net, solver: Solver, rounds: int, tau: int, batch: int, weights: DataFrame | None = None,
        test: DataFrame | None = None, eval_every: int = 0, seed: int = 0, wrap: bool = False, tolerance: float | None = None,
        weighted: bool = False, segments: Segments | SampleFiles | None = None, history_path: str | None = None,
        start: Callable[[int], Column] | None = None, test_batch: int | None = None, drop_remainder: bool = True) -> FitResult:
    """Local SGD: per round, `tau` steps per worker from common weights, then their average.

    `samples` is an assigned table (see `assign_workers`); with `segments` its rows are read from the written copy.
    Per round the driver sees the mean loss and, every `eval_every` rounds, the test metrics; the averaged weights go
    to the shared checkpoint folder, so a lost executor costs at most one round. Training stops after `rounds` or
    when the loss changes by less than `tolerance`. `weighted` weighs workers by their rows.
    With `test_batch` the test table is an assigned one too, and its metrics are means over its workers' minibatches (see `evaluate`);
    without a full minibatch there is no such row.
    `start` gives a round's window starts instead of the draw, as an expression of `worker` and `worker_rows`.
    """
    spark = samples.sparkSession
    began = time.monotonic()
    counts = cut_lineage(worker_counts(samples))
    workers = counts.agg(F.max("worker") + 1, F.count(F.lit(1))).first()
    if workers[0] != workers[1]:
        raise ValueError(f"only {workers[1]} of {workers[0]} workers have rows")
    workers = workers[0]
    weights = weights if weights is not None else init_weights(spark, net, seed)
    keep_local = solver.momentum_state == "local" and solver.momentum > 0
    state, last, log = None, None, []
    for round_no in range(rounds):
        with lifetime(spark):  # what a round publishes goes at its end; its result is checkpointed
            if test is not None and eval_every and round_no % eval_every == 0:
                measured = evaluate(test, net, weights, test_batch, drop_remainder, round_no=round_no).first()
                log += _logged(spark, history_path, round_no, began, accuracy=measured["accuracy"], test_loss=measured["loss"])
            begin = start(round_no) if start else None
            if isinstance(segments, SampleFiles):
                window = position_window(segments, counts, tau, batch, round_no, seed, wrap, begin)
            elif segments:
                window = segment_window(segments, counts, tau, batch, round_no, seed, wrap, begin)
            else:
                window = round_window(samples, counts, tau, batch, round_no, seed, wrap, begin)
            local = local_sgd_round(window, weights, net, solver, workers, tau, batch, round_no, seed, state)
            if keep_local:
                local = cut_lineage(local)
                state = local.filter(F.col("layer").endswith(MOMENTUM))
                local = local.filter(~F.col("layer").endswith(MOMENTUM))
            if weighted:
                local = local.join(F.broadcast(counts), "worker")
            merged = cut_lineage(average_weights(local, workers, "worker_rows" if weighted else None))
            loss = merged.filter(F.col("layer") == LOSS).select(F.col("values")[0]).first()[0]
            weights = merged.filter(F.col("layer") != LOSS)
            log += _logged(spark, history_path, round_no, began, loss=loss)
        if tolerance is not None and last is not None and abs(last - loss) < tolerance:
            break
        last = loss
    history = spark.createDataFrame(log, HISTORY_SCHEMA)
    return FitResult(weights.filter(~F.col("layer").endswith(MOMENTUM)), history)


def _logged(spark, path: str | None, round_no: int, began: float, **metrics: float) -> list[tuple]:
    rows = [(round_no, time.monotonic() - began, name, float(value)) for name, value in metrics.items() if value is not None]
    if path:
        append_history(spark.createDataFrame(rows, HISTORY_SCHEMA), path)
    return rows

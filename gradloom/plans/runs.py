"""Whole runs: from raw samples to trained weights or features, with the settings of a preset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradloom.functions.convert import Conversion, float_vector
from gradloom.functions.image import rescale, round_crop
from gradloom.operators.joins import gather
from gradloom.operators.means import publish_mean
from gradloom.operators.samples import apply_null_policy, convert_inputs, persisted
from gradloom.operators.score import featurize
from gradloom.operators.workers import assign_workers, assign_workers_in_place, open_positions, write_positions
from gradloom.plans.fit import FitResult, fit
from gradloom.plans.net import Input, Net
from gradloom.plans.presets import NETS, RUNS, SOLVERS
from gradloom.plans.solver import Solver
from gradloom.session import lifetime, shared_path, stored
from gradloom.sources.archives import index_tar
from gradloom.sources.chunks import write_shuffled_chunks
from gradloom.sources.images import read_archived_images, read_labelled_images
from gradloom.sources.labels import publish_labels


def train(preset: str, samples: DataFrame, workers: int, rounds: int, test: DataFrame | None = None, net: Net | None = None,
          solver: Solver | None = None, conversions: Mapping[str, Conversion] | None = None, on_null: str = "raise",
          seed: int = 0, raw: Sequence[int] | None = None, **options) -> FitResult:
    """Train a preset's net on (sample_id, inputs...) rows; `net` and `solver` override the preset's.

    Rows are shuffled over the workers or left where they are, as the preset says. They are written once in order of their positions, and
    each round reads its windows; test rows are kept in memory. Raw images (bytes of the preset's `raw` shape, or of `raw`) stay bytes
    until they are in a batch: their mean is taken once over the training rows and stored, and each round crops anew. Test metrics are
    means over minibatches of the preset's size, the short ones at the workers' ends too unless `drop_remainder=True`.
    """
    run, net, solver = RUNS[preset], net or NETS[preset](), solver or SOLVERS[preset]
    raw = tuple(raw or run.raw or ())
    image = raw_image(net, samples) if raw else None
    if image:
        # Filled in once the mean is known; till then it only says which columns are needed.
        net = net.prepared(image.name, round_crop(np.zeros(raw, "f4"), raw, image.shape[1:], seed))
    centred = lambda table: net.prepared(image.name, round_crop(publish_mean(table, image.name, raw), raw, image.shape[1:], seed)) if image else net
    if run.scaled:
        conversions = {**{i.name: rescaled_vector for i in net.inputs if not i.label}, **(conversions or {})}
    spark = samples.sparkSession
    with lifetime(spark):  # samples, means and places are needed until the weights are there
        prepare = lambda df: prepare_inputs(apply_null_policy(df, net.columns(), on_null), net, conversions)
        assigned = (assign_workers(prepare(samples), workers, seed=seed) if run.shuffle
                    else assign_workers_in_place(prepare(samples), workers))
        if test is not None:
            # Test rows are never reshuffled; their minibatches are numbered where the rows lie.
            test = prepare(test)
            test = assign_workers(test, workers, seed=seed) if run.shuffle else stored(assign_workers_in_place(test, workers), "test-samples")
        options = {"test": test, "eval_every": run.eval_every, "test_batch": run.test_batch, "drop_remainder": False, "seed": seed, **options}
        path, rows = shared_path(spark, "samples"), run.tau * run.batch
        write_positions(assigned, path, rows)
        files = open_positions(spark, path, rows)
        with persisted(*[t for t in (test,) if t is not None and run.cached]):
            return fit(files.table, centred(files.table), solver, rounds, run.tau, run.batch, segments=files, **options)


def raw_image(net: Net, samples: DataFrame) -> Input | None:
    """The net's one image input, if the table holds it as bytes."""
    found = [i for i in net.inputs if not i.label and len(i.shape) == 3 and i.prepare is None
             and i.name in samples.columns and isinstance(samples.schema[i.name].dataType, T.BinaryType)]
    if len(found) > 1:
        raise ValueError(f"net {net.name} has several image inputs: {[i.name for i in found]}")
    return found[0] if found else None


def extract_features(preset: str, samples: DataFrame, weights: DataFrame, blob: str, net: Net | None = None,
                     conversions: Mapping[str, Conversion] | None = None) -> DataFrame:
    """(sample_id, blob) of every row, in batches of the preset's size."""
    net = (net or NETS[preset]()).subnet([blob])
    return featurize(prepare_inputs(samples, net, conversions), net, weights_of(weights, net), blob, batch=RUNS[preset].batch)


def prepare_inputs(samples: DataFrame, net: Net, conversions: Mapping[str, Conversion] | None) -> DataFrame:
    """Converted inputs, except that bytes stay bytes until they are in a batch: a quarter of the size of floats."""
    raw = {i.name: lambda col, data_type, shape: col for i in net.inputs
           if i.name in samples.columns and isinstance(samples.schema[i.name].dataType, T.BinaryType)}
    return convert_inputs(samples, net, ["sample_id"], {**raw, **(conversions or {})})


def rescaled_vector(col: Column, data_type: T.DataType, shape: Sequence[int]) -> Column:
    """Unsigned pixels as `x / 255 - 0.5`."""
    return rescale(float_vector(col, data_type, shape)).cast("array<float>")


def weights_of(weights: DataFrame, net: Net) -> DataFrame:
    """The rows of the layers a net has."""
    return weights.filter(F.col("layer").isin([p.layer for p in net.params()]))


def chunk_archives(archives: DataFrame, labels: DataFrame, n_chunks: int, path: str, height: int, width: int, seed: int = 0,
                   prefix: str = "train", digits: int = 5, files_per_chunk: int = 1, on_missing: str = "drop") -> DataFrame:
    """`chunk_images` from archives (`list_archives`), with labels joined to their index before any image is read.

    Returns how many labelled members were read, kept and dropped as undecodable.
    """
    with lifetime(archives.sparkSession):
        images, counts = read_labelled_images(index_tar(archives), labels, height, width, on_missing)
        write_shuffled_chunks(images, n_chunks, f"{path}/chunks", "filename", seed, prefix, digits, files_per_chunk)
        publish_labels(archives.sparkSession.read.parquet(f"{path}/chunks"), f"{path}/labels")
    return counts


def chunk_images(members: DataFrame, labels: DataFrame, n_chunks: int, landing: str, path: str, height: int, width: int,
                 seed: int = 0, prefix: str = "train", digits: int = 5, files_per_chunk: int = 1, on_missing: str = "drop") -> None:
    """Archive members and labels to shuffled chunks of resized, labelled images, beside the label file of what was written.

    Labels without an image that can be decoded are dropped by default, as undecodable images are; `on_missing="error"` fails.
    """
    images = stored(read_archived_images(members, landing, height, width), "images")
    labelled = gather(labels, images, on_missing=on_missing)
    write_shuffled_chunks(labelled, n_chunks, f"{path}/chunks", "filename", seed, prefix, digits, files_per_chunk)
    publish_labels(images.sparkSession.read.parquet(f"{path}/chunks"), f"{path}/labels")

"""Crops drawn in every round, stored mean images, minibatch evaluation, whole runs from raw bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.functions.image import crop_corner, round_crop
from gradloom.operators.means import publish_mean
from gradloom.operators.score import evaluate, forward, prepared_input
from gradloom.operators.train import gradient
from gradloom.operators.weights import init_weights, weights_equal
from gradloom.operators.workers import assign_workers
from gradloom.plans import net as n
from gradloom.plans.runs import train
from gradloom.plans.solver import Solver

SHAPE, CROP = (3, 8, 7), (5, 4)


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(0, 256, SHAPE, np.uint8).tobytes(), i % 3) for i in range(200)]
    return spark.createDataFrame(rows, "sample_id long, data binary, label int").repartition(4).cache()


def net():
    return n.Net("small", (n.Input("data", (3, *CROP)), n.Input("label", label=True)), (
        n.dense("ip", "data", 3), n.softmax("prob", "ip"), n.accuracy("accuracy", "ip"), n.softmax_loss("loss", "ip")))


def pixels(images):
    rows = {r["sample_id"]: np.frombuffer(r["data"], "u1").reshape(SHAPE) for r in images.collect()}
    return rows, np.mean([v.astype("i8") for v in rows.values()], axis=0).astype("f4")


@pytest.mark.parametrize("interleave", [False, True])
def test_another_crop_each_round(spark, images, interleave):
    stored = publish_mean(images, "data", SHAPE)
    assert len(stored.files) == 1 and stored.size == 168
    cropping = net().prepared("data", round_crop(stored, SHAPE, CROP, seed=3, interleave=interleave))
    assert cropping.columns() == ["data", "label", "sample_id"] and cropping.batch_columns() == ["data", "label", "crop_row", "crop_col"]
    rows, mean = pixels(images)
    corners = {}
    for round_no in range(3):
        row, col = crop_corner(F.col("sample_id"), SHAPE, CROP, round_no, 3)
        corners[round_no] = {r[0]: (r[1], r[2]) for r in images.select("sample_id", row, col).collect()}
        found = {r["sample_id"]: np.array(r["data"]) for r in prepared_input(images, cropping, "data", round_no=round_no, batch=37).collect()}
        for i, (r, c) in corners[round_no].items():
            expected = (rows[i].astype("f4") - mean)[:, r:r + CROP[0], c:c + CROP[1]]
            expected = expected.transpose(1, 2, 0) if interleave else expected
            assert np.array_equal(found[i], expected.ravel().astype("f8"))
    assert sum(corners[0][i] != corners[1][i] for i in corners[0]) > 100 and corners[0] != corners[2]
    again = prepared_input(images.repartition(7), cropping, "data", round_no=1).collect()
    first = {r["sample_id"]: r["data"] for r in prepared_input(images, cropping, "data", round_no=1).collect()}
    assert {r["sample_id"]: r["data"] for r in again} == first


def test_too_large_crop_and_no_rows(spark, images):
    with pytest.raises(ValueError, match="larger"):
        round_crop(np.zeros(SHAPE), SHAPE, (9, 4))
    with pytest.raises(ValueError, match="no rows"):
        publish_mean(images.limit(0), "data", SHAPE)


def test_scores_and_gradients_draw_too(spark, images):
    cropping = net().prepared("data", round_crop(publish_mean(images, "data", SHAPE), SHAPE, CROP))
    weights = init_weights(spark, cropping, 1)
    first, second = (forward(images, cropping, weights, ["prob"], round_no=r).orderBy("sample_id").collect() for r in (0, 1))
    assert [r["sample_id"] for r in first] == list(range(200)) and first != second
    assert not weights_equal(gradient(images, cropping, weights), weights, 0.0).first()["equal"]


@pytest.mark.parametrize("preset", ["imagenet", "imagenet-alexnet"])
def test_training_from_raw_bytes(spark, images, preset):
    """The preset's way for raw images, small: bytes of a larger shape than the net's input, cropped anew in each round."""
    options = {"net": net(), "solver": Solver(1e-6), "raw": SHAPE, "test": images, "wrap": True, "eval_every": 1, "seed": 4}
    one = train(preset, images, 2, 1, **options)
    two = train(preset, images, 2, 2, **options)
    assert {r["metric"] for r in two.history.collect()} == {"loss", "accuracy", "test_loss"}
    assert not weights_equal(one.weights, two.weights, 0.0).first()["equal"]
    assert all(np.isfinite(r["value"]) for r in two.history.collect())


def test_raw_images_of_the_preset_size(spark):
    """3 x 256 x 256 bytes fit the preset as they are: the net behind the crop has 3 x 227 x 227 inputs."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 256, 3 * 256 * 256, np.uint8).tobytes(), i % 2) for i in range(6)]
    raw = spark.createDataFrame(rows, "sample_id long, data binary, label int").repartition(2)
    small = n.Net("wide", (n.Input("data", (3, 227, 227)), n.Input("label", label=True)), (
        n.dense("ip", "data", 2), n.softmax("prob", "ip"), n.accuracy("accuracy", "ip"), n.softmax_loss("loss", "ip")), dtype="float32")
    result = train("imagenet", raw, 2, 1, net=small, solver=Solver(1e-9), wrap=True)
    assert result.history.where("metric = 'loss'").count() == 1


@pytest.mark.parametrize("drop", [True, False])
def test_minibatch_evaluation(spark, images, drop):
    plain = n.Net("plain", (n.Input("data", SHAPE), *net().inputs[1:]), net().layers)
    weights = init_weights(spark, plain, 2)
    assigned = assign_workers(images, 3).cache()
    by_row = {r["sample_id"]: (r["accuracy"][0], r["loss"][0]) for r in forward(images, plain, weights, ["accuracy", "loss"], element="double").collect()}
    batches = {}
    for r in assigned.select("sample_id", "worker", "pos", "worker_rows").collect():
        if not drop or r["pos"] < r["worker_rows"] // 25 * 25:
            batches.setdefault((r["worker"], r["pos"] // 25), []).append(by_row[r["sample_id"]])
    expected = np.mean([np.mean(rows, axis=0) for rows in batches.values()], axis=0)
    for table in (assigned, assigned.drop("worker_rows")):
        found = evaluate(table, plain, weights, 25, drop).first()
        assert np.allclose([found["accuracy"], found["loss"]], expected) and found["n"] == sum(map(len, batches.values()))

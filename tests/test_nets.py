from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from gradloom.functions.dense import argmax, dense, learning_rate, percent, relu, softmax, softmax_loss
from gradloom.functions.fill import filler_value, inverse_normal, uniform
from gradloom.functions.image import crop_preparation
from gradloom.operators.samples import bind_inputs
from gradloom.operators.score import evaluate, featurize, forward
from gradloom.operators.weights import (blob_values, init_weights, l2_term, weights_equal, weights_from_dict)
from gradloom.plans import net as n
from gradloom.plans.batches import pack, unpack
from gradloom.plans.kernels import backward_pass, forward_pass, mean_loss
from gradloom.plans.presets import NETS, RUNS, SOLVERS, adult_net, alexnet, cifar_net, mnist_net
from gradloom.plans.solver import Solver

RNG = np.random.default_rng(5)


def small_conv(pad, method, pool_pad=0, stride=1):
    return n.Net("small", (n.Input("data", (2, 7, 6)), n.Input("label", label=True)), (
        n.conv("conv1", "data", 3, 3, pad=pad, stride=stride), n.relu("relu1", "conv1"),
        n.pool("pool1", "conv1", method, 3, 2, pool_pad),
        n.dense("ip1", "pool1", 5), n.relu("relu2", "ip1"), n.dropout("drop", "ip1", 0.4), n.dense("ip2", "ip1", 4),
        n.softmax("prob", "ip2"), n.accuracy("accuracy", "ip2"), n.softmax_loss("loss", "ip2")), l2={"ip1": 0.05})


@pytest.mark.parametrize("net", [small_conv(1, "max"), small_conv("SAME", "ave", "SAME"), small_conv(0, "ave", stride=2),
                                 small_conv("VALID", "max", "VALID"), small_conv(2, "ave", 1)], ids=str)
def test_gradients_match_differences(net):
    weights = {(p.layer, p.blob): RNG.normal(0, 0.5, p.shape) for p in net.params()}
    inputs = {"data": RNG.normal(0, 1, (3, 2, 7, 6)), "label": np.array([0, 3, 1])}

    def loss():
        out, caches = forward_pass(net, weights, inputs, True, np.random.default_rng(9))
        return mean_loss(net, weights, out), caches

    grads = backward_pass(net, weights, loss()[1])
    assert set(grads) == set(weights)
    for name, w in weights.items():
        for at in RNG.integers(0, w.size, 6):
            old = w.reshape(-1)[at]
            w.reshape(-1)[at] = old + 1e-6
            high = loss()[0]
            w.reshape(-1)[at] = old - 1e-6
            low = loss()[0]
            w.reshape(-1)[at] = old
            assert grads[name].reshape(-1)[at] == pytest.approx((high - low) / 2e-6, abs=2e-6)


def test_convolution_and_pooling_by_hand():
    net = small_conv(1, "ave")
    weights = {(p.layer, p.blob): RNG.normal(0, 0.5, p.shape) for p in net.params()}
    x = RNG.normal(0, 1, (1, 2, 7, 6))
    out, _ = forward_pass(net.subnet(["pool1"]), weights, {"data": x})
    padded = np.pad(x[0], ((0, 0), (1, 1), (1, 1)))
    conv = np.array([[[(padded[:, r:r + 3, c:c + 3] * weights["conv1", 0][o]).sum() + weights["conv1", 1][o]
                       for c in range(6)] for r in range(7)] for o in range(3)]).clip(0)
    pooled = np.array([[[conv[o, r:r + 3, c:c + 3].mean() for c in (0, 2, 4)] for r in (0, 2, 4)] for o in range(3)])
    assert np.allclose(out["pool1"][0], pooled)


def test_preset_shapes():
    assert cifar_net().blob_shapes()["pool3"] == (64, 4, 4)
    assert mnist_net().blob_shapes()["pool2"] == (64, 7, 7)
    shapes = alexnet().blob_shapes()
    assert shapes["conv1"] == (64, 57, 57) and shapes["pool5"] == (256, 6, 6) and shapes["fc8"] == (1000,)
    assert alexnet().size() == sum(p.size for p in alexnet().params()) > 50_000_000
    assert adult_net().outputs() == ["prob"] and cifar_net().outputs() == ["prob", "accuracy", "loss"]
    assert set(RUNS) == set(NETS) and set(SOLVERS) <= set(RUNS)
    assert RUNS["cifar"].tau == 10 and SOLVERS["cifar"].decay == 0.004


def test_unknown_names_fail():
    net = n.softmax_regression(4, 2)
    with pytest.raises(ValueError, match="no blob named conv9"):
        net.output_schema(["conv9"])
    with pytest.raises(ValueError, match="unknown blobs"):
        n.Net("x", (n.Input("a"),), (n.dense("d", "b", 2),)).blob_shapes()
    fields = net.output_schema(["prob"]).fields
    assert fields == [T.StructField("prob", T.ArrayType(T.FloatType()), False)]


def test_binding(spark):
    net = n.softmax_regression(4, 2)
    df = spark.createDataFrame([(1, [1.0] * 4, 0, "x")], "id int, data array<float>, label int, more string")
    assert bind_inputs(df, net, ["id"]).columns == ["id", "data", "label"]
    with pytest.raises(ValueError, match="unknown columns"):
        bind_inputs(df, net, ["id"], exact=True)
    with pytest.raises(ValueError, match="missing columns"):
        bind_inputs(df.drop("label"), net)


def drawn(spark, filler, shape, seed=1):
    rows = spark.range(int(np.prod(shape))).select(filler_value(filler, shape, uniform(seed, F.lit("layer"), F.lit(0), F.col("id"))).alias("x"))
    return rows.toArrow().column("x").to_numpy()


def test_fillers(spark):
    assert (drawn(spark, n.Filler(value=0.1), (5,)) == 0.1).all()
    gauss = drawn(spark, n.Filler("gaussian", std=0.01), (100, 100))
    assert abs(gauss.std() - 0.01) < 5e-4 and abs(gauss.mean()) < 5e-4 and np.abs(gauss).max() > 0.03
    cut = drawn(spark, n.Filler("truncated", std=0.1), (100, 100))
    assert np.abs(cut).max() <= 0.2 and cut.std() > 0.08
    xavier = drawn(spark, n.Filler("xavier"), (10, 12))
    assert np.abs(xavier).max() <= 0.5 and np.abs(xavier).max() > 0.45
    assert not np.array_equal(gauss, drawn(spark, n.Filler("gaussian", std=0.01), (100, 100), 2))
    with pytest.raises(ValueError, match="unknown filler"):
        filler_value(n.Filler("other"), (1,), F.lit(0.5))


def test_inverse_normal(spark):
    shares = [1e-9, 0.001, 0.0242, 0.0243, 0.3, 0.5, 0.9, 0.9757, 0.9758, 1 - 1e-9]
    law = NormalDist()
    found = [r[0] for r in spark.createDataFrame([(p,) for p in shares], "p double").select(inverse_normal(F.col("p"))).collect()]
    assert all(abs(x - law.inv_cdf(p)) < 1e-8 * max(1, abs(x)) for x, p in zip(found, shares))


def test_initial_weights_do_not_depend_on_partitions(spark):
    net = n.softmax_regression(3000, 7)
    first = init_weights(spark, net, 3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert weights_equal(first, init_weights(spark, net, 3), 0.0).first()["equal"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert not weights_equal(first, init_weights(spark, net, 4), 0.0).first()["equal"]
    blobs = unpack(first.toArrow())
    assert blobs["ip", 0].shape == (7, 3000) and (blobs["ip", 1] == 0).all()
    assert weights_equal(first, weights_from_dict(spark, blobs), 0.0).first()["equal"]
    assert unpack(pack(blobs))["ip", 0].tolist() == blobs["ip", 0].tolist()


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 84).tolist(), int(rng.integers(0, 4))) for i in range(57)]
    return spark.createDataFrame(rows, "sample_id long, data array<double>, label int").repartition(3).cache()


def test_forward_ways_agree_and_leave_weights(spark, images):
    net = small_conv(1, "max")
    weights = init_weights(spark, net, 1).cache()
    before = unpack(weights.toArrow())
    blobs = ["conv1", "pool1", "prob"]
    shared = forward(images, net, weights, blobs, element="double")
    written = forward(images, net, weights, blobs, batch=10, element="double")
    a = {r["sample_id"]: r for r in shared.collect()}
    b = {r["sample_id"]: r for r in written.collect()}
    assert len(a) == 57 and all(np.allclose(a[k][c], b[k][c], atol=1e-12) for k in a for c in blobs)
    assert [len(a[0][c]) for c in blobs] == [126, 27, 4]
    after = unpack(weights.toArrow())
    assert all((before[k] == after[k]).all() for k in before)


def test_unlabelled_rows_can_be_featurized(spark, images):
    net = small_conv(1, "max")
    out = featurize(images.drop("label"), net, init_weights(spark, net, 1), "ip1")
    assert out.columns == ["sample_id", "ip1"] and {len(r["ip1"]) for r in out.collect()} == {5}
    assert forward(images.drop("label"), net, init_weights(spark, net, 1)).columns == ["sample_id", "prob"]


def test_wrong_inputs_fail(spark, images):
    net = small_conv(1, "max")
    weights = init_weights(spark, net, 1)
    with pytest.raises(Exception, match="every row must hold 84 values"):
        forward(images.withColumn("data", F.slice("data", 1, 83)), net, weights, ["prob"]).collect()
    with pytest.raises(Exception, match="null input"):
        forward(images.withColumn("data", F.when(F.col("sample_id") > 5, F.col("data"))), net, weights, ["prob"]).collect()
    with pytest.raises(ValueError, match="do not fit net"):
        forward(images, n.softmax_regression(84, 4), weights, ["prob"])
    with pytest.raises(Exception, match="label outside"):
        evaluate(images.withColumn("label", F.lit(4)), net, weights).collect()


def test_accuracies_over_all_labels_sum_to_one(spark, images):
    net = small_conv(1, "max")
    weights = init_weights(spark, net, 1)
    total = sum(evaluate(images.withColumn("label", F.lit(c)), net, weights).first()["accuracy"] for c in range(4))
    assert total == pytest.approx(1.0, abs=1e-6)


def test_adult_preset_on_one_column(spark):
    df = spark.createDataFrame([(i, 30 + i) for i in range(64)], "sample_id long, C0 int")
    out = forward(df, adult_net(), init_weights(spark, adult_net(), 2), ["prob"])
    rows = out.collect()
    assert len(rows) == 64 and all(len(r["prob"]) == 10 and sum(r["prob"]) == pytest.approx(1, abs=1e-5) for r in rows)


def test_prepared_bytes_enter_the_batch(spark):
    rng = np.random.default_rng(8)
    raw, mean = rng.integers(0, 256, (9, 3, 6, 6), "u1"), rng.normal(120, 9, (3, 6, 6)).astype("f4")
    rows = [(i, x.tobytes(), i % 3, i % 2) for i, x in enumerate(raw)]
    df = spark.createDataFrame(rows, "sample_id long, data binary, crop_row int, crop_col int")
    net = n.Net("crop", (n.Input("data", (3, 4, 5), prepare=crop_preparation(mean, (3, 6, 6), (4, 5))),), (n.dense("ip", "data", 2),))
    weights = init_weights(spark, net, 6)
    w = unpack(weights.toArrow())
    for r in forward(df, net, weights, ["ip"], element="double").collect():
        i = r["sample_id"]
        x = (raw[i].astype("f4") - mean)[:, i % 3:i % 3 + 4, i % 2:i % 2 + 5]
        assert np.allclose(r["ip"], w["ip", 0] @ x.reshape(-1) + w["ip", 1], atol=1e-3)


def test_column_functions_match_numpy(spark):
    rows = [([1.0, -2.0, 0.5], 2), ([300.0, 0.0, 300.0], 0), ([-4.0, -4.0, -4.0], 1)]
    df = spark.createDataFrame(rows, "z array<double>, label int").coalesce(1)
    found = df.select(softmax(F.col("z")).alias("p"), argmax(F.col("z")).alias("a"), relu(F.col("z")).alias("r"),
                      softmax_loss(F.col("z"), F.col("label")).alias("l")).collect()
    for (z, label), r in zip(rows, found):
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(r["p"], e / e.sum()) and r["a"] == int(np.argmax(z)) and r["r"] == [max(0.0, x) for x in z]
        assert r["l"] == pytest.approx(-np.log(e[label] / e.sum()))
    w = F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(1.0), F.lit(0.0)))
    assert df.select(dense(F.col("z"), w, F.array(F.lit(0.1), F.lit(0.2))).alias("y")).first()["y"] == pytest.approx([2.1, -1.3])
    assert spark.range(1).select(percent(F.lit(0.12345)).alias("x")).first()["x"] == "12.35"


def test_learning_rates_agree(spark):
    policies = [Solver(0.01), Solver(0.01, policy="step", gamma=0.1, step_size=100),
                Solver(0.01, policy="exponential", decay_rate=0.95, decay_samples=6000)]
    df = spark.range(0, 1000, 37)
    for s in policies:
        column = learning_rate(F.col("id"), s.policy, s.base_lr, s.gamma, s.step_size, 64, s.decay_rate, s.decay_samples)
        for r in df.select("id", column.alias("lr")).collect():
            assert r["lr"] == pytest.approx(s.rate(r["id"], 64))


def test_l2_and_blob_values(spark):
    net = n.softmax_regression(2500, 4)
    weights = init_weights(spark, net, 3)
    blobs = unpack(weights.toArrow())
    assert l2_term(weights, {"ip": 0.5}).first()["l2"] == pytest.approx(0.25 * (blobs["ip", 0] ** 2).sum())
    assert blob_values(weights, "ip", 0).first()["values"] == blobs["ip", 0].reshape(-1).tolist()


def test_mnist_inputs_are_rescaled(spark):
    from gradloom.plans.runs import prepare_inputs, rescaled_vector
    df = spark.createDataFrame([(1, bytes(range(256)) * 3 + bytes(16), 3)], "sample_id long, data binary, label int")
    row = prepare_inputs(df, mnist_net(), {"data": rescaled_vector}).first()
    assert RUNS["mnist"].scaled and np.allclose(row["data"][:256], np.arange(256) / 255 - 0.5, atol=1e-6)

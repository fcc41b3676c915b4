import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from gradloom.functions.convert import float_vector
from gradloom.operators.evaluate import accuracy, batch_accuracy
from gradloom.operators.score import featurize, forward
from gradloom.operators.train import LOSS, gradient, local_sgd_round, sgd_step
from gradloom.operators.weights import (MOMENTUM, add_weights, average_weights, init_weights, scalar_divide, weights_equal,
                                        weights_from_dict)
from gradloom.operators.workers import assign_workers, open_segments, round_window, worker_counts, write_segments
from gradloom.plans.batches import unpack
from gradloom.plans.fit import fit
from gradloom.plans.kernels import backward_pass, forward_pass
from gradloom.plans.net import softmax_regression
from gradloom.plans.presets import cifar_net
from gradloom.plans.runs import extract_features, train
from gradloom.plans.solver import Solver
from gradloom.streaming.rows import write_stream

NET = softmax_regression(6, 3)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 2, (3, 6))
    rows = []
    for i in range(240):
        label = int(rng.integers(0, 3))
        rows.append((i, (centres[label] + rng.normal(0, 0.5, 6)).tolist(), label))
    return spark.createDataFrame(rows, "sample_id long, data array<double>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def start(spark):
    return init_weights(spark, NET, 1).cache()


def blobs_of(df):
    return unpack(df.select("layer", "blob", "shape", "chunk", "values").filter(F.col("layer") != LOSS).toArrow())


def same(a, b, tolerance=1e-10):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=tolerance, rtol=0) for k in a)


def plain_sgd(rows, weights, solver, tau, batch, first=0):
    """The same training without Spark: rows in window order."""
    weights, velocity = dict(weights), {}
    data, label = np.array([r["data"] for r in rows]), np.array([r["label"] for r in rows])
    for k in range(tau):
        at = slice(k * batch, (k + 1) * batch)
        inputs = {"data": data[at], "label": label[at]}
        grads = backward_pass(NET, weights, forward_pass(NET, weights, inputs)[1])
        solver.update(NET, weights, grads, velocity, first + k, batch)
    return weights, velocity


def test_one_worker_equals_plain_sgd(samples, start):
    df = assign_workers(samples, 1)
    window = round_window(df, worker_counts(df), 5, 8, 2)
    for solver in (Solver(0.2, 0.9, 0.01), Solver(0.2, 0.9, form="plain", policy="step", step_size=3)):
        local = blobs_of(local_sgd_round(window, start, NET, solver, 1, 5, 8, 2))
        weights, velocity = plain_sgd(window.orderBy("offset").collect(), blobs_of(start), solver, 5, 8, first=10)
        expected = {**weights, **{(layer + MOMENTUM, b): v for (layer, b), v in velocity.items()}}
        assert same(local, expected)


def test_one_step_of_equal_workers_equals_one_large_batch(samples, start):
    df = assign_workers(samples, 4)
    window = round_window(df, worker_counts(df), 1, 30, 0)
    solver = Solver(0.3)
    averaged = average_weights(local_sgd_round(window, start, NET, solver, 4, 1, 30), 4)
    large = sgd_step(start, gradient(window, NET, start), NET, solver)
    assert same(blobs_of(averaged), blobs_of(large))


def test_gradient_does_not_depend_on_partitions(samples, start):
    before = blobs_of(start)
    one, many = (blobs_of(gradient(samples.repartition(p), NET, start, batch=b)) for p, b in ((1, 1000), (7, 9)))
    assert same(one, many) and same(before, blobs_of(start), 0)
    by_label = gradient(samples, NET, start, by=["label"])
    sizes = {r["label"]: r["count"] for r in samples.groupBy("label").count().collect()}
    total = sum(sizes[c] * blobs_of(by_label.filter(F.col("label") == c))["ip", 0] for c in sizes) / sum(sizes.values())
    assert np.allclose(total, one["ip", 0])


def test_gradient_of_a_null_group_and_of_many_groups(samples, start):
    keyed = samples.withColumn("k", F.when(F.col("sample_id") % 3 > 0, F.col("sample_id") % 40))
    groups = gradient(keyed, NET, start, by=["k"])
    keys = {r["k"] for r in keyed.select("k").distinct().collect()}
    assert None in keys and {r["k"] for r in groups.select("k").distinct().collect()} == keys
    assert same(blobs_of(groups.filter("k IS NULL").drop("k")), blobs_of(gradient(keyed.filter("k IS NULL"), NET, start)))


def test_two_table_steps_equal_the_batch_solver(samples, start):
    solver = Solver(0.1, 0.9, 0.02)
    weights, velocity = blobs_of(start), {}
    table = start
    rows = samples.collect()
    inputs = {"data": np.array([r["data"] for r in rows]), "label": np.array([r["label"] for r in rows])}
    for step in range(2):
        table = sgd_step(table, gradient(samples, NET, table), NET, solver, step)
        solver.update(NET, weights, backward_pass(NET, weights, forward_pass(NET, weights, inputs)[1]), velocity, step, 1)
    assert same({k: v for k, v in blobs_of(table).items() if k[0] == "ip"}, weights)


def test_average_of_equal_weights_is_the_identity(spark, start):
    copies = start.withColumn("worker", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    assert weights_equal(average_weights(copies, 5), start, 0.0).first()["equal"]
    halves = scalar_divide(add_weights(start, start), 2)
    assert weights_equal(halves, start, 0.0).first()["equal"]


def test_weights_that_do_not_match(spark, start):
    other = weights_from_dict(spark, {("ip", 0): np.zeros((2, 6)), ("ip", 1): np.zeros(3)})
    assert not weights_equal(start, other, 100.0).first()["equal"]
    assert not weights_equal(start, start.filter("blob = 0"), 100.0).first()["equal"]
    with pytest.raises(Exception, match="weights do not match"):
        add_weights(start, other).collect()
    with pytest.raises(Exception, match="weights do not match"):
        average_weights(start.unionByName(start.filter("blob = 0")), 2).collect()


@pytest.mark.parametrize("state", ["average", "local", "reset"])
def test_momentum_between_rounds(samples, start, state):
    df = assign_workers(samples, 3).cache()
    counts = worker_counts(df)
    solver = Solver(0.1, 0.9, momentum_state=state)
    result = fit(df, NET, solver, rounds=2, tau=2, batch=10, weights=start, seed=3)
    workers, weights, velocity = range(3), blobs_of(start), [dict() for _ in range(3)]
    for round_no in range(2):
        locals_ = []
        rows = round_window(df, counts, 2, 10, round_no, 3).collect()
        for w in workers:
            mine = sorted((r for r in rows if r["worker"] == w), key=lambda r: r["offset"])
            data, label = np.array([r["data"] for r in mine]), np.array([r["label"] for r in mine])
            local = dict(weights)
            for k in range(2):
                at = slice(10 * k, 10 * k + 10)
                grads = backward_pass(NET, local, forward_pass(NET, local, {"data": data[at], "label": label[at]})[1])
                solver.update(NET, local, grads, velocity[w], 2 * round_no + k, 10)
            locals_.append(local)
        weights = {k: np.mean([x[k] for x in locals_], axis=0) for k in weights}
        if state == "average":
            mean = {k: np.mean([v[k] for v in velocity], axis=0) for k in weights}
            velocity = [dict(mean) for _ in workers]
        if state == "reset":
            velocity = [dict() for _ in workers]
    assert same(blobs_of(result.weights), weights)


def test_loss_falls_and_history_is_kept(spark, samples, tmp_path):
    df = assign_workers(samples, 4).cache()
    result = fit(df, NET, Solver(0.3), rounds=5, tau=4, batch=10, test=df, eval_every=2, history_path=str(tmp_path / "h"))
    rows = result.history.collect()
    losses = [r["value"] for r in rows if r["metric"] == "loss"]
    assert len(losses) == 5 and losses[-1] < losses[0] / 2
    assert [r["round"] for r in rows if r["metric"] == "accuracy"] == [0, 2, 4]
    assert spark.read.parquet(str(tmp_path / "h")).exceptAll(result.history).count() == 0
    early = fit(df, NET, Solver(0.3), rounds=50, tau=4, batch=10, tolerance=0.5)
    assert early.history.count() < 10


def test_segments_and_weights_by_size(spark, samples, start, tmp_path):
    df = assign_workers(samples, 4).cache()
    write_segments(df, str(tmp_path / "seg"), 16)
    direct = fit(df, NET, Solver(0.2), 2, 2, 10, weights=start)
    stored = fit(df, NET, Solver(0.2), 2, 2, 10, weights=start, segments=open_segments(spark, str(tmp_path / "seg"), 16))
    assert same(blobs_of(direct.weights), blobs_of(stored.weights))
    weighted = fit(df, NET, Solver(0.2), 1, 2, 10, weights=start, weighted=True)
    counts = {r["worker"]: r["worker_rows"] for r in worker_counts(df).collect()}
    local = local_sgd_round(round_window(df, worker_counts(df), 2, 10, 0), start, NET, Solver(0.2), 4, 2, 10)
    parts = {w: blobs_of(local.filter(F.col("worker") == w)) for w in counts}
    mean = sum(parts[w]["ip", 0] * n for w, n in counts.items()) / sum(counts.values())
    assert np.allclose(blobs_of(weighted.weights)["ip", 0], mean)


def test_wrapped_window_reuses_rows(samples, start):
    df = assign_workers(samples, 4)
    window = round_window(df, worker_counts(df), 10, 20, 0, wrap=True)
    local = local_sgd_round(window, start, NET, Solver(0.1), 4, 10, 20)
    assert local.select("worker").distinct().count() == 4


def test_a_lost_task_changes_nothing(samples, start):
    df = assign_workers(samples, 4)
    window = round_window(df, worker_counts(df), 3, 10, 1)

    def fail_once(batches):
        for batch in batches:
            if TaskContext.get().attemptNumber() == 0:
                raise OSError("executor lost")
            yield batch

    broken = window.mapInArrow(fail_once, window.schema)
    results = [blobs_of(average_weights(local_sgd_round(w, start, NET, Solver(0.2, 0.9), 4, 3, 10, 1), 4)) for w in (window, broken)]
    assert same(*results, 0)


def test_batch_accuracy_leaves_out_the_rest(samples, start):
    df = assign_workers(samples, 3)
    scored = forward(df, NET, start, ["ip"], ["worker", "pos", "label"], element="double")
    hit = F.array_position("ip", F.array_max("ip")).cast("int") - 1
    counts = worker_counts(df)
    found = batch_accuracy(scored, hit, F.col("label"), 20, counts).first()
    rows = scored.withColumn("hit", (hit == F.col("label")).cast("int")).collect()
    sums = batches = 0
    for w in range(3):
        mine = sorted((r["pos"], r["hit"]) for r in rows if r["worker"] == w)
        for b in range(len(mine) // 20):
            sums += np.mean([h for _, h in mine[20 * b:20 * b + 20]])
            batches += 1
    assert found["batches"] == batches and found["accuracy"] == pytest.approx(sums / batches)
    assert accuracy(scored, hit, F.col("label")).first()["n"] == 240


def test_image_net_trains(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 256, 3072, "u1").tobytes(), i % 10) for i in range(24)]
    df = assign_workers(spark.createDataFrame(rows, "sample_id long, data binary, label int"), 2).cache()
    result = fit(df, cifar_net(), Solver(0.001, 0.9, 0.004, momentum_state="local"), 1, 2, 4, wrap=True, seed=1)
    assert result.history.first()["value"] > 0
    shapes = {k: v.shape for k, v in blobs_of(result.weights).items()}
    assert shapes == {(p.layer, p.blob): p.shape for p in cifar_net().params()}
    assert featurize(df, cifar_net(), result.weights, "ip1").count() == 24


def test_presets_run_from_raw_rows(spark, samples):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 256, 3072, "u1").tobytes(), i % 10) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, data binary, label int").repartition(2)
    for preset, net in (("cifar", softmax_regression(3072, 10)), ("imagenet-alexnet", softmax_regression(3072, 10))):
        result = train(preset, df, 2, 1, test=df, net=net, solver=Solver(1e-5), wrap=True,
                       conversions={"data": lambda c, t, shape: F.transform(float_vector(c, t, shape), lambda x: x / 255)})
        metrics = {r["metric"] for r in result.history.collect()}
        assert metrics == {"accuracy", "test_loss", "loss"}
    weights = init_weights(spark, cifar_net(), 1)
    features = extract_features("featurize", df.drop("label"), weights, "ip1")
    assert features.columns == ["sample_id", "ip1"] and {len(r["ip1"]) for r in features.collect()} == {64}
    with pytest.raises(Exception, match="column data is null"):
        train("cifar", df.withColumn("data", F.lit(None).cast("binary")), 2, 1, net=softmax_regression(3072, 10), wrap=True)


def test_scoring_a_stream(spark, samples, start, tmp_path):
    samples.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_stream(stream, lambda df: featurize(df, NET, start, "prob"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = featurize(samples, NET, start, "prob")
    assert streamed.count() == 240 and streamed.exceptAll(batch).count() == 0
    with pytest.raises(ValueError):
        write_stream(samples, lambda df: df, str(tmp_path / "o2"), str(tmp_path / "c2"))

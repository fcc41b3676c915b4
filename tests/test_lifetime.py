import os

import pytest
from pyspark.sql import functions as F

from gradloom.operators.workers import assign_workers
from gradloom.plans.fit import fit
from gradloom.plans.net import softmax_regression
from gradloom.plans.runs import train
from gradloom.plans.solver import Solver
from gradloom.session import checkpoint_root, lifetime, shared_path, stored


def folders(spark):
    """What this library has written into the shared folder; Spark's own checkpoints are numbered rdd-... in a folder of theirs."""
    return {name for name in os.listdir(checkpoint_root(spark).removeprefix("file:")) if not name.startswith("rdd-")}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(400).select(F.col("id").alias("sample_id"), F.array(F.rand(1), F.rand(2), F.lit(1.0)).alias("data"), (F.col("id") % 3).cast("int").alias("label")).cache()


def test_tables_go_with_their_block(spark):
    before = folders(spark)
    with lifetime(spark):
        stored(spark.range(3), "inner")
        with lifetime(spark):
            kept = stored(spark.range(4), "kept", outlives=True)
            stored(spark.range(5), "gone")
            shared_path(spark, "never-written")
        assert kept.count() == 4 and len(folders(spark) - before) == 2
        whole = stored(spark.range(6), "whole", outlives=True)
    assert whole.count() == 6 and len(folders(spark) - before) == 1
    with pytest.raises(ZeroDivisionError), lifetime(spark):
        stored(spark.range(3), "failed")
        1 / 0
    assert len(folders(spark) - before) == 1


@pytest.mark.parametrize("momentum", ["average", "local"])
def test_training_leaves_no_tables(spark, samples, momentum):
    net, before = softmax_regression(3, 3), folders(spark)
    assigned = assign_workers(samples, 2).cache()
    result = fit(assigned, net, Solver(0.1, momentum=0.5, momentum_state=momentum), 2, 2, 10, test=assigned, eval_every=1, test_batch=10)
    assert folders(spark) == before
    assert result.weights.count() == 2 and result.history.count() == 6
    result = train("cifar", samples, 2, 1, net=net, solver=Solver(0.1), wrap=True)
    assert folders(spark) == before and result.weights.count() == 2

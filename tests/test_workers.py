import os

import pytest
from pyspark.sql import functions as F

from gradloom.operators.joins import attach_labels, gather, hot_keys, missing_images, missing_labels, salted_join
from gradloom.operators.numbering import count_distinct, number_rows
from gradloom.operators.samples import persisted, widen
from gradloom.operators.workers import (any_of, assign_workers, assign_workers_in_place, open_positions, open_segments, position_window, round_starts,
                                        round_window, segment_window, skip_rows, worker_counts, write_positions, write_segments)


def placed(df):
    return {r["sample_id"]: (r["worker"], r["pos"]) for r in df.collect()}


@pytest.fixture()
def samples(spark):
    return spark.range(500).select(F.col("id").alias("sample_id"))


def test_positions_are_complete_and_stable(spark, samples):
    first = placed(assign_workers(samples, 3, seed=7))
    by_worker = {}
    for worker, pos in first.values():
        by_worker.setdefault(worker, []).append(pos)
    assert set(by_worker) == {0, 1, 2}
    assert all(sorted(p) == list(range(len(p))) for p in by_worker.values())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert placed(assign_workers(samples.repartition(5), 3, seed=7)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    other = placed(assign_workers(samples, 3, seed=8))
    assert {k: w for k, (w, _) in other.items()} == {k: w for k, (w, _) in first.items()} and other != first


def test_numbering_over_buckets_equals_a_sort(spark):
    df = spark.createDataFrame([(i % 2, (i * 37) % 101) for i in range(101)], "g int, k int")
    rows = number_rows(df, ["g"], F.col("k"), F.floor(F.col("k") / 9), "n").collect()
    for g in (0, 1):
        part = sorted((r["k"], r["n"]) for r in rows if r["g"] == g)
        assert [n for _, n in part] == list(range(len(part)))


def test_in_place_assignment(samples):
    with pytest.raises(ValueError, match="need as many partitions"):
        assign_workers_in_place(samples.coalesce(3), 8)
    df = assign_workers_in_place(samples.repartition(8), 4)
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    for worker in range(4):
        assert sorted(r["pos"] for r in rows if r["worker"] == worker)[0] == 0
    assert len(rows) == 500 and len({(r["worker"], r["pos"]) for r in rows}) == 500


def test_windows_hold_tau_batches(samples):
    df = assign_workers(samples, 4)
    counts = worker_counts(df)
    sizes = {r["worker"]: r["worker_rows"] for r in counts.collect()}
    seen = set()
    for round_no in range(4):
        rows = round_window(df, counts, 4, 10, round_no, seed=1).collect()
        for worker in range(4):
            mine = sorted((r["offset"], r["pos"], r["batch_id"]) for r in rows if r["worker"] == worker)
            assert [o for o, _, _ in mine] == list(range(40)) and [b for *_, b in mine] == [o // 10 for o in range(40)]
            start = mine[0][1]
            assert [p for _, p, _ in mine] == list(range(start, start + 40)) and start < sizes[worker] - 40
            seen.add((worker, start))
    assert len(seen) > 8


def test_small_workers_fail_or_wrap(samples):
    df = assign_workers(samples, 4)
    counts = worker_counts(df)
    with pytest.raises(Exception, match="rows for a window of 200"):
        round_window(df, counts, 10, 20, 0).collect()
    exact = counts.agg(F.min("worker_rows")).first()[0]
    with pytest.raises(Exception, match="has only"):
        round_starts(counts, 1, exact, 0).collect()
    rows = round_window(df, counts, 5, 20, 3, wrap=True).collect()
    assert all(sorted(r["offset"] for r in rows if r["worker"] == w) == list(range(100)) for w in range(4))


@pytest.mark.parametrize("wrap,regroup", [(False, False), (True, False), (True, True)])
def test_segments_give_the_same_window(spark, samples, tmp_path, wrap, regroup):
    df = assign_workers(samples, 4)
    counts = worker_counts(df)
    write_segments(df, str(tmp_path / "s"), 25, regroup)
    opened = open_segments(spark, str(tmp_path / "s"), 25)
    for round_no in range(3):
        stored = segment_window(opened, counts, 3, 10, round_no, 2, wrap)
        direct = round_window(df, counts, 3, 10, round_no, 2, wrap)
        assert {tuple(r) for r in stored.select(direct.columns).collect()} == {tuple(r) for r in direct.collect()}
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "segment" in plan.split("PartitionFilters:")[1].split("]")[0]


@pytest.mark.parametrize("wrap,rows", [(False, 30), (True, 7), (True, 1000)])
def test_sorted_files_give_the_same_window(spark, samples, tmp_path, wrap, rows):
    df = assign_workers(samples, 4)
    counts = worker_counts(df)
    path = str(tmp_path / "p")
    write_positions(df, path, rows)
    assert not [f for f in os.listdir(path) if "=" in f]  # no folder by worker or run
    opened = open_positions(spark, path, rows)
    for round_no in range(3):
        found = position_window(opened, counts, 3, 10, round_no, 2, wrap)
        direct = round_window(df, counts, 3, 10, round_no, 2, wrap)
        assert sorted(map(tuple, found.select(direct.columns).collect())) == sorted(map(tuple, direct.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(place" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]


def test_files_without_a_window_are_not_opened(spark, tmp_path):
    """Workers in place, a file each or several: a round of one worker opens only the files that its window lies in."""
    df = spark.range(0, 4000, numPartitions=8).select(F.col("id").alias("sample_id"), (F.col("id") % 500).alias("pos"), (F.col("id") / 500).cast("int").alias("worker"),
                                                      F.lit(500).cast("bigint").alias("worker_rows"))
    write_positions(df, str(tmp_path / "p"), 50)
    opened = open_positions(spark, str(tmp_path / "p"), 50)
    assert opened.places.count() == 80
    window = position_window(opened, worker_counts(df).where("worker = 3"), 1, 20, 0, start=F.lit(390))
    assert [r["pos"] for r in window.orderBy("pos").collect()] == list(range(390, 410)) and len(window.inputFiles()) == 1


def test_many_conditions(spark):
    wide = any_of([F.col("id") == i for i in range(0, 3000, 3)])
    assert spark.range(3000).where(wide).count() == 1000


def test_skip_and_persist(samples):
    with persisted(assign_workers(samples, 2)) as (df,):
        assert df.is_cached and skip_rows(df, 200).count() == df.filter("pos >= 200").count()
    assert not df.is_cached


def test_widen(samples):
    assert widen(samples.coalesce(1), 6).rdd.getNumPartitions() == 6


def test_salted_join_equals_plain_join_on_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).cast("int").alias("k"))
    right = spark.range(600).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    assert [tuple(r) for r in hot_keys(left, "k", 100).collect()] == [(7, 34)]
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("k", "id", "v")
        salted = salted_join(left, right, "k", how, tasks=100).select("k", "id", "v")
        assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_labels(spark):
    images = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "filename string, x int")
    table = spark.createDataFrame([("a", 5)], "filename string, label int")
    assert {tuple(r) for r in attach_labels(images, table, "drop").select("x", "label").collect()} == {(1, 5), (2, 5)}
    with pytest.raises(Exception, match="no label for b"):
        attach_labels(images, table).collect()
    with pytest.raises(ValueError):
        attach_labels(images, table, "ignore")
    assert [r[0] for r in missing_labels(images, table).collect()] == ["b"]
    assert {tuple(r) for r in gather(table, images).select("filename", "x").collect()} == {("a", 1), ("a", 2)}
    more = table.union(spark.createDataFrame([("c", 9), (None, 4)], table.schema))
    with pytest.raises(Exception, match="no image for"):
        gather(more, images).collect()
    assert gather(more, images, on_missing="drop").count() == 2
    assert {r[0] for r in missing_images(more, images).collect()} == {"c", None}
    with pytest.raises(ValueError):
        gather(more, images, on_missing="ignore")


def test_tasks_follow_rows(spark, samples, monkeypatch, capsys):
    """More rows are sorted and numbered by more tasks, to the same positions."""
    before = placed(assign_workers(samples, 3))
    monkeypatch.setattr("gradloom.session.TASK_ROWS", 50)
    df = assign_workers(samples, 3)
    df.explain()
    assert ", 10), REPARTITION_BY_NUM" in capsys.readouterr().out
    assert placed(df) == before


def test_distinct_counts_follow_rows(spark, monkeypatch, capsys):
    monkeypatch.setattr("gradloom.session.TASK_ROWS", 50)
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 40).alias("x"), F.col("id").alias("y"))
    counts = count_distinct(df, ["g"], ["x", "y"], 300)
    expected = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("x"), F.sum("x").alias("x_total"),
                                   F.countDistinct("y").alias("y"), F.sum("y").alias("y_total"))
    assert sorted(counts.collect()) == sorted(expected.collect())
    counts.explain()
    assert ", 12), REPARTITION_BY_NUM" in capsys.readouterr().out
    assert count_distinct(df.where("g > 5"), ["g"], ["x"], 0).count() == 0

"""Shared helpers: word hashes, sorted neighbours, prefix sums, components, bitmaps."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.llm import bitmap, near_duplicates
from gradloom.llm.components import components
from gradloom.llm.ranges import first_by_hash, neighbours, prefix_sums
from gradloom.llm.words import Words, lower_words
from gradloom.session import checkpoint_root, stored

TEXTS = ["", "One", "one two  THREE", "a-b c.d É é", "x " * 300, "\n\t", "one two three four five six"]


def test_words_of_a_batch_are_those_of_each_text():
    raw = [t.encode() for t in TEXTS]
    words = Words(raw)
    for i, text in enumerate(raw):
        assert words.words(i) == lower_words(text)
        alone = Words([text])
        at = slice(words.firsts[i], words.firsts[i] + words.counts[i])
        assert (alone.hashes == words.hashes[at]).all()
    assert len({int(h) for h in words.hashes}) == len({w for t in raw for w in lower_words(t)})


def test_shingles_of_short_and_long_texts():
    value, counts = Words([t.encode() for t in TEXTS]).shingles(5)
    assert counts.tolist() == [0, 1, 1, 2, 296, 0, 2] and len(value) == counts.sum()
    assert (Words([b"one two three four five"]).shingles(5)[0][0] == value[-2])


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_neighbours_connect_every_run(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rng = random.Random(3)
        rows = [(rng.choice([5, 5, 5, -7, rng.randrange(30)]), i) for i in range(400)]
        pairs = neighbours(spark.createDataFrame(rows, "k long, id long"), "k", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = dict((i, k) for k, i in rows)
    assert all(key[r["a"]] == key[r["b"]] == r["key"] for r in pairs) and len(pairs) <= 800
    parent = {i: i for i in key}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in pairs:
        parent[root(r["a"])] = root(r["b"])
    assert len({root(i) for i in key}) == len(set(key.values()))


def test_prefix_sums_with_null_key(spark):
    rows = [("a", i, i % 5) for i in range(50)] + [(None, i, 2) for i in range(20)] + [("b", 1, 9)]
    found = prefix_sums(spark.createDataFrame(rows, "k string, o int, v long"), "k", ["o"], "v").collect()
    assert len(found) == 71
    for r in found:
        assert r["before"] == sum(v for k, o, v in rows if k == r["k"] and o < r["o"])


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7)]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert label == {x: root(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_has_all_and_few_others(spark):
    values = [int(x) for x in np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500)] + [None]
    sent = bitmap.build(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    assert bitmap.contains(sent.value, np.array(values[:-1])).all()
    other = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 10_000)
    assert bitmap.contains(sent.value, other).sum() <= 1


def test_first_by_hash_is_bounded_and_whole(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    assert first_by_hash(df, 5000, 300).count() == 300
    assert first_by_hash(df, 5000, 9000).count() == 5000


def test_near_duplicates_leave_their_result_only(spark):
    """Tables on the way to the classes go, also those of the components' rounds; no checkpoint is written."""
    root = checkpoint_root(spark).removeprefix("file:")
    docs = stored(spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(20)], "doc_id long, text string"), "docs")
    before = {os.path.join(d, x) for d, names, _ in os.walk(root) for x in names}
    found = near_duplicates.near_duplicates(docs)
    after = {os.path.join(d, x) for d, names, _ in os.walk(root) for x in names} - before
    assert [x.rpartition("/")[2].rpartition("-")[0] for x in after if os.path.dirname(x) == root] == ["document-classes"]
    assert not [x for x in after if "/rdd-" in x]
    assert found.count() == 20 and found.select("class_id").distinct().count() == 10

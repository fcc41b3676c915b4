import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from gradloom.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
    rows = []
    for item, text in items:
        query, scored = Counter(terms(text)), []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(r * weight(t) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in query.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return rows


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "MIX", "x-y", "42"]
    law = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, law, k=rng.choice([1, 5, 40, 300])))) for i in range(n)]
    docs += [(7, docs[7][1])] * 60 + [(None, docs[3][1]), (n, None), (n + 1, ""), (n + 2, " .,; "), (n + 3, "w1 " * 70_000)]
    items = [(i, " ".join(rng.choices(vocabulary, law, k=rng.choice([1, 3, 12, 60])))) for i in range(40)]
    return docs, items + [(3, items[3][1]), (None, "w5 w6"), (90, None), (91, "..."), (92, "nowhere"), (93, "w0 " * 50)]


@pytest.mark.parametrize("shard,query_bytes", [(20_000, 500), (ls.SHARD_BYTES, ls.QUERY_BYTES)])
def test_as_brute_force(spark, shard, query_bytes):
    docs, items = corpus(2, 1500)
    index = ls.build_index(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, term int").repartition(3), shard_bytes=shard)
    found = ls.search(index, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int"), query_bytes=query_bytes)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], -r[3], r[2] is None, r[2] or 0)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_blocks_are_skipped():
    """Late documents that cannot enter are rejected without decompressing their blocks, and results stay those of all blocks."""
    rng = np.random.default_rng(4)
    n = 12_000
    doc, term, tf = [], [], []
    for t, share in enumerate([0.9, 0.8, 0.7, 0.01]):
        some = np.flatnonzero(rng.random(n) < share)
        doc.append(some)
        term.append(np.full(len(some), t))
        tf.append(rng.integers(1, 4, len(some)))
    doc, term, tf = (np.concatenate(x).astype(np.int64) for x in (doc, term, tf))
    lengths = rng.integers(5, 400, n)
    batch = ls.shard_row(term, doc, tf, list(range(n)), lengths)
    cells = {f: batch.column(f)[0] for f in batch.schema.names}
    row = {f: c.values if hasattr(c, "values") else c for f, c in cells.items()}
    shard = ls.Shard(row, n, int(lengths.sum()))
    weights = np.array([100, 200, 300, 4000])
    dense = np.zeros(n, np.int64)
    for t in range(4):
        docs, part = shard.postings(np.arange(shard.block_of[t], shard.block_of[t + 1]), shard.block_of[t])
        assert (docs == doc[term == t]).all()
        assert (part == shard.part(tf[term == t], shard.m[docs])).all()
        for b in range(shard.block_of[t], shard.block_of[t + 1]):
            at = slice((b - shard.block_of[t]) * ls.BLOCK, (b - shard.block_of[t] + 1) * ls.BLOCK)
            assert shard.block_best[b] == part[at].max()
        dense[docs] += weights[t] * part
    expected = sorted(range(n), key=lambda d: (-dense[d], d))[:20]
    best = ls.Best(20)
    ls.search_shard(shard, np.arange(4), weights, best)
    assert best.ids.tolist() == expected
    again = ls.Shard(row, n, int(lengths.sum()))
    ls.search_shard(again, np.arange(4), weights, best)
    assert best.ids.tolist() == sorted(expected * 2, key=lambda d: (-dense[d], d))[:20]
    assert 0 < again.read < 0.5 * int(shard.block_of[-1])


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 2**31, 2**40, 5])
    data, sizes = ls.varints(values)
    assert (ls.read_varints(data) == values).all() and sizes.tolist() == [1, 1, 1, 2, 2, 5, 6, 1]


def test_no_documents_or_items(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    assert ls.ranked(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], items)).count() == 0
    assert ls.ranked(spark.createDataFrame([(1, None), (2, "")], docs), spark.createDataFrame([(1, "a")], items)).count() == 0
    assert ls.ranked(some, spark.createDataFrame([], items)).count() == 0
    assert [tuple(r) for r in ls.ranked(some, spark.createDataFrame([(1, "a")], items)).collect()] == brute([(1, "a b")], [(1, "a")])


def test_shards_of_a_file_are_written_and_read_one_by_one(spark):
    """A task that makes many shards writes each as a row group of its own: what the reader decodes at once is one shard. Nor does the writer
    keep shards as statistics."""
    docs, items = corpus(5, 300)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "20")
    try:
        index = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), shard_bytes=2_000)
    finally:
        spark.conf.set(key, before)
    metas = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in index.inputFiles()]
    groups = [meta.row_group(i) for meta in metas for i in range(meta.num_row_groups)]
    assert len(groups) == index.count() > 10 and {group.num_rows for group in groups} == {1}
    assert not any(group.column(i).is_stats_set for group in groups for i in range(group.num_columns))
    some = items[:5]
    assert sorted(map(tuple, ls.search(index, spark.createDataFrame(some, "item_id long, text string")).collect())) == sorted(brute(docs, some))

import random

import numpy as np
import pytest

from gradloom.llm import suffixes
from gradloom.llm.words import lower_words


def brute(rows, least):
    where = {}
    for n, (_, text) in enumerate(rows):
        words = lower_words((text or "").encode())
        for p in range(len(words) - least + 1):
            where.setdefault(tuple(words[p:p + least]), set()).add(n)
    found = []
    for doc, text in rows:
        words, runs = lower_words((text or "").encode()), []
        for p in range(len(words) - least + 1):
            if len(where[tuple(words[p:p + least])]) > 1:
                if runs and runs[-1][1] == p - 1:
                    runs[-1][1] = p
                else:
                    runs.append([p, p])
        found += [(str(doc), b, e + least) for b, e in runs]
    return sorted(found)


def corpus():
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(n))
    passages = [fresh(n) for n in (10, 12, 13, 20, 40)]
    rows = [(i, " ".join([fresh(rng.randrange(30)), rng.choice(passages), fresh(rng.randrange(5)), passages[i % 5].upper(), fresh(rng.randrange(9))])) for i in range(120)]
    rows += [(500 + i, passages[4]) for i in range(200)]  # a passage that most documents hold
    rows += [(900, "inside " * 60), (901, fresh(12) + " " + " ".join([fresh(1)] * 1)), (902, None), (903, ""), (None, rows[0][1]), (904, "only " * 5), (905, fresh(70_000)), (906, "twice " * 40), (907, "twice " * 40)]
    rows += [(908, (p := fresh(15)) + " " + fresh(9) + " " + p)]  # repeats inside one document only
    return rows


@pytest.mark.parametrize("partitions", [2, 40])
def test_against_brute_force(spark, partitions):
    rows, before = corpus(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, begin_word int")
        found = suffixes.shared_passages(docs, least=12, anchor=6).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((str(r["doc_id"]), r["begin_word"], r["end_word"]) for r in found) == brute(rows, 12)
    words = {i: lower_words((t or "").encode()) for i, t in rows}
    for r in found:
        assert words[r["doc_id"]][r["begin_word"]:r["begin_word"] + 12] == words[r["other_doc_id"]][r["other_begin"]:r["other_begin"] + 12]


def test_empty_table(spark):
    assert suffixes.shared_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_window_has_its_least_value():
    rng = np.random.default_rng(1)
    counts = np.array([0, 3, 50, 26, 25, 200])
    value = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64)
    expected = {b + i + int(value[b + i:b + i + 26].argmin()) for b, n in zip(np.cumsum(counts) - counts, counts) for i in range(n - 25)}
    assert set(suffixes.minimisers(value, counts, 26).tolist()) == expected

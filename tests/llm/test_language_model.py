import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from gradloom.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        state, words = rng.randrange(20), []
        for _ in range(rng.randrange(200)):
            state = (state * 3 + rng.randrange(3)) % 20
            words.append(f"T{state}" if rng.random() < 0.9 else f"rare{rng.randrange(2000)}É")
        rows.append((i, "\t".join(words)))
    return rows + [(None, "T1 t2"), (301, None), (302, ""), (303, "T1 " * 50_000), (3, "again T1"), (3, "again T1")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_by_brute_force_and_a_better_model(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    scored = lm.score_texts(docs, docs.where(~lm.held_out()).select("text"), vocabulary=25, head=60).withColumn("held_out", lm.held_out())
    found = scored.collect()
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((str(i), held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total,
                       round(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens(x)), 5)) for i, x in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found) == expected
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_probabilities_sum_to_one():
    weights = lm.Weights.start(np.log(np.array([1e-9, 0.2, 0.5, 0.3])), 8)
    scorer = lm.Scorer(weights)
    for u in range(4):
        for v in range(4):
            words = np.arange(1, 4)
            assert abs((10 ** scorer.log10(np.full(3, u), np.full(3, v), words)).sum() - 1) < 1e-5


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = lm.score_texts(docs, docs.where("false").select("text")).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in found] == [(0, 0, 0.0)] * 2 and all(abs(r["score"]) < 1e-6 for r in found)
    assert lm.score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0

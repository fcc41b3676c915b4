"""Near duplicates and benchmark passages against brute force."""

import random

import numpy as np
import pytest

from gradloom.llm import decontaminate, near_duplicates as nd
from gradloom.llm.words import lower_words


def shingles(text):
    w = lower_words((text or "").encode())
    return [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def classes(rows, weighted=False):
    bags = [shingles(t) for _, t in rows]
    counts = [{s: (b.count(s) if weighted else 1) for s in set(b)} for b in bags]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(counts):
        for j in range(i):
            b = counts[j]
            common = sum(min(v, b.get(s, 0)) for s, v in a.items())
            if common >= 0.8 * (sum(a.values()) + sum(b.values()) - common) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(str(rows[i][0]))
    return sorted(sorted(g) for g in groups.values())


def corpus(seed=3):
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows = []
    for family in range(12):
        base = fresh(rng.choice([6, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 3, 8])):
            text = list(base)
            for _ in range(max(1, len(text) // 90)):
                text[rng.randrange(len(text))] = fresh(1)[0]
            rows.append(" ".join(text))
        rows.append(" ".join(base).upper())
    hot = fresh(200)
    for i in range(60):  # a large group, each copy with an own edit
        rows.append(" ".join(hot[:3 * i] + fresh(1) + hot[3 * i + 1:]))
    frame = fresh(100)
    for _ in range(30):  # half of each text is the same: similar signatures, but no duplicates
        rows.append(" ".join(frame + fresh(100)))
    rows += ["", "", None, "one", "One", "one two", "a b c d e", " ".join(fresh(20_000))] + ["exact copy of a short text here"] * 20 + ["junk " * 30, "junk " * 31]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("weighted", [False, True])
def test_classes_by_brute_force(spark, weighted):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class_id string")
    groups = {}
    for r in nd.near_duplicates(docs, weighted=weighted).collect():
        groups.setdefault(r["class_id"], []).append(str(r["doc_id"]))
    assert sorted(sorted(g) for g in groups.values()) == classes(rows, weighted)


def test_one_of_each_stays_and_empty_tables(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gone__ string, row_id long").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = nd.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = {str(r["doc_id"]) for r in kept.collect()}
    assert all(len(ids & set(g)) == 1 for g in classes(rows)) and len(ids) == len(classes(rows))
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("weights", [(1.0, 1.0), (3.0, 1.0), (0.3, 2.5)])
def test_signatures_agree_with_weighted_similarity(weights):
    rng, k, n = np.random.default_rng(1), 256, 120
    elements = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
    a, b = np.zeros(2 * n), np.zeros(2 * n)
    a[:n], b[n // 3:n + n // 3] = weights[0], weights[1]
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for shift in range(12):
        own = elements + np.uint64(shift)
        signature = [nd.dart_signatures(own[x > 0], x[x > 0], np.array([(x > 0).sum()]), k)[0] for x in (a, b)]
        agree.append((signature[0] == signature[1]).mean())
    assert abs(np.mean(agree) - truth) < 4 * np.sqrt(truth * (1 - truth) / (12 * k)) + 0.01


def test_links_that_neighbours_missed(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 30, nd.BANDS * nd.ROWS)
    signatures, sets = [], []
    for i in range(40):
        own = rng.integers(0, 1 << 30, len(base))
        own[:4] = base[:4]
        signatures.append(own)
        sets.append(sorted({int(x) for x in rng.integers(0, 1 << 60, 100)}))
    signatures[31] = np.where(rng.random(len(base)) < 0.9, signatures[7], signatures[31])
    sets[31] = sorted(sets[7][:92] + sets[31][:5])
    signatures[20] = signatures[8]  # alike by signature only
    signed = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(signatures)], "row_id long, signature array<int>")
    elements = spark.createDataFrame(list(enumerate(sets)), "row_id long, elements array<long>")
    labels = spark.createDataFrame([(5, 5), (6, 5)], "node long, label long")
    found = {tuple(sorted(r)) for r in nd.missed_links(nd.bands(signed), signed, elements, labels, 0.8, block=7).collect()}
    assert found == {(7, 31)}


def test_contained_items_by_brute_force(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
    items = [(i, " ".join(fresh(n))) for i, n in enumerate([5, 6, 12, 13, 20, 36, 59, 130, 300])] + [(20, None), (21, ""), (22, "one two"), (None, " ".join(fresh(30))), (3, "again " + " ".join(fresh(30)))]
    docs = [(i, " ".join(fresh(rng.choice([3, 50, 3000])))) for i in range(40)]
    for n, (_, text) in enumerate(items):
        words = (text or "").split()
        for share in (1.0, 0.9, 0.85, 0.5):
            part = words[:round(len(words) * share)]
            docs.append((100 * (n + 1) + round(share * 10), " ".join(fresh(rng.randrange(900)) + part + fresh(rng.randrange(900))).upper()))
    docs += [(9000, None), (9001, ""), (9002, "ONE two"), (None, items[5][1]), (9003, items[5][1]), (9003, items[5][1])]
    a = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["shared"], r["item_shingles"]) for r in decontaminate.contained_items(a, b).collect())
    sets = [(i, set(shingles(t))) for i, t in items]
    expected = sorted((str(d), str(i), len(s & own), len(s)) for d, t in docs for own in [set(shingles(t))] for i, s in sets if s and len(s & own) >= 0.8 * len(s) - 1e-9)
    assert found == expected
    assert decontaminate.contained_items(a, b.where("false")).count() == 0 and decontaminate.contained_items(a.where("false"), b).count() == 0
    assert decontaminate.without_items(a, b).count() == len(docs) - len({x[0] for x in expected if x[0] not in ("None", "9003")}) - 3


def test_no_short_item_is_lost(spark):
    """1,000 items of five words, and some of six to nine, each inside a document of 400 shingles."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(5 if i < 1000 else 6 + i % 4))) for i in range(1100)]
    docs = []
    for i, text in items:
        words = [word() for _ in range(400)]
        at = rng.randrange(400)
        docs.append((i, " ".join([*words[:at], text, *words[at:]])))
    found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i, _ in items}

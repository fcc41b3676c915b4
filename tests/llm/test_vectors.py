import numpy as np
import pytest

from gradloom.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, vector string"


def brute(rows, k=20):
    vectors = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = [i for i, _ in vectors], np.array([v for _, v in vectors], np.float32).astype(float)
    found = {}
    for n, i in enumerate(ids):
        if i is not None and i % 20 == 0:
            score = x @ x[n]
            order = sorted((m for m in range(len(ids)) if m != n), key=lambda m: (-score[m], ids[m] is None, ids[m] or 0))
            found.setdefault(i, []).append([(ids[m], score[m]) for m in order[:k]])
    return found


@pytest.mark.parametrize("unit", [64, 8192])
def test_recall_and_order(spark, unit):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16))
    values = centres[rng.integers(0, 10, 1200)] * 0.7 + rng.normal(size=(1200, 16)) * 0.5
    values[300:700] = values[300]  # a third of all rows is one vector
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(values)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [None] + [1.0] * 15), (2080, [float("nan")] * 16), (2100, [float("inf")] * 16), (None, rows[5][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA).repartition(3)
    found = {}
    for r in vector_search.nearest(df, unit=unit).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    expected = brute(rows)
    assert set(found) == set(expected)
    hits = 0
    for query, ranks in found.items():
        assert sorted(ranks) == list(range(1, 21))
        scores = [ranks[i][1] for i in sorted(ranks)]
        assert scores == sorted(scores, reverse=True)
        true = np.array([s for _, s in expected[query][0]])
        hits += (np.isclose(scores, true)).sum()
        if np.allclose(scores, true) and query < 300:
            assert [v for v, _ in (ranks[i] for i in sorted(ranks))] == [v for v, _ in expected[query][0]]
    assert hits / (20 * len(found)) >= 0.9


def test_few_and_no_vectors(spark):
    few = vector_search.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [0.5, 0.5], 0, ""), (40, [0.0, 2.0], 0, "")], SCHEMA)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few) == [(0, 1, 1, 0.5), (0, 2, 40, 0.0), (40, 1, 1, 1.0), (40, 2, 0, 0.0)]
    assert vector_search.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chi_square_quantile():
    assert abs(vector_search.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(vector_search.chi_square_quantile(0.5, 2) - 2 * np.log(2)) < 1e-9

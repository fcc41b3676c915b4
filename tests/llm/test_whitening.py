import numpy as np
import pytest

from gradloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, component string"


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) @ (rng.normal(size=(width, width)) / np.sqrt(width)) + rng.normal(size=width)
    return x.astype(np.float32)


def brute(values):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in values]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    covariance = y.T @ y / n
    e, u = np.linalg.eigh(covariance)
    return n, [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x], e[::-1], y @ u[:, ::-1] / np.sqrt(np.abs(e[::-1]))


@pytest.mark.parametrize("n,width,block,parts", [(300, 12, 1, 3), (900, 40, 50, 40), (900, 40, None, 2), (30, 64, None, 4)])
def test_as_brute_force(spark, n, width, block, parts):
    values = vectors(n, n, width)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(values)]
    odd = [(-1, None, ""), (-2, [], ""), (-3, [float("nan")] * width, ""), (-4, [None] * width, ""), (-5, [float("inf")] + [0.0] * (width - 1), ""), (-6, [1.0, 2.0], ""), (-7, [2.0**50] * width, "")]
    found = w.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(parts), block=block).collect()
    count, deviation, e, z = brute(values)
    k = min(8, width, n - 1)
    assert len(found) == n * k and {r["n"] for r in found} == {n}
    got = np.zeros((n, k))
    for r in found:
        assert r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    for c in range(k):
        assert min(np.abs(got[:, c] - z[:, c]).max(), np.abs(got[:, c] + z[:, c]).max()) < 1e-7


def test_repeats_and_flat_components(spark):
    """A third of the rows is one vector, two entries are constant, two are equal: fewer components than entries."""
    values = vectors(5, 90, 6)
    values[:30] = values[0]
    values[:, 4] = 3.0
    values[:, 5] = values[:, 3]
    rows = [(i % 80 if i else None, v.tolist(), "") for i, v in enumerate(values)]
    found = w.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(found) == 90 * 4 and max(r["identity_error"] for r in found) < 1e-9
    assert sum(r["explained"] for r in found if r["vec_id"] == 1) == pytest.approx(2 if sum(1 for r in rows if r[0] == 1) == 2 else 1)


def test_no_rows_and_no_variance(spark):
    assert w.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, None, ""), (2, [], "")], SCHEMA)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, [1.0, 2.0], "")] * 5, SCHEMA)).count() == 0


def test_large_deviations():
    model = w.Whitening(3, [0, 0], np.ones(1), np.eye(2)[:, :1], 1.0)
    x = np.array([[2**40, 1], [5, -2]], np.int64)
    assert model.deviations(x) == [None, 9 * 29]


@pytest.mark.parametrize("width", [1, 5, 33])
def test_rank_one_updates(width):
    """Equal eigenvalues, entries of nothing and updates along an eigenvector: eigenpairs stay those of the sum."""
    rng = np.random.default_rng(width)
    values, basis = np.sort(rng.integers(0, 4, width)).astype(float), np.linalg.qr(rng.normal(size=(width, width)))[0]
    whole = basis * values @ basis.T
    for update in [rng.normal(size=width), basis[:, 0] * 3, np.zeros(width), rng.normal(size=width) * 1e-9, rng.normal(size=width) * 1e5]:
        values, basis = w.rank_one(values, basis, update)
        whole = whole + np.outer(update, update)
        size = max(np.abs(values).max(), 1e-300)
        assert np.abs(basis.T @ basis - np.eye(width)).max() < 1e-13
        assert np.abs(basis * values @ basis.T - whole).max() <= 1e-13 * size
        assert (np.diff(values) >= 0).all()

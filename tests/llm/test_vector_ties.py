import numpy as np
import pytest

from gradloom.llm import vector_search


@pytest.mark.parametrize("unit", [64, 8192])
def test_copies_go_by_their_ids(spark, unit):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(900, 13))
    values[200:600] = 3 * values[200]
    order = [int(i) for i in rng.permutation(900)]  # rows are not in the order of their ids
    rows = [(None, [float(x) for x in values[200]])] * 30 + [(i, [float(x) for x in values[i]]) for i in order]
    found = {}
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), unit=unit).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for query in range(200, 600, 20):
        assert [found[query][i] for i in range(1, 21)] == [i for i in range(200, 221 + (query <= 220)) if i != query][:20]

import re

import pytest

from gradloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, epochs=3):
    """Give by weight, cut at the limit, give the excess again, until nothing is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                open_.discard(s)
    return target


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, target string")


@pytest.mark.parametrize("rows", [
    [(i, "w " * (i % 7), ["a", "b", "é", "Z", None][i % 5]) for i in range(200)] + [(3, "w w w", "a"), (None, "x\ty z", "b"), (None, None, "c")],
    [(i, "w " * 50, "hot") for i in range(300)] + [(1000 + i, "w", s) for i, s in enumerate("abcdefgh")],
    [(1, "", "a"), (2, None, None)], [(1, "one", "a")]])
def test_targets_and_cut(spark, rows):
    found = mixing.mix_sources(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix_sources(documents(spark, rows[::-1])).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_empty_table(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0

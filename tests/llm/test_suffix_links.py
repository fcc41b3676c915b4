import random

import pytest
from test_suffixes import corpus

from gradloom.llm import suffixes
from gradloom.llm.words import lower_words


def holders(found):
    """By source and place: the (row, place) that are linked to it."""
    there = {}
    for r in found:
        assert r["links"][0]["begin_word"] == r["begin_word"] and r["links"][-1]["end_word"] == r["end_word"]
        for link in r["links"]:
            for p in range(link["begin_word"], link["end_word"] - 11):
                there.setdefault((link["source_row"], link["source_begin"] + p - link["begin_word"]), set()).add((r["row_id"], p))
    return there


@pytest.mark.parametrize("partitions", [2, 40])
def test_links_give_all_holders_of_every_window(spark, partitions):
    rng, before = random.Random(8), spark.conf.get("spark.sql.shuffle.partitions")
    fresh = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    one, two, passage = fresh(30), fresh(30), fresh(40)
    groups = [(2000, f"{one} {passage}"), (2001, f"{one} {passage}"), (2002, f"{two} {passage}"), (2003, f"{two} {passage}")]
    rows = [(n, text) for n, (_, text) in enumerate(corpus() + groups)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = suffixes.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"), least=12, anchor=6).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    row_of = {r["doc_id"]: r["row_id"] for r in found}
    expected = {}
    for doc, text in rows:
        words = lower_words((text or "").encode())
        for p in range(len(words) - 11):
            expected.setdefault(tuple(words[p:p + 12]), set()).add((row_of.get(doc), p))
    expected = [sorted(h) for h in expected.values() if len({r for r, _ in h}) > 1]
    assert sorted(sorted(h) for h in holders(found).values()) == sorted(expected)
    last = len(rows) - 4
    assert [len(r["links"]) for r in sorted(found, key=lambda r: r["doc_id"]) if r["doc_id"] >= last] == [1, 1, 2, 2]

"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from gradloom.llm import privacy
from gradloom.session import stored
from test_duplicates import classes, shingles


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], folder), name))
    return docs


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_columns_and_methods(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert all(df.schema.names == stages[0].schema.names for df in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows_of(stages[1])}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    toxic = [i for i, t in labels.items() if t]
    assert sum(i not in kept for i in toxic) >= 0.8 * len(toxic)


def test_one_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in rows_of(stages[1])]
    after = {str(r["doc_id"]) for r in rows_of(stages[2])}
    assert all(len(after & set(group)) == 1 for group in classes(before)) and len(after) == len(classes(before))


def test_benchmark_documents_go(spark, folder, stages):
    items = [set(shingles(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = {r["doc_id"]: set(shingles(r["text"])) for r in rows_of(stages[2])}
    expected = {i for i, own in before.items() if not any(len(s & own) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert {r["doc_id"] for r in rows_of(stages[3])} == expected and len(expected) < len(before)


def test_personal_data_is_replaced(stages):
    before, after = ({r["doc_id"]: r for r in rows_of(df)} for df in stages[3:5])
    assert set(before) == set(after)
    changed = 0
    for i, row in after.items():
        spans = privacy.base_spans(before[i]["text"])
        assert not privacy.base_spans(row["text"]) and row["n_chars"] == len(row["text"])
        assert Counter(re.findall(r"\[(?:email|ip|card|phone)\]", row["text"]))["[email]"] == sum(k == 0 for _, k, _ in spans)
        keys = re.findall(r"\b[0-9a-f]{40}\b", before[i]["text"])
        assert row["text"].count("[secret]") >= len(keys) and not any(k in row["text"] for k in keys)
        if not spans and not keys:
            assert row == before[i]
        changed += bool(spans)
    assert changed


def test_the_mixture_takes_its_targets(stages):
    taken, target = Counter(), {}
    for r in rows_of(stages[5]):
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and stages[5].count() == stages[4].count()


def test_run_gives_the_same_rows(spark, folder, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, stages[5].collect()))


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [None, "", "one", "a b c d e f g h", "a b c d e f g h", long, "mail x.y@corp.example now " + "k l m n o p q r s t", "\x00 \U0001F600 é"]
    rows = [(i, t, "en", None if i % 3 == 0 else "s", None, 7, 0.9, "p", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id here at all", None, None, 3, None, None, None, None)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, row_id int, score double, passages string, gone int"


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_go_through_all_stages(spark, tmp_path, empty):
    """Null, empty and very long texts, null ids and sources, repeated rows, clashing columns; and no rows at all."""
    folder = str(tmp_path)
    spark.createDataFrame([] if empty else odd_rows(), ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "k l m n o"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == [f.split()[0] for f in ODD.split(", ")]
        kept.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    # No label of both classes: nothing is toxic. Texts without words are one group, the equal ones another; row 6 holds a benchmark item.
    ids = [] if empty else ["0", "1", "2", "3", "3", "4", "5", "6", "7", "None"]
    assert kept[0] == ids and len(kept[1]) == (0 if empty else 7)
    assert kept[2] == [i for i in kept[1] if i != "6"] == kept[3]
    found = corpus_pipeline.run(spark, folder)
    assert sorted(str(r["doc_id"]) for r in found.collect()) == kept[3]
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found.collect())

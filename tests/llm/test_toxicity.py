import random
import zlib

from gradloom.llm import toxicity

BAD = ["awful", "nasty", "vile"]


def corpus():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))]
        toxic = i % 5 == 2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD) + rng.choice(["", "ly", "ness", f"x{i}"]))
        docs.append((i, " ".join(words), 7))
        if i % 3:
            labels.append((i, 0, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, passages int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_texts(spark):
    docs, labels = corpus()
    docs += [(None, "w1 w2", 7), (900, None, 7), (901, "", 7), (902, "w1 " * 60_000, 7), (903, "w1 " * 2000 + "awful nasty vile awfulness " + "w2 " * 2000, 7), (5, "w5", 7)]
    labels += [(None, 0, 1), (3, 0, None), (1, 0, 0), (1, 0, 0)]
    found = toxicity.score_toxicity(*frames(spark, docs, labels)).collect()
    assert len(found) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    row = {r["doc_id"]: r for r in found}
    held = [r for r in found if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 2) for r in held) >= 0.95 * len(held)
    assert row[903]["predicted"] == 1 and 1998 <= row[903]["passages"][0]["begin"] <= 2004
    assert row[900]["score"] == row[901]["score"] < 0.5 and row[902]["predicted"] == row[None]["predicted"] == 0


def test_a_repeated_labelled_id_counts_once(spark, monkeypatch):
    """A third of all rows holds one labelled id: what is learned from, and what reaches the driver, is one text for each label."""
    docs, labels = corpus()
    seen = []
    original = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda texts, *rest: (seen.append(texts.count()), original(texts, *rest))[1])
    model = toxicity.fit(*frames(spark, docs, labels))
    many = spark.createDataFrame(docs, "doc_id long, text string, passages int").unionByName(
        spark.range(20_000).selectExpr("1L AS doc_id", "concat('w1 w2 copy', id) AS text", "7 AS passages"))
    again = toxicity.fit(many, frames(spark, docs, labels)[1])
    assert seen == [len(labels), len(labels)]
    scores = [[r["score"] for r in toxicity.score_texts(frames(spark, docs, labels)[0].drop("passages"), m, score="score").orderBy("doc_id").collect()] for m in (model, again)]
    assert sum((a >= 0.5) == (b >= 0.5) for a, b in zip(*scores)) >= 0.97 * len(docs)


def test_no_labels_and_no_rows(spark):
    docs, _ = corpus()
    assert {r["score"] for r in toxicity.score_toxicity(*frames(spark, docs[:5], [])).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score_toxicity(*frames(spark, docs[:5], [(1, 0, 1)])).collect()} == {0.0}
    assert toxicity.score_toxicity(*frames(spark, [], [])).count() == 0


def test_segments_are_maximal():
    rng = random.Random(2)

    def recursive(scores, begin):
        best = None
        for i in range(len(scores)):
            total = 0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] or total == best[0] and j - i < best[2] - best[1]):
                    best = (total, i, j)
        if best is None:
            return []
        total, i, j = best
        return recursive(scores[:i], begin) + [(begin + i, begin + j + 1)] + recursive(scores[j + 1:], begin + j + 1)

    for _ in range(300):
        scores = [rng.choice([-3.25, -1.5, 2.125, 0.875, 4.0625]) * rng.random() for _ in range(rng.randrange(14))]
        assert [(b, e) for b, e, _ in toxicity.segments(scores)] == recursive(scores, 0)
        assert all(abs(sum(scores[b:e]) - s) < 1e-9 for b, e, s in toxicity.segments(scores))

import random

from gradloom.llm import licenses

PAIRS = [("bsd", "mit-release"), ("bsd", "apache-2.0"), ("bsd", "gpl-3.0"), ("isc", "mit-release"), ("mit-notice", "gpl-2.0")]


def test_every_notice_of_a_text_is_found(spark):
    notice = {label: text for label, (text, _) in licenses.NOTICES.items()}
    texts = [f"{notice[a]}. And: {notice[b]}." for a, b in PAIRS] + [". ".join(notice.values())]
    # A long text with a dozen licence words that are rarer than those of the notice.
    texts.append("persons " * 9 + "person files charge copy obtaining associated documentation redistribution binary forms met conditions permitted provided " * 400 + notice["mit-release"])
    texts += [notice[label] for label in ("mit-release", "apache-2.0", "gpl-3.0", "gpl-2.0")] * 30 + ["plain words"] * 200
    random.Random(1).shuffle(order := list(range(len(texts))))
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")).collect()}
    for i, pair in enumerate(PAIRS):
        assert set(pair) <= set(found[i])
    assert set(notice) <= set(found[len(PAIRS)]) and "mit-release" in found[len(PAIRS) + 1]

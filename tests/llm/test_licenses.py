import re

from gradloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", "nothing here", "MIT License, mit-license; the MIT\nlicense", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.", "apache apache license license apache  LICENSE",
         "Licensed under CC BY-NC 4.0.", "x " * 30000 + "This work is licensed under the GNU General Public License, version 2", "mit", "license mit", "general public",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "Mité license"]


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_against_brute_force(spark):
    rows = [(None if i == 2 else i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for i, text in enumerate(TEXTS):
        words, row = words_of(text), by_id[None if i == 2 else i]
        starts = {label: [p for p in range(len(words)) if words[p:p + len(phrase.split())] == phrase.split()] for phrase, label in licenses.BASE_PHRASES.items()}
        every = [p for v in starts.values() for p in v]
        base = sorted(label for label, v in starts.items() if v)
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (
            len(words), len(every), min(every, default=None), max(every, default=None), ",".join(base))
        assert set(base) <= set(row["labels"].split(",")) or not base
        assert row["labels"] == ",".join(sorted(set(row["labels"].split(",")))) and 0 <= row["score"] <= 1
    assert "mit-release" in by_id[4]["labels"] and "apache-2.0" in by_id[5]["labels"] and "gpl-3.0" in by_id[6]["labels"]
    assert by_id[8]["labels"] == "cc-by-nc-4.0" and "gpl-2.0" in by_id[9]["labels"] and "mit-notice" in by_id[13]["labels"]
    assert by_id[7]["labels"] == "apache" and by_id[None]["labels"] == ""


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0

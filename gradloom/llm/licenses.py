"""Licence scans by a positional index of rare words.

The templates' words of the highest inverse document frequency (counted over all texts) are indexed with their positions. All
occurrences of them in a text are looked up; each votes for a template at a relative position (text position less template
position); postings that agree on it are a candidate, which must hold the template's mandatory phrases there. The base phrases
are found in the same index by their rarest word, at every place.

Defined cases: a null text is empty; an empty text has no words, no labels and score 0. Repeated rows are scanned each.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradloom.llm.words import lower_words, texts_of

# The base phrases with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short public licence notices, and phrases that a text must hold at the place where a notice is found.
NOTICES = {
    "agpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
                 ["gnu affero general public license"]),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            ["redistribution and use in source and binary forms"]),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    "cc-by-4.0": ("Licensed under CC BY 4.0", ["cc by 4 0"]),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            ["permission to use copy modify and or distribute this software"]),
    "lgpl": ("GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    "mit-notice": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
                   ["permission is hereby granted free of charge"]),
    "mit-release": ("Released under the MIT License", ["mit license"]),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    "proprietary": ("All rights reserved. No part of this work may be reproduced without permission", ["all rights reserved"]),
    "unlicense": ("This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
}


class Index:
    """Postings (template, position) by word, for notices and base phrases. Its size is that of the templates alone."""

    def __init__(self, notices=NOTICES, base=BASE_PHRASES):
        self.templates = [(label, lower_words(text.encode()), [lower_words(p.encode()) for p in must]) for label, (text, must) in notices.items()]
        self.base = [(lower_words(phrase.encode()), label) for phrase, label in base.items()]
        self.words = sorted({w for _, text, must in self.templates for w in (*text, *(x for p in must for x in p))} | {w for p, _ in self.base for w in p})


def document_counts(df: DataFrame, text: str, words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of texts, and of texts with each of these words, over all rows; a few numbers by task."""
    wanted = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            for value in texts_of(batch.column(text)):
                n += 1
                found.update(wanted.intersection(lower_words(value)))
        rows = [(None, n), *found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=["word", "n"])

    sums = df.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {None if w is None else bytes(w): n for w, n in sums}
    return found.pop(None, 0), found


class Scanner:
    def __init__(self, index: Index, n: int, counts: dict[bytes, int], rare_idf: float, least: int):
        self.idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in index.words}
        self.index, self.least = index, least
        order = lambda w: (-self.idf[w], w)
        #: A phrase is looked up by its rarest word, and checked around it.
        self.base = []
        for phrase, label in index.base:
            key = min(phrase, key=order)
            self.base.append((phrase, label, key, phrase.index(key)))
        # Words that are frequent in the corpus do not vote; every template keeps its own rarest few.
        self.postings = defaultdict(list)
        for t, (_, text, _) in enumerate(index.templates):
            own = sorted(set(text), key=order)
            kept = {w for i, w in enumerate(own) if i < least or self.idf[w] >= rare_idf}
            for q, w in enumerate(text):
                if w in kept:
                    self.postings[w].append((t, q))
        self.wanted = frozenset(self.postings) | {key for _, _, key, _ in self.base}

    def scan(self, text: bytes):
        """n_words, n_base, first, last, base labels, notice labels, score."""
        words = lower_words(text)
        there = self.wanted.intersection(words)
        if not there:
            return len(words), 0, None, None, [], [], 0.0
        places = {w: [] for w in there}
        for i, w in enumerate(words):
            if w in there:
                places[w].append(i)
        starts, base = [], set()
        for phrase, label, key, at in self.base:
            found = [p - at for p in places.get(key, ()) if p >= at and words[p - at:p - at + len(phrase)] == phrase]
            starts += found
            if found:
                base.add(label)
        labels, score = set(), 0.0
        votes = defaultdict(set)
        for w in there & self.postings.keys():
            for p in places[w]:
                for t, q in self.postings[w]:
                    votes[t, p - q].add(w)
        for (t, at), agreeing in votes.items():
            label, template, must = self.index.templates[t]
            if len(agreeing) < min(self.least, len(set(template))):
                continue
            near = words[max(0, at - 2):max(0, at) + len(template) + 2]
            if not all(holds(near, phrase) for phrase in must):
                continue
            aligned = sum(self.idf[w] for i, w in enumerate(template) if 0 <= at + i < len(words) and words[at + i] == w)
            labels.add(label)
            score = max(score, aligned / (sum(self.idf[w] for w in template) or 1.0))
        if starts:
            score = max(score, 0.5)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), min(1.0, score)


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i] == phrase[0] and words[i:i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def scan_licenses(df: DataFrame, id_column: str = "doc_id", text: str = "text", rare_idf: float = 1.5, least: int = 3,
                  notices=NOTICES, base=BASE_PHRASES) -> DataFrame:
    """One row per text. A notice is found when `least` of its rare words agree on its place, whatever else the text holds.

    Two scans, no shuffle but a few counters: the first counts in how many texts each licence word stands, the second scans.
    """
    index = Index(notices, base)
    scanner = Scanner(index, *document_counts(df, text, index.words), rare_idf, least)
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanner.scan(value) for value in texts_of(batch.column("text"))]
            if rows:
                n_words, n_base, first, last, base_labels, labels, score = zip(*rows)
                both = [",".join(sorted({*b, *o})) for b, o in zip(base_labels, labels)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)),
                                                  pa.array([",".join(b) for b in base_labels], pa.string()), pa.array(both, pa.string()),
                                                  pa.array(score, pa.float64())], names=[f.split()[0] for f in schema.split(", ")])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, schema)

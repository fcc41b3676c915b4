"""Personal data: spans by pattern, and terms that reveal them, by information-theoretic sanitisation.

Emails, IP addresses, card and phone numbers are protected entities. For every entity value e and every term t within `reach` words
of it, the corpus says how much t reveals of e: PMI(e; t) = log2(N n(e, t) / (n(e) n(t))), with n counted in documents, against
the information IC(e) = log2(N / n(e)) that e holds. A term that reveals at least `remove` of it is removed, one that reveals at
least `generalise` is replaced by its shape, wherever it stands near that entity.

Small counts are judged by significance: if e and t met by chance, their n(e) n(t) / N expected meetings would give as many
different contexts as were seen with a probability (Poisson) that, times the number of pairs looked at, must be below `chance`. Copies
of one text are one context and prove nothing; two contexts of a rare entity do. An entity seen once is pooled with its parts: a
term that is a part of an address near it is one more meeting of the two.

A term can also disclose by itself what nobody could guess: a key or password. The letters of all texts give the information of
each step from letter to letter; a word that holds `secret` bits more than its length would hold on average, letters and digits mixed, is a span of kind secret.

Defined cases: a null text is empty; it stays null when sanitised. Null ids stay null: rows are counted, not ids. Repeated rows
count each, their contexts once. Offsets are code points, ends exclusive. Overlapping spans are all listed; sanitising covers
them by one replacement, that of the first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradloom.llm import bitmap
from gradloom.llm.words import Words, distinct_by_text, fresh, mix, scanned, slices, small, summed, with_row_id
from gradloom.session import stored

KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]", "secret": "[secret]"}
REACH, CHANCE, REMOVE, GENERALISE, SECRET = 8, 0.01, 0.8, 0.5, 64.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # both cases: offsets are those of the text
_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them from left to right, but led by the @ signs, so that long runs of letters cost nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and _LOCAL.match(text, begin - 1):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1)
        if begin < at and domain:
            found.append((begin, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers in a row of dotted numbers, from the left; those with a part over 255 are dropped."""
    found = []
    for run in _DOTTED.finditer(text):
        parts, at, ends = run.group().split("."), run.start(), []
        for part in parts:
            ends.append((at, at + len(part)))
            at += len(part) + 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i:i + 4]):
                found.append((ends[i][0], ends[i + 3][1]))
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    found = [(b, 0, e) for b, e in emails(text)] if "@" in text else []
    if "." in text:
        found += [(b, 1, e) for b, e in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


SPAN = "struct<start:int,kind:string,end:int>"
SCANNED = f"row_id long, doc_id long, base array<{SPAN}>, secrets array<{SPAN}>, context array<struct<entity:long,term:long,context:long,start:int,end:int>>"


def _hash(texts: list[str]) -> list[int]:
    """Hash of each text's first word, as `Words` gives it for all other texts too."""
    return Words([t.encode() for t in texts]).hashes.view(np.int64).tolist() if texts else []


def _contexts(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int, int, int]]:
    """(entity, term, context, start, end) of the terms near each entity; none of them lies in a span."""
    rows, inside = [], [(b, e) for b, _, e in spans]
    for start, kind, end in spans:
        # Far enough to hold the words of the reach unless they are very long; then the context is shorter.
        left, right = max(0, start - 40 * reach), min(len(text), end + 40 * reach)
        before = [m for m in _WORD.finditer(text, left, start) if m.start() > left or left == 0][-reach:]
        after = [m for m in _WORD.finditer(text, end, right) if m.end() < right or right == len(text)][:reach]
        terms = [m for m in (*before, *after) if m.end() - m.start() >= 3 and not any(b < m.end() and m.start() < e for b, e in inside)]
        value = text[start:end].translate(_LOWER) if kind == 0 else _digits(text[start:end]) if kind != 1 else text[start:end]
        hashes = _hash([m.group() for m in terms])
        # An entity's value is hashed by its words and its kind; a context by its terms in order.
        entity, context = np.array([kind + 1], np.uint64), np.array([kind + 1], np.uint64)
        for h in Words([value.encode()]).hashes:
            entity = mix(entity + h)
        for h in hashes:
            context = mix(context + np.array([h], np.int64).view(np.uint64))
        rows += [(int(entity.view(np.int64)[0]), h, int(context.view(np.int64)[0]), m.start(), m.end()) for h, m in zip(hashes, terms)]
        if kind == 0:
            # A part of the address that stands near it: the two have met once more, in the address itself.
            parts = set(Words([value.encode()]).hashes.view(np.int64).tolist())
            rows += [(int(entity.view(np.int64)[0]), h, OWN_PART, m.start(), m.end()) for h, m in zip(hashes, terms) if h in parts]
        rows.append((int(entity.view(np.int64)[0]), 0, int(context.view(np.int64)[0]), start, end))
    return rows


#: Digits, letters, any other, and the place before a word, as classes of bytes in a lower-cased buffer; and how many classes there are.
LETTERS = np.full(256, 36, np.int64)
LETTERS[48:58], LETTERS[97:123], LETTERS[32] = np.arange(10), np.arange(10, 36), 37
CLASSES = 38
#: Terms that a counting task holds.
HELD = 400_000
#: The context of a term that is a part of the entity.
OWN_PART = 1


def letter_information(rows: DataFrame) -> np.ndarray:
    """(from, to): bits that a letter after another holds beyond those of an average letter, over the words of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for _, texts in slices(batches, "text", 1 << 20):
            letters = LETTERS[np.frombuffer(b" " + Words(texts).buffer, np.uint8)]
            total += np.bincount(letters[:-1] * CLASSES + letters[1:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["step", "n"])

    n = np.zeros(CLASSES * CLASSES)
    for step, times in rows.select("text").mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n")).collect():  # a row for each step
        n[step] = times
    n = n.reshape(CLASSES, CLASSES)
    bits = -np.log2((n + 1) / (n.sum(axis=1, keepdims=True) + CLASSES))
    inside = n[:, :37]
    return bits - (inside * bits[:, :37]).sum() / max(inside.sum(), 1)


def secrets(texts: list[bytes], information: np.ndarray, least: float) -> list[list[tuple[int, int]]]:
    """(start, end) in code points of the words of letters and digits that hold at least `least` bits more than words of their length, even
    if a step that a word repeats counts once. A long word of letters alone, or a row of equal letters, is no secret.
    """
    words = Words(texts)
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    letters = LETTERS[np.frombuffer(b" " + words.buffer, np.uint8)]
    total = np.append(0.0, np.cumsum(information[letters[:-1], letters[1:]]))
    for i in np.flatnonzero(total[words.ends] - total[words.starts] >= least):
        own = letters[words.starts[i] + 1:words.ends[i] + 1]
        steps = np.unique(letters[words.starts[i]:words.ends[i]] * CLASSES + own)
        if own.min() > 9 or own.max() < 10 or information.ravel()[steps].sum() < least:
            continue
        text = int(np.searchsorted(words.offsets, words.starts[i], side="right")) - 1
        begin, end = (int(x - words.offsets[text]) for x in (words.starts[i], words.ends[i]))
        start = len(texts[text][:begin].decode())
        found[text].append((start, start + len(texts[text][begin:end].decode())))
    return found


def scan(rows: DataFrame, reach: int, information: np.ndarray, secret: float) -> DataFrame:
    """Base spans and secrets of every row, and what stands near the base spans (term 0 is the entity itself)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            base, hidden, context = [], [], []
            texts = batch.column("text").to_pylist()
            for text, keys in zip(texts, secrets([(t or "").encode() for t in texts], information, secret)):
                spans = base_spans(text) if text else []
                hidden.append([{"start": b, "kind": "secret", "end": e} for b, e in keys])
                base.append([{"start": b, "kind": KINDS[k], "end": e} for b, k, e in spans])
                context.append([dict(zip(("entity", "term", "context", "start", "end"), r)) for r in _contexts(text, spans, reach)] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(base, span), pa.array(hidden, span), pa.array(context, near)],
                                             names=["row_id", "doc_id", "base", "secrets", "context"])

    return rows.select("row_id", "doc_id", "text").mapInArrow(find, SCANNED)


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many of all texts each of these terms stands. A bitmap of fixed size picks the words to count."""
    sent = bitmap.build(terms, "term")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task adds its slices up, so that it emits a term once, or once for every HELD terms it meets.
        value, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, texts in slices(batches, "text"):
            words = Words(texts)
            hit = bitmap.contains(sent.value, words.hashes)
            owner = np.repeat(np.arange(len(texts)), words.counts)[hit]
            found, _ = distinct_by_text(words.hashes[hit], np.bincount(owner, minlength=len(texts)))
            new, times = np.unique(found.view(np.int64), return_counts=True)
            value, n = summed(np.append(value, new), np.append(n, times))
            if len(value) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["term", "n"])
                value, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["term", "n"])

    counted = rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.join(terms, "term", "left_semi")


def revealing(scanned: DataFrame, rows: DataFrame, chance: float, remove: float, generalise: float) -> DataFrame:
    """(entity, term, kind): the terms that reveal an entity beyond the thresholds; kind is removed or generalised."""
    near = scanned.select("row_id", F.inline("context"))
    # All contexts that differ, whether in one text or in several; copies of a text add rows, not contexts.
    contexts = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    both = near.select("entity", "term", "row_id").distinct().groupBy("entity", "term").agg(F.count("*").alias("both"))
    pairs = stored(contexts.join(both, ["entity", "term"]), "co-occurrence")
    entities = pairs.where("term = 0").select("entity", F.col("both").alias("n_entity"))
    strong = pairs.where((F.col("term") != 0) & (F.col("contexts") >= 2))  # no pair that met once can be significant
    terms = stored(strong.select("term").distinct(), "terms")
    counts = term_counts(rows, terms).withColumnRenamed("n", "n_term")
    total, looked_at = scanned.count(), pairs.count()
    joined = strong.join(entities, "entity").join(counts, "term")
    # A bound of the Poisson tail: k or more meetings where x are expected have a probability of at most x^k / k!.
    k = F.least("contexts", F.lit(20)).cast("int")
    expected = F.col("n_entity") * F.col("n_term") / F.lit(float(max(total, 1)))
    joined = joined.where((k * F.log10(expected) - F.log10(F.factorial(k)) + F.lit(math.log10(max(looked_at, 1)))) < math.log10(chance))
    information = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(max(total, 1))) * F.col("both") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    return joined.select("entity", "term", F.when(share >= remove, "removed").when(share >= generalise, "generalised").alias("kind")).dropna()


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text", reach: int = REACH, chance: float = CHANCE,
                  remove: float = REMOVE, generalise: float = GENERALISE, secret: float = SECRET) -> DataFrame:
    """row_id, doc_id, base and spans of every row: arrays of (start, kind, end); spans has the secrets and the revealing terms too."""
    rows = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")))
    scanned = stored(scan(rows, reach, letter_information(rows), secret), "scanned-texts")
    terms = stored(revealing(scanned, rows, chance, remove, generalise), "revealing-terms")
    near = scanned.select("row_id", F.inline("context")).join(terms, ["entity", "term"])
    # Of two kinds for one place, `removed` wins.
    more = near.groupBy("row_id", "start", "end").agg(F.max("kind").alias("kind")).groupBy("row_id").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    joined = scanned.select("row_id", "doc_id", "base", "secrets").join(more, "row_id", "left")
    return joined.select("row_id", "doc_id", "base", F.concat("base", "secrets", F.coalesce("more", F.expr(f"cast(array() AS array<{SPAN}>)"))).alias("spans"))


def joined_spans(spans: str) -> Column:
    """kind:start:end by start, then kind (base kinds as listed, then others by name), comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    keyed = F.expr(f"array_sort(transform({spans}, x -> struct(x.start AS start, if(array_position(array({kinds}), x.kind) = 0, 99, array_position(array({kinds}), x.kind)) AS rank, x.kind AS kind, x.end AS end)))")
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    counts += [F.expr(f"size(filter(spans, x -> x.kind IN ({k})))").cast("long").alias(n) for k, n in (("'secret'", "n_secret"), ("'removed', 'generalised'", "n_revealing"))]
    return found.select("doc_id", *counts, F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


def shape(word: str) -> str:
    return "[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "[word]"


def replaced(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            word = text[span["start"]:span["end"]]
            parts += [text[at:span["start"]], MARKS.get(span["kind"]) or ("[removed]" if span["kind"] == "removed" else shape(word))]
        at = max(at, span["end"])
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns of docs, with personal data and the terms that reveal them replaced in the text."""
    docs = scanned(docs)
    found = personal_data(docs, id_column, text, **options)
    own, other, marks = fresh(docs, "row"), fresh(docs, "changed"), fresh(docs, "marks")
    changes = stored(found.where(F.size("spans") > 0).select("row_id", "spans"), "spans").toDF(other, marks)
    columns = docs.columns
    joined = with_row_id(docs, own).join(changes, F.col(own) == F.col(other), "left").drop(own, other)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            new = [replaced(t, s) if t and s else t for t, s in zip(batch.column(text).to_pylist(), batch.column(marks).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in columns], names=columns)

    return joined.mapInArrow(apply, docs.schema)

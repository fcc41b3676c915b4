"""Toxic passages: maximum-scoring segments over word log-odds with Dirichlet priors, calibrated by extreme values.

A word's log-odds come from labelled texts with a prior that is itself estimated: the prior of a word is its 6-byte prefix, that
of a prefix the next shorter one, that of the shortest the share of toxic texts. A constant drift makes ordinary words negative,
and one linear scan (Ruzzo and Tompa) gives every maximal segment. A segment of score S in n words is expected K n exp(-lambda S)
times by chance (Karlin and Altschul); the passages' evidence, the sum of -ln E, becomes a probability by a logistic curve.
lambda, K and the curve are fitted on texts that the log-odds used for them have not seen.

The classifier is fitted on at most `sample` labelled texts, taken by hash; so is the size of the model that tasks receive.

Defined cases: a null text is empty; an empty text has no passages and the score of a text without evidence. Labels with a null
id or value are left out; repeated labels count as toxic if one of them does. Of the rows that share a labelled id one is learned from, that
whose text has the least hash; all are scored. Without labelled
texts of both classes the score is 0 for every text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradloom.llm.ranges import first_by_hash
from gradloom.llm.words import lower_words, small, texts_of
from gradloom.session import stored

PREFIXES = (4, 5, 6)
#: Columns that `score_texts` adds unless it is given other names.
SCORE, PASSAGES = "toxicity__", "passages__"


def remainder(column: str, modulus: int = 5) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def nodes_of(word: bytes) -> list[bytes]:
    """The word and its proper prefixes, from the general to the special; a prefix ends with a blank."""
    return [word[:k] + b" " for k in PREFIXES if len(word) > k] + [word]


class Odds(dict):
    """Score of a word: log-odds less drift. Computed once per word and kept, within a bound."""

    def __init__(self, nodes: dict[bytes, tuple[int, int]], toxic: int, clean: int, strength: float, drift: float):
        super().__init__()
        self.nodes, self.strength, self.drift = nodes, strength, drift
        self.share = toxic / (toxic + clean)
        self.zero = math.log(self.share / (1 - self.share))

    def odds(self, word: bytes) -> float:
        share = self.share
        for node in nodes_of(word):
            counts = self.nodes.get(node)
            if counts is not None:
                share = (counts[0] + self.strength * share) / (counts[0] + counts[1] + self.strength)
        share = min(max(share, 1e-9), 1 - 1e-9)
        return math.log(share / (1 - share)) - self.zero

    def __missing__(self, word: bytes) -> float:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = self.odds(word) - self.drift
        return value


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time; end is exclusive."""
    kept: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    total = 0.0
    for i, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        begin, end, left, right = i, i + 1, total, total + score
        total = right
        while kept:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                break
            begin, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((begin, end, left, right))
    return [(b, e, r - l) for b, e, l, r in kept]


class Model:
    def __init__(self, odds: Odds | None, rate: float = 1.0, k: float = 1.0, curve: tuple[float, float] = (0.0, 0.0)):
        self.odds, self.rate, self.k, self.curve = odds, rate, k, curve

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        words = lower_words(text)
        scores = list(map(self.odds.__getitem__, words)) if self.odds is not None else []
        return len(words), segments(scores) if scores and max(scores) > 0 else []

    def passages(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Segments that chance gives less than once in such a text, with their evidence -ln E."""
        noise = math.log(self.k * max(n, 1))
        return [(b, e, self.rate * s - noise) for b, e, s in found if self.rate * s > noise]

    def score(self, evidence: float) -> float:
        if self.odds is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.curve[0] + self.curve[1] * evidence))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def flush():
        keys = list(found)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()),
                                            pa.array([k[2] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())],
                                           names=["node", "fold", "toxic", "n"])
        found.clear()
        return batch

    for batch in batches:
        for text, fold, toxic in zip(texts_of(batch.column("text")), batch.column("fold").to_pylist(), batch.column("toxic").to_pylist()):
            found.update((node, fold, toxic) for node in {x for w in set(lower_words(text)) for x in nodes_of(w)})
            found[b" ", fold, toxic] += 1
            if len(found) > 300_000:
                yield flush()
    yield flush()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton's method for P(y) = 1 / (1 + exp(-(a + b x))), b not negative."""
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * len(x) * np.eye(2) / 100, design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000,
        strength: float = 4.0, drift: float = 1.5) -> Model:
    """Fit on the labelled texts; leave held-out ids out of `labels` beforehand."""
    chosen = (labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
              .select("id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("id").alias("h")))
    chosen = stored(chosen, "labels")
    chosen = first_by_hash(chosen, chosen.count(), sample).drop("h")
    chosen = stored(chosen.withColumn("fold", remainder("id", 7) % 2), "labelled")
    # At most `sample` small rows are broadcast.
    joined = (docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
              .select("id", F.struct("text", F.col("fold").cast("int").alias("fold"), "toxic").alias("row")))
    # An id that many rows hold counts once: no more texts than labels, whatever repeats. Partial aggregates keep one text by id and task.
    texts = stored(joined.groupBy("id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*"), "labelled-texts")
    sums = texts.mapInArrow(_count, "node binary, fold int, toxic int, n long").groupBy("node").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}{t}") for f in (0, 1) for t in (1, 0)])
    counts = stored(sums, "toxic-counts")
    total = counts.where(F.col("node") == F.lit(b" ")).first()
    if total is None or not total["n01"] + total["n11"] or not total["n00"] + total["n10"]:
        return Model(None)
    whole = {bytes(r["node"]): tuple(r)[1:] for r in counts.where("n01 + n11 >= 2").toLocalIterator()}
    # Words that are clean in spite of a toxic prefix are exceptions and come along.
    share = (total["n01"] + total["n11"]) / sum(tuple(total)[1:])
    suspect = {n for n, c in whole.items() if n.endswith(b" ") and len(n) > 1 and c[0] + c[2] > 2 * share * sum(c)}

    def exceptions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [any(x in suspect for x in nodes_of(bytes(n).rstrip(b" "))[:-1]) for n in batch.column("node").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    whole |= {bytes(r["node"]): tuple(r)[1:] for r in counts.where("n01 + n11 < 2").mapInArrow(exceptions, counts.schema).toLocalIterator()}
    whole.pop(b" ", None)

    def odds(folds: tuple[int, ...]) -> Odds | None:
        pick = lambda c: (sum(c[2 * f] for f in folds), sum(c[2 * f + 1] for f in folds))
        toxic, clean = pick(tuple(total)[1:])
        return Odds({n: p for n, c in whole.items() if sum(p := pick(c))}, toxic, clean, strength, drift) if toxic and clean else None

    return calibrate(texts, {0: odds((1,)), 1: odds((0,))}, odds((0, 1)))


def calibrate(texts: DataFrame, cross: dict[int, Odds | None], final: Odds, least: float = 1.0) -> Model:
    """Score each fold with the log-odds of the other one; fit the extreme-value law on the clean texts and the curve on all."""
    scorers = {fold: Model(o) for fold, o in cross.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, fold, toxic in zip(texts_of(batch.column("text")), batch.column("fold").to_pylist(), batch.column("toxic").to_pylist()):
                n, found = scorers[fold].scan(text)
                clean = Counter(round(scorers[fold].odds[w], 1) for w in lower_words(text)) if not toxic and scorers[fold].odds is not None else {}
                rows.append((toxic, n, [s for _, _, s in found], list(clean), list(clean.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                    pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["toxic", "n", "found", "score", "times"])

    seen = stored(texts.mapInArrow(scan, "toxic int, n long, found array<double>, score array<double>, times array<long>"), "toxic-scans")
    histogram = (seen.select(F.inline(F.arrays_zip("score", "times"))).groupBy("score").agg(F.sum("times").alias("times"))).collect()
    value, times = (np.array([r[i] for r in histogram] or [0.0], float) for i in (0, 1))
    rate = 1.0
    if (value > 0).any():
        # The root above zero of E[exp(rate * score)] = 1; it is at most 1 for true log-odds.
        low, high = 1e-3, 1.0
        for _ in range(60):
            rate = (low + high) / 2
            low, high = (rate, high) if (times * np.exp(rate * value)).sum() < times.sum() else (low, rate)
    clean = seen.where("toxic = 0").agg(F.sum("n").alias("n"), F.sum(F.size(F.filter("found", lambda s: s >= least))).alias("over")).first()
    k = ((clean["over"] or 0) + 0.5) / max(1.0, (clean["n"] or 0) * math.exp(-rate * least))
    model = Model(final, rate, k)
    evidence = [(sum(e for _, _, e in model.passages(r["n"], [(0, 0, s) for s in r["found"]])), r["toxic"]) for r in seen.select("toxic", "n", "found").toLocalIterator()]
    # The square root keeps the curve from resting on the few texts with very much evidence.
    model.curve = _logistic(np.sqrt([e for e, _ in evidence]), np.array([t for _, t in evidence], float))
    return model


def score_texts(docs: DataFrame, model: Model, text: str = "text", score: str = SCORE, passages_column: str = PASSAGES) -> DataFrame:
    """All columns of docs, with the score (0 to 1) and the passages (word ranges with their evidence). One scan, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in small(batches):
            scores, passages = [], []
            for value in texts_of(batch.column(text)):
                n, found = model.scan(value)
                found = model.passages(n, found)
                scores.append(model.score(math.sqrt(sum(e for _, _, e in found))))
                passages.append([{"begin": b, "end": e, "evidence": x} for b, e, x in found])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*kept, score, passages_column])
        if model.odds is not None:
            model.odds.clear()  # the worker lives on, and with it the model it was sent

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scan, f"{fields}, `{score}` double, `{passages_column}` array<struct<begin:int,end:int,evidence:double>>")


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled texts whose id is not held out (crc32 of the id as text, modulo 5, is 0)."""
    return fit(docs, labels.where(remainder("doc_id") != 0))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learned(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), F.col(SCORE).alias("score"),
                         (F.col(SCORE) >= 0.5).cast("int").alias("predicted"), F.col(PASSAGES).alias("passages"))

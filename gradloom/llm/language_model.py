"""A log-bilinear neural language model, trained with noise-contrastive estimation, and a unigram base, over whole texts.

Words are runs of anything but blanks, A-Z in lower case; an end token closes each text. The model predicts a word class from the
two before it: the `vocabulary` most frequent tokens are classes of their own, all others share one. score(w | u, v) = (c1 * r_u +
c2 * r_v) . q_w + b_w, normalised over all classes by matrix products; a token of the shared class gets its share of the class
from its count, so that the probabilities of all tokens, one unseen token included, sum to 1.

Training is data parallel: every task takes one pass over its training texts from common start weights, and the tasks' weights
are averaged by the words they saw, in partial sums. Counts cover all training texts. Counts of the `head` most frequent tokens
are sent to the tasks; all other tokens get theirs by a join, so nothing that grows with the corpus is broadcast. Tokens are told apart
by 64-bit hashes of their bytes, in arrays for whole slices of texts.

Defined cases: a null text is empty and has one token, its end. A null id is not held out. Repeated rows count and are scored
each. Without training texts N and V are 0, the base gives each token log10(0.5 / 0.5) = 0, and the model has the one shared
class, which gives the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradloom.llm.words import BLANK_WORDS, Words, mix, once, slices, summed, with_row_id
from gradloom.session import stored

VOCABULARY, WIDTH, HEAD = 1000, 16, 200_000
NOISE, BATCH, RATE = 64, 2048, 0.1
#: Distinct tokens that a counting task holds.
HELD = 400_000


def hash_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, each text closed by END, and how many each has."""
    words = Words(texts, BLANK_WORDS)
    return np.insert(words.hashes.view(np.int64), words.firsts + words.counts, END), words.counts + 1


#: The end token: no run of letters has this hash but by the chance of any two.
END = mix(np.array([0], np.uint64) - np.uint64(1)).view(np.int64)[0]


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over the texts, tokens as hashes. Tasks count up to HELD tokens at a time, Spark sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(token, n):
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

        token, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, some in slices(batches, "text"):
            new, times = np.unique(hash_tokens(some)[0], return_counts=True)
            token, n = summed(np.append(token, new), np.append(n, times))
            if len(token) > HELD:
                yield table(token, n)
                token, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield table(token, n)

    return texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent tokens and their counts, the most frequent first, equal ones by hash.

    A histogram of fixed size (by the logarithm: a few hundred rows) says above which count all tokens are among them; of the step below as
    many as are missing are taken, with about the least hashes, so that about `most` rows reach the driver.
    """
    step = F.floor(F.log2("n") * 32)
    total, limit, rest = 0, None, None
    for value, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if total + n > most:
            rest = value, n
            break
        total, limit = total + n, value
    wanted = F.lit(False) if limit is None else step >= limit
    if rest and most > total:
        # A step's tokens differ by 2% in count at most; the hash decides between them, as between equal ones.
        share = min(1.0, 1.05 * (most - total) / rest[1] + 1e-4)
        wanted = wanted | ((step == rest[0]) & (F.col("token") <= min(int(-(1 << 63) + share * (1 << 64)), (1 << 63) - 1)))
    found = counts.where(wanted).select("token", "n").toArrow()
    token, n = (found.column(c).to_numpy() for c in ("token", "n"))
    order = np.lexsort((token, -n))[:most]
    return token[order], n[order]


class Places:
    """Tokens by hash: the rank of each in a list, or -1."""

    def __init__(self, tokens: np.ndarray):
        self.order = np.argsort(tokens, kind="stable").astype(np.int32)
        self.sorted = tokens[self.order]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(tokens), -1, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        return np.where(self.sorted[at] == tokens, self.order[at], np.int32(-1))


class Weights:
    """Word vectors r (classes, width), context factors c1 and c2, target vectors q, biases b. Class 0 is the start, 1 the shared one."""

    SHAPES = ("r", "c1", "c2", "q", "b")

    def __init__(self, r, c1, c2, q, b):
        self.r, self.c1, self.c2, self.q, self.b = r, c1, c2, q, b

    @classmethod
    def start(cls, log_p: np.ndarray, width: int, seed: int = 17) -> "Weights":
        n, rng = len(log_p), np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(n, width), np.ones(width, np.float32), np.full(width, 0.5, np.float32), draw(n, width), log_p.astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.SHAPES])

    def like(self, flat: np.ndarray) -> "Weights":
        parts, at = [], 0
        for k in self.SHAPES:
            shape = getattr(self, k).shape
            n = int(np.prod(shape))
            parts.append(flat[at:at + n].reshape(shape).astype(np.float32))
            at += n
        return Weights(*parts)

    def copy(self) -> "Weights":
        return self.like(self.flat().copy())


class Trainer:
    """Noise-contrastive steps with AdaGrad: B contexts against their words and NOISE common draws of the unigram law."""

    def __init__(self, weights: Weights, log_noise: np.ndarray, seed: int = 5):
        self.w, self.log_noise, self.seed = weights.copy(), log_noise, seed
        law = np.exp(log_noise)
        self.cumulated = np.cumsum(law / law.sum())
        self.squares = {k: np.full_like(getattr(self.w, k), 1e-6) for k in Weights.SHAPES}
        self.seen = 0

    def _rows(self, rows: np.ndarray, gradients: dict[str, np.ndarray]) -> None:
        """Add up the gradients of equal rows, then update. Classes are few: 16-bit rows are sorted by radix."""
        order = np.argsort(rows.astype(np.uint16) if len(self.log_noise) < 1 << 16 else rows, kind="stable")
        rows = rows[order]
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for name, gradient in gradients.items():
            self._update(name, rows[begins], np.add.reduceat(gradient[order], begins, axis=0))

    def _update(self, name: str, at, gradient: np.ndarray) -> None:
        square, value = self.squares[name], getattr(self.w, name)
        square[at] += gradient * gradient
        value[at] += RATE * gradient / np.sqrt(square[at])

    def step(self, u: np.ndarray, v: np.ndarray, word: np.ndarray) -> None:
        w, size = self.w, np.float32(len(word))
        rng = np.random.default_rng((self.seed, self.seen))
        noise = np.minimum(np.searchsorted(self.cumulated, rng.random(NOISE)), len(self.cumulated) - 1)
        ru, rv = w.r[u], w.r[v]
        context = w.c1 * ru + w.c2 * rv
        floor = np.log(NOISE) + self.log_noise
        target = (context * w.q[word]).sum(1) + w.b[word] - floor[word]
        drawn = context @ w.q[noise].T + w.b[noise] - floor[noise]
        gain = (1 / (1 + np.exp(np.clip(target, -30, 30)))).astype(np.float32) / size
        loss = (-1 / (1 + np.exp(np.clip(-drawn, -30, 30)))).astype(np.float32) / size
        d_context = gain[:, None] * w.q[word] + loss @ w.q[noise]
        d_q = np.concatenate([gain[:, None] * context, loss.T @ context])
        d_b = np.concatenate([gain, loss.sum(0)])
        d_c1, d_c2 = (d_context * ru).sum(0), (d_context * rv).sum(0)
        self._rows(np.concatenate([u, v]), {"r": np.concatenate([d_context * w.c1, d_context * w.c2])})
        self._rows(np.concatenate([word, noise]), {"q": d_q, "b": d_b})
        self._update("c1", slice(None), d_c1)
        self._update("c2", slice(None), d_c2)
        self.seen += len(word)


def contexts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes two and one before each token, the start class (0) before a text."""
    begins = np.cumsum(counts) - counts
    v = np.r_[0, ids[:-1]]
    v[begins] = 0
    u = np.r_[0, v[:-1]]
    u[begins] = 0
    return u, v


CHUNK = 4096


def train(texts: DataFrame, vocabulary: Places, start: Weights, log_noise: np.ndarray) -> Weights:
    """One pass over all texts in every task, then the average of the tasks' weights."""
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, start, log_noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start, log_noise = sent.value
        trainer = Trainer(start, log_noise)
        for _, some in slices(batches, "text", 1 << 20):
            tokens, counts = hash_tokens(some)
            ids = vocabulary.find(tokens) + 2  # 1, the shared class, if not found
            u, v = contexts(ids, counts)
            for at in range(0, len(ids), BATCH):
                trainer.step(u[at:at + BATCH], v[at:at + BATCH], ids[at:at + BATCH])
        if trainer.seen:
            change = (trainer.w.flat() - start.flat()).astype(np.float64) * trainer.seen
            for k, at in enumerate(range(0, len(change), CHUNK)):
                part = change[at:at + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int32()), pa.array(np.arange(len(part)), pa.int32()), pa.array(part),
                                                  pa.array([trainer.seen] * len(part), pa.int64())], names=["chunk", "i", "change", "seen"])

    # Rows by weight and task; partial sums leave one row by weight. The result is the model, whose size is fixed.
    sums = texts.select("text").mapInArrow(run, "chunk int, i int, change double, seen long").groupBy("chunk", "i").agg(F.sum("change"), F.sum("seen")).toPandas()
    if not len(sums):
        return start
    chunk, i, change, seen = (sums.iloc[:, k].to_numpy() for k in range(4))
    flat = start.flat().astype(np.float64)
    flat[chunk * CHUNK + i] += change / seen
    return start.like(flat)


class Scorer:
    """Normalised log10 probabilities. The bilinear form splits over the two context words: two (classes, classes) products hold all of it."""

    def __init__(self, weights: Weights):
        self.first = ((weights.r * weights.c1) @ weights.q.T).astype(np.float32)
        self.second = ((weights.r * weights.c2) @ weights.q.T + weights.b).astype(np.float32)
        self.first[:, 0] = 0
        self.second[:, 0] = -np.inf  # the start is never predicted
        self.norm = np.full(len(weights.b) ** 2, np.nan, np.float32)

    def log10(self, u: np.ndarray, v: np.ndarray, word: np.ndarray) -> np.ndarray:
        n = len(self.first)
        at = u.astype(np.int64) * n + v
        fresh = np.unique(at[np.isnan(self.norm[at])])
        for k in range(0, len(fresh), 2048):
            some = fresh[k:k + 2048]
            logits = self.first[some // n] + self.second[some % n]
            top = logits.max(1)
            self.norm[some] = np.log(np.exp(logits - top[:, None]).sum(1)) + top
        return (self.first[u, word].astype(np.float64) + self.second[v, word] - self.norm[at]) / np.log(10)


def score_texts(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY,
                width: int = WIDTH, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text; `training` has the texts to learn from (column `text`)."""
    counts = stored(token_counts(training), "token-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = int(sums["n"]), int(sums["v"])
    tokens, times = most_frequent(counts, head)
    own = times[:vocabulary]
    own_sum = int(own.sum())
    base_floor = np.log10(n_all + 0.5 * (distinct + 1))
    shared_floor = np.log10(n_all - own_sum + 0.5 * (distinct - len(own) + 1))
    law = np.array([1e-9, max(n_all - own_sum, 0.5), *own], float)
    log_noise = np.log(law / law.sum())
    weights = train(training, Places(tokens[:vocabulary]), Weights.start(log_noise, width), log_noise)
    # The last one is for tokens outside the head, which get their share by a join.
    logs = np.log10(np.append(times, 0.5) + 0.5)
    sent = docs.sparkSession.sparkContext.broadcast((weights, Places(tokens), logs))
    key = uuid.uuid4().hex

    fields = "row_id long, doc_id long, n_tokens long, n_head long, head_sum double, n_shared long, class_sum double, tail array<long>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, places, logs = sent.value
        scorer = once(key, lambda: Scorer(weights))
        own = len(weights.b) - 2
        for batch, texts in slices(batches, "text", 1 << 20):
            found, counts = hash_tokens(texts)
            begins = np.cumsum(counts) - counts
            at = places.find(found)
            classes = np.where((at >= 0) & (at < own), at + 2, 1)
            u, v = contexts(classes, counts)
            known = np.where(at >= 0, logs[at], 0.0)
            # Tokens with a class of their own have no part in the shared class.
            scores = scorer.log10(u, v, classes) + np.where(classes == 1, known, 0.0)
            total = lambda x: np.add.reduceat(x, begins)
            rare = np.flatnonzero(at < 0)
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, np.r_[begins, len(found)]).astype(np.int32)), pa.array(found[rare]))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(counts), pa.array(total((at >= 0).astype(np.int64))),
                                              pa.array(total(known)), pa.array(total((classes == 1).astype(np.int64))), pa.array(total(scores)), tail],
                                             names=[f.split()[0] for f in fields.split(", ")])

    rows = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")))
    scored = stored(rows.select("row_id", "doc_id", "text").mapInArrow(score, fields), "scored-texts")
    tail = scored.select("row_id", F.explode("tail").alias("token"))
    # Tail tokens are rarer than the head's last, so no key is hot; one sum by text follows.
    found = tail.join(counts.withColumnRenamed("n", "c"), "token", "left").groupBy("row_id").agg(
        F.count("c").alias("tail_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("tail_sum"))
    whole = scored.drop("tail").join(found, "row_id", "left").fillna(0, ["tail_known"]).fillna(0.0, ["tail_sum"])
    return whole.select("doc_id", "n_tokens", (F.col("n_head") + F.col("tail_known")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                        (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * F.lit(float(base_floor))).alias("base_score"),
                        (F.col("class_sum") + F.col("tail_sum") - F.col("n_shared") * F.lit(float(shared_floor))).alias("score"))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_corpus(docs: DataFrame) -> DataFrame:
    """Score all documents, learning from those that are not held out."""
    scored = score_texts(docs, docs.where(~held_out()).select("text"))
    return scored.withColumn("held_out", held_out())

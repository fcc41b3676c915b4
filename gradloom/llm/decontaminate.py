"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are put into classes by their number of shingles, (s/2, s] for s = 1, 2, 4, ... For every class that has items, each
document is cut into overlapping windows of 2 s shingles, one every s, so that any run of s shingles lies whole in one window and
a window is never more than four times as long as an item. Containment in a long document so becomes a plain similarity of two
sets of like size. `functions` minima are taken of windows and items; one common minimum makes a candidate. What an item and a
document share is then counted exactly, over the whole document.

A window that holds a share t = 0.8 of an item of q shingles agrees in one minimum with probability t q / (2 s + (1 - t) q), at
least 0.19; with 48 functions a pair is lost with probability 4e-5 in the worst case, and 1e-10 if the item has q = s shingles.

Defined cases: null texts are empty. An item without words matches nothing; one of 1 to 4 words is one shingle, which only a
document of just these words has. Null ids stay null; repeated rows of documents or items give a row each. No items, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradloom.llm import bitmap
from gradloom.llm.words import Words, as_long, distinct_by_text, lists, mix, scanned, slices, with_row_id, without_rows
from gradloom.session import stored

SHINGLE, CONTAINMENT, FUNCTIONS = 5, 0.8, 48


def size_class(n: np.ndarray) -> np.ndarray:
    """The class s of items with n shingles: the power of two that is not below n."""
    return 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _functions(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def minima(values: np.ndarray, begins: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Least value of one hash function in each run. Shingle hashes are mixed already: a product's high half orders them anew."""
    return np.minimum.reduceat(((values * factor) >> np.uint64(32)).astype(np.uint32), begins)


def _key(s: int, i: int, minimum: np.ndarray) -> np.ndarray:
    return mix((minimum.astype(np.uint64) << np.uint64(32)) + np.uint64(s * 1024 + i))


def item_table(items: DataFrame, id_column: str, text: str, functions: int) -> DataFrame:
    """item_row, item_id, size_class, shingles (distinct), keys of the minima."""
    factors = _functions(functions)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            value, counts = distinct_by_text(*Words(texts).shingles(SHINGLE))
            classes = size_class(counts)
            keys = []
            for i, end in enumerate(np.cumsum(counts)):
                own = value[end - counts[i]:end]
                keys.append([int(k) for f in range(functions) for k in _key(int(classes[i]), f, minima(own, np.zeros(1, np.int64), factors[f])).view(np.int64)] if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column("item_row"), batch.column("item_id"), pa.array(classes), lists(value, counts), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["item_row", "item_id", "size_class", "shingles", "keys"])

    rows = with_row_id(items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text).alias("text")), "item_row")
    return stored(rows.select("item_row", "item_id", "text").mapInArrow(sign, "item_row long, item_id long, size_class long, shingles array<long>, keys array<long>")
                  .where(F.size("shingles") > 0), "items")


def windows(counts: np.ndarray, s: int) -> np.ndarray:
    """First shingles of the blocks of s shingles, text by text."""
    blocks = -(-counts // s)
    firsts = np.cumsum(counts) - counts
    return np.repeat(firsts, blocks) + s * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)), blocks


def candidates(rows: DataFrame, items: DataFrame, functions: int) -> DataFrame:
    """(row_id, doc_id, keys, shingles) of the documents with a window minimum that is in the items' bitmap; keys are those minima."""
    classes = sorted(r[0] for r in items.select("size_class").distinct().collect())  # powers of two: a few
    sent = bitmap.build(items.select(F.explode("keys").alias("key")), "key")
    factors = _functions(functions)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            value, counts = Words(texts).shingles(SHINGLE)
            ends = np.cumsum(counts)
            owners, keys = [], []
            if len(value):
                for s in classes:
                    begins, blocks = windows(counts, s)
                    owner = np.repeat(np.arange(len(counts)), blocks)
                    joined = owner[1:] == owner[:-1]
                    for f in range(functions):
                        low = minima(value, begins, factors[f])
                        low[:-1][joined] = np.minimum(low[:-1], low[1:])[joined]
                        key = _key(s, f, low)
                        hit = np.flatnonzero(bitmap.contains(sent.value, key))
                        owners.append(owner[hit])
                        keys.append(key[hit])
            if not sum(map(len, owners)):
                continue
            found, hits = np.concatenate(owners), np.concatenate(keys)
            keys, number = distinct_by_text(hits[np.argsort(found, kind="stable")], np.bincount(found, minlength=len(counts)))
            which = np.flatnonzero(number)
            own = [np.unique(value[ends[i] - counts[i]:ends[i]]) for i in which]
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(which)), batch.column("doc_id").take(pa.array(which)), lists(keys, number[which]),
                                              lists(np.concatenate(own), np.array([len(x) for x in own]))], names=["row_id", "doc_id", "keys", "shingles"])

    return stored(rows.select("row_id", "doc_id", "text").mapInArrow(search, "row_id long, doc_id long, keys array<long>, shingles array<long>"), "candidates")


def contained_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    containment: float = CONTAINMENT, functions: int = FUNCTIONS) -> DataFrame:
    """row_id, doc_id, item_id, item_shingles, shared and containment of every document and item where that reaches the bound.

    Documents are scanned once and not shuffled; candidates are, with their shingles.
    """
    table = item_table(items, item_id, item_text, functions)
    rows = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")))
    found = candidates(rows, table, functions)
    hits = found.select("row_id", F.explode("keys").alias("key"))
    pairs = hits.join(table.select("item_row", F.explode("keys").alias("key")), "key").select("row_id", "item_row").distinct()
    both = (stored(pairs, "pairs").join(found.select("row_id", "doc_id", F.col("shingles").alias("own")), "row_id")
            .join(table.select("item_row", "item_id", "shingles"), "item_row"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, size = [], []
            for own, item in zip(batch.column("own"), batch.column("shingles")):
                own, item = np.asarray(own.values), np.asarray(item.values)
                shared.append(len(np.intersect1d(own, item, assume_unique=True)))
                size.append(len(item))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "doc_id", "item_id")), pa.array(size, pa.int64()), pa.array(shared, pa.int64())],
                                             names=["row_id", "doc_id", "item_id", "item_shingles", "shared"])

    counted = both.select("row_id", "doc_id", "item_id", "own", "shingles").mapInArrow(count, "row_id long, doc_id long, item_id long, item_shingles long, shared long")
    return counted.withColumn("containment", F.col("shared") / F.col("item_shingles")).where(F.col("shared") >= containment * F.col("item_shingles") - 1e-9)


def without_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    docs = scanned(docs)
    found = contained_items(docs, items, id_column, text, containment=containment)
    return without_rows(docs, stored(found.select("row_id").distinct(), "contaminated"))

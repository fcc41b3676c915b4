"""Passages that several documents share, by sparse suffix arrays.

Suffixes are kept where the text itself says so: at the least hash of `anchor` words in every window, so that any passage of
`least` words holds an anchor whole, and equal passages hold equal anchors. Kept suffixes are sorted by their first words and
compared with their neighbours; those that another document has too are extended left and right, as far as `least` words reach
around the anchor, and the extended windows are sorted and compared in turn. Runs of consecutive shared windows are the maximal
passages. Not all windows of such a run need have the same holders: a run's links say, part by part, where the first holder of its
windows has them. Those that hold a window are all those that are linked to the same place.

Sorting is by range, so a passage that a third of all documents hold is spread over many tasks, and a row is compared with its
neighbours only: no pairs within a group are made.

Defined cases: null and empty texts, and texts of fewer than `least` words, have no passages. A passage that only repeats inside
one document is none. Repeated rows are documents of their own and share their whole text. Null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradloom.llm import bitmap
from gradloom.llm.ranges import sorted_parts
from gradloom.llm.words import Words, as_long, mix, slices, with_row_id
from gradloom.session import stored

LEAST, ANCHOR = 50, 25
LINKS = "array<struct<begin_word:int,end_word:int,source_row:long,source_begin:int>>"
_POSITION_BITS = np.uint64(28)


def minimisers(value: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Indices of the least value (the leftmost of equals) of each run of `window` values inside one text; `counts` values a text."""
    n = len(value)
    if n < window:
        return np.zeros(0, np.int64)
    packed = ((value >> _POSITION_BITS) << _POSITION_BITS) | np.arange(n, dtype=np.uint64)
    low, width = packed, 1
    while 2 * width <= window:
        low = np.minimum(low[:len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:n - window + 1], low[window - width:window - width + n - window + 1])
    inside = np.maximum(counts - window + 1, 0)
    firsts = np.cumsum(counts) - counts
    begins = np.repeat(firsts - (np.cumsum(inside) - inside), inside) + np.arange(inside.sum())
    return np.unique((low[begins] & np.uint64((1 << 28) - 1)).astype(np.int64))


#: first_pos is where the first document of the run has it first, in that document's rows; the other rows have it as other_pos.
FOUND = "key long, check long, row_id long, pos int, other_row long, other_pos int, first_pos int, state int"
_NAMES = [f.split()[0] for f in FOUND.split(", ")]
#: What a row of the comparison is: it has a partner; its run may go on in another partition; an edge that such rows are held against.
#: Edges are the first and last row of a partition, the second document of its first run and the first of its last: a run over
#: several partitions so shows a row of another document, whichever document is asked for.
SHARED, OPEN, EDGE = 0, 1, 2


def _batch(rows: np.ndarray, other_row, other_pos, state: int, first_pos: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(rows)
    firsts = pa.nulls(n, pa.int32()) if first_pos is None else pa.array(first_pos.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3].astype(np.int32)),
                                       pa.array(np.broadcast_to(other_row, n).astype(np.int64)), pa.array(np.broadcast_to(other_pos, n).astype(np.int32)),
                                       firsts, pa.array(np.full(n, state, np.int32))], names=_NAMES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, check, row_id, pos) in order. A run is one key and check; the rows of its first document wait until a second one is seen."""
    waiting = np.zeros((0, 4), np.int64)  # rows of the last run, as long as that has one document
    known = None                          # first row of the last run, once that has two
    begun = last = None                   # key of the partition's first run; its last row
    for batch in batches:
        fresh = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "check", "row_id", "pos")], 1)
        if not len(fresh):
            continue
        if last is None:
            begun = fresh[0, :2]
            yield _batch(fresh[:1], 0, 0, EDGE)
        last = fresh[-1:]
        rows = np.concatenate([waiting, fresh])
        begins = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        run = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(rows)]))
        first = rows[begins]
        if known is not None and (known[:2] == rows[0, :2]).all():
            first[0] = known
        other = rows[:, 2] != first[run, 2]
        # The first row of another document, by run, is the partner of the run's first document.
        at = np.flatnonzero(other)
        partner = np.full(len(begins), -1)
        partner[run[at][::-1]] = at[::-1]
        yield _batch(rows[other], first[run[other], 2], first[run[other], 3], SHARED)
        own = np.flatnonzero(~other & (partner[run] >= 0))
        yield _batch(rows[own], rows[partner[run[own]], 2], rows[partner[run[own]], 3], SHARED, first[run[own], 3])
        if partner[0] >= 0 and (rows[0, :2] == begun).all():
            yield _batch(rows[partner[:1]], 0, 0, EDGE)
        alone = rows[(partner[run] < 0) & (run < run[-1]) & (rows[:, :2] == begun).all(1)]
        yield _batch(alone, 0, 0, OPEN)
        known, waiting = (first[-1], waiting[:0]) if partner[-1] >= 0 else (None, rows[run == run[-1]])
    if last is not None:
        yield _batch(waiting, 0, 0, OPEN)
        yield _batch(np.concatenate([last, waiting[:1] if known is None else known[None]]), 0, 0, EDGE)


def shared_rows(rows: DataFrame) -> DataFrame:
    """Of rows (key, check, row_id, pos), those whose key and check another row_id has too, with one such row as other_row and other_pos.

    source_row and source_pos are the first of all rows with this key and check: equal for all of them, and for them alone.
    """
    order = ["key", "check", "row_id", "pos"]
    found = stored(sorted_parts(rows.select(*order), order).select(*order).mapInArrow(_compare, FOUND), "compared-suffixes")
    # Runs at the ends of partitions: at most one document's rows by partition end, against a few rows by partition.
    edges = found.where(F.col("state") == EDGE).select("key", "check", F.col("row_id").alias("other_row"), F.col("pos").alias("other_pos"))
    ends = (found.where(F.col("state") == OPEN).select(*order).join(edges, ["key", "check"]).where("row_id <> other_row")
            .groupBy(*order).agg(F.min(F.struct("other_row", "other_pos")).alias("x")).select(*order, "x.other_row", "x.other_pos"))
    every = found.where(F.col("state") == SHARED).drop("state").unionByName(ends, allowMissingColumns=True)
    # A run over several partitions has its first row among the edges; any other run has it in its own partition.
    firsts = edges.groupBy("key", "check").agg(F.min(F.struct("other_row", "other_pos")).alias("edge"))
    own = F.col("first_pos").isNotNull()
    return every.join(F.broadcast(firsts), ["key", "check"], "left").select(
        *order, "other_row", "other_pos", F.coalesce("edge.other_row", F.when(own, F.col("row_id")).otherwise(F.col("other_row"))).alias("source_row"),
        F.coalesce("edge.other_pos", F.when(own, F.col("first_pos")).otherwise(F.col("other_pos"))).alias("source_pos"))


def anchors(rows: DataFrame, least: int, anchor: int) -> DataFrame:
    """The kept suffixes: (key, check, row_id, pos), pos being the word at which the suffix begins."""
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            words = Words(texts)
            value, begins, counts = words.grams(anchor)
            at = minimisers(value, counts, least - anchor + 1)
            owner = np.searchsorted(np.cumsum(counts), at, side="right")
            yield pa.RecordBatch.from_arrays([as_long(value[at]), pa.array(np.zeros(len(at), np.int64)), batch.column("row_id").take(pa.array(owner)),
                                              pa.array((begins[at] - words.firsts[owner]).astype(np.int32))], names=["key", "check", "row_id", "pos"])

    return rows.select("row_id", "text").mapInArrow(select, "key long, check long, row_id long, pos int")


def extended(rows: DataFrame, shared: DataFrame, least: int, anchor: int) -> DataFrame:
    """Windows of `least` words around the shared anchors, hashed twice. Only texts with such anchors are shuffled (a bitmap keeps most others out)."""
    places = stored(shared.groupBy("row_id").agg(F.collect_list("pos").alias("places")), "shared-anchors")
    sent = bitmap.build(places.select(F.xxhash64("row_id").alias("h")), "h")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.contains(sent.value, batch.column("h").to_numpy()))).select(["row_id", "text"])

    texts = rows.select("row_id", F.xxhash64("row_id").alias("h"), "text").mapInArrow(some, "row_id long, text string")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, "text"):
            words = Words(values)
            value, begins, counts = words.grams(least)
            check = mix(value * np.uint64(3) + words.hashes[begins] * np.uint64(5) + words.hashes[begins + least // 2] * np.uint64(7) + words.hashes[begins + least - 1])
            firsts, near = np.cumsum(counts) - counts, np.zeros(len(value) + 1, np.int64)
            for i, places in enumerate(batch.column("places")):
                places = np.asarray(places.values, np.int64)
                near_i = np.clip(places - (least - anchor), 0, counts[i]) + firsts[i]
                np.add.at(near, near_i, 1)
                np.add.at(near, np.clip(places + 1, 0, counts[i]) + firsts[i], -1)
            at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            owner = np.searchsorted(np.cumsum(counts), at, side="right")
            yield pa.RecordBatch.from_arrays([as_long(value[at]), as_long(check[at]), batch.column("row_id").take(pa.array(owner)),
                                              pa.array((begins[at] - words.firsts[owner]).astype(np.int32))], names=["key", "check", "row_id", "pos"])

    joined = texts.join(places, "row_id").select("row_id", "text", "places")
    return joined.mapInArrow(extend, "key long, check long, row_id long, pos int")


def shared_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """row_id, doc_id, begin_word, end_word (exclusive), n_words, other_doc_id, other_begin and links of every maximal shared passage.

    The other document is one that holds the passage's first `least` words. The links are (begin_word, end_word, source_row,
    source_begin) in order, overlapping by `least` - 1 words: the document of row source_row has the words from begin_word to end_word
    too, from source_begin on. It is the first that has them, so all documents that have them, itself too, are linked to that place.
    """
    rows = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")))
    kept = shared_rows(anchors(rows, least, anchor)).select("row_id", "pos")
    windows = shared_rows(stored(extended(rows, kept, least, anchor), "extended-windows"))
    # A document's windows are at most its words. Consecutive ones make a passage, and a link of it as long as the source goes on with them.
    window = F.struct("pos", "other_row", "other_pos", "source_row", "source_pos")
    by_text = windows.groupBy("row_id").agg(F.array_sort(F.collect_list(window)).alias("all"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, links, sizes = [[], [], [], [], []], [[], [], [], []], []
            for row, found in zip(batch.column("row_id").to_pylist(), batch.column("all")):
                pos, other, there, source, where = (np.asarray(found.values.field(i)) for i in range(5))
                begins = np.flatnonzero(np.r_[True, np.diff(pos) > 1])
                ends = np.r_[begins[1:], len(pos)] - 1
                for values, more in zip(parts, ([row] * len(begins), pos[begins], pos[ends] + least, other[begins], there[begins])):
                    values.extend(more)
                turns = np.flatnonzero(np.r_[True, (np.diff(pos) > 1) | (np.diff(source) != 0) | (np.diff(where) != 1)])
                lasts = np.r_[turns[1:], len(pos)] - 1
                for values, more in zip(links, (pos[turns], pos[lasts] + least, source[turns], where[turns])):
                    values.extend(more)
                sizes.extend(np.diff(np.searchsorted(turns, np.r_[begins, len(pos)])))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            parts = [pa.array(p, t) for p, t in zip(parts, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
            links = pa.StructArray.from_arrays([pa.array(p, t) for p, t in zip(links, (pa.int32(), pa.int32(), pa.int64(), pa.int32()))],
                                               names=["begin_word", "end_word", "source_row", "source_begin"])
            yield pa.RecordBatch.from_arrays([*parts, pa.ListArray.from_arrays(offsets, links)],
                                             names=["row_id", "begin_word", "end_word", "other_row", "other_begin", "links"])

    passages = stored(by_text.mapInArrow(join, f"row_id long, begin_word int, end_word int, other_row long, other_begin int, links {LINKS}"), "passages")
    ids = rows.select("row_id", "doc_id")
    return (passages.join(ids, "row_id").join(ids.select(F.col("row_id").alias("other_row"), F.col("doc_id").alias("other_doc_id")), "other_row")
            .select("row_id", "doc_id", "begin_word", "end_word", (F.col("end_word") - F.col("begin_word")).alias("n_words"), "other_doc_id", "other_begin", "links"))

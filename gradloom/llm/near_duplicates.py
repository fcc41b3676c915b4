"""Near duplicates by DartMinHash: weighted signatures from hashed darts, banded joins, exact verification.

An element (a word shingle) of weight w owns a region of width w. Darts fall on it as a Poisson process in time: their times and
places are hashes of the element and the dart's number, so every text that holds the element sees the same darts. A text keeps
darts up to a time that gives it about k ln k + 2 k of them, whatever its length, and of each of k coordinates the earliest. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Texts with the same elements and weights are one class from the start and take part once. Bands of the signatures are sorted, not
grouped: each row is paired with the one before it and the first of its bucket, so a bucket of any size gives twice its rows in
pairs, on many tasks. Pairs are verified on the shingles themselves; only pairs that still join different components are. Where
buckets then still hold several components, all their members are compared in blocks, by signature and then exactly, inside the
tasks: no similar pair that shares a bucket is lost to the shortcut, and only links that join two components leave a task.

Defined cases: a null text is empty; texts without words are one class. A text of one to four words has one shingle, all of it.
Null ids stay null: rows, not ids, are the members. Repeated rows are members of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradloom.llm import bitmap
from gradloom.llm.components import components
from gradloom.llm.ranges import neighbours
from gradloom.llm.words import Words, as_long, distinct_by_text, lists, mix, scanned, slices, with_row_id, without_rows
from gradloom.session import lifetime, stored

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 4 coordinates: a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
_STEP = np.uint64(0xD1B54A32D192ED03)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def dart_signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Signatures (texts, k) of int32. `elements` are distinct within each text, `counts` says how many each text has."""
    texts = len(counts)
    signature = np.zeros((texts, k), np.uint64)
    owner = np.repeat(np.arange(texts), counts)
    # A region wider than 1 is cut into cells of width 1; the last cell is used up to its share.
    cells = np.ceil(weights).astype(np.int64)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.repeat(weights, cells) - cell
    owner, seed = np.repeat(owner, cells), mix(np.repeat(elements, cells) + cell.astype(np.uint64) * _STEP)
    total = np.bincount(owner, width.clip(0, 1), minlength=texts)
    limit = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300) / k, 0)
    open_texts = np.flatnonzero(total > 0)
    while len(open_texts):
        # Dart times of a cell are a Poisson process of rate k: sums of exponential gaps. Only cells whose last dart came in time go on.
        is_open = np.zeros(texts, bool)
        is_open[open_texts] = True
        at = np.flatnonzero(is_open[owner])
        time, number = np.zeros(len(at)), 0
        rows, coordinates, times, values = [], [], [], []
        while len(at):
            number += 1
            dart = mix(seed[at] + np.array([number], np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
            time = time - np.log(_uniform(dart)) / k
            near = time <= limit[owner[at]]
            at, time, dart = at[near], time[near], dart[near]
            place = mix(dart + np.uint64(1))
            hit = _uniform(mix(place + np.uint64(1))) < width[at]
            rows.append(owner[at][hit])
            coordinates.append((place[hit] % np.uint64(k)).astype(np.int64))
            times.append(time[hit])
            values.append(dart[hit])
        rows, coordinates, times, values = (np.concatenate(x) for x in (rows, coordinates, times, values))
        slot = rows * k + coordinates
        order = np.lexsort((times, slot))
        slot, values = slot[order], values[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        signature.ravel()[slot[first]] = values[first] | np.uint64(1)
        # Coordinates that no dart has hit wait for later darts.
        open_texts = open_texts[(signature[open_texts] == 0).any(1)]
        limit[open_texts] *= 2
    return (signature >> np.uint64(33)).astype(np.int32)


def elements_of(words: Words, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their weights (their number in the text, or 1), and how many each text has."""
    value, counts = words.shingles(SHINGLE)
    distinct, distinct_counts = distinct_by_text(value, counts)
    if not weighted:
        return distinct, np.ones(len(distinct)), distinct_counts
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    begins = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, np.int64)
    return distinct, np.diff(np.r_[begins, len(value)]).astype(float), distinct_counts


def _sum_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def signatures(rows: DataFrame, weighted: bool) -> DataFrame:
    """row_id, doc_id, c1 and c2 (128 bits of the elements and weights), weight, signature."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            elements, weights, counts = elements_of(Words(texts), weighted)
            both = mix(elements + weights.astype(np.uint64) * _STEP)
            c1, c2 = _sum_by_text(both, counts), _sum_by_text(mix(both + np.uint64(7)), counts)
            total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights, minlength=len(counts)).astype(float)  # whole numbers if there are none
            signature = dart_signatures(elements, weights, counts, BANDS * ROWS)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), as_long(c1), as_long(c2), pa.array(total, pa.float64()),
                                              lists(signature.ravel(), np.full(len(counts), BANDS * ROWS))], names=["row_id", "doc_id", "c1", "c2", "weight", "signature"])

    return rows.select("row_id", "doc_id", "text").mapInArrow(sign, "row_id long, doc_id long, c1 long, c2 long, weight double, signature array<int>")


def bands(signed: DataFrame) -> DataFrame:
    """(row_id, band, rest): the hash of each band, and one of the coordinates that follow it, by which a bucket is sorted."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row_id").to_numpy()
            values = batch.column("signature").flatten().to_numpy().reshape(len(row), BANDS, ROWS).astype(np.uint64)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(row), BANDS)).copy()
            rest = np.zeros((len(row), BANDS), np.uint64)
            for i in range(ROWS):
                band = mix(band + values[:, :, i])
                # The coordinates after the band, the first in the highest bits: rows that agree on more of them stand closer.
                rest = (rest << np.uint64(15)) | (np.roll(values, -1, axis=1)[:, :, i] & np.uint64(0x7FFF))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, BANDS)), as_long(band.ravel()), as_long(rest.ravel())], names=["row_id", "band", "rest"])

    return signed.select("row_id", "signature").mapInArrow(split, "row_id long, band long, rest long")


def unit_elements(words: Words, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Elements of weight 1, sorted: a shingle that counts w times is w elements. Weighted similarity is that of these sets."""
    elements, weights, counts = elements_of(words, weighted)
    if not weighted:
        return elements, counts
    times = weights.astype(np.int64)
    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    owner = np.repeat(np.repeat(np.arange(len(counts)), counts), times)
    return distinct_by_text(mix(np.repeat(elements, times) + copy.astype(np.uint64) * _STEP), np.bincount(owner, minlength=len(counts)))


def element_sets(rows: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """(row_id, elements) of the rows whose id is in `wanted`. A bitmap of fixed size keeps most other texts from the join."""
    wanted = stored(wanted.select(F.col("row_id"), F.xxhash64("row_id").alias("h")).distinct(), "wanted")
    sent = bitmap.build(wanted, "h")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bitmap.contains(sent.value, batch.column("h").to_numpy())
            for part, texts in slices(iter([batch.filter(pa.array(keep))]), "text"):
                yield pa.RecordBatch.from_arrays([part.column("row_id"), lists(*unit_elements(Words(texts), weighted))], names=["row_id", "elements"])

    sets = rows.select("row_id", F.xxhash64("row_id").alias("h"), "text").mapInArrow(some, "row_id long, elements array<long>")
    return stored(sets.join(wanted.select("row_id"), "row_id", "left_semi"), "element-sets")


def similar(common, size_a, size_b, similarity: float):
    return common >= similarity * (size_a + size_b - common) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the bound."""
    sides = [sets.select(*[F.col(c).alias(f"{c}_{s}") for c in sets.columns]) for s in ("a", "b")]
    joined = pairs.select("a", "b").join(sides[0], F.col("a") == F.col("row_id_a")).join(sides[1], F.col("b") == F.col("row_id_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("elements_a"), batch.column("elements_b")):
                x, y = np.asarray(x.values), np.asarray(y.values)
                keep.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "elements_a", "elements_b").mapInArrow(check, "a long, b long")


def _unlike(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    left, right = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(~F.coalesce("label_a", "a").eqNullSafe(F.coalesce("label_b", "b"))).select("a", "b")


def missed_links(banded: DataFrame, signed: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, block: int = 128) -> DataFrame:
    """Links (a, b) between components that share a bucket of four or more rows; at least one for every two that are linked.

    Buckets with several components are joined to families, so that two rows that share many buckets are compared once. A family
    is cut into blocks of about `block` rows and a task compares two blocks. A signature estimates similarity 0.8 with a standard
    deviation of 0.04; pairs down to 4.5 of them below are compared exactly. Smaller buckets have had all their pairs.
    """
    large = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 3")
    members = (banded.select("band", "row_id").join(stored(large, "large-buckets"), "band").join(labels.withColumnRenamed("node", "row_id"), "row_id", "left")
               .select("band", "row_id", F.coalesce("label", "row_id").alias("label")))
    members = stored(members, "bucket-members")
    mixed = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("row_id").alias("first")).where("low < high")
    members = stored(members.join(stored(mixed.select("band", "first"), "mixed-buckets"), "band").select("row_id", "label", "first").distinct(), "mixed-members")
    families = components(members.select(F.col("row_id").alias("a"), F.col("first").alias("b"))).withColumnsRenamed({"node": "row_id", "label": "family"})
    sizes = stored(families.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "family-sizes")
    rows = (members.select("row_id", "label").distinct().join(families, "row_id").join(sizes, "family")
            .withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks").cast("int")))
    full = rows.join(signed.select("row_id", "signature"), "row_id").join(sets, "row_id")
    packed = stored(full.groupBy("family", "block", "blocks").agg(F.collect_list(F.struct("row_id", "label", "signature", "elements")).alias("rows")), "blocks")
    left = packed.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", F.col("rows").alias("x")).where("block <= other")
    right = packed.select("family", F.col("block").alias("other"), F.col("rows").alias("y"))
    k = BANDS * ROWS
    least = int(np.floor((similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / k)) * k))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                (row_x, label_x, sign_x, sets_x), (row_y, label_y, sign_y, sets_y) = _unpack(x.values), _unpack(y.values)
                same = np.zeros((len(row_x), len(row_y)), np.int16)
                for c in range(k):
                    same += sign_x[:, c, None] == sign_y[None, :, c]
                i, j = np.nonzero((same >= least) & (label_x[:, None] != label_y[None, :]))
                # The most similar first: two components need one link.
                linked, out = set(), []
                for n in np.argsort(-same[i, j], kind="stable"):
                    u, v = i[n], j[n]
                    key = (min(label_x[u], label_y[v]), max(label_x[u], label_y[v]))
                    if key not in linked and similar(len(np.intersect1d(sets_x[u], sets_y[v], assume_unique=True)), len(sets_x[u]), len(sets_y[v]), similarity):
                        linked.add(key)
                        out.append((int(row_x[u]), int(row_y[v])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out)], names=["a", "b"])

    return left.join(right, ["family", "other"]).select("x", "y").mapInArrow(compare, "a long, b long")


def _unpack(rows: pa.StructArray):
    return (rows.field("row_id").to_numpy(), rows.field("label").to_numpy(), rows.field("signature").flatten().to_numpy().reshape(len(rows), -1),
            [np.asarray(e.values) for e in rows.field("elements")])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """row_id, doc_id and class_id of every row: texts joined by chains of pairs of at least this similarity are one class.

    class_id is the row_id of the class's first row. row_id numbers the rows of the table scan. `weighted` counts a shingle as
    often as it stands in the text; else the similarity is that of the shingle sets. The result is a table; those on the way to it go.
    """
    with lifetime(docs.sparkSession):
        rows = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")))
        signed = stored(signatures(rows, weighted), "signatures")
        groups = stored(signed.groupBy("c1", "c2").agg(F.min("row_id").alias("first"), F.count("*").alias("copies")), "exact-classes")
        one_each = signed.join(groups.select(F.col("first").alias("row_id")), "row_id", "left_semi").where("weight > 0")
        one_each = stored(one_each.select("row_id", "signature"), "distinct-signatures")
        banded = bands(one_each)
        paired = neighbours(banded, "band", "row_id", ["rest"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = stored(paired.groupBy("a", "b").agg(F.count("*").alias("times")), "candidates")
        sets = element_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("row_id")), weighted)
        # First each row's most frequent partner; then only what still joins different components.
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")
        edges = stored(verified(best, sets, similarity), "links")
        labels = components(edges)
        edges = stored(edges.union(verified(_unlike(pairs, labels), sets, similarity)), "links")
        labels = components(edges)
        edges = edges.union(missed_links(banded, one_each, sets, labels, similarity))
        labels = components(edges)
        named = stored(groups.join(labels, F.col("first") == F.col("node"), "left").select("c1", "c2", F.coalesce("label", "first").alias("class_id")), "classes")
        return stored(signed.select("row_id", "doc_id", "c1", "c2").join(named, ["c1", "c2"]).select("row_id", "doc_id", "class_id"), "document-classes", outlives=True)


def first_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near duplicates: of each class the first row of the scan stays, with all its columns."""
    docs = scanned(docs)
    classes = near_duplicates(docs, id_column, text, similarity)
    return without_rows(docs, stored(classes.where("row_id <> class_id").select("row_id"), "duplicates"))

"""Words of many texts at once: byte tables, vectorised word and shingle hashes, Arrow helpers.

A text is handled as its UTF-8 bytes. All hashes depend on the words alone, never on a process, a batch or a partition, so a
retried task gives the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.session import stored

#: Words of letters, digits and all non-ASCII bytes; A-Z become a-z, everything else a blank.
LOWER_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Words of anything but blanks; A-Z become a-z.
BLANK_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Text that one vectorised step takes at most (a longer text is a step of its own).
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch of texts, of which the JVM and the worker hold copies for every task.
BATCH_BYTES = "8m"
#: Of a row number, those that are the row's place in its file.
PLACE_BITS = 36

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session, unless it has a bound of its own: ten thousand texts are much more than as many numbers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m").lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(key, BATCH_BYTES)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a Parquet table by file and place in it. A later scan of the table gives the same numbers, whatever columns it
    reads and however the files are split. Rows that are no such scan are written first: what joins back to `df` by number must
    begin with `scanned(df)` itself.
    """
    df = scanned(df)
    file, place, path, number = (fresh(df, c) for c in ("file", "place", "path", "number"))
    # A path without authority is written with one slash or with three.
    paths = [(p, i) for i, f in enumerate(sorted(df.inputFiles())) for p in {f, f.replace(":///", ":/", 1)}]
    files = df.sparkSession.createDataFrame(paths, f"{path} string, {number} long")
    placed = df.withColumns({file: F.col("_metadata.file_path"), place: F.col("_metadata.row_index")})
    known = F.when(F.col(number).isNull(), F.raise_error(F.concat(F.lit("no number for "), F.col(file))).cast("long")).otherwise(F.col(number))
    row = F.shiftleft(known, PLACE_BITS) + F.col(place)
    return placed.join(F.broadcast(files), F.col(file) == F.col(path), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != name], row.alias(name))


def scanned(df: DataFrame) -> DataFrame:
    """`df` if it is a scan of Parquet files, or columns or a part of one; else its rows written as a table."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    scan = plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString().lower() == "parquet"
    return df if scan and "_metadata" not in df.columns else stored(df, "scanned-rows")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def without_rows(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a table scan (see `scanned`) whose row number is not in the one column of `gone`; all columns, whatever their names."""
    own, other = fresh(df, "row"), fresh(df, "gone")
    numbers = gone.toDF(other)
    return with_row_id(df, own).join(numbers, F.col(own) == F.col(other), "left_anti").drop(own)


def lower_words(text: bytes) -> list[bytes]:
    return text.translate(LOWER_WORDS).split()


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, nulls as empty texts."""
    if column.type != pa.binary():
        column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts have at most `limit` bytes together, or one row."""
    for batch in batches:
        texts = batch.column(column)
        begin = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if i > begin and size + n > limit:
                yield batch.slice(begin, i - begin), texts_of(texts.slice(begin, i - begin))
                begin, size = i, 0
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin), texts_of(texts.slice(begin))
    give_back()


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, for work that makes Python strings of every text: only these are in memory beside the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


_kept: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """What `make` gives, kept by the Python worker for the tasks that follow; only the last value is kept. (A function of this module: what
    a task's closure holds itself is sent anew to every task.)
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    found = _powers.get(name)
    if found is None or len(found) < n:
        found = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = found
    return found[:n]


class Words:
    """The words of several texts: `hashes`, byte offsets `starts` and `ends` in `buffer`, `counts` and `firsts` by text.

    `letters` maps the bytes: what becomes a blank parts words.
    """

    def __init__(self, texts: list[bytes], letters: bytes = LOWER_WORDS):
        self.buffer = b" ".join(texts).translate(letters)
        letters = np.frombuffer(self.buffer, np.uint8)
        edges = np.flatnonzero(np.diff((letters != 32).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.offsets = offsets
        self.firsts = np.searchsorted(self.starts, offsets[:-1])
        self.counts = np.diff(np.append(self.firsts, len(self.starts)))
        n = len(letters)
        total = np.zeros(n + 1, np.uint64)
        # Prefix sums of letter * base^-i: the difference over a word, times base^start, depends on the word alone.
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _power("inverse", _BASE_INVERSE, n), out=total[1:])
        value = (total[self.ends] - total[self.starts]) * _power("base", _BASE, n + 1)[self.starts]
        self.hashes = mix(value + (self.ends - self.starts).astype(np.uint64))

    def words(self, i: int) -> list[bytes]:
        at = slice(self.firsts[i], self.firsts[i] + self.counts[i])
        return [self.buffer[s:e] for s, e in zip(self.starts[at], self.ends[at])]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, where each begins, and runs by text."""
        n = len(self.hashes)
        counts = np.maximum(self.counts - k + 1, 0)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
        value = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            value = value * _BASE + self.hashes[j:n - k + 1 + j]
        begins = np.repeat(self.firsts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return mix(value[begins]), begins, counts

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word shingles of each text, with repeats, and how many each has; a text of 1 to k - 1 words has one shingle, all its words."""
        value, _, counts = self.grams(k)
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if not len(short):
            return value, counts
        own = np.array([short_hash(self.hashes[self.firsts[i]:self.firsts[i] + self.counts[i]]) for i in short], np.uint64)
        return np.insert(value, np.concatenate([[0], np.cumsum(counts)])[short], own), np.where((self.counts > 0) & (self.counts < k), 1, counts)


def short_hash(hashes: np.ndarray) -> np.uint64:
    value = np.array([len(hashes)], np.uint64)
    for h in hashes:
        value = value * _BASE + h
    return mix(value)[0]


def distinct_by_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and how many are left."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.bincount(owner[keep], minlength=len(counts))


def summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sums of their `n`."""
    if not len(values):
        return values, n
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[begins], np.add.reduceat(n, begins)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and their number by row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    flat = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))

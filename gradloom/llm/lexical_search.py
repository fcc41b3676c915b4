"""Ranked lexical search over an inverted index of block-compressed postings, by Block-Max MaxScore.

Index: a task cuts its texts into shards of about `SHARD_BYTES` and inverts each by itself, so nothing is shuffled. A shard is one row: its
documents (id, length), its terms sorted by hash, and per term blocks of `BLOCK` postings, gaps and frequencies as varints. All but the
documents are bytes, so that Spark moves a shard in little memory. What bounds a block's scores are the (frequency, length) pairs that no other posting of the block beats in both; they are stored instead
of a score, so the index needs no corpus statistics and stays right when other shards are added.

Search: document frequencies of the query terms, N and L are summed over the shards. A task then goes through its shards with one heap
of the best k for each query. Lists are sorted by their global bounds; those whose bounds together stay below the heap's worst score
are non-essential: only documents of the other, essential lists are candidates. A candidate is then looked up list by list, the
largest bound first, and is given up once its score so far, its block's bound and the bounds of the lists to come stay below the
heap's worst; blocks without a candidate left are never decompressed. The heaps of all tasks are merged by a window per query.

Queries come in blocks of bounded size, each a job over all shards: what is broadcast never grows with the table of queries.

Scores are 64-bit integers, exact: weight * ((10^9 tf) div (1000 tf + 12 m)) for each term of the query, repeats included, where weight is
floor(1000 ln((2N+2)/(2df+1))) and m = 75 + (25 n N) div L.

Defined cases: a null text or one without terms is in no result and not counted in N; repeated rows are documents of their own. A
null doc_id comes after all others among equal scores. Every row of the query table is an item with its own ranks, also a
repeated one; an item without terms has no result. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from gradloom.llm.words import Words, slices
from gradloom.session import shared_path, stored

#: Text and documents of a shard, postings of a block, text of a block of queries, results by query.
SHARD_BYTES, SHARD_DOCS, BLOCK, QUERY_BYTES, BEST = 8 << 20, 16_384, 64, 4 << 20, 20

#: Bytes of `terms` are 64-bit and of `last` (document of a block) 32-bit numbers, all others varints: `df` by term; by block the sizes of its
#: gaps and frequencies and the number of its bounds.
SHARD = ("n_docs long, n_words long, doc_ids array<long>, lengths array<long>, terms binary, df binary, last binary, "
         "gap_sizes binary, gaps binary, tf_sizes binary, tfs binary, bounds binary, bound_tf binary, bound_n binary")
_NAMES = [f.split()[0] for f in SHARD.split(", ")]
#: A row group for each shard: the writer holds, and the reader decodes, a row group's rows at once, by default a hundred rows of any size at least.
#: Statistics would keep every shard's bytes, as least and greatest values, until the file is closed.
ONE_BY_ONE = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, the last byte below 128: the bytes, and how many each value has."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.uint8)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    begins = np.cumsum(sizes, dtype=np.int64) - sizes
    out = np.zeros(int(sizes.sum(dtype=np.int64)), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        more = (sizes[some] > k + 1).astype(np.uint8) << 7
        out[begins[some] + k] = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more
    return out, sizes


def read_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    value = np.zeros(len(ends), np.int64)
    sizes = ends - begins + 1
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        value[some] |= (data[begins[some] + k] & 127).astype(np.int64) << 7 * k
    return value


def numbers(cell: pa.BinaryScalar, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of several half-open ranges, one after the other."""
    sizes = ends - begins
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def shard_row(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, ids: list, lengths: np.ndarray) -> pa.RecordBatch:
    """One shard from its (term, doc, tf) triples; docs are places in `ids` and `lengths`."""
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order]
    del order
    firsts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    terms, df = term[firsts], np.diff(np.append(firsts, len(term)))
    del term
    place = np.arange(len(doc)) - np.repeat(firsts, df)
    opens = place % BLOCK == 0
    block_begin = np.flatnonzero(opens)
    block_end = np.append(block_begin[1:], len(doc))
    by_block = lambda sizes: np.add.reduceat(sizes, block_begin, dtype=np.int64)
    data = lambda values: varints(values)[0].tobytes()
    # A list's gaps run through its blocks: a block begins from the last document of the one before.
    gaps, gap_size = varints(np.where(place == 0, doc, doc - np.roll(doc, 1) - 1))
    tfs, tf_size = varints(tf - 1)
    del place
    columns = [len(ids), int(lengths.sum()), ids, lengths, terms.tobytes(), data(df), doc[block_end - 1].astype(np.int32).tobytes(),
               data(by_block(gap_size)), gaps.tobytes(), data(by_block(tf_size)), tfs.tobytes()]
    del gaps, gap_size, tfs, tf_size
    block, n = np.cumsum(opens, dtype=np.int32) - 1, lengths[doc]
    by_tf = np.lexsort((n, -tf, block))
    # Down the frequencies of a block, only postings in ever shorter documents can have a better score.
    step = np.int64(n.max() + 1)
    least = np.minimum.accumulate(n[by_tf] - block[by_tf] * step)
    best = by_tf[np.r_[True, least[1:] < least[:-1]]]
    columns += [data(np.bincount(block[best], minlength=len(block_begin))), data(tf[best]), data(n[best])]
    kinds = [f.split()[1] for f in SHARD.split(", ")]
    arrow = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([c], arrow[k]) for c, k in zip(columns, kinds)], names=_NAMES)


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard of the texts (see SHARD), written to the shared folder."""
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, lengths, size = [], [], [], 0

        def emit():
            term, doc, tf = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return shard_row(term, doc, tf, ids, np.array(lengths, np.int64))

        for batch, texts in slices(batches, "text"):
            words = Words(texts)
            some = np.flatnonzero(words.counts)
            if not len(some):
                continue
            number = np.cumsum(words.counts > 0) - 1 + len(ids)
            doc, term = np.repeat(number, words.counts), words.hashes.view(np.int64)
            order = np.lexsort((term, doc))
            term, doc = term[order], doc[order]
            begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
            held.append((term[begins], doc[begins].astype(np.int32), np.diff(np.append(begins, len(term))).astype(np.int32)))
            ids += batch.column("doc_id").take(pa.array(some)).to_pylist()
            lengths += words.counts[some].tolist()
            size += sum(map(len, texts))
            if size >= shard_bytes or len(ids) >= SHARD_DOCS:
                yield emit()
                held, ids, lengths, size = [], [], [], 0
        if ids:
            yield emit()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(invert, SHARD), "lexical-index", options=ONE_BY_ONE)


class Shard:
    """A shard's arrays, and the scores of its blocks for given corpus statistics."""

    def __init__(self, row: dict, n: int, total: int):
        self.row = row
        self.ids = np.array([-1 if i is None else i for i in row["doc_ids"].to_pylist()], np.int64) if row["doc_ids"].null_count else row["doc_ids"].to_numpy()
        self.unnamed = ~np.asarray(row["doc_ids"].is_valid())
        get = lambda name: read_varints(numbers(row[name]))
        begins = lambda sizes: np.append(0, np.cumsum(sizes))
        self.terms, self.last = numbers(row["terms"], np.int64), numbers(row["last"], np.int32)
        self.gaps, self.tfs = numbers(row["gaps"]), numbers(row["tfs"])
        self.block_of = begins(-(-get("df") // BLOCK))
        self.gap_at, self.tf_at = begins(get("gap_sizes")), begins(get("tf_sizes"))
        self.m = self.length_part(row["lengths"].to_numpy(), n, total)
        part = self.part(get("bound_tf"), self.length_part(get("bound_n"), n, total))
        self.block_best = np.maximum.reduceat(part, begins(get("bounds"))[:-1])
        self.list_best = np.maximum.reduceat(self.block_best, self.block_of[:-1])
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = 0

    @staticmethod
    def length_part(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
        # Only a length beyond 3.7e17 / N leaves 64 bits; then Python's integers take over.
        if int(lengths.max(initial=0)) * 25 * n < 1 << 63:
            return 75 + 25 * lengths * n // total
        return np.array([75 + 25 * x * n // total for x in lengths.tolist()], np.int64)

    @staticmethod
    def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The list of each term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, blocks: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and score parts of some blocks, in order, of the list whose first block is `first`."""
        gaps = read_varints(self.gaps[ranges(self.gap_at[blocks], self.gap_at[blocks + 1])])
        tf = read_varints(self.tfs[ranges(self.tf_at[blocks], self.tf_at[blocks + 1])]) + 1
        sizes = np.full(len(blocks), BLOCK)
        sizes[-1] = len(gaps) - BLOCK * (len(blocks) - 1)
        before = np.where(blocks == first, -1, self.last[blocks - 1])
        run = np.cumsum(gaps + 1)
        begins = np.cumsum(sizes) - sizes
        doc = run + np.repeat(before - np.where(begins > 0, run[begins - 1], 0), sizes)
        self.read += len(blocks)
        return doc, self.part(tf, self.m[doc])

    def whole(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole list, kept for the other queries."""
        if at not in self.lists:
            first = self.block_of[at]
            self.lists[at] = self.postings(np.arange(first, self.block_of[at + 1]), first)
        return self.lists[at]


class Best:
    """The k best documents of a query so far: score, whether the id is null, id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.unnamed, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def worst(self) -> int:
        """A document below this score cannot enter; only scores above 0 can."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        score, unnamed, ids = np.append(self.score, score), np.append(self.unnamed, unnamed), np.append(self.ids, ids)
        order = np.lexsort((ids, unnamed, -score))[:self.k]
        self.score, self.unnamed, self.ids = score[order], unnamed[order], ids[order]


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Bring a query's best documents up to date with those of a shard. `weights` has each distinct term's weight times its repeats."""
    lists = shard.find(terms)
    held = np.flatnonzero((lists >= 0) & (weights > 0))
    if not len(held):
        return
    lists, weights = lists[held], weights[held]
    bound = weights * shard.list_best[lists]
    order = np.argsort(bound, kind="stable")
    lists, weights, bound = lists[order], weights[order], bound[order]
    together = np.cumsum(bound)
    worst = best.worst
    essential = int(np.searchsorted(together, worst))  # the first list whose bound, with all smaller ones, reaches the worst score
    if essential == len(lists):
        return
    score = np.zeros(len(shard.ids), np.int64)
    for i in range(essential, len(lists)):
        doc, part = shard.whole(int(lists[i]))
        score[doc] += weights[i] * part
    doc = np.flatnonzero(score)
    for i in range(essential - 1, -1, -1):
        doc = doc[score[doc] + together[i] >= worst]
        if not len(doc):
            return
        at = int(lists[i])
        first, end = int(shard.block_of[at]), int(shard.block_of[at + 1])
        block = first + np.searchsorted(shard.last[first:end], doc)
        inside = block < end
        limit = score[doc] + np.where(inside, weights[i] * shard.block_best[np.minimum(block, end - 1)], 0) + (together[i - 1] if i else 0)
        doc, block, inside = (x[limit >= worst] for x in (doc, block, inside))
        wanted = doc[inside]
        if not len(wanted):
            continue
        blocks = np.unique(block[inside])
        has, part = shard.lists[at] if at in shard.lists else shard.postings(blocks, first)
        place = np.minimum(np.searchsorted(has, wanted), len(has) - 1)
        hit = has[place] == wanted
        score[wanted[hit]] += weights[i] * part[place[hit]]
    doc = doc[score[doc] >= worst]
    if len(doc) > best.k:
        # Below the k-th best of these none can enter, equal ones still can.
        doc = doc[score[doc] >= np.partition(score[doc], -best.k)[-best.k]]
    best.add(score[doc], shard.unnamed[doc], shard.ids[doc])


def _query_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[Row]]:
    """Rows (id, text) of the query table in blocks of at most `limit` bytes of text, or one row."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).toLocalIterator():
        n = 64 + len((row["text"] or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append(row)
        size += n
    if block:
        yield block


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of these terms (sorted hashes). The sums have one row for each term of a block of queries."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for own, df in zip(batch.column("terms"), batch.column("df")):
                own, df = numbers(own, np.int64), read_varints(numbers(df))
                at = np.minimum(np.searchsorted(own, sent.value), len(own) - 1)
                total += np.where(own[at] == sent.value, df[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], names=["at", "df"])

    found = np.zeros(len(terms), np.int64)
    for at, df in index.select("terms", "df").mapInArrow(count, "at int, df long").groupBy("at").agg(F.sum("df")).collect():
        found[at] = df
    return found


def search_block(index: DataFrame, block: list[Row], n: int, total: int, id_type: str, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of a block of queries over all shards."""
    spark = index.sparkSession
    words = Words([(row["text"] or "").encode() for row in block])
    terms = np.unique(words.hashes.view(np.int64))
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * _frequencies(index, terms) + 1))).astype(np.int64)
    queries = []
    for i in range(len(block)):
        own, repeats = np.unique(words.hashes[words.firsts[i]:words.firsts[i] + words.counts[i]].view(np.int64), return_counts=True)
        queries.append((own, weight[np.searchsorted(terms, own)] * repeats))
    sent = spark.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value]
        for batch in batches:
            for row in range(batch.num_rows):
                cells = {f: batch.column(f)[row] for f in _NAMES}
                shard = Shard({f: c.values if isinstance(c, pa.ListScalar) else c for f, c in cells.items()}, n, total)
                for (own, weights), found in zip(sent.value, best):
                    search_shard(shard, own, weights, found)
        for i, found in enumerate(best):
            if len(found.score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found.score), pa.int32()), pa.array(found.ids, pa.int64(), mask=found.unnamed), pa.array(found.score)],
                                                 names=["item", "doc_id", "score"])

    found = index.mapInArrow(search, "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, row["id"]) for i, row in enumerate(block)], f"item int, item_id {id_type}")
    # The names have one row for each item of the block.
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = BEST, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, over an index of `build_index`."""
    sums = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    id_type = items.schema[item_id].dataType.simpleString()
    path = None
    for block in _query_blocks(items, item_id, text, query_bytes):
        path = path or shared_path(index.sparkSession, "ranked")
        search_block(index, block, sums["n"], sums["words"], id_type, k).write.mode("append").parquet(path)
    if path is None:
        return index.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return index.sparkSession.read.parquet(path)


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 20 best documents of every item."""
    return search(build_index(docs), items)

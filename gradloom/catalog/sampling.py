"""Workers, windows, chunks and label joins. Arithmetic keys stand in for hashes, which other engines lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.catalog.registry import Registry, table
from gradloom.session import shared_path, stored
from gradloom.operators.joins import attach_labels, gather, missing_images, missing_labels
from gradloom.operators.numbering import count_distinct
from gradloom.operators.workers import (assign_workers, assign_workers_in_place, batch_id, open_positions, position_window, round_window,
                                        skip_rows, worker_counts, write_positions)
from gradloom.sources.chunks import assign_chunks, chunk_name, write_shuffled_chunks
from gradloom.sources.labels import parse_labels
from gradloom.sources.tabular import read_samples

REGISTRY = Registry()
query = REGISTRY.query
WORKERS = 4


def by_arithmetic(df, id_col="vec_id"):
    """Worker id % 4, rows in id order, numbered in ranges of 4096 ids."""
    key = F.col(id_col)
    return assign_workers(df, WORKERS, id_col, worker=key % WORKERS, order=key, bucket=F.floor(key / 4096))


POS = """w AS (SELECT vec_id, (vec_id % 4)::INTEGER AS worker, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS pos,
count(*) OVER (PARTITION BY vec_id % 4) AS worker_rows FROM embeddings)"""
WINDOW = POS + """, win AS (SELECT *, pos - (worker * 31 + 7) % (worker_rows - 40) AS "offset" FROM w),
picked AS (SELECT * FROM win WHERE "offset" >= 0 AND "offset" < 40)"""


@query("SELECT (o_orderkey % 4)::INTEGER AS worker, count(*) AS worker_rows FROM orders GROUP BY o_orderkey % 4")
def worker_row_counts(spark, folder):
    df = table(spark, folder, "orders").withColumn("worker", (F.col("o_orderkey") % WORKERS).cast("int"))
    return worker_counts(df)


@query("""SELECT o_orderkey, (o_orderkey % 4)::INTEGER AS worker, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1
AS pos, count(*) OVER (PARTITION BY o_orderkey % 4) AS worker_rows FROM orders""")
def worker_positions(spark, folder):
    return by_arithmetic(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, sum(o_orderkey)::BIGINT AS total, 4::BIGINT AS workers, true AS complete FROM orders")
def worker_shuffle(spark, folder):
    """Workers and order from hashes: every row once, and each worker's positions are 0 to its size less 1."""
    placed = stored(assign_workers(table(spark, folder, "orders").select("o_orderkey"), WORKERS, "o_orderkey"), "placed")
    ends = placed.groupBy("worker").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("worker_rows").alias("least"), F.max("worker_rows").alias("most"))
    each = count_distinct(placed, ["worker"], ["o_orderkey", "pos"], placed.count()).join(ends, "worker")
    whole = (F.col("pos") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("least") == F.col("n")) & (F.col("most") == F.col("n"))
    return each.agg(F.sum("n").alias("n"), F.sum("o_orderkey").alias("ids"), F.sum("o_orderkey_total").alias("total"), F.count(F.lit(1)).alias("workers"),
                    F.bool_and(whole).alias("complete"))


def _window(spark, folder):
    df = by_arithmetic(table(spark, folder, "embeddings").select("vec_id"))
    start = (F.col("worker") * 31 + 7) % (F.col("worker_rows") - 40)
    return round_window(df, worker_counts(df), 4, 10, 0, start=start)


@query(f'WITH {WINDOW} SELECT vec_id, worker, pos, "offset" FROM picked')
def round_windows(spark, folder):
    return _window(spark, folder).select("vec_id", "worker", "pos", "offset")


@query(f'WITH {WINDOW} SELECT vec_id, worker, pos, "offset" FROM picked')
def segment_windows(spark, folder):
    """The same windows, read from files in order of positions."""
    df = by_arithmetic(table(spark, folder, "embeddings").select("vec_id"))
    path = shared_path(spark, "positions")
    write_positions(df, path, 16)
    start = (F.col("worker") * 31 + 7) % (F.col("worker_rows") - 40)
    found = position_window(open_positions(spark, path, 16), worker_counts(df), 4, 10, 0, start=start)
    return found.select("vec_id", "worker", "pos", "offset")


@query(f'WITH {WINDOW} SELECT worker, "offset" // 10 AS batch_id, count(*) AS n, min(vec_id) AS low, max(vec_id) AS high FROM picked GROUP BY worker, "offset" // 10')
def batch_ids(spark, folder):
    return _window(spark, folder).groupBy("worker", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))


WRAPPED = POS + """, win AS (SELECT *, (pos - (worker * 31 + 7) % worker_rows + worker_rows) % worker_rows AS "offset" FROM w)"""


@query(f'WITH {WRAPPED} SELECT vec_id, worker, pos, "offset", "offset" // 10 AS batch_id FROM win WHERE "offset" < 100')
def round_windows_wrapped(spark, folder):
    df = by_arithmetic(table(spark, folder, "embeddings").select("vec_id"))
    start = (F.col("worker") * 31 + 7) % F.col("worker_rows")
    return round_window(df, worker_counts(df), 10, 10, 0, wrap=True, start=start)


@query("SELECT count(*) AS n, count(*) AS ids, count(*) AS places FROM lineitem")
def sample_ids(spark, folder):
    """Ids for a table without key are distinct, and so are the places they are assigned."""
    df = read_samples(spark, f"{folder}/lineitem.parquet").select("sample_id")
    placed = assign_workers(df, WORKERS)
    # Equal ids have one worker, so ids are distinct if they are in each worker.
    each = count_distinct(placed, ["worker"], ["sample_id", "pos"], df.count())
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name) for c, name in (("n", "n"), ("sample_id", "ids"), ("pos", "places"))])


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, sum(o_orderkey)::BIGINT AS total, 3::BIGINT AS workers, true AS complete FROM orders")
def workers_in_place(spark, folder):
    """Every row once, and each worker's positions without repeats."""
    df = stored(assign_workers_in_place(table(spark, folder, "orders").repartition(8), 3), "workers")
    each = count_distinct(df, ["worker"], ["o_orderkey", "pos"], df.count())
    return each.agg(F.sum("n").alias("n"), F.sum("o_orderkey").alias("ids"), F.sum("o_orderkey_total").alias("total"), F.count(F.lit(1)).alias("workers"),
                    F.bool_and(F.col("pos") == F.col("n")).alias("complete"))


@query(f"WITH {POS} SELECT worker, pos // 30 AS batch_id, count(*) AS n FROM w GROUP BY worker, pos // 30")
def batches_with_short_last(spark, folder):
    df = by_arithmetic(table(spark, folder, "embeddings").select("vec_id"))
    return df.groupBy("worker", batch_id(F.col("pos"), 30).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POS} SELECT vec_id, worker, pos FROM w WHERE pos >= 100")
def skip_first_rows(spark, folder):
    df = by_arithmetic(table(spark, folder, "embeddings").select("vec_id"))
    return skip_rows(df, 100).select("vec_id", "worker", "pos")


@query("""SELECT doc_id, rn AS position, (rn % 7)::INTEGER AS chunk, 'train.' || lpad((rn % 7)::VARCHAR, 5, '0') AS name FROM (
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)""")
def chunk_assign(spark, folder):
    key = F.col("doc_id")
    dealt = assign_chunks(table(spark, folder, "documents").select("doc_id"), 7, key, F.floor(key / 4096))
    return dealt.withColumn("name", chunk_name("train", F.col("chunk"), 5))


@query("""SELECT doc_id, md5(text) AS text, sizes AS chunk_sizes FROM documents, (SELECT list((n + 6 - i) // 7 ORDER BY i) AS sizes FROM range(7) c(i),
(SELECT count(*) AS n FROM documents))""")
def shuffled_chunks(spark, folder):
    """Documents dealt into seven chunks in hashed order, written and read back: every text, and the chunks' sizes."""
    path = shared_path(spark, "chunks")
    write_shuffled_chunks(table(spark, folder, "documents").select("doc_id", "text"), 7, path, "doc_id", files_per_chunk=2)
    back = spark.read.parquet(path)
    sizes = back.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "n"))), lambda x: x["n"]).alias("sizes"))  # seven rows
    return back.select("doc_id", F.md5("text").alias("text")).withColumn("chunk_sizes", sizes.scalar())


@query("""SELECT documents.doc_id AS doc_id, lang, n_chars, quality FROM documents JOIN labels ON documents.doc_id = labels.doc_id""")
def label_join(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return attach_labels(docs, table(spark, folder, "labels"), "drop", "doc_id", "quality")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag AS flag, code FROM lineitem
JOIN (SELECT l_returnflag AS f, count(*) AS code FROM lineitem GROUP BY l_returnflag) ON l_returnflag = f""")
def label_join_few_keys(spark, folder):
    """Each of the three keys holds about a third of the rows; no key may lack its label."""
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("flag"))
    codes = df.groupBy("flag").agg(F.count(F.lit(1)).alias("code"))
    return attach_labels(df, codes, "error", "flag", "code")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_missing(spark, folder):
    return missing_labels(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query("SELECT labels.doc_id AS doc_id, toxic, length(text) AS n FROM labels JOIN documents ON labels.doc_id = documents.doc_id")
def label_gather(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return gather(table(spark, folder, "labels").select("doc_id", "toxic"), docs, "doc_id")


@query("SELECT documents.doc_id AS doc_id, lang, toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id")
def label_gather_dropped(spark, folder):
    """The documents stand for label rows, of which many have nothing to fetch."""
    return gather(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "drop")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gather_missing(spark, folder):
    return missing_images(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query("""SELECT f AS filename, arg_max(n, page_id)::INTEGER AS label, count(*) AS lines FROM (
SELECT page_id, list_last(string_split(url, '/')) AS f, length(html) AS n FROM pages) GROUP BY f""")
def label_lines(spark, folder):
    """Lines `url length` of the pages, keyed by the last part of the url; the last page of a key wins."""
    pages = table(spark, folder, "pages")
    lines = pages.select(F.concat_ws(" ", "url", F.length("html")).alias("line"), F.struct("page_id").alias("order"))
    return parse_labels(lines)

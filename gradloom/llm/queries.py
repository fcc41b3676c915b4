"""The operators over the test tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.catalog import registry
from gradloom.catalog.registry import Registry
from gradloom.llm import (bpe, decontaminate, language_model, lexical_search, licenses, mixing, near_duplicates, privacy, suffixes, toxicity, vector_search,
                          warc, whitening)
from gradloom.llm.words import bound_batches
from gradloom.session import shared_path, stored

REGISTRY = Registry()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return registry.table(spark, folder, name)


# Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS winner FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('{BASE32}', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)
FOR i IN range(32)], '') AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS NOT DISTINCT FROM winner THEN NULL ELSE winner END AS refers_to FROM w"""


@REGISTRY.query(WARC_SQL)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = shared_path(spark, "warc")
    warc.write_warc(warc.label_revisits(table(spark, folder, "pages")), archive)
    return warc.read_warc(spark, archive).select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                                 warc.page_number("refers_to").alias("refers_to"))


@REGISTRY.query(None)
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


MIX_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap, 3 * source_size / (rank % 3 + 1)::DOUBLE AS ratio FROM r),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER a, 0)::DOUBLE AS room, ((sum(weight) OVER ()) - coalesce(sum(weight) OVER a, 0))::DOUBLE AS left_ FROM w
WINDOW a AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT room / left_ AS level FROM l WHERE room / left_ <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, greatest(least(cap::DOUBLE, weight * coalesce((SELECT level FROM v), 'inf'::DOUBLE)), 0.0) AS target FROM w),
o AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target, (CASE WHEN source_size > 0 THEN budget // source_size * size + least(greatest(budget % source_size - ahead, 0), size) ELSE 0 END)::BIGINT AS taken FROM o"""


@REGISTRY.query(MIX_SQL)
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


@REGISTRY.query(None)
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@REGISTRY.query(None)
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_corpus(table(spark, folder, "documents"))


@REGISTRY.query(None)
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """class_id is the smallest doc_id of the class, or null if all are null."""
    classes = near_duplicates.near_duplicates(table(spark, folder, "documents"))
    names = stored(classes.groupBy("class_id").agg(F.min("doc_id").alias("name"), F.count("*").alias("members")), "class-names")
    return classes.join(names, "class_id").select("doc_id", F.col("name").alias("class_id"), "members")


SHINGLES_SQL = r"""{0}_words AS (SELECT {1} AS id, rowid AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT *, row_number() OVER () AS rowid FROM {0})),
{0}_shingles AS (SELECT DISTINCT id, n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS x FROM {0}_words)"""
CONTAINED_SQL = "WITH " + SHINGLES_SQL.format("documents", "doc_id") + ", " + SHINGLES_SQL.format("benchmark", "item_id") + """,
sizes AS (SELECT id, n, count(*) AS item_shingles FROM benchmark_shingles GROUP BY id, n),
hits AS (SELECT d.id AS doc_id, d.n AS dn, b.id AS item_id, b.n AS bn, count(*) AS shared FROM documents_shingles d JOIN benchmark_shingles b USING (x) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment FROM hits JOIN sizes ON bn = sizes.n WHERE shared >= 0.8 * item_shingles - 1e-9"""


@REGISTRY.query(CONTAINED_SQL)
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_id")


@REGISTRY.query(None)
def op7_shared_passages(spark: SparkSession, folder: str) -> DataFrame:
    """With row_id, since the links name rows."""
    return suffixes.shared_passages(table(spark, folder, "documents"))


@REGISTRY.query(None)
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.digest(privacy.personal_data(table(spark, folder, "documents")))


@REGISTRY.query(None)
def op4_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.nearest(table(spark, folder, "embeddings"))


RANKED_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS b, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, b, t, count(*) AS repeats FROM b GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n_all, sum(len(w))::BIGINT AS l_all FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, r, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
f AS (SELECT doc_id, r, n, t, count(*)::BIGINT AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY ALL),
g AS (SELECT t, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY t, n_all),
m AS (SELECT item_id, b, doc_id, r, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))))::BIGINT AS score
FROM f JOIN g USING (t) JOIN q USING (t), s GROUP BY item_id, b, doc_id, r)
SELECT item_id, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM m WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) <= 20"""


@REGISTRY.query(RANKED_SQL)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@REGISTRY.query(None)
def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), bpe.read_vocabulary(bpe.default_path()))


@REGISTRY.query(None)
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = REGISTRY.queries

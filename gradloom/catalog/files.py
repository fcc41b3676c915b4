"""Binary formats, decoded from bytes and files that Spark derives from the tables."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from gradloom.catalog.preparation import PLANES, image_struct, pixel_bytes
from gradloom.catalog.registry import Registry, elements, table
from gradloom.functions.convert import byte_at, unsigned_bytes
from gradloom.session import shared_path, shuffle_partitions
from gradloom.sources.archives import expand_tar, index_tar, land_members, list_archives, read_nested_tar, read_tar
from gradloom.sources.files import basename
from gradloom.sources.idx import (IMAGE_MAGIC, LABEL_MAGIC, decode_idx_images, decode_idx_labels, idx_header, read_idx_images,
                                  read_idx_labels, zip_by_index)
from gradloom.sources.images import read_labelled_images
from gradloom.sources.labels import publish_labels, read_labels
from gradloom.sources.records import decode_fixed_records, read_fixed_records
from gradloom.sources.tabular import read_csv_features

REGISTRY = Registry()
query = REGISTRY.query
PER_CHUNK = 64


def _packed(df, record):
    """(chunk, content): the records of 64 consecutive ids joined in id order."""
    ordered = F.array_sort(F.collect_list(F.struct("vec_id", F.hex(record).alias("h"))))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda s: s["h"]), ""))
    return df.groupBy(F.floor(F.col("vec_id") / PER_CHUNK).alias("chunk")).agg(joined.alias("content"))


def _sums(vector):
    return F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i % 7 + 1)), F.lit(0.0), lambda t, x: t + x)


def _landed(spark, df, name):
    """Write (filename, content) rows as files of a new folder; returns its path."""
    folder = shared_path(spark, name)
    land_members(df.select("filename", "content"), folder, unique_names=True).write.format("noop").mode("overwrite").save()
    return folder


def _tarred(rows: pa.Table) -> pa.Table:
    """One archive of the rows' (member, body) with the first row's `filename`."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        archive.addfile(_directory())
        for row in rows.sort_by("member").to_pylist():
            entry = tarfile.TarInfo(row["member"])
            entry.size = len(row["body"])
            archive.addfile(entry, io.BytesIO(row["body"]))
    return pa.table({"filename": pa.array([rows["filename"][0].as_py()]), "content": pa.array([out.getvalue()])})


def tar_up(df):
    """(filename, member, body) to (filename, content)."""
    return df.groupBy("filename").applyInArrow(_tarred, "filename string, content binary")


SUMS = """WITH px AS (SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1) AS pos,
floor((unnest(embedding)::DOUBLE + 1) * 127.5)::INTEGER AS px FROM embeddings),
s AS (SELECT vec_id, any_value(label) AS label, sum(px * (pos % 7 + 1))::DOUBLE AS total FROM px GROUP BY vec_id)
"""


@query(SUMS + """SELECT 'data_batch_' || (vec_id // 64) || '.bin' AS file, vec_id % 64 AS record_index,
CASE WHEN vec_id // 64 = 3 THEN 'test' ELSE 'train' END AS split, label, total FROM s""")
def fixed_records(spark, folder):
    df = table(spark, folder, "embeddings")
    chunks = _packed(df, F.concat(F.unhex(F.lpad(F.hex("label"), 2, "0")), pixel_bytes()))
    name = F.concat(F.lit("/in/data_batch_"), F.col("chunk"), F.lit(".bin"))
    chunks = chunks.select(name.alias("path"), F.lit(0).cast("bigint").alias("first_record"), "content")
    rows = decode_fixed_records(chunks, (1, 8, 8), test_file="data_batch_3.bin")
    return rows.select(basename(F.col("path")).alias("file"), "record_index", "split", "label", _sums("data").alias("total"))


@query(SUMS + "SELECT vec_id AS sample_id, label::BIGINT AS label, total FROM s")
def idx_samples(spark, folder):
    df = table(spark, folder, "embeddings")
    one_file = [F.lit("/in/images").alias("path"), (F.col("chunk") * PER_CHUNK).alias("first_record"), "content"]
    images = _packed(df, pixel_bytes()).select(*one_file, F.lit(64).cast("bigint").alias("record_bytes"))
    labels = _packed(df, F.unhex(F.lpad(F.hex("label"), 2, "0"))).select(*one_file)
    pairs = zip_by_index(decode_idx_images(images), decode_idx_labels(labels))
    return pairs.select("sample_id", "label", _sums("data").alias("total"))


@query("SELECT label, count(*) AS images, 8::BIGINT AS height, 8::BIGINT AS width FROM embeddings GROUP BY label")
def idx_headers(spark, folder):
    counts = table(spark, folder, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    header = F.unhex(F.concat(number(F.lit(IMAGE_MAGIC)), number(F.col("n")), number(F.lit(8)), number(F.lit(8))))
    extents = counts.select("label", idx_header(header, 3, IMAGE_MAGIC).alias("e"))
    return extents.select("label", *[F.col("e")[i].alias(n) for i, n in enumerate(("images", "height", "width"))])


@query("""SELECT doc_id, ('0x' || substr(hex(encode(text)), 1, 2))::INTEGER AS first_byte,
('0x' || right(hex(encode(text)), 2))::INTEGER AS last_byte FROM documents WHERE length(text) > 0""")
def unsigned_byte_at(spark, folder):
    df = table(spark, folder, "documents").filter(F.length("text") > 0)
    raw = F.encode("text", "UTF-8")
    return df.select("doc_id", byte_at(raw, F.lit(0)).alias("first_byte"), byte_at(raw, F.length(raw) - 1).alias("last_byte"))


def _directory() -> tarfile.TarInfo:
    entry = tarfile.TarInfo("docs")
    entry.type = tarfile.DIRTYPE
    return entry


@query("SELECT doc_id // 20 AS archive, doc_id || '.txt' AS filename, octet_length(encode(text)) AS size FROM documents")
def tar_members(spark, folder):
    """Twenty documents per archive, each archive with a directory entry."""
    return expand_tar(_document_archives(spark, folder)).select(
        F.split("filename", "-")[0].cast("bigint").alias("archive"), basename(F.col("member")).alias("filename"),
        F.length("content").cast("bigint").alias("size"))


def _document_archives(spark, folder):
    archive = F.floor(F.col("doc_id") / 20)
    return tar_up(table(spark, folder, "documents").select(
        F.concat(archive, F.lit("-docs.tar")).alias("filename"), F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("member"),
        F.encode("text", "UTF-8").alias("body")))


@query("SELECT (doc_id // 20) || '-docs.tar' AS archive, doc_id || '.txt' AS filename, octet_length(encode(text)) AS size FROM documents")
def tar_files(spark, folder):
    """The same archives as files: listed, indexed by header, members read by range."""
    members = read_tar(spark, _landed(spark, _document_archives(spark, folder), "tars"))
    return members.select(F.col("parent").alias("archive"), "filename", F.length("content").cast("bigint").alias("size"))


@query("SELECT (doc_id // 20) || '-docs.tar' AS inner_archive, doc_id || '.txt' AS filename, octet_length(encode(text)) AS size FROM documents")
def nested_tar_files(spark, folder):
    """Archives of ten such archives each."""
    inner = _document_archives(spark, folder).withColumnRenamed("filename", "member").withColumnRenamed("content", "body")
    outer = F.concat(F.floor(F.split("member", "-")[0].cast("bigint") / 10), F.lit("-outer.tar"))
    members = read_nested_tar(spark, _landed(spark, tar_up(inner.withColumn("filename", outer)), "nested"))
    return members.select(F.col("parent").alias("inner_archive"), "filename", F.length("content").cast("bigint").alias("size"))


@query(SUMS + """SELECT 'data_batch_' || (vec_id // 64) || '.bin' AS file, vec_id % 64 AS record_index,
'train' AS split, label, total FROM s""")
def fixed_record_files(spark, folder):
    df = table(spark, folder, "embeddings")
    chunks = _packed(df, F.concat(F.unhex(F.lpad(F.hex("label"), 2, "0")), pixel_bytes()))
    named = chunks.select(F.concat(F.lit("data_batch_"), "chunk", F.lit(".bin")).alias("filename"), "content")
    rows = read_fixed_records(spark, _landed(spark, named, "records"), (1, 8, 8))
    return rows.select(basename(F.col("path")).alias("file"), "record_index", "split", "label", _sums("data").alias("total"))


@query(SUMS + "SELECT vec_id // 64 AS file, vec_id % 64 AS record_index, label::BIGINT AS label, total FROM s")
def idx_files(spark, folder):
    """Image and label files of 64 samples each, with headers, paired by file and record number."""
    df = table(spark, folder, "embeddings")
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    images, labels = _packed(df, pixel_bytes()), _packed(df, F.unhex(F.lpad(F.hex("label"), 2, "0")))
    image_head = F.unhex(F.concat(number(F.lit(IMAGE_MAGIC)), number(F.length("content") / 64), number(F.lit(8)), number(F.lit(8))))
    label_head = F.unhex(F.concat(number(F.lit(LABEL_MAGIC)), number(F.length("content"))))
    named = lambda t, head: t.select(F.col("chunk").cast("string").alias("filename"), F.concat(head, F.col("content")).alias("content"))
    keyed = lambda t: t.withColumn("file", basename(F.col("path")).cast("bigint")).drop("path")
    left = keyed(read_idx_images(spark, _landed(spark, named(images, image_head), "idx-images")))
    right = keyed(read_idx_labels(spark, _landed(spark, named(labels, label_head), "idx-labels")))
    return left.join(right, ["file", "record_index"]).select("file", "record_index", "label", _sums("data").alias("total"))


@query("""SELECT p_partkey::INTEGER AS "C0", p_size AS "C1", p_retailprice AS "C2", p_brand AS "C3" FROM part""")
def csv_features(spark, folder):
    path = shared_path(spark, "csv")
    table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand").write.csv(path)
    return read_csv_features(spark, path)


def bitmap():
    """Embeddings as 8 x 8 bitmap files: a 54-byte header, then rows of blue, green, red bytes from the bottom up."""
    # File size 246, data at 54, header size 40, width 8, height 8, 1 plane, 24 bits, 192 data bytes.
    header = ("424D" "F6000000" "00000000" "36000000" "28000000" "08000000" "08000000" "0100" "1800" "00000000" "C0000000"
              "00000000" "00000000" "00000000" "00000000")
    data = image_struct()["data"]
    rows = [F.substring(data, 24 * r + 1, 24) for r in reversed(range(8))]
    return F.concat(F.unhex(F.lit(header)), *rows)


def _image_archives(df, name, body):
    """Archives of fifty images each. The images are made behind the exchange: their table may be one small file, and would be one task."""
    placed = df.withColumn("filename", F.concat(F.floor(F.col("vec_id") / 50), F.lit(".tar")))
    placed = placed.repartition(shuffle_partitions(df.sparkSession), "filename")
    return tar_up(placed.select("filename", F.concat(F.lit("x/"), name).alias("member"), body.alias("body")))


@query(f"""WITH {PLANES} SELECT vec_id, label::INTEGER AS label, (c * 16 + (spot // 16) * 4 + (spot % 8) // 2)::INTEGER AS pos,
floor(avg(px) + 0.5)::DOUBLE AS value FROM (SELECT plane.*, embeddings.label FROM plane JOIN embeddings ON plane.vec_id = embeddings.vec_id)
GROUP BY vec_id, label, c, spot // 16, (spot % 8) // 2""")
def image_archives(spark, folder):
    """Archives of bitmaps and a label file to decoded, resized, labelled images."""
    df = table(spark, folder, "embeddings")
    name = F.concat("vec_id", F.lit(".bmp"))
    archives = _image_archives(df, name, bitmap())
    labels_path = shared_path(spark, "labels")
    publish_labels(df.select(F.concat(F.lit("y/"), name).alias("filename"), "label"), labels_path)
    index = index_tar(list_archives(spark, _landed(spark, archives, "image-tars"), shuffle_partitions(spark)))
    images, _ = read_labelled_images(index, read_labels(spark, labels_path), 4, 4, "error")
    rows = images.select(F.split("filename", "[.]")[0].cast("bigint").alias("vec_id"), "label", unsigned_bytes(F.col("data")).alias("v"))
    return elements(rows, ["vec_id", "label"], F.col("v"))


@query("""SELECT label, count(*) FILTER (WHERE vec_id % 11 <> 3) AS images, any_value(n) AS read, any_value(kept) AS kept, any_value(n - kept) AS dropped
FROM embeddings, (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 11 <> 3) AS kept FROM embeddings WHERE vec_id % 7 <> 2)
WHERE vec_id % 7 <> 2 GROUP BY label""")
def broken_images_dropped(spark, folder):
    """Archives in which every eleventh image is broken and every seventh has no label: what is decoded by label, and how many were dropped."""
    df = table(spark, folder, "embeddings")
    name = F.concat("vec_id", F.lit(".bmp"))
    body = F.when(F.col("vec_id") % 11 == 3, F.encode(F.lit("no image"), "UTF-8")).otherwise(bitmap())
    archives = _image_archives(df, name, body)
    labels = df.where("vec_id % 7 <> 2").select(name.alias("filename"), "label")
    index = index_tar(list_archives(spark, _landed(spark, archives, "broken-tars"), shuffle_partitions(spark)))
    images, counts = read_labelled_images(index, labels, 4, 4, group_bytes=40_000)
    by_label = images.groupBy("label").agg(F.count(F.lit(1)).alias("images"))
    return by_label.withColumns({c: counts.select(c).scalar() for c in counts.columns})

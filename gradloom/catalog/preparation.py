"""Conversion and image preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.catalog.registry import EMB, PIX, Registry, elements, pixels, r6, table
from gradloom.functions.convert import signed_bytes, to_float_vector, to_typed, unsigned_bytes, unsigned_bytes_native
from gradloom.functions.image import crop_chw, crop_corner, prepare_hwc, random_crop, rescale, round_crop, subtract_mean, to_planar_rgb
from gradloom.functions.shapes import counting, indexed, let
from gradloom.operators.means import mean_by_position, mean_image, mean_vector, publish_mean
from gradloom.operators.samples import apply_null_policy, convert_inputs, null_counts, project, widen, with_scalar
from gradloom.operators.score import prepared_input
from gradloom.plans.net import softmax_regression
from gradloom.session import shuffle_partitions

REGISTRY = Registry()
query = REGISTRY.query


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::FLOAT::DOUBLE AS quantity,
l_extendedprice::FLOAT::DOUBLE AS price, l_linenumber::FLOAT::DOUBLE AS line, l_orderkey::FLOAT::DOUBLE AS orderkey
FROM lineitem""")
def scalar_to_vector(spark, folder):
    df = table(spark, folder, "lineitem")
    one = lambda name: to_float_vector(df, name)[0].cast("double")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", one("l_quantity").alias("quantity"),
                     one("l_extendedprice").alias("price"), one("l_linenumber").alias("line"),
                     one("l_orderkey").alias("orderkey"))


@query("""SELECT p_partkey, p_size::BIGINT AS size_long, p_retailprice::FLOAT::DOUBLE AS price_float,
p_partkey::INTEGER AS key_int, p_size::DOUBLE AS size_double FROM part""")
def typed_conversion(spark, folder):
    df = table(spark, folder, "part")
    return df.select("p_partkey", to_typed(df, "p_size", "long").alias("size_long"),
                     to_typed(df, "p_retailprice", "float").cast("double").alias("price_float"),
                     to_typed(df, "p_partkey", "int").alias("key_int"),
                     to_typed(df, "p_size", "double").alias("size_double"))


BYTES = """WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents),
b AS (SELECT doc_id, ('0x' || unnest(h))::INTEGER AS u, generate_subscripts(h, 1) - 1 AS i FROM h)
"""
UNSIGNED = BYTES + """SELECT doc_id, count(*) AS n, sum(u)::DOUBLE AS total, sum(u * (i % 97))::DOUBLE AS checksum
FROM b GROUP BY doc_id"""


def _checksum(df, vector):
    """Sums over each row's vector, in the row: nothing is exploded or shuffled."""
    add = lambda a, x: a + x
    values = df.select("doc_id", vector.alias("x")).filter(F.size("x") > 0)
    weighted = F.transform("x", lambda x, i: x.cast("double") * (i % 97))
    return values.select("doc_id", F.size("x").cast("bigint").alias("n"), F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), add).alias("total"),
                         F.aggregate(weighted, F.lit(0.0), add).alias("checksum"))


@query(UNSIGNED)
def bytes_to_vector(spark, folder):
    df = widen(table(spark, folder, "documents"), shuffle_partitions(spark)).withColumn("raw", F.encode("text", "UTF-8"))
    return _checksum(df, unsigned_bytes(F.col("raw")))


@query(UNSIGNED)
def bytes_to_vector_native(spark, folder):
    df = widen(table(spark, folder, "documents"), shuffle_partitions(spark)).withColumn("raw", F.encode("text", "UTF-8"))
    return _checksum(df, unsigned_bytes_native(F.col("raw")))


@query(BYTES + """SELECT doc_id, count(*) AS n, sum(s)::DOUBLE AS total, sum(s * (i % 97))::DOUBLE AS checksum
FROM (SELECT doc_id, i, CASE WHEN u > 127 THEN u - 256 ELSE u END AS s FROM b) GROUP BY doc_id""")
def bytes_signed(spark, folder):
    df = widen(table(spark, folder, "documents"), shuffle_partitions(spark)).withColumn("raw", F.encode("text", "UTF-8"))
    return _checksum(df, signed_bytes(F.col("raw")))


@query(f"WITH {PIX} SELECT vec_id, pos, round(px / 255.0::DOUBLE - 0.5, 6) + 0.0 AS value FROM pix")
def rescale_pixels(spark, folder):
    return elements(table(spark, folder, "embeddings"), ["vec_id"], rescale(pixels()))


@query(f"""WITH {PIX} SELECT vec_id, pos, round((CASE WHEN px > 127 THEN px - 256 ELSE px END) / 255.0::DOUBLE - 0.5, 6)
+ 0.0 AS value FROM pix""")
def rescale_signed(spark, folder):
    return elements(table(spark, folder, "embeddings"), ["vec_id"], rescale(pixels(), signed=True))


MEAN = f"WITH {EMB} SELECT pos, round(avg(x), 6) + 0.0 AS value FROM emb GROUP BY pos"
PIXEL_MEAN = f"WITH {PIX} SELECT pos, round(sum(px) / count(*), 6) + 0.0 AS value FROM pix GROUP BY pos"


@query(MEAN)
def mean_vector_by_position(spark, folder):
    df = table(spark, folder, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    return mean_by_position(df, "embedding").select("pos", r6("mean").alias("value"))


@query(MEAN)
def mean_vector_summary(spark, folder):
    return elements(mean_vector(table(spark, folder, "embeddings"), "embedding"), [], F.col("mean"))


@query(PIXEL_MEAN)
def mean_vector_pixels(spark, folder):
    df = table(spark, folder, "embeddings").select(pixels().alias("data"))
    return mean_by_position(df, "data").select("pos", r6("mean").alias("value"))


def pixel_bytes(embedding="embedding"):
    """Pixels as `binary`."""
    return F.unhex(F.array_join(F.transform(pixels(embedding), lambda p: F.lpad(F.hex(p), 2, "0")), ""))


@query(PIXEL_MEAN)
def mean_image_bytes(spark, folder):
    df = table(spark, folder, "embeddings").select(pixel_bytes().alias("data"))
    return elements(mean_image(df, "data", (1, 8, 8)), [], F.col("mean"))


@query(f"""WITH {EMB}, m AS (SELECT pos, avg(x) AS m FROM emb GROUP BY pos)
SELECT vec_id, emb.pos AS pos, round(x - m, 6) + 0.0 AS value FROM emb JOIN m ON emb.pos = m.pos""")
def subtract_mean_vector(spark, folder):
    df = table(spark, folder, "embeddings")
    centred = with_scalar(df, "mean", mean_vector(df, "embedding"))
    return elements(centred, ["vec_id"], subtract_mean(F.col("embedding").cast("array<double>"), F.col("mean")))


CROP = f"""WITH {EMB}, g AS (SELECT vec_id, x, pos // 16 AS c, (pos // 4) % 4 - vec_id % 2 AS r, pos % 4 - vec_id % 3 AS q FROM emb)
SELECT vec_id, (c * 6 + r * 2 + q)::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM g
WHERE r BETWEEN 0 AND 2 AND q BETWEEN 0 AND 1"""


@query(CROP)
def crop(spark, folder):
    at = [(F.col("vec_id") % n).cast("int") for n in (2, 3)]
    return elements(table(spark, folder, "embeddings"), ["vec_id"], crop_chw(F.col("embedding"), (4, 4, 4), (3, 2), *at))


@query(f"""WITH {EMB}, m AS (SELECT pos, avg(x) AS m FROM emb GROUP BY pos), g AS (SELECT vec_id, x - m AS x, emb.pos // 16 AS c,
(emb.pos // 4) % 4 - vec_id % 2 AS r, emb.pos % 4 - vec_id % 3 AS q FROM emb JOIN m ON emb.pos = m.pos)
SELECT vec_id, ((r * 2 + q) * 4 + c)::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM g
WHERE r BETWEEN 0 AND 2 AND q BETWEEN 0 AND 1""")
def crop_chw_to_hwc(spark, folder):
    df = table(spark, folder, "embeddings")
    at = [(F.col("vec_id") % n).cast("int") for n in (2, 3)]
    centred = with_scalar(df, "mean", mean_vector(df, "embedding"))
    vector = prepare_hwc(F.col("embedding").cast("array<double>"), F.col("mean"), (4, 4, 4), (3, 2), *at)
    return elements(centred, ["vec_id"], vector)


#: Embeddings as 4 x 4 x 4 bytes, their mean image, and in each round crops of 3 x 2 pixels with a corner from id and round.
CROPPED = PIX + """, mean AS (SELECT pos, avg(px)::FLOAT AS m FROM pix GROUP BY pos), rounds AS (SELECT unnest([0, 1, 2]) AS round),
cropped AS (SELECT round, vec_id, label, (px::FLOAT - m)::DOUBLE AS x, pix.pos // 16 AS c, (pix.pos // 4) % 4 - (vec_id + round) % 2 AS r,
pix.pos % 4 - (vec_id + 2 * round) % 3 AS q FROM pix JOIN mean ON pix.pos = mean.pos, rounds),
crops AS (SELECT round, vec_id, label, c, r, q, x FROM cropped WHERE r BETWEEN 0 AND 2 AND q BETWEEN 0 AND 1)"""


def crop_corners(sample, round_no):
    return F.pmod(sample + round_no, F.lit(2)).cast("int"), F.pmod(sample + 2 * round_no, F.lit(3)).cast("int")


def byte_images(spark, folder):
    """(vec_id, label, data): embeddings as byte images."""
    return table(spark, folder, "embeddings").select("vec_id", "label", pixel_bytes().alias("data"))


def cropping_net(images, interleave=False):
    """Softmax regression on crops minus the stored mean image, drawn anew in each round."""
    mean = publish_mean(images, "data", (4, 4, 4))
    return softmax_regression(24, 10).prepared("data", round_crop(mean, (4, 4, 4), (3, 2), id_col="vec_id", corner=crop_corners, interleave=interleave))


def _crop_rounds(spark, folder, interleave):
    images = byte_images(spark, folder)
    net = cropping_net(images, interleave=interleave)
    parts = [prepared_input(images, net, "data", ["vec_id"], r).withColumn("round", F.lit(r)) for r in range(3)]
    return elements(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["round", "vec_id"], F.col("data"))


@query(f"WITH {CROPPED} SELECT round::INTEGER AS round, vec_id, (c * 6 + r * 2 + q)::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM crops")
def crop_rounds(spark, folder):
    """Planar batches of three rounds: the stored mean subtracted, another crop in each."""
    return _crop_rounds(spark, folder, False)


@query(f"WITH {CROPPED} SELECT round::INTEGER AS round, vec_id, ((r * 2 + q) * 4 + c)::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM crops")
def crop_rounds_interleaved(spark, folder):
    return _crop_rounds(spark, folder, True)


@query("SELECT vec_id, 90 AS size, true AS same, true AS inside FROM embeddings")
def crop_random(spark, folder):
    """Each random crop is the image at its corner, value by value, and the corner leaves room for it."""
    image = F.concat("embedding", F.reverse("embedding"), F.transform("embedding", lambda x: -x))
    row, col = crop_corner(F.col("vec_id"), (3, 8, 8), (5, 6))
    df = table(spark, folder, "embeddings").select("vec_id", image.alias("image"), row.alias("row"), col.alias("col"),
                                                   random_crop(image, (3, 8, 8), (5, 6), F.col("vec_id")).alias("crop"))
    at = lambda i: F.floor(i / 30) * 64 + (F.col("row") + F.floor(i % 30 / 6)) * 8 + F.col("col") + i % 6
    expected = F.transform(F.sequence(F.lit(0), F.lit(89)), lambda i: F.get("image", at(i).cast("int")))
    return df.select("vec_id", F.size("crop").alias("size"), (F.col("crop") == expected).alias("same"),
                     (F.col("row").between(0, 3) & F.col("col").between(0, 2)).alias("inside"))


@query("""SELECT count(*) FILTER (WHERE quality IS NULL) AS quality, count(*) FILTER (WHERE toxic IS NULL) AS toxic,
count(*) FILTER (WHERE lang IS NULL) AS lang FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id""")
def null_inputs(spark, folder):
    df = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return null_counts(df, ["quality", "toxic", "lang"])


@query("SELECT documents.doc_id AS doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE quality IS NOT NULL")
def null_rows_dropped(spark, folder):
    df = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return apply_null_policy(df.select("doc_id", "quality"), ["quality"], "drop")


@query(f"WITH {EMB} SELECT vec_id, pos, label::BIGINT AS label, round(x, 6) + 0.0 AS value FROM emb")
def converted_inputs(spark, folder):
    """A table bound to a net's inputs by name and converted to them."""
    net = softmax_regression(64, 10, data="embedding")
    df = convert_inputs(table(spark, folder, "embeddings"), net, ["vec_id"])
    return elements(df, ["vec_id", "label"], F.col("embedding"))


@query("""SELECT event_type, pos, round(avg(v), 6) + 0.0 AS value FROM (
SELECT event_type, 0 AS pos, value AS v FROM events UNION ALL
SELECT event_type, 1 AS pos, hour(ts)::DOUBLE AS v FROM events) GROUP BY event_type, pos""")
def event_features_mean(spark, folder):
    df = project(table(spark, folder, "events"), event_type="event_type",
                 features=F.array("value", F.hour("ts").cast("double")))
    return mean_by_position(df, "features", ["event_type"]).select("event_type", "pos", r6("mean").alias("value"))


def image_struct():
    """Embeddings as decoded 8 x 8 images in Spark's layout: rows of blue, green, red bytes."""
    third = lambda k: F.floor(k / 3).cast("int")
    source = lambda k: F.when(k % 3 == 0, third(k)).when(k % 3 == 1, 63 - third(k)).otherwise(third(k) * 5 % 64)
    mixed = let(pixels(), lambda plane: F.transform(counting(192), lambda k: F.get(plane, source(k))))
    data = F.unhex(F.array_join(F.transform(mixed, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    return F.struct(F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"),
                    F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))


PLANES = PIX + """, plane AS (SELECT vec_id, 0 AS c, pos AS src, px, (pos * 13) % 64 AS spot FROM pix UNION ALL
SELECT vec_id, 1 AS c, pos AS src, px, 63 - pos AS spot FROM pix UNION ALL SELECT vec_id, 2 AS c, pos AS src, px, pos AS spot FROM pix)"""


@query(f"WITH {PLANES} SELECT vec_id, (c * 64 + spot)::INTEGER AS pos, px::DOUBLE AS value FROM plane")
def planar_rgb(spark, folder):
    df = table(spark, folder, "embeddings").withColumn("image", image_struct())
    return elements(df, ["vec_id"], unsigned_bytes(to_planar_rgb(F.col("image"))))


@query(f"""WITH {PLANES} SELECT vec_id, (c * 16 + (spot // 16) * 4 + (spot % 8) // 2)::INTEGER AS pos,
floor(avg(px) + 0.5)::DOUBLE AS value FROM plane GROUP BY vec_id, c, spot // 16, (spot % 8) // 2""")
def resize_image(spark, folder):
    df = table(spark, folder, "embeddings").withColumn("image", image_struct())
    return elements(df, ["vec_id"], unsigned_bytes(to_planar_rgb(F.col("image"), 4, 4)))

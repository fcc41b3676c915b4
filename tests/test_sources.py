import io
import os
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.operators.joins import attach_labels
from gradloom.plans.net import softmax_regression
from gradloom.session import checkpoint_root
from gradloom.operators.weights import init_weights, weights_equal
from gradloom.plans.runs import chunk_archives, chunk_images
from gradloom.sources import archives, chunks, files, idx, images, labels, records, tabular, weights

RNG = np.random.default_rng(3)


def write_records(path, n):
    data = RNG.integers(0, 256, (n, 3073), "u1")
    data[:, 0] %= 10
    path.write_bytes(data.tobytes())
    return data


def png(pixels):
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def tar_bytes(entries, folder=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        if folder:
            entry = tarfile.TarInfo(folder)
            entry.type = tarfile.DIRTYPE
            archive.addfile(entry)
        for name, body in entries.items():
            entry = tarfile.TarInfo(name)
            entry.size = len(body)
            archive.addfile(entry, io.BytesIO(body))
    return out.getvalue()


def test_fixed_records(spark, tmp_path):
    train = write_records(tmp_path / "data_batch_1.bin", 7)
    test = write_records(tmp_path / "test_batch.bin", 5)
    (tmp_path / "readme.html").write_text("not records")
    df = records.read_fixed_records(spark, str(tmp_path))
    rows = {(r["split"], r["record_index"]): r for r in df.collect()}
    kept = {(r["split"], r["record_index"]): r["data"] for r in records.read_fixed_records(spark, str(tmp_path), raw=True).collect()}
    assert all(list(kept[k]) == rows[k]["data"] for k in rows)
    through_spark = records.read_fixed_records(spark, str(tmp_path), whole=True)
    assert {r["sample_id"] for r in through_spark.collect()} == {r["sample_id"] for r in rows.values()}
    assert len(rows) == 12 and len({r["sample_id"] for r in rows.values()}) == 12
    for split, data in [("train", train), ("test", test)]:
        for at, expected in enumerate(data):
            assert rows[split, at]["label"] == expected[0]
            assert np.array_equal(rows[split, at]["data"], expected[1:])


def test_fixed_records_are_cut_into_ranges(spark, tmp_path):
    data = write_records(tmp_path / "data_batch_1.bin", 10)
    ranges = files.record_ranges(files.list_files(spark, str(tmp_path)), 3073, range_bytes=3 * 3073)
    assert ranges.count() == 4
    rows = records.decode_fixed_records(files.read_ranges(ranges), (3, 32, 32)).orderBy("record_index").collect()
    assert [r["label"] for r in rows] == data[:, 0].tolist()


def test_truncated_record_fails(spark, tmp_path):
    write_records(tmp_path / "data_batch_1.bin", 2)
    with open(tmp_path / "data_batch_1.bin", "ab") as f:
        f.write(b"\1\2")
    for whole in (False, True):
        with pytest.raises(Exception, match="not a whole number of 3073-byte records"):
            records.read_fixed_records(spark, str(tmp_path), whole=whole).collect()


def test_required_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.require_files(spark, str(tmp_path / "absent"), ["a"])
    for name in records.TRAIN_FILES:
        (tmp_path / name).write_bytes(b"")
    with pytest.raises(FileNotFoundError, match="test_batch.bin"):
        records.read_fixed_records(spark, str(tmp_path), required=[*records.TRAIN_FILES, records.TEST_FILE])
    with pytest.raises(NotADirectoryError):
        files.require_files(spark, str(tmp_path / records.TRAIN_FILES[0]), ["a"])


def test_idx_pair(spark, tmp_path):
    pixels = RNG.integers(0, 256, (5, 28, 28), "u1")
    (tmp_path / "images").write_bytes(struct.pack(">IIII", 2051, 5, 28, 28) + pixels.tobytes())
    (tmp_path / "labels").write_bytes(struct.pack(">II", 2049, 5) + bytes([3, 1, 4, 1, 255]))
    pairs = idx.zip_by_index(idx.read_idx_images(spark, str(tmp_path / "images")), idx.read_idx_labels(spark, str(tmp_path / "labels")))
    rows = pairs.orderBy("sample_id").collect()
    assert [r["label"] for r in rows] == [3, 1, 4, 1, 255]
    assert np.array_equal([r["data"] for r in rows], pixels.reshape(5, -1))


def test_idx_folders_pair_by_split(spark, tmp_path):
    for split, values in (("train", [7, 8]), ("t10k", [9])):
        for kind, header in (("images-idx3", struct.pack(">IIII", 2051, len(values), 2, 2)), ("labels-idx1", struct.pack(">II", 2049, len(values)))):
            (tmp_path / kind).mkdir(exist_ok=True)
            (tmp_path / kind / f"{split}-{kind}-ubyte").write_bytes(header + bytes(x for v in values for x in [v] * (4 if "3" in kind else 1)))
    read = lambda: idx.zip_by_index(idx.read_idx_images(spark, str(tmp_path / "images-idx3")), idx.read_idx_labels(spark, str(tmp_path / "labels-idx1")))
    assert sorted((r["split"], r["sample_id"], r["label"], r["data"][0]) for r in read().collect()) == [
        ("t10k-", 0, 9, 9.0), ("train-", 0, 7, 7.0), ("train-", 1, 8, 8.0)]
    (tmp_path / "labels-idx1" / "t10k-labels-idx1-ubyte").write_bytes(struct.pack(">II", 2049, 2) + bytes([9, 9]))
    with pytest.raises(Exception, match="no image or no label for record 1 of t10k"):
        read().collect()


def test_label_names_with_blanks_and_plus_signs(spark, tmp_path):
    rows = [("a b.bmp", 3), ("a+b.bmp", 4), ("plain.bmp", 5)]
    labels.publish_labels(spark.createDataFrame(rows, "filename string, label int"), str(tmp_path / "labels"))
    assert sorted(tuple(r) for r in labels.read_labels(spark, str(tmp_path / "labels")).collect()) == sorted(rows)


@pytest.mark.parametrize("header,problem", [((2052, 5, 28, 28), "IDX magic 2051 expected, found 2052"),
                                            ((2051, 6, 28, 28), "length does not match its header")])
def test_bad_idx(spark, tmp_path, header, problem):
    (tmp_path / "images").write_bytes(struct.pack(">IIII", *header) + bytes(5 * 784))
    with pytest.raises(Exception, match=problem):
        idx.read_idx_images(spark, str(tmp_path / "images")).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("39, State-gov, 77516, 1.5\n50, Private, 83311, 2\n")
    df = tabular.read_csv_features(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["C0", "C1", "C2", "C3"]
    assert [t for _, t in df.dtypes] == ["int", "string", "int", "double"]
    assert df.first() == (39, "State-gov", 77516, 1.5)


def test_tar_to_labelled_images(spark, tmp_path):
    colours = {f"n{i}.png": np.full((6, 8, 3), (i, 10 * i, 100 + i), "u1") for i in range(1, 4)}
    body = tar_bytes({**{f"x/{n}": png(p) for n, p in colours.items()}, "x/broken.png": b"no image"}, folder="x")
    source, landing = tmp_path / "in", tmp_path / "landed"
    source.mkdir()
    (source / "train.00000.tar").write_bytes(body)
    members = archives.read_tar(spark, str(source))
    assert sorted(r["member"] for r in members.collect()) == ["x/broken.png", "x/n1.png", "x/n2.png", "x/n3.png"]
    through_spark = archives.read_tar(spark, str(source), whole=True)
    assert through_spark.exceptAll(members).count() == 0 and through_spark.count() == 4
    decoded = images.read_archived_images(members, str(landing), 3, 4)
    rows = {r["filename"]: np.frombuffer(r["data"], "u1").reshape(3, 3, 4) for r in decoded.collect()}
    assert set(rows) == set(colours)
    for name, planes in rows.items():
        assert (planes == colours[name][0, 0][:, None, None]).all()
    assert images.dropped_count(members, decoded).first() == (4, 3, 1)
    (tmp_path / "labels.txt").write_text("a/n1.png 7\na/n2.png 8\nb/n2.png 9\n")
    table = labels.read_labels(spark, str(tmp_path / "labels.txt"))
    assert {tuple(r) for r in table.collect()} == {("n1.png", 7), ("n2.png", 9)}
    assert [r["filename"] for r in labels.duplicate_labels(spark, str(tmp_path / "labels.txt")).collect()] == ["n2.png"]
    found = attach_labels(decoded, table, "drop")
    assert {(r["filename"], r["label"]) for r in found.collect()} == {("n1.png", 7), ("n2.png", 9)}
    with pytest.raises(Exception, match="no label for n3.png"):
        attach_labels(decoded, table).collect()


def test_archives_to_labelled_chunks(spark, tmp_path):
    names = [f"n{i}.png" for i in range(9)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.tar").write_bytes(tar_bytes({n: png(np.full((4, 4, 3), i, "u1")) for i, n in enumerate(names)}))
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "filename string, label int")
    chunk_images(archives.read_tar(spark, str(source)), table, 3, str(tmp_path / "land"), str(tmp_path / "out"), 2, 2, prefix="val", digits=3)
    back = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert {r["chunk"]: r["count"] for r in back.groupBy("chunk").count().collect()} == {f"val.00{i}": 3 for i in range(3)}
    assert all(r["data"] == bytes([r["label"]] * 12) for r in back.collect())
    assert labels.read_labels(spark, str(tmp_path / "out" / "labels")).count() == 9


def test_sample_ids_from_places(spark, tmp_path):
    spark.createDataFrame([(1,)] * 50, "x int").repartition(3).write.parquet(str(tmp_path / "t"))
    a, b = ({r["sample_id"] for r in tabular.read_samples(spark, str(tmp_path / "t")).collect()} for _ in range(2))
    assert a == b and len(a) == 50
    files = {i >> tabular.PLACE_BITS for i in a}
    assert files == set(range(len(files))) and {i & 31 for i in a} <= set(range(50)) and len(files) == 3


def test_nested_tar(spark, tmp_path):
    inner = {f"class{c}.tar": tar_bytes({f"img{c}_{i}.bin": bytes([c, i]) * 300 for i in range(3)}) for c in range(2)}
    (tmp_path / "all.tar").write_bytes(tar_bytes(inner))
    rows = archives.read_nested_tar(spark, str(tmp_path / "all.tar")).collect()
    assert {(r["parent"], r["filename"], r["content"][:2]) for r in rows} == {
        (f"class{c}.tar", f"img{c}_{i}.bin", bytes([c, i])) for c in range(2) for i in range(3)}
    assert all(len(r["content"]) == 600 for r in rows)


def test_archive_listing_partitions(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"t{i}.tar").write_bytes(tar_bytes({f"m{i}": b"x" * i}))
    assert archives.list_archives(spark, str(tmp_path), 2).rdd.getNumPartitions() == 2
    assert archives.list_archives(spark, str(tmp_path), glob="t1*").count() == 1
    assert {(r["member"], len(r["content"])) for r in archives.read_tar(spark, str(tmp_path)).collect()} == {(f"m{i}", i) for i in range(5)}


def test_last_label_line_wins_across_blocks(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"d{i % 3}/f{i % 50}.jpg {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {r["filename"]: r["label"] for r in labels.read_labels(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"f{i % 50}.jpg": i for i in range(5000)}


def test_published_labels_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a.jpg", 1), ("b.jpg", 2)], "filename string, label int")
    labels.publish_labels(df, str(tmp_path / "out"))
    assert labels.read_labels(spark, str(tmp_path / "out")).exceptAll(df).count() == 0


def test_shuffled_chunks(spark, tmp_path):
    df = spark.range(103).select(F.col("id").alias("sample_id"))
    chunks.write_shuffled_chunks(df, 10, str(tmp_path / "c"), seed=1, files_per_chunk=2)
    back = spark.read.parquet(str(tmp_path / "c"))
    sizes = {r["chunk"]: r["count"] for r in back.groupBy("chunk").count().collect()}
    assert set(sizes) == {f"train.{i:05d}" for i in range(10)} and sorted(sizes.values()) == [10] * 7 + [11] * 3
    assert sorted(r["sample_id"] for r in back.collect()) == list(range(103))
    first = [r["sample_id"] for r in back.filter("chunk = 'train.00000'").collect()]
    assert first != sorted(first)
    written = os.listdir(tmp_path / "c" / "chunk=train.00000")
    assert len([f for f in written if f.endswith(".parquet")]) == 2


def test_weights_round_trip(spark, tmp_path):
    net = softmax_regression(700, 9)
    start = init_weights(spark, net, 4)
    weights.save_weights(start, str(tmp_path / "deep" / "w"))
    back = weights.load_weights(spark, str(tmp_path / "deep" / "w"), net)
    assert weights_equal(start, back, 0.0).first()["equal"]
    with pytest.raises(Exception, match="do not fit"):
        weights.load_weights(spark, str(tmp_path / "deep" / "w"), softmax_regression(701, 9)).collect()
    with pytest.raises(Exception):
        weights.load_weights(spark, str(tmp_path / "nowhere"), net)


def test_create_samples(spark):
    df = tabular.create_samples(spark, [([1.0], 2)], "data array<float>, label int")
    assert df.first() == ([1.0], 2)


def test_paths_of_other_stores(tmp_path):
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert files.file_system(path)[1] == str(tmp_path)


def test_range_reads_keep_their_width(spark, tmp_path):
    write_records(tmp_path / "data_batch_1.bin", 64)
    ranges = files.record_ranges(files.list_files(spark, str(tmp_path)), 3073, range_bytes=3073)
    read = files.read_ranges(ranges, 16)
    used = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 8


def test_chunk_bounds(spark):
    keys = [(-1 << 63), *range(-50, 50), 1 << 40, 1 << 62]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    for count in (1, 2, 7, 103, 150):
        bounds = chunks.chunk_bounds(df, count)
        sizes = np.bincount(np.searchsorted(bounds, np.array(keys), side="right"), minlength=count) if bounds else [len(keys)]
        assert sorted(sizes, reverse=True) == sorted([len(keys) // count + (c < len(keys) % count) for c in range(count)], reverse=True)
    assert chunks.chunk_bounds(df.limit(0), 3) == [(1 << 63) - 1] * 2
    assert chunks.chunk_bounds(df.union(df), 103) is not None
    assert chunks.chunk_bounds(spark.createDataFrame([(7,)] * 10, "k long"), 3) is None


def test_chunks_send_content_once(spark, tmp_path, monkeypatch):
    """One exchange carries the content; rows of one id that fill more than a chunk are still dealt evenly."""
    df = spark.range(60).select(F.col("id").alias("sample_id"), F.lit("x").alias("key"), F.repeat(F.lit("y"), 50).alias("text"))
    plans = []
    writer = type(df.write)
    original = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, **o: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), original(self, path, **o))[1])
    chunks.write_shuffled_chunks(df, 7, str(tmp_path / "a"), seed=1)
    assert plans[-1].count("Exchange") == 1
    chunks.write_shuffled_chunks(df.unionByName(df.withColumn("sample_id", F.lit(5))), 7, str(tmp_path / "b"), seed=1)
    for name, total in (("a", 60), ("b", 120)):
        back = spark.read.parquet(str(tmp_path / name))
        assert sorted(back.columns) == ["chunk", "key", "sample_id", "text"]
        sizes = [r["count"] for r in back.groupBy("chunk").count().collect()]
        assert sum(sizes) == total and max(sizes) - min(sizes) <= 1


def test_labels_before_bytes(spark, tmp_path):
    """Only labelled members are read; broken ones are dropped and counted; labels of any kind, twice if they stand twice."""
    source = tmp_path / "in"
    source.mkdir()
    files = {f"d/n-{i}+ä.png": png(np.full((4, 4, 3), i, "u1")) for i in range(9)} | {"d/broken.png": b"no image", "d/other.png": png(np.zeros((2, 2, 3), "u1"))}
    (source / "a.tar").write_bytes(tar_bytes(files))
    (source / "b.tar").write_bytes(tar_bytes({"n-3+ä.png": png(np.full((4, 4, 3), 99, "u1"))}))
    names = [(f"n-{i}+ä.png", f"k-{i}" if i != 4 else None) for i in range(9)] + [("n-0+ä.png", "k-0"), ("broken.png", "b"), ("absent.png", "a")]
    table = spark.createDataFrame(names, "filename string, label string")
    index = archives.index_tar(archives.list_archives(spark, str(source), 2)).cache()
    labelled = archives.attach_index_labels(index, table)
    assert "content" not in labelled.columns and labelled.count() == 12
    found, counts = images.read_labelled_images(index, table, 2, 2, group_bytes=300)
    assert counts.first().asDict() == {"read": 12, "kept": 11, "dropped": 1}
    rows = sorted((r["filename"], r["label"] or "", r["data"][0]) for r in found.collect())
    assert rows == sorted([(f"n-{i}+ä.png", f"k-{i}" if i != 4 else "", i) for i in (*range(9), 0)] + [("n-3+ä.png", "k-3", 99)])
    with pytest.raises(Exception, match="no image for absent.png"):
        archives.attach_index_labels(index, table, "error").collect()
    counts = chunk_archives(archives.list_archives(spark, str(source), 2), table.where("label <> 'a'"), 2, str(tmp_path / "out"), 2, 2)
    assert counts.first()["dropped"] == 1 and spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 10
    root = checkpoint_root(spark)
    assert not [f for f in os.listdir(root.removeprefix("file:")) if f.startswith("landing-")]


def test_groups_of_images_have_a_least_size(spark, tmp_path, monkeypatch):
    """A few images are one round, whatever `group_bytes`; enough disk is several."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.tar").write_bytes(tar_bytes({f"d/n-{i}.png": png(np.full((4, 4, 3), i, "u1")) for i in range(9)}))
    index = archives.index_tar(archives.list_archives(spark, str(source), 2)).cache()
    table = spark.createDataFrame([(f"n-{i}.png", i) for i in range(9)], "filename string, label int")
    land, rounds = images.land_members, []
    monkeypatch.setattr(images, "land_members", lambda *a, **b: rounds.append(1) or land(*a, **b))
    found, _ = images.read_labelled_images(index, table, 2, 2, group_bytes=100)
    assert len(rounds) == 1
    rows = sorted((r["label"], bytes(r["data"])) for r in found.collect())
    assert len(rows) == 9
    monkeypatch.setattr(images, "LEAST_GROUP_BYTES", 8192)
    found, counts = images.read_labelled_images(index, table, 2, 2, group_bytes=100)
    assert len(rounds) > 3 and counts.first()["kept"] == 9
    assert sorted((r["label"], bytes(r["data"])) for r in found.collect()) == rows

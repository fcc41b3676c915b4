from pyspark.sql import functions as F

from gradloom.llm import words


def numbers(df):
    return {r["doc_id"]: r["row_id"] for r in words.with_row_id(df.select("doc_id")).collect()}


def test_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(3).write.option("parquet.block.size", 100_000).parquet(path)
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before, found = [spark.conf.get(s) for s in settings], []
    try:
        for size in ("100k", "128m"):
            spark.conf.set(settings[0], size)
            spark.conf.set(settings[1], "1k")
            found.append(numbers(spark.read.parquet(path)))
            gone = spark.createDataFrame([(found[0][i],) for i in range(0, 20_000, 3)], "x long")
            left = words.without_rows(spark.read.parquet(path), gone)
            assert left.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [i for i in range(20_000) if i % 3]
    finally:
        for setting, value in zip(settings, before):
            spark.conf.set(setting, value)
    assert found[0] == found[1] and len(set(found[0].values())) == 20_000


def test_other_rows_are_written_first(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id")).repartition(5)
    kept = words.scanned(df)
    assert numbers(kept) == numbers(kept) and words.scanned(kept) is kept
    assert words.scanned(kept.where("doc_id > 3").select("doc_id")).inputFiles() == kept.inputFiles()

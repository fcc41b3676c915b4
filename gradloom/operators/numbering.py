"""Row numbers without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradloom.session import shuffle_partitions, tasks_for


def hash_bucket(key: Column, bits: int) -> Column:
    """The top bits of a 64-bit hash: 2 ** bits even buckets that keep the hash's order."""
    return F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def bucket_offsets(df: DataFrame, groups: Sequence[str], bucket: Column, total: str | None = None) -> DataFrame:
    """(groups..., bucket, offset): the number of rows in earlier buckets of the group. One row per bucket."""
    counts = df.groupBy(*groups, bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*(groups or [F.lit(0)]))
    before = F.sum("__n").over(group.orderBy("__bucket")) - F.col("__n")
    totals = [F.sum("__n").over(group).alias(total)] if total else []
    return counts.select(*groups, "__bucket", before.alias("__offset"), *totals)


def number_rows(df: DataFrame, groups: Sequence[str], order: Column | Sequence[Column], bucket: Column,
                out: str = "pos", total: str | None = None, rows: int | None = None) -> DataFrame:
    """0-based row number of each row in its group, by `order`.

    `bucket` must not decrease along `order`. Rows are ranked inside (group, bucket) only, and the small table of
    bucket sizes turns ranks into row numbers. Tasks are as many as `rows` (counted here if not given) ask for.
    """
    spark = df.sparkSession
    order = list(order) if isinstance(order, (list, tuple)) else [order]
    offsets = bucket_offsets(df, groups, bucket, total)
    ranked = df.withColumn("__bucket", bucket)
    tasks = tasks_for(spark, df.count() if rows is None else rows)
    if tasks > shuffle_partitions(spark):
        ranked = ranked.repartition(tasks, *groups, "__bucket")
    rank = F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy(*order))
    ranked = ranked.withColumn("__rank", rank)
    numbered = ranked.join(offsets, [*groups, "__bucket"])
    position = (F.col("__offset") + F.col("__rank") - 1).cast("bigint")
    return numbered.withColumn(out, position).drop("__bucket", "__rank", "__offset")


def count_distinct(df: DataFrame, groups: Sequence[str], values: Sequence[str], rows: int) -> DataFrame:
    """Per group: its rows `n`, and of each of the long columns `values` how many distinct ones it has (as a count distinct, without
    nulls) and their sum over all rows (`<value>_total`).

    Every value of every row goes to the task that counts it, before anything is held; tasks are as many as `rows`, those of `df`, ask for.
    """
    kind, value, times = "__kind", "__value", "__times"
    each = F.explode(F.array(*[F.struct(F.lit(i).alias(kind), F.col(v).cast("long").alias(value)) for i, v in enumerate(values)]))
    dealt = df.select(*groups, each.alias("__each")).select(*groups, f"__each.{kind}", f"__each.{value}")
    keys = [*groups, kind, value]
    dealt = dealt.repartition(tasks_for(df.sparkSession, rows * len(values)), *keys)
    once = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias(times))
    of = lambda i, column: F.when(F.col(kind) == i, column)
    counts = [F.coalesce(F.sum(of(0, F.col(times))), F.lit(0).cast("long")).alias("n")]
    for i, v in enumerate(values):
        counts += [F.count(of(i, F.col(value))).alias(v), F.sum(of(i, F.col(value) * F.col(times))).alias(f"{v}_total")]
    return once.groupBy(*groups).agg(*counts)

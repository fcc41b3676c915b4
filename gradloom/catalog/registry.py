"""How a query is declared: a function of (spark, folder) and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradloom.functions.shapes import indexed
from gradloom.session import ship

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)

    def query(self, sql: str | None) -> Callable[[Build], Build]:
        def register(build: Build) -> Build:
            def shipped(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return build(spark, folder)

            self.queries[build.__name__] = Query(shipped, sql)
            return build

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Doubles rounded for comparison between engines; -0.0 becomes 0.0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def elements(df: DataFrame, keys: Sequence[str], vector: Column) -> DataFrame:
    """One row per array element: keys, pos, value."""
    return indexed(df, keys, vector, "pos", "value").withColumn("value", r6("value"))


def pixels(embedding: Column | str = "embedding") -> Column:
    """Embedding values as 0..255 integers."""
    return F.transform(embedding, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


# SQL fragments shared by the counterparts.
EMB = """emb AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos
FROM embeddings)"""
PIX = EMB + """, pix AS (SELECT vec_id, label, pos, floor((x + 1) * 127.5)::INTEGER AS px FROM emb)"""

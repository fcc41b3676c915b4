"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradloom.session import lifetime, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge, label being its component's smallest node. `edges` has long columns a and b.

    Large-star and small-star steps by turns (Kiveris and others, 2014): a node's smallest neighbour is a partial aggregate, no
    neighbourhood is collected. Each round is written as a table, whose small files the next one reads in few tasks; the rounds'
    tables go at the end, the result is a table. The number of rounds is about the logarithm of the longest path.
    """
    with lifetime(edges.sparkSession):
        now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        for _ in range(rounds):
            both = now.union(now.select("b", "a"))
            low = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            large = large.where("a <> b").distinct()
            # Every edge now points down (a > b); the small star links a node's smaller neighbours to the smallest.
            low = large.groupBy("a").agg(F.min("b").alias("least"))
            small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
            now = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
            # Stars only: a leaf has one centre, and no centre is a leaf.
            loose = now.groupBy("a").count().where("count > 1").select("a").union(now.join(now.select(F.col("b").alias("a")), "a", "left_semi").select("a"))
            if loose.isEmpty():
                break
        else:
            raise RuntimeError(f"components are not joined after {rounds} rounds")
        labels = now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        return stored(labels, "components", outlives=True)

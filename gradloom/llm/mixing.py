"""Mix sources to target weights: hash-random order, distributed prefix sums of word counts, an exact cut, repeated epochs.

Sources weigh 1, 2, 3, repeating, in code point order, null last (or as a weight column says). Together they get `share` of all
words. A source's target stops at `epochs` times its size; what it cannot take goes to the others by weight. In closed form that
is one level L with target = min(epochs * size, weight * L).

Defined cases: a null text has size 0 and takes 0. Sources are compared byte by byte; null is a source. Documents of one source
with equal keys are ordered by id and size, so repeated rows are exchangeable. No rows give no rows; sources without any words
have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradloom.llm.ranges import prefix_sums
from gradloom.session import stored

#: Words are runs of anything but blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, epochs: int = 3, share: float = 1.0) -> DataFrame:
    """`sizes` has source and source_size; adds weight and target. Sources may be many: their order and the level are prefix sums."""
    nulls_last = sizes.withColumn("null__", F.col("source").isNull().cast("int")).withColumn("one__", F.lit(1).cast("long")).withColumn("all__", F.lit(0))
    ranked = prefix_sums(nulls_last, "all__", ["null__", "source"], "one__", "rank__").withColumn("weight", F.col("rank__") % 3 + 1)
    limited = ranked.withColumn("limit__", epochs * F.col("source_size")).withColumn("ratio__", F.col("limit__") / F.col("weight"))
    order = ["ratio__", "rank__"]
    capped = prefix_sums(limited, "all__", order, "limit__", "capped__")
    weighed = prefix_sums(capped, "all__", order, "weight", "passed__")
    total = stored(weighed, "source-levels")
    sums = total.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    level = ((F.lit(share * sums["words"]) - F.col("capped__")) / (F.lit(sums["weights"]) - F.col("passed__")).cast("double"))
    # The first source, by ratio, whose limit lies above the level that is left for it and all after it.
    open_ = total.withColumn("level__", level).where("level__ <= ratio__").agg(F.min(F.struct(*order, "level__")).alias("x")).first()["x"]
    if open_ is None:
        target = F.col("limit__").cast("double")
    else:
        target = F.least(F.col("limit__").cast("double"), F.col("weight") * F.lit(open_["level__"]))
    return total.select("source", "source_size", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def mix_sources(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", epochs: int = 3, share: float = 1.0,
                seed: str = "") -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words the mix takes of the document, repeats counted).

    Only ids, sources and sizes are shuffled. Each source takes floor(target) words: whole epochs, then documents in hash order
    up to the word at which the budget ends.
    """
    rows = stored(df.select(F.col(id_column).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, share)
    keyed = rows.withColumn("key__", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ahead = prefix_sums(keyed, "source", ["key__", "doc_id", "size"], "size", "ahead__")
    own = targets.withColumnsRenamed({"source": "source__"})
    # One row per source against all documents: a hot source is split by adaptive execution, both sides being plain exchanges.
    joined = ahead.join(stored(own, "targets"), F.col("source").eqNullSafe(F.col("source__")))
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size") - F.col("ahead__")
    taken = passes * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return joined.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))

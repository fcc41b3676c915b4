"""From raw documents to a weighted mixture: toxicity, near duplicates, benchmark passages, personal data, mixing.

Defined cases, of every stage: a null text is an empty one and stays null; texts without words are one group of near duplicates, of
which one stays; they are never toxic, hold no benchmark item and no personal data, and the mixture takes nothing of them. Null ids
and repeated rows are rows like any other (of equal texts one stays); null sources are one source. Further columns stay, whatever
their names. A text of any length is handled whole. An empty table gives one.

Each stage takes what its predecessor kept, written as a table and read again. All but the last return the columns of documents;
the last returns, for every document that is left, how many of its words the mixture takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.catalog.registry import Registry, table
from gradloom.llm import decontaminate, mixing, near_duplicates, privacy, toxicity
from gradloom.llm.words import bound_batches, fresh
from gradloom.session import lifetime, ship, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepare(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    prepare(spark)
    score, passages = fresh(docs, toxicity.SCORE), fresh(docs, toxicity.PASSAGES)
    scored = toxicity.score_texts(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")), score=score, passages_column=passages)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    prepare(spark)
    return near_duplicates.first_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's five-word shingles."""
    prepare(spark)
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced; n_chars follows the text."""
    prepare(spark)
    return privacy.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every document."""
    prepare(spark)
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", reject_toxic), ("near_duplicates", keep_one_of_each), ("decontamination", remove_benchmark),
                                   ("personal_data", remove_personal_data), ("mixing", mix_to_weights)]
#: Log-odds, signatures and co-occurrence thresholds are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with lifetime(spark):  # a stage's own tables go once its result is written
            kept = stored(stage(spark, docs, sf_dir), name, outlives=True)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTRY = Registry()


@REGISTRY.query(ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder)


QUERIES = REGISTRY.queries

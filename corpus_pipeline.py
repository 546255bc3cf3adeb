"""From documents to a mix for training: language, boilerplate lines, near duplicates, benchmark leaks, source weights.

Part of the subpackage wavequill.llm. Every stage takes what the one before kept, and all but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequill.llm import decontaminate, language, line_dedup, mixing, near_duplicates
from wavequill.llm.common import small, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that the network is sure enough of.

    Null, empty and letterless texts go. Equal rows stay or go together. Empty tables give no rows.
    """
    return language.accepted(docs.select(*COLUMNS))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a share of their source's other documents have; a text of such lines alone is empty.

    All rows stay, repeated ones too. Null texts stay null, with null n_chars; null sources are one. Empty tables give no rows.
    """
    kept = line_dedup.drop_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that is linked by a similarity of 0.8 and more of five-word shingles.

    Null and blank texts are linked with nothing and stay. Rows that repeat a doc_id, and equal rows without one, keep one.
    The least doc_id stays of a group. Empty tables give no rows.
    """
    return near_duplicates.deduplicated(docs.select(*COLUMNS), size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts stay. All rows of a doc_id go with one of them, and those of null doc_ids together. Empty tables give
    no rows, an empty benchmark takes none away.
    """
    docs = docs.select(*COLUMNS)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = stage(found.select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    return docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: a row for every row, see mixing.mix(). Null and empty texts are not taken.

    Repeated rows are documents of their own, null sources are one. Empty tables give no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("language", by_language),
    ("line dedup", without_boilerplate),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL can't express the network of the first stage; tests/llm compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

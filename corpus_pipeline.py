"""A corpus pipeline: language ID, line dedup, near-dedup, mixing and packing in turn.

Every stage works on all rows that the one before kept, and all but the last give the columns
of documents. Null and wordless texts go in the first stage, as they have no language; rows
that repeat a document to the letter stay once after the third; a null doc_id is an id like
others, but holds no lines against other documents; an empty table gives no rows in any stage;
columns beyond those of documents pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saccadia.llm import language, linededup, mixing, packing, simhash
from saccadia.llm.common import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language, row by row."""
    return language.known_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a document of smaller id holds; rows with a null doc_id keep all theirs."""
    return linededup.drop_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity of 0.8 or more."""
    return simhash.near_unique(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often, 0 to 3 times, as its source's target word count asks for."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a repeated document is packed once for each copy."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", identify), ("lines", dedup_lines), ("near", dedup_near), ("mix", mix), ("pack", pack)]

#: Language models, Newton steps and the packing plan are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of the operators in ``postflow.llm``: every stage is written as Parquet and read by the next.

Quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing. All stages but the last return the
columns of ``documents``, whatever these are; each works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow.llm import decontaminate, line_dedup, ngram_join, quality_rules
from postflow.llm.common import read, written
from postflow.llm.queries import pack_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier, also with an edit. ``n_chars`` follows the text.

    A document of which nothing is left stays, with an empty text.
    """
    # names that no column of the documents has
    longest = max(docs.columns, key=len)
    n_lines, n_removed = f"{longest}_lines", f"{longest}_removed"
    kept = line_dedup.dedup(docs, counts=(n_lines, n_removed))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.col(f"`{n_removed}`") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", counted)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: 0.8 of five-word shingles in common."""
    return ngram_join.one_of_each(docs, like=ngram_join.NEAR_COPIES)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of at most 4096 ids."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("line_dedup", distinct_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: The similarity join, the edit distances and the tokenizer have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

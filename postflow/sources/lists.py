"""Small side inputs: deny lists, user dictionary, synonyms, and the state scan for re-indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow import constants as K
from postflow import schemas
from postflow.functions.keys import file_identity, to_time


def deny_list(value: str, legacy: bool = False) -> list[str]:
    """A comma-separated parameter; the legacy job adds one label of its own."""
    values = value.split(",")
    return [*values, K.LEGACY_EXTRA_SOURCE_LABEL] if legacy else values


def default_dictionary(spark: SparkSession) -> DataFrame:
    rows = [tuple(line.split(",")) for line in K.USER_DICTIONARY.splitlines()]
    return spark.createDataFrame(rows, schemas.DICTIONARY)


def default_synonyms(spark: SparkSession) -> DataFrame:
    lines = [(line,) for line in K.SYNONYM_GROUPS.splitlines()]
    return _synonym_terms(spark.createDataFrame(lines, "value STRING"))


def dictionary_terms() -> list[str]:
    """Surfaces of the built-in dictionary plus every synonym, which the tokeniser has to keep whole too."""
    surfaces = [line.split(",")[0] for line in K.USER_DICTIONARY.splitlines()]
    synonyms = [term for line in K.SYNONYM_GROUPS.splitlines() for term in line.split(",")]
    return list(dict.fromkeys([*surfaces, *synonyms]))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return _newest_files(spark.read.schema(schemas.DICTIONARY).csv(path), schemas.DICTIONARY.names)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``(term, canonical)``; the first term of a line stands for the group."""
    return _synonym_terms(_newest_files(spark.read.text(path), ["value"]))


def _synonym_terms(lines: DataFrame) -> DataFrame:
    terms = F.transform(F.split(F.lower("value"), ","), lambda t: F.trim(t))
    return (
        lines.where(F.trim("value") != "")
        .select(terms.alias("terms"))
        .select(F.explode("terms").alias("term"), F.element_at("terms", 1).alias("canonical"))
        # a term of two groups goes with one of them
        .groupBy("term")
        .agg(F.min("canonical").alias("canonical"))
    )


def _newest_files(files: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``.txt`` files; of files with the same identity only the last modified one."""
    rows = files.select(
        *columns,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_modification_time").alias("_time"),
    ).where(F.col("_path").endswith(".txt"))
    rows = rows.withColumn("_name", file_identity(F.col("_path")))
    newest = rows.groupBy("_name").agg(F.max_by("_path", F.struct("_time", "_path")).alias("_path"))
    return rows.join(newest, ["_name", "_path"], "left_semi").select(*columns)


def scan_state_by_year(state: DataFrame, year: str) -> DataFrame:
    """State rows created in ``year``; ISO text sorts by time, so this is a range the Parquet scan can use."""
    created = F.col("created_at")
    in_range = (created >= f"{year}-") & (created < f"{int(year) + 1:04d}-")
    return state.where(in_range & to_time(created).isNotNull())

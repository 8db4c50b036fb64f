"""The corpus pipeline: stages over ``documents``, each written and read again by ``run``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, neardup, packing, quality, secrets
from tidemark.llm.common import Tables, made_folders, ship, sweep


# Every stage keeps the columns of its documents but the last, which returns pieces. In all of them an empty table gives an empty
# result, extra columns are carried along whatever their names, and whole texts are read, however long.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words, so it goes. Rows with a null doc_id are
    judged like others, and repeated rows alike. Without labels the surface
    rules alone decide.
    """
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id.

    Texts without words and rows with a null doc_id are linked with nothing and
    stay. Repeated rows count once; rows that share a doc_id but not a text are
    judged by their texts.
    """
    ship(spark)
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 13 words of the benchmark in a row go, and those with a twentieth of their words in its items.

    Null and empty texts stay, as does everything when the benchmark is empty;
    repeated rows are judged alike.
    """
    ship(spark)
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one; no row goes, and null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences.

    A null or empty text is the end token alone; repeated rows and rows with a
    null doc_id are packed each on their own.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate), ("secret scans", mask_secrets), ("best-fit packing", pack)]

#: Tokens and entropies can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read by the next.

    What a stage leaves there is deleted once its result is written, so in the
    end the last result alone is left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, since = Tables(spark), len(made_folders(spark))
    for name, stage in STAGES:
        docs = tables.put(name, stage(spark, docs, sf_dir))
        tables.drop(*[other for other in list(tables.held) if other != name])
        sweep(spark, since, keep=(tables.held[name],))
    return docs

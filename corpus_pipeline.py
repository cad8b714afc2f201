"""A corpus in four stages: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last
return the columns of documents.

Null, empty and very short texts fail the quality rules, so no later stage sees them; a null id, language or source is
carried along. Of repeated rows and of near copies one stays, that of the least id (a null id comes last). Extra columns
are carried whatever their names. An empty table goes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import crc_mod, documents, shared_dir
from kinlink.llm.language_id import fit_languages, keep_identified
from kinlink.llm.near_dedup import keep_heads
from kinlink.llm.packing import pack
from kinlink.llm.quality_rules import keep_by_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects. Null and empty texts go: they have too few words."""
    return keep_by_rules(docs, "v1")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, by a model of the labelled documents of the given ones."""
    return keep_identified(docs, fit_languages(docs, F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id."""
    return keep_heads(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("packing", packing_stage),
]

#: No SQL expresses language identification by compression, sampling-based classes and packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what each keeps is written in the shared folder and read by the next."""
    docs, folder = documents(spark, sf_dir), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

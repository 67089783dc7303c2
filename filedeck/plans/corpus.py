"""The corpus as queries see it, built from the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filedeck.operators import entities
from filedeck.session import table


def filings(spark: SparkSession, d: str) -> DataFrame:
    return entities.current_filings(table(spark, d, "filings"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    return entities.clean_companies(table(spark, d, "companies"))


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks with corp_name and report_nm of their filing; each chunk once, also where it was loaded twice."""
    rows = table(spark, d, "chunks")
    kept = entities.first_loaded(rows.select("id", "rcept_no", "section_path", "chunk_index", *columns))
    own = filings(spark, d).join(companies(spark, d).select("corp_code", "corp_name"), "corp_code").select("rcept_no", "corp_name", "report_nm")
    return kept.join(own, "rcept_no")


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden questions, each text once under its smallest id, as queries (query_id, text, corp_name, ...)."""
    rows = table(spark, d, "golden").withColumnRenamed("golden_id", "query_id")
    return entities.first_by(rows, ["question"], F.asc("query_id")).withColumn("text", F.col("question"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of vector searches: the chunks whose id is divisible by 100."""
    return table(spark, d, "chunks").filter("id % 100 = 0").withColumnRenamed("id", "query_id")

"""Entities, their filings and what is current of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filedeck.functions.text import strip

# Fixed value: an annual report's name, with or without a correction prefix.
ANNUAL = r"^(\[기재정정\]|\[첨부정정\]|\[첨부추가\])?사업보고서\s*\("


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order, which must decide every tie that matters."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def current_filings(filings: DataFrame) -> DataFrame:
    """Each receipt number once: of several deliveries the last loaded; equal ones count once."""
    return first_by(filings, ["rcept_no"], F.desc_nulls_last("loaded_at"), F.desc_nulls_last("rcept_dt"), F.asc("corp_code"), F.asc("report_nm"))


def clean_companies(companies: DataFrame) -> DataFrame:
    """Names without outer blanks; a null stock code counts as unlisted ('')."""
    return companies.withColumn("corp_name", strip(F.col("corp_name"))).withColumn("stock_code", F.coalesce(strip(F.col("stock_code")), F.lit("")))


def find_by_name(companies: DataFrame, pattern: str, listed_only: bool = True, literal: bool = False) -> DataFrame:
    """Companies whose name has a match of the pattern (a regular expression, or plain text with `literal`); null names have none."""
    name = F.col("corp_name")
    hit = F.coalesce(name.contains(pattern) if literal else name.rlike(pattern), F.lit(False))
    return companies.filter(hit & ((F.col("stock_code") != "") if listed_only else F.lit(True)))


def resolve(seeds: DataFrame, companies: DataFrame) -> DataFrame:
    """seeds (corp_name, ...) with corp_code, stock_code and modify_date of the company of that name, or nulls.

    Among companies of one name listed ones come first, then the last modified (null last), then the smallest code."""
    listed = F.coalesce(F.col("stock_code"), F.lit("")) != ""
    best = first_by(companies.filter("corp_name is not null"), ["corp_name"], listed.desc(), F.desc_nulls_last("modify_date"), F.asc("corp_code"))
    return seeds.join(best.select("corp_name", "corp_code", "stock_code", "modify_date"), "corp_name", "left")


def unmatched(resolved: DataFrame) -> DataFrame:
    return resolved.filter("corp_code is null")


def annual_reports(filings: DataFrame) -> DataFrame:
    """Filings named as annual reports, corrections included; null names are not."""
    return filings.filter(F.coalesce(F.col("report_nm").rlike(ANNUAL), F.lit(False)))


def latest_by(df: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """The row of each key with the latest date; null dates last, ties to the greatest `tie`."""
    return first_by(df, [key], F.desc_nulls_last(date), F.desc(tie))


def first_filings(filings: DataFrame, n: int) -> DataFrame:
    """A limit as a feature: the n filings with the smallest receipt numbers; null numbers come last."""
    return filings.orderBy(F.asc_nulls_last("rcept_no")).limit(n)


def last_values(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The last value that is not null, of each column by itself, for each key.

    One aggregation with partial results: no key's rows are brought together."""
    return df.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns))


def missing(names: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The distinct keys of `names` that `present` lacks."""
    return names.select(key).distinct().join(present.select(key), key, "left_anti")


def new_rows(rows: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not loaded yet; equal keys within `rows` are all kept. Null keys are never loaded."""
    return rows.join(loaded.select(*keys).distinct(), keys, "left_anti")


def first_loaded(chunks: DataFrame) -> DataFrame:
    """Each (rcept_no, section_path, chunk_index) once, under its smallest id."""
    best = chunks.groupBy("rcept_no", "section_path", "chunk_index").agg(F.min("id").alias("id"))  # partial: no hot key
    return chunks.join(best.select("id"), "id", "left_semi")

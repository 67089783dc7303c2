"""Landed files as DataFrames, and sinks. Schemas are fixed: codes keep their zeros and '' stays ''."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "corp_code string, corp_name string, stock_code string, modify_date string"
SEED = "source_rank string, corp_name string"
FILING = "rcept_no string, corp_code string, corp_name string, stock_code string, report_nm string, rcept_dt string"
GOLDEN = "question string, corp_name string, expected_chunk_id bigint, expected_value string, metric string"


def strings_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, every column text; an empty field is '', never null."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in df.columns))


def entities_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each <list> of an entity file; a missing or blank stock code is ''."""
    df = spark.read.format("xml").option("rowTag", "list").schema(ENTITY).load(path)
    return df.select(*(F.trim(c).alias(c) for c in ("corp_code", "corp_name")), F.coalesce(F.trim("stock_code"), F.lit("")).alias("stock_code"), F.trim("modify_date").alias("modify_date"))


def filings_json(spark: SparkSession, path: str) -> DataFrame:
    """Listing records, one JSON object a line; a receipt date that is no date becomes null."""
    df = spark.read.schema(FILING).json(path)
    return df.withColumn("rcept_dt", F.try_to_date("rcept_dt", "yyyyMMdd"))


def listing_pages(spark: SparkSession, path: str) -> DataFrame:
    """Listing pages, one JSON document a file: {status, message, list: [...]}; pages of status 013 hold no data,
    others than 000 come out of `page_errors`."""
    df = spark.read.option("multiLine", True).schema(f"status string, message string, list array<struct<{', '.join(x.replace(' ', ':') for x in FILING.split(', '))}>>").json(path)
    rows = df.filter("status = '000'").select(F.explode("list").alias("r")).select("r.*")
    return rows.withColumn("rcept_dt", F.try_to_date("rcept_dt", "yyyyMMdd"))


def page_errors(spark: SparkSession, path: str) -> DataFrame:
    """Status and message of pages that failed: neither 000 (fine) nor 013 (no data)."""
    df = spark.read.option("multiLine", True).schema("status string, message string").json(path)
    return df.filter(~F.col("status").isin("000", "013"))


def golden_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(GOLDEN).json(path)


def is_zip(content: Column) -> Column:
    """Whether a download is an archive; anything else is an error body."""
    return F.coalesce(F.substring(content, 1, 2) == F.lit(b"PK"), F.lit(False))


def _decoded(raw: bytes) -> str:
    """EUC-KR where it is that throughout, else UTF-8 with marks for what is not."""
    try:
        return raw.decode("euc-kr")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


def _unzip(frames):
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, n, name, _decoded(z.read(name)), None) for n, name in enumerate(sorted(x for x in z.namelist() if not x.endswith("/")))]
            except (zipfile.BadZipFile, OSError, EOFError) as e:
                rows.append((path, 0, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "part_no", "part", "text", "error"])


def unzipped(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, part_no, part, text, error), parts in the order of their names.

    A file that is no archive gives one row with its error; the others go on."""
    return files.select("path", "content").mapInPandas(_unzip, "path string, part_no int, part string, text string, error string")


def archives(spark: SparkSession, path: str) -> DataFrame:
    return unzipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path))


def save(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Replace what is at `path`; readers see the old files or the new ones. kind: parquet, csv or json."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)

"""Blocks of a document to size-bounded chunks.

A block is one element of a document's array `blocks` of struct<section: array<string>, type: string,
text: string>, in order. A document is one row, so packing needs no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filedeck.functions.tables import TABLE_CHARS, split_table

TARGET, SMALL_TABLE = 900, 200
CHUNK = "array<struct<section: array<string>, type: string, text: string>>"


def text_blocks(text: Column, section: Column) -> Column:
    """Blocks of a plain text: its lines, those with " | " as tables; the section grows by the number of blank lines so far."""
    lines = F.split(text, "\n", -1)

    def step(s: Column, line: Column) -> Column:
        full = line.rlike(r"(?U)\S")
        kind = F.when(line.contains(" | "), "table").otherwise("paragraph")
        block = F.struct(F.concat(section, F.array(s["n"].cast("string"))).alias("section"), kind.alias("type"), line.alias("text"))
        return F.when(full, F.struct(F.concat(s["out"], F.array(block)).alias("out"), s["n"].alias("n"))).otherwise(F.struct(s["out"].alias("out"), (s["n"] + 1).alias("n")))

    return F.aggregate(lines, F.struct(F.array().cast(CHUNK).alias("out"), F.lit(0).alias("n")), step, lambda s: s["out"])


def pack(blocks: Column, target: int = TARGET, table_max: int = TABLE_CHARS, small_table: int = SMALL_TABLE, keep_oversized: bool = False) -> Column:
    """Chunks of a document's blocks.

    Paragraphs and tables below `small_table` characters are joined by line while they share a section and
    their characters, joints not counted, stay within `target`; a longer paragraph stays whole. Other tables
    stand alone, split by `split_table`. Order is kept; null gives null."""
    start = F.struct(F.array().cast(CHUNK).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(None).cast("array<string>").alias("section"), F.lit(0).alias("n"))

    def flushed(s: Column) -> Column:
        chunk = F.struct(s["section"].alias("section"), F.lit("paragraph").alias("type"), F.array_join(s["open"], "\n").alias("text"))
        return F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(chunk))).otherwise(s["done"])

    def step(s: Column, b: Column) -> Column:
        size = F.length(b["text"])
        parts = F.transform(split_table(b["text"], table_max, keep_oversized), lambda t: F.struct(b["section"].alias("section"), F.lit("table").alias("type"), t.alias("text")))
        alone = F.struct(F.concat(flushed(s), parts).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(None).cast("array<string>").alias("section"), F.lit(0).alias("n"))
        anew = F.struct(flushed(s).alias("done"), F.array(b["text"]).alias("open"), b["section"].alias("section"), size.alias("n"))
        more = F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(b["text"])).alias("open"), s["section"].alias("section"), (s["n"] + size).alias("n"))
        full = (F.size(s["open"]) > 0) & ((s["section"] != b["section"]) | (s["n"] + size > target))
        return F.when((b["type"] == "table") & (size >= small_table), alone).when(full | (F.size(s["open"]) == 0), anew).otherwise(more)

    return F.aggregate(blocks, start, step, flushed)


def chunks(documents: DataFrame, key: str, **sizes) -> DataFrame:
    """documents (key, blocks) -> (key, ordinal, section, type, text, chunk_index).

    chunk_index counts from 0 within a section over the whole document, also where a section comes back."""
    rows = documents.select(key, F.posexplode(pack(F.col("blocks"), **sizes)).alias("ordinal", "chunk")).select(key, "ordinal", "chunk.*")
    index = F.row_number().over(Window.partitionBy(key, "section").orderBy("ordinal")) - 1
    return rows.withColumn("chunk_index", index)

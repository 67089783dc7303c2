"""Retrieval and answer quality, golden sets and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filedeck.functions.text import METRICS, value_of

PERCENTS = {"median": 50, "p90": 90, "p95": 95, "p99": 99}


def judged(hits: DataFrame, golden: DataFrame, texts: DataFrame) -> DataFrame:
    """hits (query_id, id, rank), golden (query_id, expected_chunk_id, expected_value, metric) ->
    (query_id, metric, recall_at_5, recall_at_10, rr and the same by value), a row for each golden item.

    By value means: the text holds the expected value; a null value is in no text, an empty one in every text."""
    found = golden.join(hits.select("query_id", "id", "rank"), "query_id", "left").join(texts.select("id", "text"), "id", "left")
    by_id = F.when(F.col("id") == F.col("expected_chunk_id"), F.col("rank"))
    by_value = F.when(F.coalesce(F.coalesce("text", F.lit("")).contains(F.col("expected_value")), F.lit(False)) & F.col("rank").isNotNull(), F.col("rank"))
    best = found.groupBy("query_id", "metric").agg(F.min(by_id).alias("i"), F.min(by_value).alias("v"))
    at = lambda c, k: F.coalesce((F.col(c) <= k).cast("int"), F.lit(0))
    rr = lambda c: F.coalesce(1 / F.col(c), F.lit(0.0))
    return best.select("query_id", "metric", at("i", 5).alias("recall_at_5"), at("i", 10).alias("recall_at_10"), rr("i").alias("rr"), at("v", 5).alias("value_recall_at_5"), at("v", 10).alias("value_recall_at_10"), rr("v").alias("value_rr"))


def means(rows: DataFrame, *keys: str) -> DataFrame:
    """The mean of each measure over the keys and over all of the last key, which is then 'all'."""
    measures = ["recall_at_5", "recall_at_10", "rr", "value_recall_at_5", "value_recall_at_10", "value_rr"]
    *outer, last = keys
    both = rows.withColumn(last, F.explode(F.array(F.col(last), F.lit("all"))))
    return both.groupBy(*outer, last).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in measures))


def golden_items(chunks: DataFrame) -> DataFrame:
    """chunks (id, corp_name, chunk_type, text) -> (corp_name, metric, question, expected_chunk_id, expected_value).

    For each company the first table, by id, that has both a revenue and an operating income; each found metric one item."""
    values = F.struct(*(value_of(F.col("text"), m, negative).alias(f"v{i}") for i, (m, negative) in enumerate(METRICS.items())))
    tables = chunks.filter((F.lower(F.trim("chunk_type")) == "table") & F.col("text").contains("매출액") & F.col("text").contains("영업이익")).select("id", "corp_name", values.alias("v"))
    full = tables.filter(F.col("v.v0").isNotNull() & F.col("v.v1").isNotNull() & F.col("corp_name").isNotNull())
    first = full.groupBy("corp_name").agg(F.min_by(F.struct("id", "v"), "id").alias("f"))
    named = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"f.v.v{i}").alias("value")) for i, m in enumerate(METRICS)))
    items = first.select("corp_name", F.col("f.id").alias("expected_chunk_id"), F.explode(named).alias("m")).filter("m.value is not null")
    question = F.concat("corp_name", F.lit("의 "), F.col("m.metric"), F.lit("은 얼마인가요?"))
    return items.select("corp_name", F.col("m.metric").alias("metric"), question.alias("question"), "expected_chunk_id", F.col("m.value").alias("expected_value"))


def answer_correct(answer: Column, value: Column) -> Column:
    """Whether the answer holds the expected value; null of either is no."""
    return F.coalesce(answer.contains(value), F.lit(False))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones on every run and engine: in the order of a hash of seed and key."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def percentiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, median, p90, p95, p99, max and n of an integer column, whole numbers by truncation.

    Quantiles of the exclusive kind: place p (n + 1) / 100, extrapolating at the ends; one value stands for itself.
    Values are counted first, so what is put in order is distinct values with counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    parts = list(keys) or [F.lit(1)]
    w = Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*parts)
    ranked = counts.select(*keys, F.col(value).alias("x"), F.sum("c").over(w).alias("last"), F.sum("c").over(every).alias("n")).withColumn("first", F.coalesce(F.lag("last").over(Window.partitionBy(*parts).orderBy("x")), F.lit(0)) + 1)
    m = F.col("n") + 1
    ends = [F.min("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max")]
    for name, k in PERCENTS.items():
        j = F.greatest(F.lit(1), F.least(F.floor(k * m / 100), F.col("n") - 1))
        at = lambda p: F.max(F.when((F.col("first") <= p) & (F.col("last") >= p), F.col("x")))  # noqa: E731, B023
        ends += [at(j).alias(f"a_{name}"), at(F.least(j + 1, F.col("n"))).alias(f"b_{name}")]
    found = ranked.groupBy(*keys).agg(*ends)

    def quantile(name: str, k: int) -> Column:
        j = F.greatest(F.lit(1), F.least(F.floor(k * m / 100), F.col("n") - 1))
        d = k * m - 100 * j
        return F.when(F.col("n") == 1, F.col("min")).otherwise((F.col(f"a_{name}") * (100 - d) + F.col(f"b_{name}") * d) / 100).cast("bigint")

    return found.filter("n > 0").select(*keys, "n", "min", *(quantile(name, k).alias(name) for name, k in PERCENTS.items()), "max")


def counts(df: DataFrame, key: Column, name: str, most: int | None = None) -> DataFrame:
    """How often each value stands, the most frequent first; `most` makes it a top list."""
    out = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc(name)).limit(most) if most else out

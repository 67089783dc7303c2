"""Incremental loading with Structured Streaming; each job may be stopped and started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

KEY = ["rcept_no", "section_path", "chunk_index"]


def stream(spark: SparkSession, folder: str, schema, files_at_once: int = 8) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def append_new(target: str, keys: list[str] = KEY):
    """For foreachBatch: append the rows whose key `target` lacks, one row for each key, the smallest id first.

    A batch that is run again after a failure finds its keys loaded and adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        from filedeck.operators.entities import first_by

        fresh = first_by(batch, keys, F.asc("id"))
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(target).select(*keys), keys, "left_anti")
        except AnalysisException:  # the first batch
            pass
        fresh.write.mode("append").parquet(target)

    return run


def load(source: DataFrame, target: str, checkpoint: str, keys: list[str] = KEY) -> StreamingQuery:
    return source.writeStream.foreachBatch(append_new(target, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_versions(source: DataFrame, key: str = "rcept_no", order: str = "loaded_at") -> DataFrame:
    """A running table of the latest version of each key, for output mode complete or update.

    State holds one row for each key; a null order value loses to any other."""
    columns = [c for c in source.columns if c != key]
    return source.groupBy(key).agg(F.max(F.struct(order, *(c for c in columns if c != order))).alias("v")).select(key, "v.*")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value); later events than `late` are dropped by a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")

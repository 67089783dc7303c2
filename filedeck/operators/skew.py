"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so there are at most 1 / SHARE hot keys.
SHARE = 0.001
SALTS = 32


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """The inner join on keys, a hot key of `large` over many tasks: its rows are spread by a hash of the whole row and
    those of `small` repeated for each part. Null keys join nothing. `large` is read twice more for the counts, so it should be cheap to
    read (a cut one is). Only the hot keys, at most 1 / SHARE, are broadcast."""
    counts = large.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = large.agg(F.count("*").alias("_all"))  # one row
    hot = counts.join(F.broadcast(total)).filter(F.col("_n") > SHARE * F.col("_all")).select(*keys, F.lit(True).alias("_hot"))
    plain = [c for c, t in large.dtypes if "map<" not in t]  # maps have no hash
    spread = large.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    copied = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(parts))
    return spread.drop("_hot").join(copied.drop("_hot"), [*keys, "_salt"]).drop("_salt")

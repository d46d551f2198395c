"""Runs of rows that share a key, cut so that no task holds more than a bounded part of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(keys: DataFrame, name: str, most: int) -> DataFrame:
    """``keys`` (key, ...) with a column ``pair``: rows of a run of up to ``most`` rows have one; a longer run is cut in
    blocks, and each row gets a pair for every block, so that any two rows of a run share one."""
    long = keys.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64(name, F.lit(11)), F.col("blocks"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.least(own, b) * 1_000_000 + F.greatest(own, b))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(every)
    return keys.join(long, "key", "left").withColumn("pair", F.explode(pairs)).drop("blocks")

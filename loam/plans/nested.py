"""Queries of problem 5: nested metadata as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import nesting

#: The arrays of objects that a memory's metadata has, as paths in its schema graph.
ARRAYS = ["$.relations", "$.relations.history", "$.support_info.slices", "$.support_info.slices.evidence", "$.support_info.slices.evidence.spans", "$.artifacts", "$.artifacts.refs"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, node_path): the elements of the seven arrays."""
    entries = spark.read.parquet(f"{sf_dir}/memory_entries.parquet")
    plan = nesting.plan_of(entries, "metadata", ARRAYS)
    rows = nesting.shred(entries, "id", "metadata", plan)
    arrays = F.regexp_replace("node_path", r"\[\d+\]", "")
    return rows.where(arrays.isin([a[2:] for a in ARRAYS])).select("id", "node_path").distinct()


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flat table's number of rows, of parents that have rows in it, and of columns."""
    entries = spark.read.parquet(f"{sf_dir}/memory_entries.parquet")
    rows = nesting.shred(entries, "id", "metadata", nesting.plan_of(entries, "metadata", ARRAYS)).dropDuplicates(["id", "node_path"])
    return rows.groupBy("table").agg(F.count("*").alias("n_rows"), F.countDistinct("id", "parent_path").alias("n_parents"), F.max("position").alias("last_position"))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all flat tables: table, id, row_key, parent_key, position and the inlined values as JSON."""
    entries = spark.read.parquet(f"{sf_dir}/memory_entries.parquet")
    rows = nesting.shred(entries, "id", "metadata", nesting.plan_of(entries, "metadata", ARRAYS)).dropDuplicates(["id", "node_path"])
    return rows.select("table", "id", F.col("node_path").alias("row_key"), F.col("parent_path").alias("parent_key"), "position", F.to_json("values").alias("values"))


def queries() -> dict:
    return {"p5_found": p5_found, "p5_tables": p5_tables, "p5_rows": p5_rows}


def oracle_sql() -> dict[str, str]:
    return {}

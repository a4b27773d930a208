"""Readers of the test tables: one Parquet file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Node kinds whose body is running text.
TEXT_KINDS = ("page", "chunk", "segment")


def text_rows(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """tbl, row_id, owner file id and text of chunks and of page, chunk and segment nodes."""
    from pyspark.sql import functions as F

    c = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("id").alias("row_id"), F.col("file_id").alias("file_id"), F.col("text"))
    n = (
        table(spark, sf_dir, "nodes")
        .where(F.col("kind").isin(*TEXT_KINDS))
        .select(F.lit("nodes").alias("tbl"), F.col("id").alias("row_id"), F.col("owner_file_id").cast("long").alias("file_id"), F.col("body").alias("text"))
    )
    return c.unionByName(n)

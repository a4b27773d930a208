"""Queries of the text problems: name -> callable(spark, sf_dir), and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..tables import table, text_rows
from . import bpe, encoding, names, packing, pii, scans, spam, splitting

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.found(text_rows(spark, sf_dir), table(spark, sf_dir, "files"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restore(text_rows(spark, sf_dir), table(spark, sf_dir, "files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(text_rows(spark, sf_dir), table(spark, sf_dir, "name_forms"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(text_rows(spark, sf_dir), table(spark, sf_dir, "name_forms"))


def _entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes").where("kind = 'entity'").select("id", "name", F.get_json_object("props", "$.entity_type").alias("kind"))
    return n.where(F.col("kind").isin("person", "org"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(_entity_nodes(spark, sf_dir), table(spark, sf_dir, "name_forms"))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(_entity_nodes(spark, sf_dir), table(spark, sf_dir, "name_forms"))


def _scan_noise(spark: SparkSession, sf_dir: str) -> scans.ScanNoise:
    n = table(spark, sf_dir, "nodes").where(F.col("kind").isin("page", "chunk", "segment"))
    pages = n.where("kind = 'page'").select(F.col("id").alias("node_id"), F.col("owner_file_id").cast("long").alias("file_id"), F.get_json_object("props", "$.page").cast("int").alias("page"), F.col("body").alias("text"))
    return scans.ScanNoise(n.select(F.col("body").alias("text"), (F.col("kind") == "page").alias("is_page")), pages)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_noise(spark, sf_dir).found()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_noise(spark, sf_dir).repaired()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_found(table(spark, sf_dir, "chunks"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(bpe.count_tokens(table(spark, sf_dir, "documents")), "sizes")  # two numbers a document; used three times
    return packing.pack_items(sizes, 2048)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, the least number that their tokens could fill, tokens, and the share of space used."""
    c = p9_containers(spark, sf_dir).where(F.col("container").isNotNull())
    per = c.groupBy("container").agg(F.sum("size").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("used") / 2048).alias("least"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * 2048), 6).alias("fill"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.find_spam(table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_restored": p1_restored,
        "p3_found": p3_found,
        "p3_redacted": p3_redacted,
        "p4_found": p4_found,
        "p4_entities": p4_entities,
        "p5_found": p5_found,
        "p5_repaired": p5_repaired,
        "p7_found": p7_found,
        "p7_pieces": p7_pieces,
        "p8_ids": p8_ids,
        "p9_containers": p9_containers,
        "p9_fill": p9_fill,
        "p10_found": p10_found,
        "p10_scores": p10_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {"p7_found": "SELECT id AS chunk_id FROM chunks WHERE length(text) > 2000"}

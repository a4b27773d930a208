"""Streams: documents that keep arriving, chunked and mined as they come; results of a micro-batch are committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, entities
from ..operators.changes import VersionedTable
from ..session import materialize
from ..storage import Folder


def read_documents(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """Parquet files of documents as a stream, in the order in which they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def mentions_by_window(stream: DataFrame, time_col: str, text_col: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, type, value, n): entity mentions by event-time window; rows later than the watermark are dropped, as the state they need is gone."""
    m = stream.withWatermark(time_col, late).select(F.col(time_col), F.explode(entities.mentions(F.col(text_col))).alias("m"))
    w = m.groupBy(F.window(time_col, window), F.col("m.type").alias("type"), F.col("m.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "type", "value", "n")


def ingest(stream: DataFrame, sink: VersionedTable, checkpoint: str):
    """Chunk every arriving document (path, text) into a versioned table keyed by path, so that the table holds each document as it last arrived, once.

    A micro-batch replaces the chunks of its documents: their old rows go into the deletion vector of the commit that holds the new ones. The commit also notes the number of
    the batch under the query's own id, so a batch that is replayed after a failure writes nothing. A lost checkpoint makes a new query with a new id: its first
    batch brings old and new files together, and replacing leaves the old documents as they are and adds the new ones. Equal rows of a batch count once; a
    document without text has no chunks, and an earlier one's are gone. A null path is the path ''.
    """
    spark = stream.sparkSession
    folder = Folder(spark, checkpoint)

    def commit(batch: DataFrame, number: int) -> None:
        query = folder.read("metadata")["id"]
        at = sink.version()
        noted = sink.manifest(at)["info"].get("batches", {})
        if noted.get(query, -1) >= number:
            return
        docs = materialize(batch.select(F.coalesce("path", F.lit("")).alias("path"), "text").distinct(), "batch")
        sink.commit(chunking.chunk_documents(docs), docs.select("path"), {"batches": {**noted, query: number}}, expected=at)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)

import os
from datetime import datetime

from folioscope.operators.changes import VersionedTable
from folioscope.streaming import ingest

SCHEMA = "path string, text string, at timestamp"


def test_stream_of_documents(spark, tmp_path):
    rows = [("a.md", "The ticket INV-2024-0001 is closed.", datetime(2024, 1, 1, 3)), ("b.md", "The ticket INV-2024-0001 is open.", datetime(2024, 1, 1, 9)), ("c.md", None, datetime(2024, 1, 2))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.read_documents(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    q = ingest.mentions_by_window(stream, "at", "text").writeStream.outputMode("complete").format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["value"], r["n"]) for r in spark.table("m").where("type = 'identifier'").collect()] == [("inv-2024-0001", 2)]


def test_a_lost_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    sink = VersionedTable(spark, f"file://{tmp_path}/out", "path")
    run = lambda c: ingest.ingest(ingest.read_documents(spark, f"{tmp_path}/in", schema), sink, f"{tmp_path}/{c}").trigger(availableNow=True).start().awaitTermination()
    rows = lambda: sorted((r["path"], r["text"]) for r in sink.read().collect())
    spark.createDataFrame([("a.md", "one", None), ("a.md", "one", None), (None, "no path", None)], SCHEMA).write.parquet(f"{tmp_path}/in")
    run("c1")
    assert rows() == [("", "no path"), ("a.md", "one")]
    run("c1")
    assert sink.version() == 1
    spark.createDataFrame([("b.md", "two", None)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    run("c2")  # knows nothing of c1: its first batch brings both files
    assert rows() == [("", "no path"), ("a.md", "one"), ("b.md", "two")]
    spark.createDataFrame([("b.md", None, None)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    run("c2")
    assert rows() == [("", "no path"), ("a.md", "one")] and len(sink.manifest(sink.version())["info"]["batches"]) == 2


def test_a_replayed_batch_writes_nothing(spark, tmp_path):
    sink = VersionedTable(spark, f"file://{tmp_path}/out", "path")
    spark.createDataFrame([("a.md", "one", None)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = ingest.read_documents(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    ingest.ingest(stream, sink, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    for n in os.listdir(f"{tmp_path}/c/commits"):  # as if the driver had died between the sink's commit and the stream's own
        os.remove(f"{tmp_path}/c/commits/{n}")
    ingest.ingest(stream, sink, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sink.version() == 1 and sink.read().count() == 1


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [[("a", "REQ-2024-1 was closed today.", datetime(2024, 1, 10))], [("b", "REQ-2024-1 was closed too late.", datetime(2024, 1, 1)), ("c", "REQ-2024-1 was closed in time.", datetime(2024, 1, 9))], [("d", "REQ-2024-9 ends it all here.", datetime(2024, 3, 1))], [("e", "REQ-2024-9 ends it again here.", datetime(2024, 3, 1))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        w = ingest.mentions_by_window(ingest.read_documents(spark, f"{tmp_path}/in", schema), "at", "text")
        w.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {(r["start"].day, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").where("value = 'req-2024-1'").collect()}
    assert got == {(10, 1), (9, 1)}

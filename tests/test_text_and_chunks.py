import pytest
from pyspark.sql import functions as F

from folioscope import model as M
from folioscope.functions import text as X
from folioscope.operators import chunking, documents, entities


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [(None, ""), ("", ""), ("a \n\n\n\nb\x00­\x0cc  ", "a\n\nb\nc"), (" x ", "x")])
def test_clean(spark, raw, want):
    assert one(spark, raw, X.clean) == want


def test_small_functions(spark):
    assert one(spark, 3725.9, X.timestamp_label, "double") == "1:02:05" and one(spark, 65.0, X.timestamp_label, "double") == "1:05"
    assert one(spark, "UserAuthenticator and snake_case HTTPServer", X.identifier_parts) == ["authenticator", "http", "server", "user"]
    assert one(spark, "Total (USD), net!", X.slug) == "total-usd-net"
    assert one(spark, "a  b\nc" * 20, lambda c: X.preview(c, 10)).endswith("…")


@pytest.mark.parametrize("raw, want", [("  'Acme  Corp.,' ", "acme corp"), ("Straße", "strasse"), ("Noémie", "noemie"), ("ACME CORP", "acme corp")])
def test_entity_names_agree_in_python_and_spark(spark, raw, want):
    assert X.entity_name(raw) == want == one(spark, raw, X.normal_name)


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("controlled", "control"), ("café", "café"), ("as", "as")])
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_uids(spark):
    df = spark.createDataFrame([("/a\\b/c.md",)], "p string").select(M.folder_uid(F.lit("")).alias("r"), M.document_uid(F.col("p")).alias("d"), M.child_uid(M.document_uid(F.col("p")), "chunk", F.lit(7)).alias("c"), M.entity_uid(F.lit("org"), F.lit("Acme Corp.")).alias("e")).first()
    assert tuple(df) == ("dir:.", "doc:a/b/c.md", "doc:a/b/c.md#chunk:7", "ent:org:acme corp")


def test_line_chunks_cover_lines_and_repeat_two():
    text = "\n".join(f"line {i}" for i in range(400))
    got = chunking.line_chunks(text, "a.txt")
    assert [c[0] for c in got] == list(range(len(got))) and got[0][1] == 1 and got[-1][2] == 400
    for a, b in zip(got, got[1:]):
        assert b[1] == a[2] - 1
    assert chunking.line_chunks(" \n\n ", "a.md") == [] and chunking.line_chunks(None, "a.md") == []


def test_headings_end_long_chunks_and_relabel_short_ones():
    long = "# One\n" + "\n".join("words of the first section" for _ in range(25)) + "\n# Two\nshort"
    assert [(c[3], c[1]) for c in chunking.line_chunks(long, "a.md")] == [("One", 1), ("Two", 27)]
    assert [c[3] for c in chunking.line_chunks("intro\n# Two\nshort", "a.md")] == ["Two"]
    assert [c[3] for c in chunking.line_chunks("def go(x):\n    return x", "a.py")] == ["def go"]


def test_chunk_graph(spark):
    docs = spark.createDataFrame([("a.md", "x\n" * 900), ("b.md", None), ("c.md", "short"), ("c.md", "short")], "path string, text string")
    c = chunking.chunk_documents(docs).withColumn("parent", M.document_uid(F.col("path")))
    nodes, edges = chunking.chunk_graph(c)
    kinds = {r["kind"]: r["n"] for r in edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = nodes.where("owner = 'a.md'").count()
    assert kinds["contains"] == nodes.count() and kinds["next"] >= n - 1


def test_windows_and_frames(spark):
    seg = spark.createDataFrame([("f", float(i * 10), float(i * 10 + 10), "word " * 5) for i in range(12)] + [("g", 0.0, 5.0, " ")], "file string, start_time double, end_time double, text string")
    w = chunking.windows(seg)
    got = [(r["start_time"], r["end_time"]) for r in w.where("file = 'f'").orderBy("ord").collect()]
    assert got == [(0.0, 50.0), (50.0, 100.0), (100.0, 120.0)] and w.where("file = 'g'").count() == 0
    frames = spark.createDataFrame([("f", 0, 50.0), ("f", 1, 130.0)], "file string, frame int, at double")
    assert {r["frame"]: r["ord"] for r in chunking.frame_segments(frames, w).collect()} == {0: 0, 1: None}


TEXT = "Mail Ada@Norvik.example. See https://docs.norvik.example/a). and http://www.w3.org/x on 2024-02-30, 2024-02-29, March 5th, 2024, 12/31/2023 and 13/31/2023; paid $1,250.00 or 12 EUR, call +44 20 7946 0387, INV-2024-0912, INV-2024-0912 and 0b4b8fe7-6dd7-4b5f-a6ab-0123456789ab."


def test_entities(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "short"), (3, None), (4, "")], "id int, t string")
    got = [(r["type"], r["value"]) for r in entities.mention_rows(df, "id", "t").collect()]
    assert got == [
        ("email", "ada@norvik.example"), ("url", "https://docs.norvik.example/a"), ("date", "2024-02-29"), ("date", "2024-03-05"), ("date", "2023-12-31"),
        ("money", "USD 1250.00"), ("money", "EUR 12"), ("phone", "442079460387"), ("identifier", "0b4b8fe7-6dd7-4b5f-a6ab-0123456789ab"), ("identifier", "inv-2024-0912"),
    ]


def test_entities_are_capped(spark):
    df = spark.createDataFrame([(1, " ".join(f"a{i}@x.example" for i in range(500)))], "id int, t string")
    assert entities.mention_rows(df, "id", "t").count() == 40 and entities.mention_rows(df, "id", "t", None).count() == 500


def test_html_titles_links(spark):
    raw = "<title>A &amp; B</title><script>var x = '<p>';</script><p>Hi&nbsp;there</p><a href='../c/d.md#x'>d</a><a href='/abs'>n</a><img src=\"https://x/y.png\">[m](e.md?q)"
    df = spark.createDataFrame([("a/b/p.html", raw)], "path string, raw string")
    r = df.select(documents.html_text(F.col("raw")).alias("t"), documents.title(F.col("raw"), F.col("path"), F.lit(True)).alias("h")).first()
    assert r["h"] == "A & B" and "Hi" in r["t"] and "var x" not in r["t"]
    assert {(x["src"], x["dst"]) for x in documents.link_edges(df).collect()} == {("doc:a/b/p.html", "doc:a/c/d.md"), ("doc:a/b/p.html", "doc:a/b/e.md")}


def test_html_text_query_reads_every_document(spark, tmp_path):
    from hashlib import sha256

    from folioscope.plans import queries

    rows = [(1, "<p>Tide &amp; clock</p><script>x()</script>"), (2, "Tide <a href='#'>clock</a>"), (3, None), (4, "")]
    cols = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("doc_id", "text").limit(1)
    spark.createDataFrame(rows, "doc_id long, text string").crossJoin(cols).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["chars"], r["digest"]) for r in queries.html_text(spark, str(tmp_path)).collect()}
    digest = lambda t: (len(t), sha256(t.encode()).hexdigest())
    assert got == {1: digest("Tide & clock"), 2: digest("Tide  clock"), 3: digest(""), 4: digest("")}

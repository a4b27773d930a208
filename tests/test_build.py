import os
import time

import pytest

from folioscope.plans.build import GraphStore, build, index
from folioscope.sources import files as S
from folioscope.sources import readers as R


def write(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    write(root, "README.md", "# Project\n\nSee [brief](docs/brief.md). Ticket INV-2024-0912, mail ada@norvik.example, paid $1,250.00 on 2024-03-05.\n")
    write(root, "docs/brief.md", "# Brief\n\nAbout INV-2024-0912 and ada@norvik.example and $1,250.00 on March 5, 2024.\n")
    write(root, "docs/customers.csv", "customer_id,name,email\n1,Ada,ada@norvik.example\n2,Bo,bo@norvik.example\n")
    write(root, "media/fake.pdf", b"%PDF-1.4 broken")
    write(root, "media/legacy.xlsx", bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 40)
    write(root, "node_modules/skip.md", "# no")
    write(root, "blob.xyz", b"\x00\x01")
    return root


def state(store):
    n, e = store.graph()
    return sorted((r["uid"], r["kind"], r["name"], r["body"]) for r in n.collect()), sorted((r["src"], r["dst"], r["kind"], r["provenance"]) for r in e.collect())


def test_incremental_equals_full(spark, corpus, tmp_path):
    a = GraphStore(spark, f"file://{tmp_path}/a")
    st = build(spark, corpus, a)
    assert (st.new, st.removed, st.dropped_edges) == (6, 0, 0)
    nodes, edges = state(a)
    uids = {n[0] for n in nodes}
    assert {"doc:blob.xyz", "doc:media/fake.pdf", "dir:media", "doc:docs/customers.csv#sheet:sheet1#column:email", "ent:identifier:inv-2024-0912"} <= uids and not any("node_modules" in u for u in uids)
    assert ("doc:README.md", "doc:docs/brief.md", "references", "inferred") in edges
    assert sum(e[1] == "ent:email:ada@norvik.example" for e in edges) == 3
    props = {r["uid"]: r["props"] for r in a.graph()[0].where("kind = 'document'").collect()}
    assert "legacy Office" in props["doc:media/legacy.xlsx"]["warnings"] and "not .xlsx" in props["doc:media/legacy.xlsx"]["mislabelled"] and props["doc:media/legacy.xlsx"]["detected_format"] == "ole2" and props["doc:README.md"]["lines"] == "3" and "warnings" in props["doc:media/fake.pdf"] and "no reader" in props["doc:blob.xyz"]["warnings"]
    again = build(spark, corpus, a)
    assert (again.new, again.changed, again.unchanged) == (0, 0, 6)
    time.sleep(1.1)
    write(corpus, "docs/brief.md", "# Other\n\nNothing of the old ticket is left here, only REQ-2023-1.\n")
    os.remove(os.path.join(corpus, "media/fake.pdf"))
    st = build(spark, corpus, a)
    assert (st.changed, st.removed) == (1, 1)
    b = GraphStore(spark, f"file://{tmp_path}/b")
    build(spark, corpus, b)
    assert state(a) == state(b)


def test_chunk_index(spark, corpus, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/i")
    assert index(spark, corpus, s).new == 4  # the binary one is looked at once and gives no chunks
    assert {r["path"] for r in s.read("chunks", "").collect()} == {"README.md", "docs/brief.md", "docs/customers.csv"}
    assert index(spark, corpus, s).unchanged == 4


def test_readers_never_raise():
    for reader, name in [("pdf", "a.pdf"), ("docx", "a.docx"), ("slides", "a.pptx"), ("image", "a.png"), ("audio", "a.mp3"), ("sheet", "a.xlsx"), ("nothing", "a.q")]:
        parts, notes = R.read_file(reader, name, b"not that")
        assert notes
    parts, notes = R.read_file("sheet", "a.csv", "a;b\n1;2\n;\n".encode("utf-8-sig"))
    assert parts[0]["text"] == '[["a", "b"], ["1", "2"]]' and not notes
    assert R.degrees((51, 30, 0), "S") == -51.5 and R.keyframe_times(10, 2) == [2.5, 7.5]


def test_sniffing_and_dispatch(spark):
    rows = [("a.pdf", b"%PDF-1.7"), ("b.docx", b"PK\x03\x04zz"), ("c.png", b"\xff\xd8\xff"), ("d.mp4", b"\x00\x00\x00\x18ftypisom"), ("Makefile", b"all:"), ("e.txt", "é".encode("latin-1")), ("f.bin", b"a\x00b")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r["path"]: r for r in df.select("path", S.sniffed(df.content).alias("f"), S.mislabelled(df.path, S.sniffed(df.content)).alias("m"), S.reader(df.path).alias("r"), S.decoded(df.content).alias("t")).collect()}
    assert [got[p]["f"] for p, _ in rows] == ["pdf", "zip", "jpeg", "mp4", None, None, None]
    assert got["c.png"]["m"] == "content is jpeg, not .png" and got["b.docx"]["m"] is None
    assert [got[p]["r"] for p, _ in rows] == ["pdf", "docx", "image", "video", "text", "text", None]
    assert got["e.txt"]["t"] == "é" and got["f.bin"]["t"] is None and "git" in S.capabilities()


def test_tools_and_command_line(spark, corpus, tmp_path, monkeypatch):
    from folioscope import cli

    monkeypatch.setenv("FOLIOSCOPE_PROJECT", corpus)
    monkeypatch.setenv("FOLIOSCOPE_HOME", str(tmp_path))
    assert cli.run(["index"], spark)["new"] >= 1
    made = cli.run(["remember", "The brief is kept in docs", "--tag", "where", "--scope", "project"], spark)
    assert made["action"] == "created" and cli.run(["facts"], spark)[0]["tags"] == ["where"]
    hits = cli.run(["recall", "ticket brief"], spark)
    assert {h["kind"] for h in hits} == {"fact", "chunk"}
    assert cli.run(["pin", str(made["id"]), "--scope", "project"], spark)["pinned"] and "## Always" in cli.run(["facts", "--markdown"], spark)
    assert cli.run(["doctor"])["git"] in (True, False)


HOSTILE = ["pkg/__init__.py", "_notes.md", "_drafts/x.md", ".env.example", "b[1].md", "it's/50% {a,b}*?.md", "spaß/ü ñ.md", "docs/a.md", "a.md"]


@pytest.mark.parametrize("how", ["bare", "file://", "file:"])
def test_names_are_taken_as_they_are(spark, tmp_path, how):
    root = str(tmp_path / "it's [my] root%20")
    for n in HOSTILE:
        write(root, n, f"text of {n} REQ-2024-77")
    write(root, ".git/config", "x")
    write(root, "._a", "x")
    os.symlink(os.path.join(root, "a.md"), os.path.join(root, "link.md"))
    at = root if how == "bare" else how + root
    assert sorted(r["path"] for r in S.listing(spark, at).collect()) == sorted(HOSTILE)
    got = {r["path"]: bytes(r["content"]).decode() for r in S.contents(S.listing(spark, at)).collect()}
    assert got == {n: f"text of {n} REQ-2024-77" for n in HOSTILE}
    with pytest.raises(OSError):
        S.listing(spark, at + "/none")


def test_build_through_tools(spark, tmp_path, monkeypatch):
    from folioscope import cli
    from folioscope.tools import Tools, answer

    root = str(tmp_path / "it's root")
    for n in HOSTILE:
        write(root, n, f"# Head\n\nThe gauges of {n} were calibrated for REQ-2024-77.\n")
    write(root, "prices/list.csv", "item,cost\nfeather,3\nanvil,4\n")
    monkeypatch.setenv("FOLIOSCOPE_PROJECT", root)
    monkeypatch.setenv("FOLIOSCOPE_HOME", str(tmp_path / "home"))
    assert cli.run(["build"], spark)["new"] == len(HOSTILE) + 1
    t = Tools(spark)
    nodes, edges = t.graph_store.graph()
    assert {r["uid"] for r in nodes.where("kind = 'document'").collect()} == {f"doc:{n}" for n in [*HOSTILE, "prices/list.csv"]}
    assert ("dir:pkg", "doc:pkg/__init__.py") in {(r["src"], r["dst"]) for r in edges.collect()}
    assert {h["uid"] for h in t.graph_search("calibrate gauge", "document")} >= {f"doc:{n}" for n in HOSTILE if n.endswith(".md")}  # stemmed
    assert "doc:prices/list.csv#sheet:sheet1#column:cost" in {h["uid"] for h in t.graph_search("cost")} and any(h["kind"] == "sheet" for h in t.graph_search("Sheet1"))  # names and props
    assert any(h["uid"] == "doc:spaß/ü ñ.md" for h in t.graph_search("n u", None) + t.graph_search("md"))
    call = lambda m, **p: answer(t, {"jsonrpc": "2.0", "id": 1, "method": m, "params": p})
    assert len(call("tools/list")["result"]["tools"]) == 12 and "error" in call("nothing") and answer(t, {"method": "notifications/initialized"}) is None
    assert call("tools/call", name="graph_node", arguments={"uid": "doc:a.md"})["result"]["isError"] is False
    assert call("tools/call", name="graph_node", arguments={"id": 3})["result"]["isError"] is True
    client = lambda batch: {"passages": [{"id": i, "entities": [{"name": "Gauge", "type": "product"}, {"name": "Ferry", "type": "product"}], "relations": [{"source": "gauge", "target": "Ferry", "label": "beside"}]} for i, _ in batch]}
    write(root, "long.md", "A long passage about gauges and ferries. " * 6)
    assert t.build()["new"] == 1 and t.enrich(estimate_only=True, model="m")["estimate"]["passages"] == 1
    assert t.enrich(client, "m")["answered"] == 1 and t.enrich(client, "m")["answered"] == 0
    assert {"ent:product:gauge", "ent:product:ferry"} <= {r["uid"] for r in t.graph_store.graph()[0].where("kind = 'entity'").collect()}
    other = str(tmp_path / "other")
    write(other, "o.md", "An orrery stands in the hall.")
    t.index()
    assert t.add_source(other)["new"] == 1 and [s["path"] for s in t.sources()] == [root, other]
    assert [r["path"] for r in t.recall("orrery")] == [other + "/o.md"]
    t.remember("The orrery is wound on Mondays", scope="project")
    assert t.recall("orreries")[0]["kind"] == "fact" and t.facts()[0]["hits"] == 1
    assert t.embed()["embedded"] > 2 and t.embed()["embedded"] == 0 and t.recall("orrery hall", semantic=True)
    assert [s["path"] for s in t.sources(remove=other)] == [root] and all(r["kind"] == "fact" for r in t.recall("orrery"))
    assert "uid" in cli.render(t.graph_search("cost")) and cli.render([]) == "nothing found"


def test_transcripts_frames_and_ocr(spark, tmp_path):
    root = str(tmp_path / "m")
    write(root, "talk.mp4", b"\x00\x00\x00\x18ftypisom")
    write(root, "scan.png", b"\x89PNG\r\n\x1a\n")
    R.register("video", lambda p, c: [R.part("document", "", duration=100.0)])
    R.register("image", lambda p, c: [R.part("document", "", width=3, height=2, format="PNG")])
    try:
        s = GraphStore(spark, f"file://{tmp_path}/s")
        heard = lambda p, c: ("en", [(0.0, 30.0, "First part"), (30.0, 50.0, "of REQ-2024-77."), (50.0, 60.0, " "), (60.0, 99.0, "Second part.")])
        build(spark, root, s, transcribe=heard, ocr=lambda p, c: "Read REQ-2024-78 here", keyframes=2)
        n, e = state(s)
        es = {(x[0], x[1], x[2]) for x in e}
        assert ("doc:talk.mp4#segment:0", "doc:talk.mp4#segment:1", "next") in es and ("doc:talk.mp4#segment:0", "doc:talk.mp4#frame:0", "has_frame") in es and ("doc:talk.mp4#segment:1", "doc:talk.mp4#frame:1", "has_frame") in es
        assert ("doc:talk.mp4#segment:1#chunk:1", "doc:talk.mp4#segment:1", "contains") not in es and ("doc:talk.mp4#segment:1", "doc:talk.mp4#segment:1#chunk:1", "contains") in es
        assert any(x[0] == "ent:identifier:req-2024-78" for x in n) and any(x[0] == "doc:talk.mp4#segment:0" and x[2] == "talk.mp4 @ 0:00" for x in n)
    finally:
        R.READ["video"], R.READ["image"] = R.read_media, R.read_image


def test_two_runs_at_once_publish_once(spark, corpus, tmp_path):
    from folioscope.operators.changes import Conflict

    s = GraphStore(spark, f"file://{tmp_path}/p")
    assert s.current() is None
    s.publish(0, {"snapshot": "one"})
    with pytest.raises(Conflict):
        s.publish(0, {"snapshot": "two"})
    for n in range(1, 5):
        s.publish(n, {"snapshot": f"s{n}"})
    assert s.head() == (5, {"snapshot": "s4"}) and s._versions.numbers() == [3, 4, 5]


def test_every_row_of_a_sheet_is_numbered_once(spark):
    from pyspark.sql import functions as F

    from folioscope.operators import sheets

    n = 120_000  # far more than a range partitioning samples
    t = spark.range(n, numPartitions=24).select((F.xxhash64("id") % 1000).alias("k"), F.col("id").alias("v"))
    got = sheets.cells_of(t, ["v"], ["k"])
    r = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("d"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.count_distinct("v").alias("v")).first()
    assert tuple(r) == (n, n, 1, n, n)
    assert sheets.cells_of(t.limit(0), ["v"], ["k"]).count() == 0

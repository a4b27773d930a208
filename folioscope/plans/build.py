"""Folders to graph and to chunk index, incrementally: list, classify, extract what changed, keep claims, derive.

A store is a folder. store/current/N.json names the snapshot in force (the highest N; each is made once, nothing is deleted first, so a reader sees the old snapshot or the new one and a
crash leaves the old one). A snapshot holds the manifest (what was seen of each file) and the derived tables. Claims are immutable files (data/*) with deletion vectors (dv/*), listed by the snapshot:
a run writes the claims of new and changed files and the vectors of changed and vanished ones, never the rest again. The graph is derived from all claims: building at once and in steps
give the same.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..operators import changes, chunking, documents, entities, merge, search, sheets
from ..session import materialize, ship
from ..sources import files as S
from ..sources import readers as R
from ..storage import Folder, Versions

MANIFEST = "path string, mtime timestamp, size long, digest string, indexed_at timestamp"
MAX_TEXT_CHARS = 5 << 20
#: Snapshots that are kept for readers that began before the newest; claim files from which all are written anew as one.
KEEP, COMPACT = 3, 64
#: Fixed value: characters of a page's or segment's text that its own node shows; the whole text stands in the chunks below it.
PREVIEW = 300


@dataclass
class Stats:
    """What a run did."""

    new: int = 0
    changed: int = 0
    touched: int = 0
    unchanged: int = 0
    removed: int = 0
    skipped: int = 0
    dropped_edges: int = 0
    warnings: list[str] = field(default_factory=list)


class GraphStore:
    """Snapshots of one pipeline (graph or index); each pipeline has its own manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        ship(spark)
        self._folder = Folder(spark, self.root)
        self._versions = Versions(self._folder, "current")

    def head(self) -> tuple[int, dict]:
        """Number and entry of the snapshot in force; (0, {}) if there is none."""
        n = self._versions.head()
        return n, self._versions.read(n) if n else {}

    def current(self) -> str | None:
        return self.head()[1].get("snapshot")

    def info(self) -> dict:
        return self.head()[1].get("info", {})

    def publish(self, after: int, entry: dict) -> None:
        """Put a snapshot in force that was made from number after; raises Conflict if another run has published since. Snapshots before the last KEEP are removed."""
        if not self._versions.take(after + 1, entry):
            raise changes.Conflict(f"another run has published snapshot {after + 1} of {self.root}; run again")
        for n in self._versions.numbers():
            if n <= after + 1 - KEEP:
                old = self._versions.read(n)
                self._folder.remove(f"current/{n}.json")
                self._folder.remove(old["snapshot"])

    def read(self, table: str, schema) -> DataFrame:
        name = self.current()
        if name is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{table}")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and resolved edges of the snapshot in force."""
        return self.read("nodes", M.NODES), self.read("edges", M.EDGES)

    def text_index(self) -> search.TextIndex | None:
        """The postings of the snapshot in force."""
        name = self.current()
        return search.TextIndex(self.spark, f"{self.root}/{name}/postings") if name else None

    # -- claims
    def replaced(self, entry: dict, table: str, key: str, gone: DataFrame, fresh: DataFrame) -> dict:
        """The file lists of a claim table after a run: rows of the gone keys into a deletion vector, fresh rows into a new file. With more than COMPACT files all live rows are written anew as one."""
        was = entry.get(table, {"files": [], "dvs": []})
        files, dvs = list(was["files"]), list(was["dvs"])
        if files:
            vector = changes.live_rows(self.spark, self.root, key, files, dvs).select(key, "_file").join(gone.select(F.col("owner").alias(key)).distinct(), key, "left_semi").distinct()
            dvs.append(f"dv/{uuid.uuid4().hex}")
            vector.write.parquet(f"{self.root}/{dvs[-1]}")
        name = f"data/{uuid.uuid4().hex}"
        if len(files) >= COMPACT:
            fresh = fresh.unionByName(changes.live_rows(self.spark, self.root, key, files, dvs).drop("_file"))
            files, dvs = [], []
        fresh.write.parquet(f"{self.root}/{name}")
        return {"files": [*files, name], "dvs": dvs}

    def claims(self, lists: dict, key: str) -> DataFrame:
        return changes.live_rows(self.spark, self.root, key, lists["files"], lists["dvs"]).drop("_file")


def _text_docs(found: DataFrame) -> DataFrame:
    """The columns of a document (see extract) of text and HTML files."""
    t = found.withColumn("raw", F.substring(S.decoded(F.col("content")), 1, MAX_TEXT_CHARS))
    is_html = S.suffix(F.col("path")).isin(".html", ".htm", ".xhtml")
    body = F.when(is_html, documents.html_text(F.col("raw"))).otherwise(X.clean(F.col("raw")))
    warn = F.when(F.col("raw").isNull(), F.array(F.lit("not decodable as text"))).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("text", F.coalesce(body, F.lit("")))
    lines = F.regexp_count("text", F.lit("\n")) + 1
    extra = F.create_map(F.lit("chars"), F.length("text").cast("string"), F.lit("lines"), lines.cast("string"))
    return t.select("path", "size", "digest", "fmt", "raw", "text", documents.title(F.coalesce("raw", F.lit("")), F.col("path"), is_html).alias("title"), warn.alias("warnings"), F.lit(None).cast("string").alias("unreadable"), extra.alias("extra"))


def _next(df: DataFrame, parent: str, order: str) -> DataFrame:
    """(src, dst, owner, seq): NEXT from each part to the following one of its parent."""
    n = documents.next_edges(df.select("uid", "owner", "seq", F.col(parent).alias("_parent"), F.col(order).alias("_order")), "_parent", "uid", "_order")
    return n.join(df.select(F.col("uid").alias("dst"), "owner", "seq"), "dst")


def extract(found: DataFrame, transcribe: R.Transcriber | None = None, ocr: R.Ocr | None = None, keyframes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Node and edge claims of files (path, size, digest, content, reader, fmt). Nodes have by, the claiming file, which for entities isn't their owner."""
    f = found
    name_of = F.element_at(F.split("path", "/"), -1)
    stem_of = F.regexp_replace(name_of, "(?<=.)\\.[^.]+$", "")
    no_props = F.create_map().cast(M.PROPS)
    # What several tables are made from is written once.
    plain = materialize(_text_docs(f.where("reader = 'text'")), "plain")
    parts = materialize(R.read_parts(f.where("reader is not null and reader <> 'text'"), transcribe, ocr, keyframes), "parts")
    props_of = F.coalesce(F.from_json("props", "map<string,string>"), no_props)
    odd = F.coalesce(S.explained(F.col("fmt")), S.mislabelled(F.col("path"), F.col("fmt")))
    heads = parts.where("kind = 'document'").join(f.select("path", "size", "digest", "reader", "fmt", odd.alias("odd")), "path")
    told = F.coalesce(F.from_json("warnings", "array<string>"), F.array().cast("array<string>"))
    # Bytes that don't go with the name explain a warning, and stand alone where there is none.
    notes = F.when(F.col("odd").isNull(), told).when(F.size(told) == 0, F.array("odd")).otherwise(F.transform(told, lambda w: F.concat(w, F.lit(" ("), F.col("odd"), F.lit(")"))))
    empty = F.coalesce(X.clean(F.col("text")), F.lit("")) == ""
    p = F.col("props_map")
    caption = documents.caption(F.col("path"), F.col("reader"), p)
    other = heads.withColumn("props_map", props_of).select(
        "path", "size", "digest", "fmt", F.lit(None).cast("string").alias("raw"), F.when(empty & F.col("reader").isin("image", "audio", "video"), caption).otherwise(X.clean(F.col("text"))).alias("text"),
        F.coalesce("title", stem_of).alias("title"), notes.alias("warnings"), F.lit(None).cast("string").alias("unreadable"), p.alias("extra"),
    )
    why = F.coalesce(S.explained(F.col("fmt")), F.lit("no reader for this kind of file"))
    unread = f.where("reader is null").select("path", "size", "digest", "fmt", F.lit(None).cast("string").alias("raw"), F.lit("").alias("text"), stem_of.alias("title"), F.array(why).alias("warnings"), why.alias("unreadable"), no_props.alias("extra"))
    docs = plain.unionByName(other).unionByName(unread).withColumn("mislabelled", S.mislabelled(F.col("path"), F.col("fmt"))).withColumn("modality", S.modality(F.col("path"))).withColumn("seq", F.lit(1).cast("long"))
    nodes = documents.document_nodes(docs)
    whole = docs.join(parts.where("kind in ('page', 'segment', 'sheet')").select("path").distinct(), "path", "left_anti")  # the text of the others stands in their parts
    chunks = chunking.chunk_documents(whole.select("path", "text")).withColumn("parent", M.document_uid(F.col("path")))

    # Pages, slides and segments: one node each with the start of its text, chunks below it, NEXT in order.
    timed = F.col("kind") == "segment"
    uid = F.when(timed, M.child_uid(M.document_uid(F.col("path")), "segment", F.col("key"))).otherwise(M.child_uid(M.document_uid(F.col("path")), "page", F.col("key")))
    label = F.when(timed, F.concat(name_of, F.lit(" @ "), p["timestamp"])).when(p["slide"].isNotNull(), F.concat(name_of, F.lit(" slide "), F.col("key"))).otherwise(F.concat(name_of, F.lit(" p."), F.col("key")))
    spans = parts.where("kind in ('page', 'segment')").withColumn("props_map", F.map_concat(props_of, F.create_map(F.lit("path"), F.col("path")))).withColumn("text", X.clean(F.col("text")))
    spans = spans.select("*", uid.alias("uid"), F.concat_ws(" — ", label, p["heading"]).alias("label"), F.col("path").alias("owner"), F.col("key").cast("long").alias("seq"), M.document_uid(F.col("path")).alias("doc"))
    span_nodes = spans.select("uid", "kind", F.col("label").alias("name"), F.substring("text", 1, PREVIEW).alias("body"), F.col("props_map").alias("props"), "owner", "seq")
    lead = F.concat_ws("\n", F.when(p["slide"].isNotNull() & p["heading"].isNotNull(), F.concat(F.lit("# "), p["heading"])), "text")
    span_chunks = chunking.chunk_documents(spans.select(F.col("uid").alias("path"), lead.alias("text")))
    shown = spans.select(F.col("uid").alias("parent"), F.col("path"), F.map_filter(p, lambda k, v: k.isin("page", "slide", "start_time", "end_time")).alias("extra"))
    span_chunks = span_chunks.withColumnRenamed("path", "parent").join(shown, "parent")
    counted = span_chunks.groupBy("path", "parent").agg(F.count(F.lit(1)).alias("n")).join(spans.select(F.col("uid").alias("parent"), "seq"), "parent")
    first = chunking.running_ordinals(counted.select(F.col("path").alias("doc"), F.col("seq").alias("page"), "n", "parent")).select("parent", "first_ord")
    span_chunks = span_chunks.join(first, "parent").withColumn("ord", (F.col("ord") + F.col("first_ord")).cast("int")).drop("first_ord")
    every = materialize(chunks.withColumn("extra", no_props).unionByName(span_chunks), "chunks")
    chunk_nodes, chunk_edges = chunking.chunk_graph(every)

    # Frames of videos, each at the segment in which it falls.
    frames = parts.where("kind = 'frame'").withColumn("props_map", F.map_concat(props_of, F.create_map(F.lit("path"), F.col("path"))))
    frame_nodes = frames.select(M.child_uid(M.document_uid(F.col("path")), "frame", F.col("key")).alias("uid"), F.lit("frame").alias("kind"), F.concat(name_of, F.lit(" frame @ "), p["timestamp"]).alias("name"), F.concat(F.lit("video frame from "), F.col("path"), F.lit(" at "), p["timestamp"]).alias("body"), p.alias("props"), F.col("path").alias("owner"), F.col("key").cast("long").alias("seq"))
    wins = spans.where("kind = 'segment'").select(F.col("path").alias("file"), F.col("seq").cast("int").alias("ord"), p["start_time"].cast("double").alias("start_time"), p["end_time"].cast("double").alias("end_time"))
    held = chunking.frame_segments(frames.select(F.col("path").alias("file"), F.col("key").alias("frame"), p["time"].cast("double").alias("at")), wins).where("ord is not null")
    has_frame = held.select(M.child_uid(M.document_uid(F.col("file")), "segment", F.col("ord")).alias("src"), M.child_uid(M.document_uid(F.col("file")), "frame", F.col("frame")).alias("dst"), F.col("file").alias("owner"), F.col("frame").cast("long").alias("seq"))

    # Sheets, columns and rows.
    sheet_rows = parts.where("kind = 'sheet'").select("path", F.col("key").alias("sheet"), F.get_json_object("props", "$.at").cast("long").alias("at"), F.from_json("text", "array<array<string>>").alias("rows")).where(F.size("rows") > 0)
    sheet_uid = M.child_uid(M.document_uid(F.col("path")), "sheet", F.when(X.slug(F.col("sheet")) == "", F.col("sheet")).otherwise(X.slug(F.col("sheet"))))
    head = F.when(sheets.is_header(F.element_at("rows", 1)), F.element_at("rows", 1))
    sheet_rows = sheet_rows.withColumn("h", head).withColumn("uid", sheet_uid)
    shown = F.array_join(F.transform(F.slice("rows", 1, sheets.PREVIEW + 1), lambda r: F.concat_ws(" | ", r)), "\n")
    wide = F.when(F.col("h").isNotNull(), F.size("h")).otherwise(F.array_max(F.transform("rows", lambda r: F.size(r))))
    sheet_props = F.create_map(F.lit("sheet"), F.col("sheet"), F.lit("path"), F.col("path"), F.lit("rows"), (F.size("rows") - F.col("h").isNotNull().cast("int")).cast("string"), F.lit("columns"), wide.cast("string"), F.lit("headers"), F.coalesce(F.to_json("h"), F.lit("[]")))
    sheet_nodes = sheet_rows.select("uid", F.lit("sheet").alias("kind"), F.concat(name_of, F.lit(" ["), F.col("sheet"), F.lit("]")).alias("name"), shown.alias("body"), sheet_props.alias("props"), F.col("path").alias("owner"), F.col("at").alias("seq"), M.document_uid(F.col("path")).alias("doc"))
    cols = sheet_rows.where("h is not null").select("path", "uid", "sheet", "rows", F.posexplode("h").alias("pos", "label"))
    values = F.filter(F.transform(F.slice("rows", 2, 1 << 30), lambda r: F.get(r, F.col("pos"))), lambda v: v.isNotNull() & (v != ""))
    cols = cols.withColumn("vals", values)
    clash = F.count(F.lit(1)).over(_by("uid", X.slug(F.col("label")))) > 1
    key = F.when(clash | (X.slug(F.col("label")) == ""), F.concat_ws("-", F.when(X.slug(F.col("label")) != "", X.slug(F.col("label"))), F.col("pos").cast("string"))).otherwise(X.slug(F.col("label")))
    samples = F.slice(F.array_distinct(F.transform("vals", lambda v: F.substring(v, 1, 120))), 1, sheets.SAMPLES)
    column_nodes = cols.select(M.child_uid(F.col("uid"), "column", key).alias("cuid"), "*").select(
        F.col("cuid").alias("uid"), F.lit("column").alias("kind"), F.col("label").alias("name"), F.concat_ws("\n", "label", samples).alias("body"),
        F.create_map(F.lit("path"), F.col("path"), F.lit("sheet"), F.col("sheet"), F.lit("position"), F.col("pos").cast("string"), F.lit("dtype"), _dtype(F.col("vals")), F.lit("non_empty"), F.size("vals").cast("string"), F.lit("distinct"), F.size(F.array_distinct("vals")).cast("string")).alias("props"), F.col("path").alias("owner"), F.col("pos").cast("long").alias("seq"), F.col("uid").alias("parent"),
    )
    body_rows = sheet_rows.select("path", "uid", "sheet", "h", F.when(F.col("h").isNotNull(), F.slice("rows", 2, 1 << 30)).otherwise(F.col("rows")).alias("rows")).where(F.size("rows") > 0)
    batches = body_rows.select("path", "uid", "sheet", "h", "rows", F.explode(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / sheets.ROWS))).alias("ord"))
    lines = F.transform(F.slice("rows", (F.col("ord") * sheets.ROWS + 1).cast("int"), sheets.ROWS), lambda r: F.concat_ws(" | ", r))
    row_nodes = batches.select(M.child_uid(F.col("uid"), "chunk", F.col("ord")).alias("uid"), F.lit("chunk").alias("kind"), F.concat(name_of, F.lit(" rows "), (F.col("ord") * sheets.ROWS + 1).cast("string")).alias("name"), X.clean(F.concat_ws("\n", F.when(F.col("h").isNotNull(), F.concat_ws(" | ", "h")), F.array_join(lines, "\n"))).alias("body"), F.create_map(F.lit("path"), F.col("path"), F.lit("sheet"), F.col("sheet"), F.lit("ord"), F.col("ord").cast("string")).alias("props"), F.col("path").alias("owner"), F.col("ord").cast("long").alias("seq"), F.col("uid").alias("parent"))

    def edges(df: DataFrame, src, dst, kind: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), no_props.alias("props"), F.col("owner"), F.col("seq"))

    doc_of = M.document_uid(F.col("owner"))
    links = documents.link_edges(plain.where("raw is not null")).select("src", "dst", F.lit("references").alias("kind"), F.lit(1.0).alias("weight"), F.lit("inferred").alias("provenance"), F.create_map(F.lit("label"), F.lit("link"), F.lit("target"), F.col("target")).alias("props"), F.expr("substring(src, 5)").alias("owner"), F.lit(1).cast("long").alias("seq"))
    ent_nodes, ent_edges = entities.link_entities(chunk_nodes.unionByName(row_nodes.drop("parent")).select("uid", "body", "owner", "seq"))
    all_nodes = nodes
    for n in (span_nodes, frame_nodes, sheet_nodes.drop("doc"), column_nodes.drop("parent"), row_nodes.drop("parent"), chunk_nodes, ent_nodes):
        all_nodes = all_nodes.unionByName(n, allowMissingColumns=True)
    all_nodes = all_nodes.withColumn("by", F.coalesce("by", "owner"))
    src, dst, here = F.col("src"), F.col("dst"), F.col("uid")
    all_edges = chunk_edges.unionByName(links).unionByName(ent_edges)
    for e in (
        edges(span_nodes, doc_of, here, "contains"), edges(frame_nodes, doc_of, here, "contains"), edges(sheet_nodes, doc_of, here, "contains"), edges(column_nodes, F.col("parent"), here, "contains"), edges(row_nodes, F.col("parent"), here, "contains"),
        edges(has_frame, src, dst, "has_frame"), edges(_next(spans, "doc", "seq"), src, dst, "next"), edges(_next(sheet_nodes, "doc", "seq"), src, dst, "next"), edges(_next(row_nodes, "parent", "seq"), src, dst, "next"),
    ):
        all_edges = all_edges.unionByName(e)
    return all_nodes, all_edges


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _dtype(vals):
    head = F.slice(vals, 1, sheets.SEEN)
    share = lambda p: F.size(F.filter(head, p)) >= sheets.AGREE * F.size(head)
    return (
        F.when(F.size(vals) == 0, "empty").when(share(lambda v: v.rlike("(?U)" + sheets.CURRENCY)), "currency").when(share(lambda v: v.rlike("(?U)" + sheets.ISO_DATE)), "date")
        .when(share(lambda v: v.rlike("(?U)" + sheets.NUMBER)), "number").when(share(lambda v: F.lower(v).isin(sheets.BOOLEAN)), "boolean").otherwise("text")
    )


def derive(node_claims: DataFrame, edge_claims: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dropped edges) of all claims and the folders above the live paths."""
    fn, fe = documents.folder_graph(paths)
    nodes = merge.merge_nodes(node_claims.unionByName(fn))
    edges, dropped = merge.resolve_edges(merge.merge_edges(edge_claims.unionByName(fe)), nodes)
    return merge.collect_garbage(nodes, edges), edges, dropped


def build(spark: SparkSession, root: str, store: GraphStore, prune: bool = True, transcribe: R.Transcriber | None = None, ocr: R.Ocr | None = None, keyframes: int = 0) -> Stats:
    """Bring the store up to date with a folder and publish a new snapshot.

    Files with the recorded time and size aren't opened; the others are opened once. Those with the recorded digest are only touched; claims of changed and vanished files are
    replaced. A file that can't be read keeps its record and is tried again by the next run. Without changes nothing is written.
    """
    at_version, entry = store.head()
    seen = materialize(S.listing(spark, root), "listing")
    live = seen.where("skipped is null")
    known = store.read("manifest", MANIFEST)
    status = materialize(changes.classify_listing(live.withColumn("digest", F.lit(None).cast("string")), known), "status")
    n = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    st = Stats(unchanged=n.get("unchanged", 0), removed=n.get("removed", 0) if prune else 0, skipped=seen.where("skipped is not null").count())
    todo = live.join(status.where(F.col("status").isin("new", "changed")), "path").select("path", "file", "mtime", "size")
    old = known.select("path", F.col("digest").alias("was"))
    opened = S.contents(todo).withColumn("digest", S.digest(F.col("content"))).join(old, "path", "left")
    state = F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("digest"), "touched").otherwise("changed")
    opened = materialize(opened.withColumn("state", state).withColumn("reader", S.reader(F.col("path"))).withColumn("fmt", S.sniffed(F.col("content"))), "opened")
    k = {r["state"]: r["n"] for r in opened.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    st.new, st.changed, st.touched = k.get("new", 0), k.get("changed", 0), k.get("touched", 0)
    unread = n.get("new", 0) + n.get("changed", 0) - st.new - st.changed - st.touched
    st.warnings = [f"{unread} files could not be read"] if unread else []
    if not (st.new or st.changed or st.touched or st.removed) and at_version:
        return st
    fresh = opened.where("state <> 'touched'")
    gone = status.where("status = 'removed'").select(F.col("path").alias("owner")) if prune else status.limit(0).select(F.col("path").alias("owner"))
    replaced = gone.unionByName(fresh.where("state = 'changed'").select(F.col("path").alias("owner")))
    new_nodes, new_edges = extract(fresh, transcribe, ocr, keyframes)
    lists = {
        "node_claims": store.replaced(entry, "node_claims", "by", replaced, new_nodes.select(*[f.name for f in M.NODES], "by")),
        "edge_claims": store.replaced(entry, "edge_claims", "owner", replaced, new_edges.select([f.name for f in M.EDGES])),
    }
    manifest = known.join(gone.select(F.col("owner").alias("path")), "path", "left_anti").join(opened.select("path"), "path", "left_anti")
    manifest = manifest.unionByName(opened.select("path", "mtime", "size", "digest", F.current_timestamp().alias("indexed_at")))
    name = f"snapshot-{uuid.uuid4().hex}"
    at = f"{store.root}/{name}"
    manifest.write.parquet(f"{at}/manifest")
    kept = spark.read.parquet(f"{at}/manifest").select("path")
    nodes, edges, dropped = derive(store.claims(lists["node_claims"], "by").drop("by"), store.claims(lists["edge_claims"], "owner"), kept)
    nodes.write.parquet(f"{at}/nodes")
    edges.write.parquet(f"{at}/edges")
    st.dropped_edges = dropped.count()
    found = spark.read.parquet(f"{at}/nodes").select("uid", search.node_text(F.col("body"), F.col("name"), F.col("props")).alias("body"))
    search.TextIndex(spark, f"{at}/postings").write(found, "uid", "body")
    store.publish(at_version, {"snapshot": name, "info": {"root": root}, **lists})
    return st


def index(spark: SparkSession, root: str, store: GraphStore) -> Stats:
    """The same for the chunk index: text files only, chunks with what they are searched by."""
    at_version, _ = store.head()
    live = materialize(S.text_listing(spark, root).where("skipped is null").where(S.indexable(F.col("path"), F.col("size"))), "listing")
    known = store.read("manifest", MANIFEST)
    status = materialize(changes.classify_listing(live.withColumn("digest", F.lit(None).cast("string")), known), "status")
    n = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    st = Stats(new=n.get("new", 0), changed=n.get("changed", 0), unchanged=n.get("unchanged", 0), removed=n.get("removed", 0))
    if not (st.new or st.changed or st.removed) and at_version:
        return st
    fresh = S.contents(live.join(status.where(F.col("status").isin("new", "changed")), "path").select("path", "file", "mtime", "size"))
    fresh = materialize(fresh.select("path", "mtime", "size", S.digest(F.col("content")).alias("digest"), S.decoded(F.col("content")).alias("text")), "opened")
    schema = "path string, ord int, start_line int, end_line int, heading string, text string, search_body string"
    old = store.read("chunks", schema)
    gone = status.where("status = 'removed'").select("path").unionByName(fresh.select("path"))
    chunks = old.join(gone, "path", "left_anti").unionByName(chunking.chunk_index(fresh.where("text is not null").select("path", "text")).select(old.columns))
    manifest = known.join(gone, "path", "left_anti").unionByName(fresh.select("path", "mtime", "size", "digest", F.current_timestamp().alias("indexed_at")))
    name = f"snapshot-{uuid.uuid4().hex}"
    manifest.write.parquet(f"{store.root}/{name}/manifest")
    chunks.write.parquet(f"{store.root}/{name}/chunks")
    made = spark.read.parquet(f"{store.root}/{name}/chunks").select(F.xxhash64("path", "ord").alias("id"), "search_body")
    search.TextIndex(spark, f"{store.root}/{name}/postings").write(made, "id", "search_body")
    store.publish(at_version, {"snapshot": name, "info": {"root": root}})
    return st

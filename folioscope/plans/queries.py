"""Queries of the graph, text, search, vector, fact and build operators over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..operators import changes, chunking, documents, enrich, entities, facts, graph, merge, search, sheets, vectors
from ..session import materialize, scratch
from ..sources import files as S
from ..tables import table

TERMS = ["calibration", "table", "harbour"]
PHRASES = ["calibration table", "search index"]
#: Nodes whose neighbours are asked for: one that contains others, and the busiest one.
HOP = {"out": 162, "in": 1, "both": 1}


# ---------------------------------------------------------------- adapters


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf, "nodes").select(F.col("id").alias("uid"), "kind", "name", "body", "props", F.col("owner_file_id").cast("long").alias("owner"))
    e = table(spark, sf, "edges").select("id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", "weight", "provenance")
    return n, e


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """Fact texts: the distinct titles, each under its least document id."""
    return _docs(spark, sf).where("title is not null").groupBy(F.col("title").alias("text")).agg(F.min("doc_id").alias("id"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """Node claims: the graph's nodes, claimed once more by every document of the same path with its title and text."""
    n = table(spark, sf, "nodes")
    one = n.select(F.col("uid"), "kind", "name", "body", F.create_map(F.lit("from"), F.lit("node")).alias("props"), F.col("owner_file_id").cast("long").cast("string").alias("owner"), F.col("id").alias("seq"))
    d = _docs(spark, sf).select(F.concat(F.lit("doc:"), "path").alias("uid"), F.lit("document").alias("kind"), F.coalesce("title", "path").alias("name"), F.substring(F.coalesce("text", F.lit("")), 1, 1000).alias("body"), F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("und"))).alias("props"), F.lit(None).cast("string").alias("owner"), (F.col("doc_id") + 1_000_000_000).alias("seq"))
    return one.unionByName(d)


def _edge_claims(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "edges")
    return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", "weight", "provenance", F.create_map(F.lit("id"), F.col("id").cast("string")).alias("props"), F.col("owner_file_id").cast("long").cast("string").alias("owner"), F.col("id").alias("seq"))


# ---------------------------------------------------------------- sources, text, transformations


def source_dispatch(spark, sf):
    f = table(spark, sf, "files")
    return f.groupBy(S.modality(F.col("path")).alias("modality"), F.coalesce(S.reader(F.col("path")), F.lit("none")).alias("reader")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def indexable_files(spark, sf):
    f = table(spark, sf, "files")
    return f.where(S.indexable(F.col("path"), F.col("size"))).groupBy(S.suffix(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def digests(spark, sf):
    return _docs(spark, sf).select("doc_id", S.digest(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("digest"))


def text_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(X.clean(F.col("text")), 256).alias("cleaned"))


def preview_rows(spark, sf):
    return table(spark, sf, "nodes").where(F.col("body").isNotNull()).select("id", X.preview(F.col("body"), 80).alias("preview"))


def identifier_parts(spark, sf):
    return table(spark, sf, "chunks").select("id", F.explode(X.identifier_parts(F.col("text"))).alias("part"))


def html_text(spark, sf):
    d = _docs(spark, sf).select("doc_id", documents.html_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


def doc_titles(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", documents.title(F.col("text"), F.col("path"), F.lit(False)).alias("title_line"))


def page_links(spark, sf):
    return documents.link_edges(_docs(spark, sf).select("path", F.coalesce("text", F.lit("")).alias("raw"))).select("src", "dst")


def line_chunks(spark, sf):
    return chunking.chunk_documents(_docs(spark, sf).select("path", "text"))


def chunk_graph_edges(spark, sf):
    c = chunking.chunk_documents(_docs(spark, sf).select("path", "text")).withColumn("parent", M.document_uid(F.col("path")))
    return chunking.chunk_graph(c)[1].select("src", "dst", "kind")


def next_segments(spark, sf):
    s = table(spark, sf, "nodes").where("kind = 'segment'").select("uid", F.col("owner_file_id").cast("long").alias("file"), F.get_json_object("props", "$.start_time").cast("long").alias("at"))
    return documents.next_edges(s, "file", "uid", "at")


def transcript_windows(spark, sf):
    s = table(spark, sf, "nodes").where("kind = 'segment'").select(F.col("owner_file_id").cast("long").alias("file"), F.get_json_object("props", "$.start_time").cast("double").alias("start_time"), F.get_json_object("props", "$.end_time").cast("double").alias("end_time"), F.col("body").alias("text"))
    return chunking.windows(s).select("file", "ord", "start_time", "end_time")


def frame_segments(spark, sf):
    s = table(spark, sf, "nodes").where("kind = 'segment'").select(F.col("owner_file_id").cast("long").alias("file"), F.get_json_object("props", "$.start_time").cast("double").alias("start_time"), F.get_json_object("props", "$.end_time").cast("double").alias("end_time"))
    s = s.withColumn("ord", F.col("start_time").cast("int"))
    frames = s.groupBy("file").agg((F.max("end_time") * 0.5).alias("at")).select("file", F.lit(0).alias("frame"), "at")
    return chunking.frame_segments(frames, s)


def _family(name: str):
    def q(spark, sf):
        m = entities.mention_rows(_docs(spark, sf), "doc_id", "text", None)
        return m.where(F.col("type") == name).select("doc_id", "value")

    return q


def entity_dates_iso(spark, sf):
    m = _docs(spark, sf).select("doc_id", F.explode(entities.mentions(F.col("text"), None)).alias("m")).select("doc_id", "m.*")
    return m.where((F.col("type") == "date") & F.col("display").rlike("^\\d{4}-")).select("doc_id", "value").distinct()


def entity_mentions(spark, sf):
    """The capped mention lists of the chunks."""
    return entities.mention_rows(table(spark, sf, "chunks"), "id", "text")


def entity_order_dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("The order was placed on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and shipped later.")).alias("text"))
    return entities.mention_rows(o, "o_orderkey", "text").where("type = 'date'").select("o_orderkey", "value")


def entity_order_money(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("The total of the order is $"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" in all.")).alias("text"))
    return entities.mention_rows(o, "o_orderkey", "text").where("type = 'money'").select("o_orderkey", "value")


def cross_doc_entities(spark, sf):
    m = entities.mention_rows(_docs(spark, sf), "doc_id", "text", None).where("type = 'identifier'")
    return entities.shared_entities(m, "doc_id").select("value", "n_docs")


def entity_uids(spark, sf):
    n = table(spark, sf, "nodes").where("kind = 'entity'")
    return n.select("id", M.entity_uid(F.get_json_object("props", "$.entity_type"), F.get_json_object("props", "$.value")).alias("made"), "uid")


def folder_tree(spark, sf):
    return merge.live_folders(_docs(spark, sf).select("path")).select("uid", "parent")


def document_nodes(spark, sf):
    d = _docs(spark, sf).select("path", "title", "text", "modality", F.length("text").alias("size"), F.lit(None).cast("string").alias("digest"), F.array().cast("array<string>").alias("warnings"), F.col("doc_id").alias("seq"))
    return documents.document_nodes(d).select("uid", "name", F.sha2("body", 256).alias("body_hash"), F.col("props")["extension"].alias("extension"))


def column_profile(spark, sf):
    p = table(spark, sf, "part")
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    return sheets.profile(sheets.cells_of(p, cols, ["p_partkey"]), cols).select("position", "column", "dtype", "non_empty", "distinct_values", F.concat_ws("|", "samples").alias("samples"))


def sheet_rows(spark, sf):
    """Row numbers of the largest table: each of 1..n once, in order of the keys."""
    c = sheets.cells_of(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])
    return c.select("row", "l_orderkey", "l_linenumber")


def row_chunks(spark, sf):
    cols = ["p_partkey", "p_name", "p_brand"]
    c = sheets.row_chunks(sheets.cells_of(table(spark, sf, "part"), cols, ["p_partkey"]), cols)
    return c.select("ord", "first_row", "last_row", F.sha2("body", 256).alias("body_hash"))


# ---------------------------------------------------------------- sinks and merging


def upsert_merge(spark, sf):
    m = merge.merge_nodes(_claims(spark, sf))
    return m.select("uid", "kind", "name", F.sha2("body", 256).alias("body_hash"), "owner", F.to_json(F.array_sort(F.map_keys("props"))).alias("keys"))


def edge_merge(spark, sf):
    return merge.merge_edges(_edge_claims(spark, sf)).select("src", "dst", "kind", "weight", "provenance", F.col("props")["id"].alias("newest"), "owner")


def unresolved_edges(spark, sf):
    n, e = _graph(spark, sf)
    live = n.where("kind <> 'entity'")  # as if the entities had not been built
    return merge.resolve_edges(e, live)[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def resolved_edges(spark, sf):
    n, e = _graph(spark, sf)
    return merge.resolve_edges(e, n.where("kind <> 'entity'"))[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def gc_orphans(spark, sf):
    n, e = _graph(spark, sf)
    kept = merge.collect_garbage(n, e.where("kind <> 'mentions'"))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def clear_files(spark, sf):
    failed = table(spark, sf, "files").where("size = 0").select(F.col("id").cast("string").alias("owner"))
    left = merge.clear_owner(_edge_claims(spark, sf), failed)
    return left.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def cache_misses(spark, sf):
    files = table(spark, sf, "files").select("digest", F.lit("text").alias("producer"), F.lit("1").alias("version"), F.lit("x").alias("payload"))
    scans = table(spark, sf, "file_scans").where("digest is not null").select("digest", F.lit("text").alias("producer"), F.lit("1").alias("version")).distinct()
    return merge.cache_misses(scans, files).select("digest")


def export_nodes(spark, sf):
    n, e = _graph(spark, sf)
    return graph.export(n, e, 500)[0].select("uid", "kind")


def export_edges(spark, sf):
    n, e = _graph(spark, sf)
    return graph.export(n, e, 500)[1].select("src", "dst", "kind").distinct()


# ---------------------------------------------------------------- graph reads


def node_lookup(spark, sf):
    n, _ = _graph(spark, sf)
    return graph.node(n, 33).select("uid", "kind", "name")


def nodes_by_kind(spark, sf):
    n, _ = _graph(spark, sf)
    return graph.nodes_of_kind(n, "topic", 50).select("uid", "name")


def root_folders(spark, sf):
    n, _ = _graph(spark, sf)
    return n.where((F.col("kind") == "folder") & F.get_json_object("props", "$.root").isNotNull()).select("uid", "name")


def _neighbors(direction: str):
    def q(spark, sf):
        n, e = _graph(spark, sf)
        return graph.neighbors(n, e, HOP[direction], None, direction, limit=50).select("uid", "edge_kind", "direction", "weight")

    return q


def neighbors_filtered(spark, sf):
    n, e = _graph(spark, sf)
    return graph.neighbors(n, e, 1, ["mentions"], "in", ["page", "chunk"], 25).select("uid", "kind", "weight")


def graph_counts(spark, sf):
    return graph.counts(*_graph(spark, sf))


def hubs(spark, sf):
    return graph.hubs(*_graph(spark, sf)).select("uid", "name", "degree")


def hubs_entities(spark, sf):
    return graph.hubs(*_graph(spark, sf), "entity", 10).select("uid", "degree")


def hubs_parts(spark, sf):
    li = table(spark, sf, "lineitem")
    e = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return graph.degrees(e).orderBy(F.desc("degree"), "uid").limit(20)


def shortest_path(spark, sf):
    n, e = _graph(spark, sf)
    path = graph.shortest_path(n, e, 1000, 1500)
    return spark.createDataFrame([(len(path) - 1 if path else None,)], "hops int")


def subgraph_nodes(spark, sf):
    n, e = _graph(spark, sf)
    return graph.reach(n, e, 1000, 2)


def subgraph_edges(spark, sf):
    n, e = _graph(spark, sf)
    return graph.subgraph(n, e, 1000, 1, 200)[1].select("src", "dst", "kind").distinct()


def graph_health(spark, sf):
    n, e = _graph(spark, sf)
    return graph.health(n, e, F.col("owner"))


def table_counts(spark, sf):
    out = None
    for t in ("sources", "files", "chunks", "nodes", "edges"):
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def modality_counts(spark, sf):
    return _docs(spark, sf).groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


# ---------------------------------------------------------------- search, vectors, facts


def _bodies(spark, sf):
    return _graph(spark, sf)[0].select("uid", "kind", F.coalesce("body", F.lit("")).alias("body"))


def bm25_topk(spark, sf):
    return search.top(search.search_scan(_bodies(spark, sf), TERMS), 20).select("uid", F.round("score", 6).alias("score"))


def bm25_kind_filtered(spark, sf):
    hit = search.search_scan(_bodies(spark, sf), TERMS).where("kind = 'page'")
    return search.top(hit, 20).select("uid", F.round("score", 6).alias("score"))


def bm25_phrase(spark, sf):
    return search.top(search.search_scan(_bodies(spark, sf), PHRASES), 20).select("uid", F.round("score", 6).alias("score"))


def graph_search(spark, sf):
    """What the product's search reads: bodies, names and props."""
    n = table(spark, sf, "nodes").select(F.col("id").alias("uid"), "kind", search.node_text(F.col("body"), F.col("name"), F.from_json("props", "map<string,string>")).alias("body"))
    return search.top(search.search_scan(n, ["harbour", "calibration", "md"]), 20).select("uid", F.round("score", 6).alias("score"))


def bm25_index(spark, sf):
    docs = _bodies(spark, sf)
    idx = search.postings(docs, stem=False)
    return search.top(search.search_index(idx, search.doc_stats(docs), TERMS + PHRASES[:1], stem=False), 20).select("uid", F.round("score", 6).alias("score"))


def bm25_stemmed(spark, sf):
    docs = _bodies(spark, sf)
    return search.top(search.search_index(search.postings(docs), search.doc_stats(docs), ["calibrated", "tables"]), 20).select("uid", F.round("score", 6).alias("score"))


def recall_pool(spark, sf):
    hit = search.search_scan(_bodies(spark, sf), TERMS).where("kind in ('page', 'chunk')").withColumn("r", F.lit(1))
    from pyspark.sql import Window

    pool = hit.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.round("score", 9)), "uid"))).where("r <= 20")
    return search.normalised(pool, ["kind"]).select("uid", "kind", F.round("score", 6).alias("score"))


def recall(spark, sf):
    c = table(spark, sf, "chunks").select(F.lit("project").alias("scope"), "id", F.col("file_id").cast("string").alias("path"), "start_line", "text", F.col("text").alias("search_body"))
    f = _titles(spark, sf).select(F.lit("global").alias("scope"), "id", "text", F.array().cast("array<string>").alias("tags"), (F.col("id") == 1).alias("pinned"))
    return search.recall("calibration table harbour", c, f, 10).select("kind", "scope", "item", F.round("score", 6).alias("score"))


def common_terms(spark, sf):
    return search.common_terms(_docs(spark, sf)).orderBy(F.desc("n_docs"), "term").limit(50)


def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first() or e.orderBy("vec_id").select("embedding").first()
    return vectors.search(e, q[0], 40, "vec_id", "embedding").select("vec_id", F.round("cosine", 5).alias("cosine"))


def vectors_missing(spark, sf):
    items = _docs(spark, sf).select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("item"), "text")
    have = table(spark, sf, "embeddings").select(F.lit("chunk").alias("kind"), F.col("vec_id").cast("long").alias("item"), F.lit("m").alias("model"))
    return vectors.missing(items, have, "m").select("item")


def vectors_built(spark, sf):
    items = _docs(spark, sf).select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("item"), "text")
    none = spark.createDataFrame([], "kind string, item long, model string, dim int, vec array<float>")
    return vectors.build(items, none, "hash", vectors.hashing_embedder(16)).select("item", "dim")


def fact_related(spark, sf):
    return facts.related(_titles(spark, sf), "The harbour survey of the calibration table").select("id", F.round("similarity", 6).alias("similarity"))


def fact_pairs(spark, sf):
    t = _titles(spark, sf)
    return facts.similar_pairs(t, t, least=0.35).where("left_id < right_id").select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- build and enrichment


def incremental_diff(spark, sf):
    last = table(spark, sf, "file_scans").where("run_id = 30")
    now = changes.latest_per(last, ["path"], ["seen_at", "scan_id"]).select("path", "mtime", "size", "digest")
    was = changes.latest_per(table(spark, sf, "files"), ["path"], ["indexed_at", "id"]).select("path", "mtime", "size", "digest")
    return changes.classify_listing(now, was).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def enrich_estimate(spark, sf):
    n, _ = _graph(spark, sf)
    return enrich.estimate(n.where("kind = 'chunk'"), 3.0, 15.0).select("passages", "batches", "tokens_in", "tokens_out", "cost")


def enrich_claims(spark, sf):
    """Enrichment of every chunk node by a stand-in client that names the capitalised words."""
    import re

    def client(batch):
        out = []
        for i, text in batch:
            ws = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{5,}\b", text)))[:5]
            out.append({"id": i, "entities": [{"name": w, "type": "concept"} for w in ws], "relations": [{"source": a, "target": b, "label": "beside"} for a, b in zip(ws, ws[1:])]})
        return {"passages": out}

    n = table(spark, sf, "nodes").where("kind = 'chunk'").select("uid", F.col("owner_file_id").cast("long").cast("string").alias("owner"), "body")
    todo = enrich.passages(n)
    cache = spark.createDataFrame([], "digest string, producer string, version string, payload string, error string")
    got = materialize(enrich.run(todo, cache, client, "stand-in"), "enrich")
    nodes, edges = enrich.claims(todo, got, "stand-in")
    return merge.merge_edges(edges).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def versioned_run(spark, sf):
    """Chunk rows through a versioned table: two versions in, one deletion, only the differences out; the sink notes the version that it has processed."""
    at = scratch(spark, "versions")
    src, dst = changes.VersionedTable(spark, f"{at}/src", "id"), changes.VersionedTable(spark, f"{at}/dst", "id")
    c = table(spark, sf, "chunks").select("id", "file_id", "ord")
    src.commit(c.where("id % 3 <> 0"))
    changes.process_changes(src, dst, lambda d: d)
    src.commit(c.where("id % 3 = 0"), c.where("id % 3 = 1").select("id"))
    changes.process_changes(src, dst, lambda d: d)
    assert changes.process_changes(src, dst, lambda d: d) is None
    return dst.read().groupBy(F.col("_change").alias("change")).agg(F.count(F.lit(1)).alias("n"))


def stream_mentions(spark, sf):
    """Entity mentions of documents as they stream in, by type and month of change: a streaming query over the whole table, run to the end of its input.

    The watermark is two days: the file arrives in one micro-batch, in which nothing is late.
    """
    from ..streaming import ingest

    # A glob of one table: the source wants a folder or a pattern, and reads the file where it lies.
    s = ingest.read_documents(spark, f"{sf}/documents.parquet" if os.path.isdir(f"{sf}/documents.parquet") else f"{sf}/documents.parque[t]", _docs(spark, sf).schema)
    w = ingest.mentions_by_window(s.where("modified_at is not null"), "modified_at", "text", "30 days", "2 days")
    name = f"mentions_{os.urandom(4).hex()}"
    q = w.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).groupBy("start", "type").agg(F.sum("n").alias("n"))


_SIMPLE = (
    source_dispatch, indexable_files, digests, text_clean, preview_rows, identifier_parts, html_text, doc_titles, page_links, line_chunks, chunk_graph_edges, next_segments, transcript_windows, frame_segments,
    entity_dates_iso, entity_mentions, entity_order_dates, entity_order_money, cross_doc_entities, entity_uids, folder_tree, document_nodes, column_profile, sheet_rows, row_chunks, upsert_merge, edge_merge,
    unresolved_edges, resolved_edges, gc_orphans, clear_files, cache_misses, export_nodes, export_edges, node_lookup, nodes_by_kind, root_folders, neighbors_filtered, graph_counts, hubs, hubs_entities,
    hubs_parts, shortest_path, subgraph_nodes, subgraph_edges, graph_health, table_counts, modality_counts, latency_percentiles, bm25_topk, bm25_kind_filtered, bm25_phrase, graph_search, bm25_index, bm25_stemmed,
    recall_pool, recall, common_terms, vector_topk, vectors_missing, vectors_built, fact_related, fact_pairs, incremental_diff, enrich_estimate, enrich_claims, versioned_run, stream_mentions,
)


def queries() -> dict:
    out = {f.__name__: f for f in _SIMPLE}
    for name in ("email", "url", "phone", "identifier", "money"):
        out[f"entity_{name}s"] = _family(name)
    for d in ("out", "in", "both"):
        out[f"neighbors_{d}"] = _neighbors(d)
    return out


# ---------------------------------------------------------------- SQL

_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\\.[^.]+)$', 1))"
_READER = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(x) for x in e.split())})" + (f" OR {_EXT} = ''" if n == "text" else "") + f" THEN '{n}'" for n, e in S.READERS.items()) + " END"
_TOK = "regexp_extract_all(lower(coalesce(body, '')), '[\\p{L}\\p{N}]+')"


def _bm25_sql(terms: list[str], where: str = "true", extra: str = "") -> str:
    """BM25 in plain SQL; a term of several words is a phrase."""
    tf = []
    for i, t in enumerate(terms):
        words = t.split()
        if len(words) == 1:
            tf.append(f"len(list_filter(toks, lambda x: x = '{t}')) AS f{i}")
        else:
            lit = "[" + ", ".join(f"'{w}'" for w in words) + "]"
            tf.append(f"len(list_filter(range(1, greatest(len(toks) - {len(words) - 2}, 1)), lambda i: toks[i:i + {len(words) - 1}] = {lit})) AS f{i}")
    n = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END)::DOUBLE AS n{i}" for i in range(len(terms)))
    s = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(ln((N - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END" for i in range(len(terms)))
    any_ = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH d AS (SELECT id AS uid, kind, {_TOK} AS toks FROM nodes), t AS (SELECT uid, kind, len(toks)::DOUBLE AS dl, {', '.join(tf)} FROM d),
    a AS (SELECT count(*)::DOUBLE AS N, avg(dl) AS mean, {n} FROM t), s AS (SELECT uid, kind, {s} AS score FROM t, a WHERE {any_}) {extra or f"SELECT uid, round(score, 6) AS score FROM s WHERE {where} ORDER BY s.score DESC, uid LIMIT 20"}"""


#: White space as Java has it in Unicode mode, without and with line ends and separators.
_WS = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WSN = _WS + r"\n\x1C-\x1F"


def _clean_sql(c: str) -> str:
    x = rf"regexp_replace(coalesce({c}, ''), '[\x00\x{{AD}}]', '', 'g')"
    x = rf"regexp_replace({x}, '\r\n|[\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[{_WS}]+(\n|$)', '\1', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^[{_WSN}]+|[{_WSN}]+$', '', 'g')"


def _words_sql(c: str) -> str:
    noise = ", ".join("'" + w.replace("'", "''") + "'" for w in facts.NOISE)
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]+')), lambda w: len(w) > 1 AND NOT list_contains([{noise}], w))"


def _family_sql(pattern: str, value: str, group: int = 0, where: str = "true") -> str:
    return f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', {group})) AS d FROM documents WHERE length(text) >= 20) SELECT DISTINCT doc_id, {value} AS value FROM m WHERE {where}"


_T = "SELECT title AS text, min(doc_id) AS id FROM documents WHERE title IS NOT NULL GROUP BY title"
_BOTH = "SELECT src_id AS a, dst_id AS b FROM edges UNION ALL SELECT dst_id, src_id FROM edges"


def _hop_sql(direction: str) -> str:
    out = f"SELECT dst_id AS uid, kind AS edge_kind, 'out' AS direction, weight FROM edges WHERE src_id = {HOP[direction]}"
    inn = f"SELECT src_id AS uid, kind AS edge_kind, 'in' AS direction, weight FROM edges WHERE dst_id = {HOP[direction]}"
    body = {"out": out, "in": inn, "both": f"{out} UNION ALL {inn}"}[direction]
    return f"SELECT h.* FROM ({body}) h JOIN nodes n ON n.id = h.uid ORDER BY weight DESC, direction DESC, uid, edge_kind LIMIT 50"


def _profile_sql() -> str:
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    u = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS col, p_partkey AS r, trim({c}::VARCHAR) AS v FROM part" for i, c in enumerate(cols))
    num, date, cur = sheets.NUMBER, sheets.ISO_DATE, sheets.CURRENCY
    return f"""WITH u AS ({u}), h AS (SELECT * FROM u WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY position ORDER BY r) <= 200),
    t AS (SELECT position, CASE WHEN avg(regexp_matches(v, '{cur}')::INT) >= 0.9 THEN 'currency' WHEN avg(regexp_matches(v, '{date}')::INT) >= 0.9 THEN 'date' WHEN avg(regexp_matches(v, '{num}')::INT) >= 0.9 THEN 'number'
      WHEN avg((lower(v) IN ('true','false','yes','no','y','n','0','1'))::INT) >= 0.9 THEN 'boolean' ELSE 'text' END AS dtype FROM h GROUP BY position),
    f AS (SELECT position, lower(v) AS k, min(r) AS r, arg_min(v, r) AS v FROM u WHERE v <> '' GROUP BY position, lower(v)),
    s AS (SELECT position, string_agg(v[1:120], '|' ORDER BY r) AS samples FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY position ORDER BY r, k) <= 8) GROUP BY position)
    SELECT u.position, u.col AS "column", t.dtype, sum((v <> '')::INT) AS non_empty, count(DISTINCT CASE WHEN v <> '' THEN v END) AS distinct_values, s.samples FROM u JOIN t USING (position) JOIN s USING (position) GROUP BY ALL"""


def oracle_sql() -> dict:
    kinds = "SELECT kind, count(*) AS n FROM"
    seg = "SELECT uid, owner_file_id::BIGINT AS file, (props->>'$.start_time')::BIGINT AS a, (props->>'$.end_time')::BIGINT AS b FROM nodes WHERE kind = 'segment'"
    return {
        "source_dispatch": f"SELECT CASE WHEN r = 'docx' THEN 'text' ELSE coalesce(r, 'unknown') END AS modality, coalesce(r, 'none') AS reader, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT {_READER} AS r, size FROM files) GROUP BY ALL",
        "indexable_files": f"SELECT {_EXT} AS ext, count(*) AS n FROM files WHERE {_EXT} NOT IN ({', '.join(repr(x) for x in S.BINARY)}) AND size <= 1000000 GROUP BY ALL",
        "text_clean": f"SELECT doc_id, sha256({_clean_sql('text')}) AS cleaned FROM documents",
        "preview_rows": rf"WITH f AS (SELECT id, regexp_replace(regexp_replace(body, '[{_WSN}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM nodes WHERE body IS NOT NULL) SELECT id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(left(t, 79)) || '…' END AS preview FROM f",
        "graph_search": _bm25_sql(["harbour", "calibration", "md"]).replace("FROM nodes)", "FROM (SELECT id, kind, concat_ws(chr(10), nullif(body, ''), nullif(translate(name, '/_-', '   '), ''), nullif(translate(props->>'$.path', '/_', '  '), ''), nullif(translate(props->>'$.heading', '/_', '  '), ''), nullif(translate(props->>'$.title', '/_', '  '), ''), nullif(translate(props->>'$.sheet', '/_', '  '), ''), nullif(translate(props->>'$.speaker', '/_', '  '), ''), nullif(translate(props->>'$.alias', '/_', '  '), '')) AS body FROM nodes))", 1),
        "digests": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
        "identifier_parts": r"WITH w AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS w FROM chunks), p AS (SELECT id, list_filter(string_split(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '), lambda x: len(x) > 2) AS p FROM w), q AS (SELECT id, unnest(p) AS x FROM p WHERE len(p) > 1) SELECT DISTINCT id, lower(x) AS part FROM q",
        "doc_titles": r"SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^\s{0,3}#\s+(.+?)\s*$', 1))[1:200], ''), regexp_extract(path, '[^/]*$')) AS title_line FROM documents WHERE text IS NOT NULL",
        "document_nodes": r"SELECT 'doc:' || path AS uid, coalesce(title, regexp_extract(path, '[^/]*$')) AS name, sha256(concat_ws(chr(10), title, translate(path, '/_-', '   '), coalesce(text, '')[1:1000])) AS body_hash, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\.[^.]+)$', 1)) AS extension FROM documents",
        "subgraph_edges": f"WITH n AS (SELECT 1000::BIGINT AS id UNION SELECT b FROM ({_BOTH}) WHERE a = 1000) SELECT DISTINCT src_id AS src, dst_id AS dst, kind FROM edges WHERE src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n)",
        "vectors_built": "SELECT doc_id AS item, 16 AS dim FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> ''",
        "next_segments": f"WITH s AS ({seg}), l AS (SELECT lag(uid) OVER (PARTITION BY file ORDER BY a NULLS FIRST, uid) AS src, uid AS dst FROM s) SELECT * FROM l WHERE src IS NOT NULL",
        "frame_segments": f"WITH s AS ({seg}), f AS (SELECT file, max(b) * 0.5 AS at FROM s GROUP BY file) SELECT f.file, 0 AS frame, f.at, (SELECT min(a)::INT FROM s WHERE s.file IS NOT DISTINCT FROM f.file AND s.a <= f.at AND f.at <= s.b) AS ord FROM f",
        "entity_emails": _family_sql(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b", "lower(rtrim(d, '.'))"),
        "entity_identifiers": _family_sql(r"\b[A-Z][A-Z0-9]{1,9}[-_]\d{1,8}(?:[-_]\d{1,8})*\b", "lower(d)"),
        "entity_dates_iso": _family_sql(r"(?:^|[^\d-])(\d{4}-\d{2}-\d{2})(?:[^\d-]|$)", "strftime(try_cast(d AS DATE), '%Y-%m-%d')", 1, "try_cast(d AS DATE) IS NOT NULL AND year(try_cast(d AS DATE)) BETWEEN 1900 AND 2200"),
        "entity_order_dates": "SELECT o_orderkey, strftime(o_orderdate AT TIME ZONE 'UTC', '%Y-%m-%d') AS value FROM orders",
        "entity_order_money": "SELECT o_orderkey, 'USD ' || floor(o_totalprice)::BIGINT::VARCHAR AS value FROM orders",
        "cross_doc_entities": "WITH m AS (" + _family_sql(r"\b[A-Z][A-Z0-9]{1,9}[-_]\d{1,8}(?:[-_]\d{1,8})*\b", "lower(d)") + ") SELECT value, count(*) AS n_docs FROM m GROUP BY value HAVING count(*) > 1",
        "folder_tree": "WITH p AS (SELECT string_split(regexp_replace(path, '/?[^/]*$', ''), '/') AS d FROM documents), e AS (SELECT DISTINCT array_to_string(d[1:i], '/') AS path FROM (SELECT d, unnest(range(1, len(d) + 1)) AS i FROM p)) SELECT 'dir:' || path AS uid, 'dir:' || CASE WHEN regexp_replace(path, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace(path, '/?[^/]*$', '') END AS parent FROM e WHERE path <> '' UNION ALL SELECT 'dir:.', NULL",
        "column_profile": _profile_sql(),
        "sheet_rows": "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS row, l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber FROM lineitem",
        "row_chunks": "WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, p_partkey || ' | ' || p_name || ' | ' || p_brand AS l FROM part) SELECT ((r - 1) // 40)::INT AS ord, min(r) AS first_row, max(r) AS last_row, sha256('p_partkey | p_name | p_brand' || chr(10) || string_agg(l, chr(10) ORDER BY r)) AS body_hash FROM r GROUP BY (r - 1) // 40",
        "upsert_merge": """WITH c AS (SELECT uid, kind, name, coalesce(body, '') AS body, owner_file_id::BIGINT::VARCHAR AS owner, id AS seq, 'from' AS k FROM nodes UNION ALL
            SELECT 'doc:' || path, 'document', coalesce(title, path), coalesce(text, '')[1:1000], NULL, doc_id + 1000000000, 'lang' FROM documents)
            SELECT uid, arg_max(kind, seq) AS kind, arg_max(name, seq) AS name, sha256(arg_max(body, (len(body), seq))) AS body_hash, arg_max(owner, seq) FILTER (owner IS NOT NULL) AS owner, to_json(list_sort(list(DISTINCT k)))::VARCHAR AS keys FROM c GROUP BY uid""",
        "edge_merge": "SELECT src_id AS src, dst_id AS dst, kind, max(weight) AS weight, CASE WHEN bool_or(provenance = 'extracted') THEN 'extracted' ELSE arg_min(provenance, id) END AS provenance, max(id)::VARCHAR AS newest, arg_min_null(owner_file_id::BIGINT::VARCHAR, id) AS owner FROM edges WHERE src_id <> dst_id GROUP BY ALL",
        "unresolved_edges": f"{kinds} edges WHERE src_id NOT IN (SELECT id FROM nodes WHERE kind <> 'entity') OR dst_id NOT IN (SELECT id FROM nodes WHERE kind <> 'entity') GROUP BY kind",
        "resolved_edges": f"{kinds} edges WHERE src_id IN (SELECT id FROM nodes WHERE kind <> 'entity') AND dst_id IN (SELECT id FROM nodes WHERE kind <> 'entity') GROUP BY kind",
        "gc_orphans": f"WITH e AS (SELECT src_id AS x FROM edges WHERE kind <> 'mentions' UNION SELECT dst_id FROM edges WHERE kind <> 'mentions') {kinds} nodes WHERE NOT (owner_file_id IS NULL AND kind IN ('entity', 'topic') AND id NOT IN (SELECT x FROM e)) GROUP BY kind",
        "clear_files": f"{kinds} edges WHERE owner_file_id IS NULL OR owner_file_id::BIGINT NOT IN (SELECT id FROM files WHERE size = 0) GROUP BY kind",
        "cache_misses": "SELECT DISTINCT digest FROM file_scans WHERE digest IS NOT NULL AND digest NOT IN (SELECT digest FROM files WHERE digest IS NOT NULL)",
        "export_nodes": "SELECT id AS uid, kind FROM nodes ORDER BY kind, id LIMIT 500",
        "export_edges": "WITH n AS (SELECT id FROM nodes ORDER BY kind, id LIMIT 500) SELECT DISTINCT src_id AS src, dst_id AS dst, kind FROM edges WHERE src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n)",
        "node_lookup": "SELECT id AS uid, kind, name FROM nodes WHERE id = 33",
        "nodes_by_kind": "SELECT id AS uid, name FROM nodes WHERE kind = 'topic' ORDER BY name, id LIMIT 50",
        "root_folders": "SELECT id AS uid, name FROM nodes WHERE kind = 'folder' AND props->>'$.root' IS NOT NULL",
        "neighbors_out": _hop_sql("out"), "neighbors_in": _hop_sql("in"), "neighbors_both": _hop_sql("both"),
        "neighbors_filtered": "SELECT e.src_id AS uid, n.kind, e.weight FROM edges e JOIN nodes n ON n.id = e.src_id WHERE e.dst_id = 1 AND e.kind = 'mentions' AND n.kind IN ('page', 'chunk') ORDER BY e.weight DESC, uid LIMIT 25",
        "graph_counts": "SELECT 'node:' || kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge:' || kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges",
        "hubs": f"SELECT n.id AS uid, n.name, count(*) AS degree FROM ({_BOTH}) x JOIN nodes n ON n.id = x.a GROUP BY ALL ORDER BY degree DESC, n.name, n.id LIMIT 20",
        "hubs_entities": f"SELECT n.id AS uid, count(*) AS degree FROM ({_BOTH}) x JOIN nodes n ON n.id = x.a WHERE n.kind = 'entity' GROUP BY n.id, n.name ORDER BY degree DESC, n.name, n.id LIMIT 10",
        "hubs_parts": "SELECT uid, count(*) AS degree FROM (SELECT 's' || l_suppkey AS uid FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) GROUP BY uid ORDER BY degree DESC, uid LIMIT 20",
        "shortest_path": f"WITH RECURSIVE s AS ({_BOTH}), r(uid, d) AS (SELECT 1000::BIGINT, 0 UNION SELECT s.b, r.d + 1 FROM r JOIN s ON s.a = r.uid WHERE r.d < 6) SELECT min(d)::INT AS hops FROM r WHERE uid = 1500",
        "subgraph_nodes": f"WITH RECURSIVE s AS ({_BOTH}), r(uid, d) AS (SELECT 1000::BIGINT, 0 UNION SELECT s.b, r.d + 1 FROM r JOIN s ON s.a = r.uid WHERE r.d < 2) SELECT uid, min(d)::INT AS depth FROM r GROUP BY uid",
        "graph_health": """WITH m AS (SELECT e.dst_id, n.owner_file_id AS f FROM edges e JOIN nodes n ON n.id = e.src_id WHERE e.kind = 'mentions'), p AS (SELECT dst_id, count(DISTINCT f) AS files, count(*) AS n FROM m GROUP BY dst_id)
            SELECT 'entities' AS key, count(*)::DOUBLE AS value FROM nodes WHERE kind = 'entity' UNION ALL SELECT 'shared_entities', sum((files > 1)::INT)::DOUBLE FROM p UNION ALL SELECT 'mentions_per_entity', round(avg(n), 6) FROM p
            UNION ALL SELECT 'documents_without_children', count(*)::DOUBLE FROM nodes WHERE kind = 'document' AND id NOT IN (SELECT src_id FROM edges WHERE kind = 'contains')""",
        "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("sources", "files", "chunks", "nodes", "edges")),
        "modality_counts": "SELECT modality, count(*) AS n FROM documents GROUP BY modality",
        "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
        "bm25_topk": _bm25_sql(TERMS), "bm25_kind_filtered": _bm25_sql(TERMS, "kind = 'page'"), "bm25_phrase": _bm25_sql(PHRASES), "bm25_index": _bm25_sql(TERMS + PHRASES[:1]),
        "recall_pool": _bm25_sql(TERMS, extra=", p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, uid) AS r FROM s WHERE kind IN ('page', 'chunk') QUALIFY r <= 20), q AS (SELECT *, min(score) OVER (PARTITION BY kind) AS lo, max(score) OVER (PARTITION BY kind) AS hi FROM p) SELECT uid, kind, round(0.35 + 0.65 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM q"),
        "common_terms": "SELECT term, count(*) AS n_docs FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM documents) GROUP BY term ORDER BY n_docs DESC, term LIMIT 50",
        "vector_topk": "WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v::DOUBLE[]), 5) AS cosine FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v::DOUBLE[]) DESC, vec_id LIMIT 40",
        "vectors_missing": "SELECT doc_id AS item FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "fact_related": f"WITH t AS ({_T}), w AS (SELECT id, {_words_sql('text')} AS a, {_words_sql(chr(39) + 'The harbour survey of the calibration table' + chr(39))} AS b FROM t), s AS (SELECT id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END AS s FROM w) SELECT id, round(s, 6) AS similarity FROM s WHERE s >= 0.35",
        "fact_pairs": f"WITH t AS ({_T}), w AS (SELECT id, {_words_sql('text')} AS a FROM t), s AS (SELECT x.id AS left_id, y.id AS right_id, len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a) - len(list_intersect(x.a, y.a))) AS s FROM w x, w y WHERE x.id < y.id AND len(x.a) > 0 AND len(y.a) > 0) SELECT left_id, right_id, round(s, 6) AS similarity FROM s WHERE s >= 0.35",
        "incremental_diff": """WITH n AS (SELECT path, mtime, size, digest FROM file_scans WHERE run_id = 30 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, scan_id DESC) = 1), w AS (SELECT path, mtime, size, digest FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, id DESC) = 1),
            j AS (SELECT CASE WHEN w.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN n.mtime IS NOT DISTINCT FROM w.mtime AND n.size IS NOT DISTINCT FROM w.size THEN 'unchanged' WHEN n.digest = w.digest THEN 'touched' ELSE 'changed' END AS status FROM n FULL JOIN w ON n.path = w.path) SELECT status, count(*) AS n FROM j GROUP BY status""",
        "enrich_estimate": f"WITH t AS (SELECT count(*) AS passages, coalesce(sum(length(body)), 0)::DOUBLE AS chars FROM nodes WHERE kind = 'chunk' AND length(body) >= 120), u AS (SELECT *, greatest(1, passages // 12) AS batches FROM t), v AS (SELECT *, floor(chars / 4 + batches * {len(enrich.SYSTEM)} / 4)::BIGINT AS tokens_in FROM u), x AS (SELECT *, floor(tokens_in * 0.2)::BIGINT AS tokens_out FROM v) SELECT passages, batches, tokens_in, tokens_out, round(tokens_in * 3.0 / 1e6 + tokens_out * 15.0 / 1e6, 6) AS cost FROM x",
        "versioned_run": "SELECT 'insert' AS change, count(*) AS n FROM chunks UNION ALL SELECT 'delete', count(*) FROM chunks WHERE id % 3 = 1",
    }

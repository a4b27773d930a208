"""Reading the graph: neighbours, paths, subgraphs, hubs, counts, dumps, export, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


def node(nodes: DataFrame, uid: str) -> DataFrame:
    return nodes.where(F.col("uid") == uid)


def nodes_of_kind(nodes: DataFrame, kind: str, limit: int = 100) -> DataFrame:
    return nodes.where(F.col("kind") == kind).orderBy("name", "uid").limit(limit)


def neighbors(nodes: DataFrame, edges: DataFrame, uid, kinds: Sequence[str] | None = None, direction: str = "both", node_kinds: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """One hop from uid: (uid, kind, name, edge_kind, direction, weight, provenance), heaviest first, out before in, then uid. The limit comes after the filters.

    An unknown uid has no neighbours. The edge filter reaches the scan; only its matches meet the node table.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    e = edges if kinds is None else edges.where(F.col("kind").isin(list(kinds)))
    out = e.where(F.col("src") == uid).select(F.col("dst").alias("uid"), F.col("kind").alias("edge_kind"), F.lit("out").alias("direction"), "weight", "provenance")
    inn = e.where(F.col("dst") == uid).select(F.col("src").alias("uid"), F.col("kind").alias("edge_kind"), F.lit("in").alias("direction"), "weight", "provenance")
    hop = {"out": out, "in": inn, "both": out.unionByName(inn)}[direction]
    n = nodes.select("uid", "kind", "name")
    if node_kinds is not None:
        n = n.where(F.col("kind").isin(list(node_kinds)))
    res = hop.join(n, "uid")
    return res.select("uid", "kind", "name", "edge_kind", "direction", "weight", "provenance").orderBy(F.desc("weight"), F.desc("direction"), "uid", "edge_kind").limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """(uid, degree): edge rows at each node, out and in; combined before the shuffle, so a hub is no single task."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uid")).where("uid is not null")
    return ends.groupBy("uid").agg(F.count(F.lit(1)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
    n = nodes if kind is None else nodes.where(F.col("kind") == kind)
    return degrees(edges).join(n.select("uid", "kind", "name"), "uid").orderBy(F.desc("degree"), "name", "uid").limit(limit).select("uid", "kind", "name", "degree")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, n): nodes, edges, node:<kind>, edge:<kind>."""
    n = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("node:"), "kind").alias("key"), "n", F.lit("nodes").alias("t"))
    e = edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("edge:"), "kind").alias("key"), "n", F.lit("edges").alias("t"))
    both = n.unionByName(e)
    return both.select("key", "n").unionByName(both.groupBy(F.col("t").alias("key")).agg(F.sum("n").alias("n")))


def _symmetric(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null")


def _expand(both: DataFrame, frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """(uid, came): nodes first reached from frontier, each by its least predecessor. One shuffle of the edges that touch the frontier; nothing of the rest moves."""
    hop = both.join(broadcast_if_small(frontier.select(F.col("uid").alias("a"))), "a").groupBy(F.col("b").alias("uid")).agg(F.min("a").alias("came"))
    return hop.join(seen.select("uid"), "uid", "left_anti")


def shortest_path(nodes: DataFrame, edges: DataFrame, start, goal, max_depth: int = 6) -> list:
    """uids along a shortest undirected path of at most max_depth edges, start to goal; [] if there is none or an end is unknown; [start] if both are one.

    Bidirectional: the smaller frontier is expanded next. Each level is written to the shared folder together with what the other side knows of its nodes, so a lost executor costs no
    earlier level, and one small aggregate tells its size and whether the sides have met; the visited
    sets stay distributed, and only the path itself (at most max_depth + 1 rows) comes to the driver.
    """
    ends = [r["uid"] for r in nodes.where(F.col("uid").isin([start, goal])).select("uid").distinct().collect()]
    if start not in ends or goal not in ends:
        return []
    if start == goal:
        return [start]
    kind = nodes.schema["uid"].dataType
    both = _symmetric(edges)
    # A range of one row has a known size, so the first frontiers are broadcast and not the edges.
    first = lambda x: nodes.sparkSession.range(1).select(F.lit(x).cast(kind).alias("uid"), F.lit(None).cast(kind).alias("came"), F.lit(0).alias("depth"))
    seen = [first(start), first(goal)]
    front = list(seen)
    size, depth = [1, 1], [0, 0]
    for _ in range(max_depth):
        i = 0 if size[0] <= size[1] else 1
        if not size[i]:
            return []
        depth[i] += 1
        other = seen[1 - i].select("uid", F.col("depth").alias("other"))
        new = materialize(_expand(both, front[i], seen[i]).join(other, "uid", "left").withColumn("depth", F.lit(depth[i])), "frontier")
        seen[i] = seen[i].unionByName(new.drop("other"))
        got = new.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("other").isNotNull(), F.struct("other", "uid"))).alias("meet")).first()
        front[i], size[i] = new, got["n"]
        if got["meet"]:
            at = got["meet"]["uid"]
            return _walk(seen[0], at)[::-1] + _walk(seen[1], at)[1:]
    return []


def _walk(seen: DataFrame, uid) -> list:
    out, at = [], uid
    while at is not None:
        out.append(at)
        at = seen.where(F.col("uid") == at).orderBy("depth").first()["came"]
    return out


def reach(nodes: DataFrame, edges: DataFrame, start, depth: int) -> DataFrame:
    """(uid, depth): nodes within depth undirected edges of start, which must be a node."""
    seen = nodes.where(F.col("uid") == start).select("uid", F.lit(0).alias("depth")).distinct()
    both, front = _symmetric(edges), seen
    for d in range(1, depth + 1):
        new = materialize(_expand(both, front, seen).select("uid", F.lit(d).alias("depth")), "reach")
        seen, front = seen.unionByName(new), new
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, start, depth: int = 1, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth of start, nearest first, at most limit; and the edges among them."""
    near = reach(nodes, edges, start, depth).join(nodes.select("uid"), "uid", "left_semi").orderBy("depth", "uid").limit(limit)
    near = materialize(near, "subgraph")
    ids = near.select("uid")
    inside = edges.join(F.broadcast(ids.withColumnRenamed("uid", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("uid", "dst")), "dst", "left_semi")  # at most limit rows
    return near.join(nodes, "uid"), inside.select(edges.columns)


def dump_nodes(nodes: DataFrame, limit: int = 100_000) -> DataFrame:
    return nodes.orderBy("kind", "uid").limit(limit)


def dump_edges(edges: DataFrame, limit: int = 500_000) -> DataFrame:
    return edges.orderBy("src", "dst", "kind").limit(limit)


def export(nodes: DataFrame, edges: DataFrame, limit: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Node-link export: the first limit nodes by kind and uid, and the edges with both ends among them."""
    n = dump_nodes(nodes, limit)
    ids = n.select("uid")
    e = edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    return n, e.select(edges.columns)


def export_json(nodes: DataFrame, edges: DataFrame, root: str, limit: int = 5000) -> str:
    """The export as one JSON document; its size is bounded by the limit."""
    import json

    n, e = export(nodes, edges, limit)
    pick = lambda df, cols: [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*[c for c in cols if c in df.columns]))).collect()]
    return json.dumps({"version": 1, "root": root, "nodes": pick(n, ["uid", "kind", "name", "props"]), "edges": pick(e, ["src", "dst", "kind", "weight", "provenance", "label"])}, ensure_ascii=False)


def health(nodes: DataFrame, edges: DataFrame, path: Column) -> DataFrame:
    """(key, value): entities, entities in several files, mentions an entity, documents without children. path: the file of a node."""
    m = edges.where("kind = 'mentions'").select("src", "dst").join(nodes.select(F.col("uid").alias("src"), path.alias("path")), "src")
    per = m.groupBy("dst").agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("n"))
    ents = nodes.where("kind = 'entity'").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("entities").alias("key"), "value")
    shared = per.agg(F.sum(F.when(F.col("files") > 1, 1.0).otherwise(0.0)).alias("value")).select(F.lit("shared_entities").alias("key"), F.coalesce("value", F.lit(0.0)).alias("value"))
    rate = per.agg(F.round(F.avg("n"), 6).alias("value")).select(F.lit("mentions_per_entity").alias("key"), "value")
    parents = edges.where("kind = 'contains'").select(F.col("src").alias("uid")).distinct()
    bare = nodes.where("kind = 'document'").join(parents, "uid", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("documents_without_children").alias("key"), "value")
    return ents.unionByName(shared).unionByName(rate).unionByName(bare)

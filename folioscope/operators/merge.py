"""Claims to graph: merging nodes and edges by identity, resolving edges, dropping what nothing claims.

Claims are immutable rows (owner, payload, seq); nodes and edges are aggregates of them, so deleting a file is dropping its claims, and a
full rebuild and an incremental one give the same graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..session import materialize
from .skew import skew_join


def _newest(value: Column, *order: Column) -> Column:
    return F.max_by(value, F.struct(*order))


def merge_nodes(claims: DataFrame) -> DataFrame:
    """One row a uid from claims (uid, kind, name, body, props, owner, seq).

    kind and name: the newest (highest seq; ties by value). body: the longest, the newest among equals. props: key by key, the newest that has the key. owner: the newest
    that isn't null. Rows without uid are left out. Every step combines before it shuffles, so a node claimed by a third of all rows is no single task.
    """
    c = claims.where(F.col("uid").isNotNull() & (F.col("uid") != ""))
    body = F.coalesce("body", F.lit(""))
    core = c.groupBy("uid").agg(
        _newest(F.col("kind"), F.col("seq"), F.col("kind"), F.col("name")).alias("kind"),
        _newest(F.col("name"), F.col("seq"), F.col("kind"), F.col("name")).alias("name"),
        _newest(body, F.length(body), F.col("seq"), body).alias("body"),
        F.max_by("owner", F.when(F.col("owner").isNotNull(), F.struct("seq", "owner"))).alias("owner"),
    )
    pairs = c.where(F.col("props").isNotNull()).select("uid", "seq", F.explode("props").alias("k", "v"))
    one = pairs.groupBy("uid", "k").agg(F.max_by("v", F.struct("seq", "v")).alias("v"))
    props = one.groupBy("uid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return core.join(props, "uid", "left").select("uid", "kind", "name", "body", F.coalesce("props", F.create_map().cast(M.PROPS)).alias("props"), "owner")


def merge_edges(claims: DataFrame) -> DataFrame:
    """One row per (src, dst, kind): the greatest weight; provenance 'extracted' if any claim has it, else the first; the newest props; the first owner. Self-loops are left out."""
    c = claims.where((F.col("src") != F.col("dst")) & F.col("kind").isNotNull())
    prov = F.when(F.max(F.col("provenance") == "extracted"), F.lit("extracted")).otherwise(F.min_by("provenance", F.struct("seq", "provenance")))
    return c.groupBy("src", "dst", "kind").agg(
        F.max("weight").alias("weight"), prov.alias("provenance"), F.max_by(F.to_json("props"), F.struct("seq", F.to_json("props"))).alias("_p"), F.min_by("owner", F.struct("seq", "owner")).alias("owner")
    ).select("src", "dst", "kind", "weight", "provenance", F.coalesce(F.from_json("_p", "map<string,string>"), F.create_map().cast(M.PROPS)).alias("props"), "owner")


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends both exist, the dropped ones). Every edge looks up each end once; targets that hold many edges are cut into shards. The result is written once and read for both."""
    ids = nodes.select("uid").distinct()
    e = edges.join(ids.select(F.col("uid").alias("src"), F.lit(True).alias("_src")), "src", "left")
    e = materialize(skew_join(e, ids.select(F.col("uid").alias("dst"), F.lit(True).alias("_dst")), ["dst"], ["src"], how="left"), "resolved")
    whole = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    return e.where(whole).select(edges.columns), e.where(~whole).select(edges.columns)


def clear_owner(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """Claims without those of the changed owners (one column, owner). Claims without owner stay."""
    return claims.join(changed.select("owner").distinct(), "owner", "left_anti")


def collect_garbage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without ownerless entities and topics that no edge touches."""
    ends = edges.select(F.col("src").alias("uid")).union(edges.select(F.col("dst").alias("uid"))).distinct()
    loose = nodes.where(F.col("owner").isNull() & F.col("kind").isin("entity", "topic")).select("uid").join(ends, "uid", "left_anti")
    return nodes.join(loose, "uid", "left_anti")


def live_folders(paths: DataFrame) -> DataFrame:
    """(uid, path, parent) of the folders above paths (one column, path), and the root. Emptied folders are simply not among them."""
    parts = F.split(F.regexp_replace(M.norm_path(F.col("path")), "/?[^/]*$", ""), "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    each = each.where("path <> ''").select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("up"))
    root = paths.limit(0).select(F.lit("").alias("path"), F.lit(None).cast("string").alias("up")).unionByName(paths.sparkSession.createDataFrame([("", None)], "path string, up string"))
    return each.unionByName(root).select(M.folder_uid(F.col("path")).alias("uid"), "path", F.when(F.col("up").isNotNull(), M.folder_uid(F.col("up"))).alias("parent"))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of wanted (digest, producer, version, ...) that the cache has no payload for. A null digest is never cached."""
    keys = ["digest", "producer", "version"]
    return wanted.join(cache.where(F.col("payload").isNotNull()).select(*keys).distinct(), keys, "left_anti")

"""Queries of the general problems (changed records, hot keys), with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, skew
from ..session import scratch
from ..tables import table


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ok run as one commit to a versioned table of states, begun afresh here; the rows are those that the commits inserted."""
    return changes.changed_by_commits(table(spark, sf_dir, "files"), table(spark, sf_dir, "index_runs"), table(spark, sf_dir, "file_scans"), scratch(spark, "runs"))


def p2_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the whole history at once, without stored versions."""
    return changes.changed_scans(table(spark, sf_dir, "files"), table(spark, sf_dir, "index_runs"), table(spark, sf_dir, "file_scans"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_changes(spark, sf_dir).select("scan_id")


def p6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.edge_key_results(table(spark, sf_dir, "edges")).withColumns({"sum_weight": F.round("sum_weight", 4), "last_created": F.date_format("last_created", "yyyy-MM-dd HH:mm:ss.SSSSSS")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.hot_keys(table(spark, sf_dir, "edges"))


def p6_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention rows with their entity: the skewed side sharded, the entity rows copied to the shards of hot keys only; counted per entity and source kind."""
    e = table(spark, sf_dir, "edges").select("id", "src_id", "dst_id", "kind")
    n = table(spark, sf_dir, "nodes").select(F.col("id").alias("dst_id"), F.col("kind").alias("node_kind"), "uid")
    return skew.skew_join(e, n, ["dst_id"], ["src_id", "id"]).groupBy("kind", "node_kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_uid"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_changes": p2_changes, "p2_window": p2_window, "p6_found": p6_found, "p6_results": p6_results, "p6_joined": p6_joined}


_P2 = """
WITH ok AS (SELECT * FROM index_runs WHERE status = 'ok'),
base AS (
  SELECT path, digest, mtime, size FROM files f
  WHERE EXISTS (SELECT 1 FROM ok WHERE f.indexed_at BETWEEN ok.started_at AND ok.finished_at)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, id DESC) = 1),
seen AS (
  SELECT run_id, path, digest, mtime, size, scan_id FROM file_scans WHERE run_id IN (SELECT run_id FROM ok)
  QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY seen_at DESC, scan_id DESC) = 1),
al AS (SELECT 0 AS v, path, digest, mtime, size, NULL AS scan_id FROM base UNION ALL SELECT run_id, path, digest, mtime, size, scan_id FROM seen),
l AS (SELECT *, lag(v) OVER w AS pv, lag(digest) OVER w AS pd, lag(mtime) OVER w AS pm, lag(size) OVER w AS ps FROM al WINDOW w AS (PARTITION BY path ORDER BY v)),
c AS (SELECT *, CASE WHEN pv IS NULL THEN 'added' WHEN digest IS NOT NULL AND pd IS NOT NULL THEN CASE WHEN digest <> pd THEN 'changed' END
                     WHEN mtime IS DISTINCT FROM pm OR size IS DISTINCT FROM ps THEN 'changed' END AS change FROM l WHERE v > 0)
"""


def oracle_sql() -> dict:
    per_key = "SELECT dst_id, kind, count(*) AS n_rows, count(DISTINCT src_id) AS n_src, round(sum(weight), 4) AS sum_weight, strftime(max(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS last_created FROM edges GROUP BY dst_id, kind"
    return {
        "p2_found": _P2 + "SELECT scan_id FROM c WHERE change IS NOT NULL",
        "p2_window": _P2 + "SELECT v AS version, path, scan_id, change FROM c WHERE change IS NOT NULL",
        "p2_changes": _P2 + "SELECT v AS version, path, scan_id, change FROM c WHERE change IS NOT NULL",
        "p6_found": "SELECT dst_id, kind FROM edges GROUP BY dst_id, kind HAVING count(*) > (SELECT count(*) FROM edges) / 200.0",
        "p6_results": per_key,
        "p6_joined": "SELECT e.kind, n.kind AS node_kind, count(*) AS n, count(DISTINCT n.uid) AS n_uid FROM edges e JOIN nodes n ON e.dst_id = n.id GROUP BY ALL",
    }

"""Per-key results when a few keys hold most rows: fragment-replicate by load.

Keys are counted with a map-side combine. Those above a task's fair share are cut into shards in proportion to their load,
and the shards are bin-packed to tasks (longest first); the other keys are packed as buckets of keys, bucket by bucket, onto what room the shards leave. A matching side is copied only to the
shards of split keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A key above this share of a task's fair load is split. So at most tasks / SPLIT keys are split: the plan's size is bounded by the number of tasks.
SPLIT = 0.5


def key_loads(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key (null keys are keys), combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"))


#: Buckets of light keys for each task: they are packed as wholes, so the plan is bounded by the number of tasks, not of keys.
BUCKETS = 16


def pack(pieces: list[tuple[float, tuple]], tasks: int) -> list[int]:
    """The task of each (load, name): the longest first, each to the task with the least load so far."""
    heap = [(0.0, t) for t in range(tasks)]
    out = [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], str(pieces[i][1]))):
        at, t = heapq.heappop(heap)
        heapq.heappush(heap, (at + pieces[i][0], t))
        out[i] = t
    return out


class Plan:
    """Where the rows go. heavy: (key, load) of the split keys; light: load of each bucket of the other keys; total: all rows."""

    def __init__(self, heavy: list[tuple[tuple, int]], light: dict[int, int], total: int, tasks: int, split: float = SPLIT):
        self.total, self.tasks, self.heavy = total, tasks, heavy
        fair = max(1, int(total / tasks * split))
        self.shards = [(key, i, k) for key, n in heavy for k in [max(1, -(-n // fair))] for i in range(k)]
        loads = dict(heavy)
        pieces = [(loads[key] / k, (1, key, i)) for key, i, k in self.shards] + [(n, (0, b)) for b, n in sorted(light.items())]
        at = pack(pieces, tasks)
        self.shard_task, self.bucket_task = at[: len(self.shards)], dict(zip(sorted(light), at[len(self.shards) :]))


def planned(df: DataFrame, keys: Sequence[str], tasks: int, split: float = SPLIT) -> Plan:
    """Count the keys, once, and plan. One pass over df; what comes to the driver is at most tasks / split heavy keys and BUCKETS * tasks sums."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * tasks)).cast("int").alias("_b")
    loads = materialize(key_loads(df, keys).select(*keys, "load", bucket), "loads")
    per = loads.groupBy("_b").agg(F.sum("load").alias("n")).collect()
    total = sum(r["n"] for r in per)
    if not total:
        return Plan([], {}, 0, tasks, split)
    rows = loads.where(F.col("load") > F.lit(total / tasks * split)).collect()
    light = {r["_b"]: r["n"] for r in per}
    for r in rows:
        light[r["_b"]] -= r["load"]
    return Plan([(tuple(r[k] for k in keys), r["load"]) for r in rows], light, total, tasks, split)


def placed(df: DataFrame, keys: Sequence[str], by: Sequence[str], plan: Plan) -> DataFrame:
    """df with _shard and _task columns.

    Rows of a split key are spread over its shards by a hash of the columns by, so equal by-values share a shard and
    distinct counts of them add up over shards. What is broadcast has at most tasks / split rows (see SPLIT), whatever the size of df.
    """
    out = _sharded(df, keys, plan).withColumn("_shard", F.coalesce(F.pmod(F.xxhash64(*by), F.size("_tasks")).cast("int"), F.lit(0)))
    return _tasked(out, keys, plan)


def _sharded(df: DataFrame, keys: Sequence[str], plan: Plan) -> DataFrame:
    """df with _tasks: the tasks of its key's shards, null for keys that aren't split."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    per: dict[tuple, list[int]] = {}
    for (key, _, _), t in zip(plan.shards, plan.shard_task):
        per.setdefault(key, []).append(t)
    shards = df.sparkSession.createDataFrame([(*key, t) for key, t in per.items()], ", ".join(f"`_k{n}` {types[k]}" for n, k in enumerate(keys)) + ", _tasks array<int>")
    cond = F.lit(True)
    for n, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(F.col(f"_k{n}"))
    return df.join(F.broadcast(shards), cond, "left").drop(*[f"_k{n}" for n in range(len(keys))])


def _tasked(df: DataFrame, keys: Sequence[str], plan: Plan) -> DataFrame:
    """df (with _tasks, _shard) with the _task of its shard or of its key's bucket in place of _tasks."""
    light = F.split(F.lit(",".join(str(plan.bucket_task.get(b, b % plan.tasks)) for b in range(BUCKETS * plan.tasks))), ",").cast("array<int>")  # folded into one literal
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * plan.tasks)).cast("int")
    return df.withColumn("_task", F.coalesce(F.get("_tasks", F.col("_shard")), F.get(light, bucket))).drop("_tasks")


def edge_key_results(edges: DataFrame, tasks: int | None = None, plan: Plan | None = None) -> DataFrame:
    """Per (dst_id, kind): n_rows, n_src (distinct src_id), sum_weight, last_created; no task does much more than its share.

    Every row moves once, as it stands (combining repeats first would be a move of its own), to the task that the plan gives its shard; there repeats of (dst, kind, src) are combined, then the shard, which yields one row a key. The last step adds up
    a handful of rows a split key. Null keys form groups; null weights add nothing;
    null src_id is no source; an empty table gives no rows.
    """
    keys = ["dst_id", "kind"]
    tasks = tasks or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = edges.select("dst_id", "kind", "src_id", "weight", "created_at")
    part = placed(slim, keys, ["src_id"], plan or planned(slim, keys, tasks))
    moved = part.repartitionById(tasks, F.col("_task"))
    pre = moved.groupBy("_task", *keys, "_shard", "src_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.max("created_at").alias("c"))
    one = pre.groupBy("_task", *keys, "_shard").agg(F.sum("n").alias("n"), F.count("src_id").alias("s"), F.sum("w").alias("w"), F.max("c").alias("c"))
    return one.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.sum("s").alias("n_src"), F.sum("w").alias("sum_weight"), F.max("c").alias("last_created"))


def hot_keys(edges: DataFrame, share: float = 1 / 200, tasks: int | None = None) -> DataFrame:
    """(dst_id, kind) holding more than share of all rows, from the balanced per-key results."""
    keys = ["dst_id", "kind"]
    tasks = tasks or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = planned(edges.select(*keys), keys, tasks)
    return edge_key_results(edges, tasks, plan).where(F.col("n_rows") > F.lit(plan.total * share)).select(*keys)


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], tasks: int | None = None, how: str = "inner") -> DataFrame:
    """Equi-join of a skewed left side: split keys spread over shards by the spread columns, matching right rows copied to those shards only.

    Both sides move once, to the packed task of their shard, and are joined there. how: inner, left, left_semi or left_anti (right rows are copied, so the right side can't be the preserved one). Null keys match nothing.
    Columns of right that clash with left's are prefixed right_.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left, left_semi or left_anti")
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = right.select(*[F.col(k).cast(left.schema[k].dataType).alias(k) for k in keys], *[F.col(c).alias(f"right_{c}" if c in left.columns else c) for c in right.columns if c not in keys])
    plan = planned(left.select(*keys), keys, tasks)
    part = placed(left, keys, spread, plan)
    copies = _sharded(right, keys, plan).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("_tasks"), F.lit(1)) - 1)))
    copies = _tasked(copies, keys, plan)
    moved = (x.repartitionById(tasks, F.col("_task")) for x in (part, copies))
    return next(moved).join(next(moved), ["_task", *keys, "_shard"], how).drop("_task", "_shard")

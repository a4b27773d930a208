"""Filling containers of fixed capacity: global best-fit decreasing over all items, with a driver state bounded by the capacity.

Item sizes are integers up to the capacity, so all items of a size are interchangeable, and so are all open containers
with equal room. The items are therefore counted by size (one short table), best-fit decreasing runs on the counts, and
moves whole blocks of items into whole blocks of containers at once. A segment tree over remaining room finds the tightest container.
The result is the same packing as item-by-item best-fit decreasing. Each item then finds its container by its rank within its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class RoomTree:
    """Which amounts of room have open containers: smallest such amount >= a size, in logarithmic time."""

    def __init__(self, capacity: int):
        self.n = 1
        while self.n < capacity + 1:
            self.n *= 2
        self.t = [0] * (2 * self.n)

    def add(self, room: int, k: int) -> None:
        i = room + self.n
        while i:
            self.t[i] += k
            i >>= 1

    def tightest(self, size: int) -> int:
        """Smallest room >= size that some open container has; -1 if none."""
        t, i = self.t, size + self.n
        if t[i]:
            return size
        while i > 1:
            if i % 2 == 0 and t[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if t[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Blocks (size, first item, last item + 1, first container, items a container) of best-fit decreasing over counts of sizes.

    Items of a size are numbered from 0; containers too. Best fit puts an item into the tightest open container, and the next one of
    the same size into the same container while it still fits and none is tighter; a block says so for a range of containers.
    """
    tree = RoomTree(capacity)
    blocks: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of container numbers
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(room: int, a: int, b: int) -> None:
        if room and b > a:
            blocks.setdefault(room, []).append((a, b))
            tree.add(room, b - a)

    for size in sorted(counts, reverse=True):
        left, item = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, per = capacity, capacity // size
                full = left // per
                ranges = [(opened, opened + full + (1 if left % per else 0))]
                opened = ranges[0][1]
            else:
                ranges = blocks.pop(room)
                tree.add(room, -sum(b - a for a, b in ranges))
                per = room // size
            for a, b in ranges:
                k = min(b - a, left // per)  # containers filled with per items each
                if k:
                    out.append((size, item, item + k * per, a, per))
                    put(room - per * size, a, a + k)
                    item += k * per
                    left -= k * per
                    a += k
                if a < b and 0 < left < per:  # one container gets the rest
                    out.append((size, item, item + left, a, left))
                    put(room - left * size, a, a + 1)
                    item, left, a = item + left, 0, a + 1
                put(room, a, b)
    return out


#: Rows of a plan (five numbers each) that are broadcast.
PLAN_ROWS = 200_000


def pack_items(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", salts: int | None = None) -> DataFrame:
    """(id, piece, first, size, container): every item in one container; an item above the capacity is cut into pieces of the capacity and a rest.

    first is the offset of the piece within its item. Items of size null or 0 take no space: one row with size 0 and container null. Ids that
    repeat are separate items. Containers are numbered from 0; full pieces of oversized items have containers of their own after the shared ones.
    salts: parts that a size is numbered in, so that a size with many items is no single task (default: the shuffle partitions).
    """
    spark = items.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    kind = items.schema[id_col].dataType.simpleString()
    base = items.select(F.col(id_col).alias("_id"), size.alias("_n"))
    pieces = base.select(
        "_id", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_n") > 0, F.ceil(F.col("_n") / capacity)).otherwise(1) - 1)).alias("piece"), "_n",
    ).select("_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first"), F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).cast("int").alias("size"))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece"), F.lit(salts)).cast("int"))
    # One row a (size, salt): at most capacity * salts rows; the histogram has at most capacity rows.
    tally = pieces.groupBy("size", "_salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["size"]: r["n"] for r in tally.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    shared = {s: n for s, n in counts.items() if 0 < s < capacity}
    plan = best_fit_plan(shared, capacity)
    opened = max((c + -(-(b - a) // per) for _, a, b, c, per in plan), default=0)
    plan += [(capacity, 0, counts[capacity], opened, 1)] if counts.get(capacity) else []
    rows = spark.createDataFrame(plan, "size int, _a long, _b long, _c long, _per long")
    starts = tally.withColumn("_off", F.sum("n").over(Window.partitionBy("size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("size", "_salt", F.coalesce("_off", F.lit(0)).alias("_off"))
    w = Window.partitionBy("size", "_salt").orderBy("_id", "piece")
    ranked = pieces.withColumn("_rn", F.row_number().over(w) - 1).join(starts, ["size", "_salt"]).withColumn("_rank", F.col("_off") + F.col("_rn"))
    # The plan has about as many rows as there are sizes and partial fills, whatever the number of items; beyond PLAN_ROWS it isn't broadcast.
    by_size = rows.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("_a", "_b", "_c", "_per"))).alias("_plan"))
    hit = F.element_at(F.filter("_plan", lambda x: (x["_a"] <= F.col("_rank")) & (F.col("_rank") < x["_b"])), 1)
    out = ranked.join(F.broadcast(by_size) if len(plan) <= PLAN_ROWS else by_size, "size", "left").withColumn("_h", F.when(F.col("_plan").isNotNull(), hit))
    container = F.col("_h._c") + F.floor((F.col("_rank") - F.col("_h._a")) / F.col("_h._per"))
    return out.select(F.col("_id").cast(kind).alias(id_col), "piece", "first", "size", F.when(F.col("size") > 0, container).alias("container"))


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Item-by-item best-fit decreasing with the same tree: the container of each item. A plain version for tests and small inputs."""
    tree, room, by_room, at = RoomTree(capacity), [], {}, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        r = tree.tightest(sizes[i])
        if r < 0:
            c = len(room)
            room.append(capacity)
        else:
            c = by_room[r].pop()
            tree.add(r, -1)
        at[i] = c
        room[c] -= sizes[i]
        if room[c]:
            by_room.setdefault(room[c], []).append(c)
            tree.add(room[c], 1)
    return at

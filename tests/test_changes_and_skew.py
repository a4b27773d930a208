from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.operators import changes, skew

T0 = datetime(2025, 1, 1)
FILES = "id long, source_id int, path string, mtime timestamp, size long, digest string, indexed_at timestamp, run_id int"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"
SCANS = "scan_id long, run_id int, source_id int, path string, mtime timestamp, size long, digest string, seen_at timestamp"


def at(h):
    return T0 + timedelta(hours=h)


def found(spark, files, runs, scans):
    from folioscope.session import scratch

    tables = spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(scans, SCANS)
    rows = lambda out: sorted((r["version"], r["path"], r["scan_id"], r["change"]) for r in out.collect())
    at = scratch(spark, "runs")
    got = rows(changes.changed_by_commits(*tables, at))
    assert got == rows(changes.changed_scans(*tables)) and got == rows(changes.changed_by_commits(*tables, at))
    return got


def test_runs_that_come_later_and_a_crash_between_commits(spark, tmp_path, monkeypatch):
    runs = [(1, at(0), at(1), "ok"), *[(r, at(10 + r), at(11 + r), "ok") for r in (25, 26, 27)]]
    files = spark.createDataFrame([(1, 1, "a", at(0), 1, "x", at(0.5), 1), (2, 1, None, at(0), 1, "n", at(0.6), 1)], FILES)
    scans = [(1, 25, 1, "a", at(0), 1, None, at(36)), (2, 26, 1, "a", at(0), 1, "y", at(37)), (3, 26, 1, "b", at(0), 1, "b", at(37)), (4, 27, 1, "b", at(0), 1, "c", at(38)), (5, 27, 1, None, at(0), 1, "m", at(38))]
    root = f"file://{tmp_path}/r"
    runs_df = lambda n: spark.createDataFrame(runs[:n], RUNS)
    scans_df = spark.createDataFrame(scans, SCANS)
    rows = lambda d: sorted((r["version"], r["scan_id"], r["change"]) for r in d.collect())
    assert rows(changes.changed_by_commits(files, runs_df(2), scans_df, root)) == []
    real = changes.VersionedTable.commit
    for at_step in ("before", "after"):  # the driver dies before or after the commit of run 26 (then 27)
        calls = []

        def dying(self, *a, **k):
            calls.append(1)
            if at_step == "before":
                raise RuntimeError("lost")
            real(self, *a, **k)
            raise RuntimeError("lost")

        monkeypatch.setattr(changes.VersionedTable, "commit", dying)
        with pytest.raises(RuntimeError):
            changes.changed_by_commits(files, runs_df(4), scans_df, root)
        monkeypatch.setattr(changes.VersionedTable, "commit", real)
        assert len(calls) == 1
    got = rows(changes.changed_by_commits(files, runs_df(4), scans_df, root))
    assert got == rows(changes.changed_scans(files, runs_df(4), scans_df)) == [(26, 3, "added"), (27, 4, "changed"), (27, 5, "changed")]


def test_one_of_two_consumers_commits(spark, tmp_path):
    src, dst = (changes.VersionedTable(spark, f"file://{tmp_path}/{n}", "id") for n in ("src", "dst"))
    src.commit(spark.createDataFrame([(1,), (2,)], "id int"))

    def while_another_runs(d):
        changes.process_changes(src, dst, lambda x: x)
        return d

    with pytest.raises(changes.Conflict):
        changes.process_changes(src, dst, while_another_runs)
    assert changes.process_changes(src, dst, lambda d: d) is None
    dst.commit(spark.createDataFrame([(9, "insert")], "id int, _change string"))  # somebody else's rows keep the note
    assert changes.process_changes(src, dst, lambda d: d) is None
    assert sorted(r["id"] for r in dst.read().collect()) == [1, 2, 9]
    src.commit(None, spark.createDataFrame([(1,)], "id int"))
    src.commit(spark.createDataFrame([(1,), (3,)], "id int"))  # a key comes back after its deletion
    assert sorted(r["id"] for r in src.read().collect()) == [1, 2, 3]
    assert sorted((r["id"], r["_change"]) for r in src.delta(1).collect()) == [(1, "delete"), (1, "insert"), (3, "insert")]


def test_runs_see_what_is_new_or_changed_since_the_last_success(spark):
    runs = [(1, at(0), at(1), "ok"), (2, at(2), at(3), "failed"), (25, at(10), at(11), "ok"), (26, at(12), None, "killed"), (27, at(14), at(15), "ok")]
    files = [
        (1, 1, "a", at(0), 1, "x", at(0.5), 9), (2, 1, "a", at(0), 1, "y", at(2.5), 9),  # the second was left by a failed run
        (3, 1, "b", at(0), 1, None, at(0.5), 9), (4, 1, "c", at(0), 1, "c", None, 9),
    ]
    scans = [
        (1, 25, 1, "a", at(5), 2, "x", at(10.1)),  # same digest: no case though time and size differ
        (2, 25, 1, "b", at(0), 1, "z", at(10.1)),  # a null digest: time and size decide
        (3, 25, 1, "c", at(0), 1, "c", at(10.2)),  # no counting record: new
        (4, 25, 1, "d", at(0), 1, "1", at(10.1)), (5, 25, 1, "d", at(0), 1, "2", at(10.2)),  # seen twice: the later holds
        (6, 26, 1, "a", at(0), 1, "q", at(12.1)),  # a killed run counts for nothing
        (7, 27, 1, "a", at(6), 1, "q", at(14.1)), (8, 27, 1, "d", at(0), 1, "2", at(14.1)), (9, 27, 1, "b", at(1), 1, None, at(16)),
    ]
    assert found(spark, files, runs, scans) == [(25, "c", 3, "added"), (25, "d", 5, "added"), (27, "a", 7, "changed"), (27, "b", 9, "changed")]


def test_empty_tables_give_nothing(spark):
    assert found(spark, [], [], []) == []


def test_versioned_table_runs_exactly_once(spark, tmp_path):
    src, dst = (changes.VersionedTable(spark, f"file://{tmp_path}/{n}", "id") for n in ("src", "dst"))
    rows = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, v string")
    src.commit(rows([1, 2, 3]))
    assert changes.process_changes(src, dst, lambda d: d) == 1
    src.commit(rows([4]), rows([2]))
    with pytest.raises(RuntimeError):  # a run that fails after some work commits neither output nor version
        changes.process_changes(src, dst, lambda d: (_ for _ in ()).throw(RuntimeError("lost")))
    assert changes.process_changes(src, dst, lambda d: d) == 2
    assert changes.process_changes(src, dst, lambda d: d) is None
    got = sorted((r["id"], r["_change"]) for r in dst.read().collect())
    assert got == [(1, "insert"), (2, "delete"), (2, "insert"), (3, "insert"), (4, "insert")]
    assert sorted(r["id"] for r in src.read().collect()) == [1, 3, 4] and sorted(r["id"] for r in src.read(1).collect()) == [1, 2, 3]


def test_listing_classes(spark):
    cols = "path string, mtime long, size long, digest string"
    now = spark.createDataFrame([("n", 1, 1, "a"), ("u", 1, 1, None), ("t", 2, 1, "a"), ("c", 2, 1, "b")], cols)
    was = spark.createDataFrame([("u", 1, 1, "x"), ("t", 1, 1, "a"), ("c", 1, 1, "a"), ("r", 1, 1, "a")], cols)
    got = {r["path"]: r["status"] for r in changes.classify_listing(now, was).collect()}
    assert got == {"n": "new", "u": "unchanged", "t": "touched", "c": "changed", "r": "removed"}


def edges(spark, rows):
    return spark.createDataFrame(rows, "id long, src_id long, dst_id long, kind string, weight double, created_at timestamp, _shard string")


def test_per_key_results_match_a_plain_aggregate_under_skew(spark):
    rows = [(i, i % 7, 1 if i % 3 else i % 11, None if i % 17 == 0 else "m", None if i % 5 == 0 else float(i % 4), at(i % 50), "x") for i in range(3000)]
    rows += [(1, None, None, None, None, None, None)] * 3
    e = edges(spark, rows)
    got = {(r["dst_id"], r["kind"]): (r["n_rows"], r["n_src"], r["sum_weight"], r["last_created"]) for r in skew.edge_key_results(e, 8).collect()}
    want = {(r["dst_id"], r["kind"]): (r["a"], r["b"], r["c"], r["d"]) for r in e.groupBy("dst_id", "kind").agg(F.count(F.lit(1)).alias("a"), F.count_distinct("src_id").alias("b"), F.sum("weight").alias("c"), F.max("created_at").alias("d")).collect()}
    assert got == want


def test_empty_edges(spark):
    assert skew.edge_key_results(edges(spark, []), 4).collect() == [] and skew.hot_keys(edges(spark, [])).collect() == []


def test_no_task_gets_much_more_than_its_share(spark):
    """One key with a third of the rows, two buckets of light keys that a hash would put together, null keys: the planned loads and the rows that arrive."""
    plan = skew.Plan([((1,), 700), ((2,), 90)], {0: 100, 16: 100, 5: 10}, 1000, 10)
    per = dict.fromkeys(range(10), 0.0)
    for (key, _, k), t in zip(plan.shards, plan.shard_task):
        per[t] += dict(plan.heavy)[key] / k
    for b, t in plan.bucket_task.items():
        per[t] += {0: 100, 16: 100, 5: 10}[b]
    assert max(per.values()) <= 120 and sum(per.values()) == pytest.approx(1000)
    e = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 500).alias("k"), "id")
    part = skew.placed(e, ["k"], ["id"], skew.planned(e, ["k"], 8))
    arrived = [r["count"] for r in part.repartitionById(8, F.col("_task")).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(arrived) == 8 and max(arrived) <= 1.3 * 30_000 / 8


def test_rows_move_once(spark):
    e = edges(spark, [(i, i % 7, i % 3, "m", 1.0, None, "x") for i in range(100)])
    plan = skew.edge_key_results(e, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 2  # the rows, then the shards' sums


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, how):
    left = spark.createDataFrame([(1 if i % 2 else i, i, "l") for i in range(400)] + [(None, 0, "l")], "k int, i int, v string")
    right = spark.createDataFrame([(i, "r") for i in range(0, 300, 3)] + [(1, "again"), (None, "r")], "k int, v string")
    got = sorted(map(str, skew.skew_join(left, right, ["k"], ["i"], 8, how).collect()))
    want = sorted(map(str, left.join(right.withColumnRenamed("v", "right_v"), "k", how).collect()))
    assert got == want

"""Processing only new or changed records: diffs of immutable table versions, and a versioned table with exactly-once runs.

A table version is described by a manifest: the set of entries it holds, each with a key and a fingerprint. Two manifests
are diffed into added, removed and changed entries; only those are processed. VersionedTable keeps its manifests as
immutable JSON files beside immutable Parquet files and deletion vectors; a consumer stores the version it has processed
in the same commit as its output, so a crash before the commit leaves neither, and one after it leaves both. process_runs()
does that for index runs: one commit a run, holding the new states, the deletion vector of the old ones and the run's number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from ..storage import Folder, Versions


# ---------------------------------------------------------------- manifests as DataFrames


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per keys: the one with the greatest order columns (nulls lowest). Combines before the shuffle, so a key with many rows costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    key = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), key).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def state_differs(a: str, b: str) -> Column:
    """Whether two fingerprints (structs of digest, mtime, size) differ: by digest; without one on either side, by mtime or size."""
    da, db = F.col(f"{a}.digest"), F.col(f"{b}.digest")
    by_meta = ~(F.col(f"{a}.mtime").eqNullSafe(F.col(f"{b}.mtime")) & F.col(f"{a}.size").eqNullSafe(F.col(f"{b}.size")))
    return F.when(da.isNotNull() & db.isNotNull(), da != db).otherwise(by_meta)


def manifest_deltas(entries: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    """Every entry that is new or changed against the last version that held its key.

    entries: one row per (key, version) with a struct column state(digest, mtime, size). A version that lacks a key leaves its
    state as it was. Adds change: 'added' or 'changed'; unchanged entries are dropped. Null keys are one key like any other.
    A key has at most one row a version, so no window holds more rows than there are versions.
    """
    w = Window.partitionBy(key).orderBy(version)
    return (
        entries.withColumn("_before", F.lag("state").over(w))
        .where(F.col("_before").isNull() | state_differs("_before", "state"))
        .withColumn("change", F.when(F.col("_before").isNull(), "added").otherwise("changed"))
        .drop("_before")
    )


def run_manifests(files: DataFrame, runs: DataFrame, scans: DataFrame) -> DataFrame:
    """Manifest entries (version, path, scan_id, state) of the recorded files (version 0) and of each successful run in scans.

    A files row counts only if indexed_at lies within an ok run; the latest indexed_at (then the highest id) holds for a path.
    In a run, the row of a path with the latest seen_at (then the highest scan_id) holds. Failed and killed runs write no version.
    runs is the run log, a few rows a day, and joins by day and interval: it is broadcast only below a checked size.
    """
    state = F.struct("digest", "mtime", "size").alias("state")
    ok = runs.where(F.col("status") == "ok")
    spans = ok.where(F.col("finished_at").isNotNull()).select("started_at", "finished_at")
    base = files.select("path", "mtime", "size", "digest", "indexed_at", F.col("id").alias("scan_id"))
    # By day first, so that a row meets only the runs of its day; a run's days are as many as it lasts.
    days = spans.where("finished_at >= started_at").withColumn("_day", F.explode(F.sequence(F.to_date("started_at"), F.to_date("finished_at"))))
    base = base.withColumn("_day", F.to_date("indexed_at")).alias("f")
    within = (F.col("f._day") == F.col("r._day")) & (F.col("f.indexed_at") >= F.col("r.started_at")) & (F.col("f.indexed_at") <= F.col("r.finished_at"))
    base = base.join(broadcast_if_small(days).alias("r"), within, "left_semi").drop("_day")
    base = latest_per(base, ["path"], ["indexed_at", "scan_id"]).select(F.lit(0).alias("version"), "path", F.lit(None).cast("long").alias("scan_id"), state)
    seen = scans.join(ok.select("run_id"), "run_id", "left_semi").select("run_id", "path", "mtime", "size", "digest", "seen_at", "scan_id")
    seen = latest_per(seen, ["run_id", "path"], ["seen_at", "scan_id"]).select(F.col("run_id").alias("version"), "path", "scan_id", state)
    return base.unionByName(seen)


def changed_scans(files: DataFrame, runs: DataFrame, scans: DataFrame) -> DataFrame:
    """The scan rows that a run must process: new or changed since the last successful run that saw the path.

    Columns: version (run_id), path, scan_id, change. Empty inputs give no rows; rows with a null run_id belong to no run.
    """
    return manifest_deltas(run_manifests(files, runs, scans)).where(F.col("version") > 0).select("version", "path", "scan_id", "change")


def classify_listing(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Full outer diff of a fresh listing with the recorded files: path, status (new, changed, touched, unchanged, removed).

    Both have path, mtime, size, digest. Equal mtime and size: unchanged; else equal digest: touched; else changed.
    """
    a = listing.select("path", F.struct("mtime", "size", "digest").alias("now"))
    b = known.select("path", F.struct("mtime", "size", "digest").alias("was"))
    same = F.col("now.mtime").eqNullSafe(F.col("was.mtime")) & F.col("now.size").eqNullSafe(F.col("was.size"))
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(same, "unchanged")
        .when(F.col("now.digest") == F.col("was.digest"), "touched").otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


# ---------------------------------------------------------------- a versioned table on any Hadoop file system


class Conflict(RuntimeError):
    """Another writer committed something that this commit was not made for."""


def live_rows(spark: SparkSession, root: str, key: str, files: Sequence[str], dvs: Sequence[str]) -> DataFrame:
    """Rows of files (data/<32 hex digits>, below root) without those of the deletion vectors, with _file: one scan and at most one join, however many there are."""
    df = spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{f}" for f in files])
    df = df.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), "(data/[0-9a-f]{32})/", 1))
    if not dvs:
        return df
    gone = spark.read.parquet(*[f"{root}/{d}" for d in dvs]).select(F.col(key).alias("_k"), F.col("_file").alias("_f"))
    return df.join(gone, df[key].eqNullSafe(gone["_k"]) & (df["_file"] == gone["_f"]), "left_anti")


class VersionedTable:
    """Immutable Parquet files plus one manifest a version; deletes are deletion vectors, not rewrites.

    root/data/*            Parquet directories, never changed
    root/dv/*              deletion vectors: (key, file) of deleted rows, never changed
    root/versions/N.json   {"version", "files": [...], "dvs": [...], "info": {...}}, made once (see storage.Folder.create)
    What a version notes under info is carried on to the next ones, key by key.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._versions = Versions(Folder(spark, self.root), "versions")

    # -- manifests
    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return self._versions.head()

    def manifest(self, version: int) -> dict:
        return self._versions.read(version) if version else {"version": 0, "files": [], "dvs": [], "info": {}}

    # -- writing
    def commit(self, added: DataFrame | None = None, deleted_keys: DataFrame | None = None, info: dict | None = None, expected: int | None = None, vectors: DataFrame | None = None) -> int:
        """Write added rows and a deletion vector, then publish them as one version; gives its number.

        deleted_keys: keys whose rows, of those in the table before this commit, are deleted; vectors: the same as (key, _file), already located. expected: the version that the
        rows were made from; if another one is in force by the time of publishing, nothing is published and Conflict is raised. Without expected, a commit that only adds rows
        goes on top of whatever is in force.
        """
        head = self.manifest(self.version() if expected is None else expected)
        files, dvs = [], []
        if deleted_keys is not None and head["files"]:
            now = self._raw(head["files"], head["dvs"]).select(self.key, "_file")
            vectors = now.join(deleted_keys.select(self.key).distinct(), self.key, "left_semi")
        if vectors is not None:
            dvs.append(f"dv/{uuid.uuid4().hex}")
            vectors.select(self.key, "_file").write.parquet(f"{self.root}/{dvs[0]}")
        if added is not None:
            files.append(f"data/{uuid.uuid4().hex}")
            added.write.parquet(f"{self.root}/{files[0]}")
        while True:
            n = head["version"] + 1
            entry = {"version": n, "files": head["files"] + files, "dvs": head["dvs"] + dvs, "info": {**head["info"], **(info or {})}}
            if self.version() < n and self._versions.take(n, entry):
                return n
            if expected is not None or dvs:
                raise Conflict(f"version {n} was taken by another writer; start again from the new head")
            head = self.manifest(self.version())

    # -- reading
    def _raw(self, files: list[str], dvs: list[str]) -> DataFrame:
        return live_rows(self.spark, self.root, self.key, files, dvs)

    def read(self, version: int | None = None, files: bool = False) -> DataFrame | None:
        """The rows of a version; with files, also _file, which a deletion vector names."""
        m = self.manifest(self.version() if version is None else version)
        if not m["files"]:
            return None
        df = self._raw(m["files"], m["dvs"])
        return df if files else df.drop("_file")

    def delta(self, since: int, until: int | None = None) -> DataFrame | None:
        """Rows inserted or deleted between two versions, with _change; reads only files and vectors that one manifest has and the other has not."""
        a, b = self.manifest(since), self.manifest(self.version() if until is None else until)
        new_files = [f for f in b["files"] if f not in set(a["files"])]
        gone_files = [f for f in a["files"] if f not in set(b["files"])]
        new_dvs = [d for d in b["dvs"] if d not in set(a["dvs"])]
        parts = []
        if new_files:
            parts.append(self._raw(new_files, new_dvs).withColumn("_change", F.lit("insert")))
        if gone_files:
            parts.append(self._raw(gone_files, a["dvs"]).withColumn("_change", F.lit("delete")))
        kept = [f for f in a["files"] if f in set(b["files"])]
        if new_dvs and kept:
            dv = self.spark.read.parquet(*[f"{self.root}/{d}" for d in new_dvs]).distinct()
            parts.append(self._raw(kept, a["dvs"]).join(dv, [self.key, "_file"], "left_semi").withColumn("_change", F.lit("delete")))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out.drop("_file")


def process_changes(source: VersionedTable, sink: VersionedTable, fn: Callable[[DataFrame], DataFrame]) -> int | None:
    """Run fn over what changed in source since the version noted in the sink, and commit output and version together.

    Returns the source version now processed, or None if there was nothing to do. After a crash at any point the next call starts from the same noted version: output that
    was written but not committed is in no manifest and is never read. Of two consumers at once one commits; the other raises Conflict and finds nothing left when it
    starts again. Other commits to the sink leave the note as it is.
    """
    at = sink.version()
    noted = sink.manifest(at)["info"].get("processed", {})
    done, head = noted.get(source.root, 0), source.version()
    if head == done:
        return None
    delta = source.delta(done, head)
    sink.commit(None if delta is None else fn(delta), info={"processed": {**noted, source.root: head}}, expected=at)
    return head


# ---------------------------------------------------------------- runs as versions of a table of states

STATES = "path string, digest string, mtime timestamp, size long, scan_id long, version int, change string"


def store_manifests(entries: DataFrame, root: str) -> list[int]:
    """Write the manifest of every version below root, one folder each, in one pass over entries; gives the versions in order. There is one version a run, so few."""
    entries.select("version", "path", "scan_id", "state").write.partitionBy("version").parquet(root)
    return sorted(int(n.split("=")[1]) for n in Folder(entries.sparkSession, root).names("") if n.startswith("version="))


def process_runs(states: VersionedTable, manifests: str, versions: Sequence[int]) -> None:
    """Bring the table of states up to date, one commit a run, from the first run after the one noted in the newest commit.

    Of a run only its own manifest and the states in force are read. A path with another fingerprint than its state gets a new row (change 'added', 'changed', or null where
    the states don't count as different), and its former row goes into the deletion vector of the same commit, which also notes the run. A crash leaves the last commit in
    force, and the next call goes on from there; a run without rows commits its note only.
    """
    spark = states.spark
    for v in versions:
        at = states.version()
        if states.manifest(at)["info"].get("run", -1) >= v:
            continue
        now = spark.read.parquet(f"{manifests}/version={v}").select("path", "scan_id", "state")
        was = states.read(at, files=True)
        if was is None:
            new = now.select("path", "state.*", "scan_id", F.lit(v).alias("version"), F.lit("added").alias("change"))
            states.commit(new, info={"run": v}, expected=at)
            continue
        was = was.select(F.col("path").alias("_path"), F.struct("digest", "mtime", "size").alias("_before"), "_file")
        step = now.join(was, F.col("path").eqNullSafe(F.col("_path")), "left").where(F.col("_file").isNull() | ~F.col("state").eqNullSafe(F.col("_before")))
        change = F.when(F.col("_file").isNull(), "added").when(state_differs("_before", "state"), "changed")
        step = materialize(step.select("path", "state.*", "scan_id", F.lit(v).alias("version"), change.alias("change"), "_file"), "step")
        states.commit(step.drop("_file"), info={"run": v}, expected=at, vectors=step.where("_file is not null").select("path", "_file"))


def run_deltas(states: VersionedTable) -> DataFrame | None:
    """(version, path, scan_id, change) of all committed runs: the rows that each commit inserted as new or changed, from the files of the commits alone."""
    files = states.manifest(states.version())["files"]
    if not files:
        return None
    return states.spark.read.parquet(*[f"{states.root}/{f}" for f in files]).where("change is not null").select("version", "path", "scan_id", "change")


def changed_by_commits(files: DataFrame, runs: DataFrame, scans: DataFrame, root: str) -> DataFrame:
    """changed_scans() through stored manifests: every ok run is one commit to a table of states below root, and the rows are those that the commits inserted.

    Called again with the same root it processes only runs that came since. A manifest is written once; of a later call only runs without one are written.
    """
    spark = files.sparkSession
    states = VersionedTable(spark, f"{root}/states", "path")
    entries = run_manifests(files, runs, scans)
    folder = Folder(spark, root)
    noted = states.manifest(states.version())["info"].get("run", -1)
    if noted >= 0:
        entries = entries.where(F.col("version") > noted)
    batch = f"manifests/{uuid.uuid4().hex}"
    process_runs(states, f"{root}/{batch}", store_manifests(entries, f"{root}/{batch}"))
    folder.remove(batch)  # the states and deletion vectors hold what later runs need
    out = run_deltas(states)
    return (out if out is not None else changed_scans(files, runs, scans).limit(0)).where(F.col("version") > 0)

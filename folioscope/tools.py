"""The query surface for other programs: one plain function a tool, JSON-ready results, over a graph store and a memory folder."""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import enrich, graph, search, vectors
from .operators import facts as K
from .operators.agent import RESULTS, STEPS, GraphAgent
from .operators.changes import Conflict, VersionedTable
from .plans.build import GraphStore, build, derive, index
from .session import materialize
from .storage import Folder, Versions

STATE = ".folioscope"


def find_root(start: str | None = None) -> Path:
    """FOLIOSCOPE_PROJECT, else the nearest folder upwards with a store or a .git, else the start itself."""
    if os.environ.get("FOLIOSCOPE_PROJECT"):
        return Path(os.environ["FOLIOSCOPE_PROJECT"]).resolve()
    at = Path(start or os.getcwd()).resolve()
    return next((p for p in (at, *at.parents) if (p / STATE).exists() or (p / ".git").exists()), at)


def global_home() -> Path:
    return Path(os.environ.get("FOLIOSCOPE_HOME", Path.home() / STATE))


def resolve_scope(scope: str | None, root: Path | None) -> str:
    """project where there is a project, else global; an explicit scope holds."""
    if scope not in (None, "project", "global"):
        raise ValueError("scope must be project or global")
    return scope or ("project" if root is not None and (root / STATE).exists() else "global")


class Tools:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, find_root(root)
        self.graph_store = GraphStore(spark, f"file://{self.root}/{STATE}/graph")
        self.index_store = GraphStore(spark, f"file://{self.root}/{STATE}/index")

    # -- memory
    def _facts_path(self, scope: str) -> str:
        return f"file://{(self.root / STATE) if scope == 'project' else global_home()}/facts"

    def _table(self, scope: str) -> VersionedTable:
        return VersionedTable(self.spark, self._facts_path(scope), "id")

    def _facts(self):
        """The facts of both scopes as they stand in their newest versions."""
        out = self.spark.createDataFrame([], K.FACTS)
        for scope in ("project", "global"):
            rows = self._table(scope).read()
            out = out if rows is None else out.unionByName(rows.where(F.col("scope") == scope).select(out.columns))
        return out

    def _save(self, df, scope: str) -> None:
        """Commit what is new or other in df, and a deletion vector of what isn't there any more; of two writers at once one gets Conflict."""
        t = self._table(scope)
        at = t.version()
        new = df.where(F.col("scope") == scope)
        old = t.read(at)
        if old is None:
            t.commit(materialize(new, "facts"), expected=at)
            return
        old = old.where(F.col("scope") == scope).select(new.columns)
        added = materialize(new.exceptAll(old), "facts")
        t.commit(added, materialize(old.exceptAll(new).select("id").distinct(), "facts"), expected=at)

    def remember(self, text: str, tags: list[str] | None = None, pin: bool = False, scope: str | None = None) -> dict:
        s = resolve_scope(scope, self.root)
        out, what = K.remember(self._facts(), text, tags or [], pin, s)
        self._save(out, s)
        return what

    def facts(self, tag: str | None = None) -> list[dict]:
        return [r.asDict() for r in K.listing(self._facts(), tag).collect()]

    def forget(self, fact_id: int, scope: str | None = None) -> dict:
        s = resolve_scope(scope, self.root)
        self._save(K.forget(self._facts(), fact_id, s), s)
        return {"forgotten": fact_id}

    def pin(self, fact_id: int, pinned: bool = True, scope: str | None = None) -> dict:
        s = resolve_scope(scope, self.root)
        self._save(K.pin(self._facts(), fact_id, pinned), s)
        return {"id": fact_id, "pinned": pinned}

    def index(self) -> dict:
        """Bring the chunk index of the root up to date, and of the folders that were added as sources."""
        out: dict = {}
        for path in self._source_paths():
            out[path] = vars(index(self.spark, path, self._index_of(path)))
        return out[str(self.root)] if len(out) == 1 else out

    # -- sources: the root, and folders added to it; each has its own index, so one can be dropped without touching the others
    def _index_of(self, path: str) -> GraphStore:
        return self.index_store if path == str(self.root) else GraphStore(self.spark, f"file://{self.root}/{STATE}/sources/{hashlib.sha256(path.encode()).hexdigest()[:16]}")

    def _registered(self) -> Versions:
        return Versions(Folder(self.spark, f"file://{self.root}/{STATE}"), "registered")

    def _source_paths(self) -> list[str]:
        r = self._registered()
        return [str(self.root), *(r.read(r.head())["paths"] if r.head() else [])]

    def add_source(self, path: str) -> dict:
        """Register a folder and index it."""
        path = str(Path(path).resolve())
        if not os.path.isdir(path):
            raise ValueError(f"{path} is not a folder")
        r, paths = self._registered(), self._source_paths()
        if path not in paths and not r.take(r.head() + 1, {"paths": [*paths[1:], path]}):
            raise Conflict("another writer changed the sources; try again")
        return vars(index(self.spark, path, self._index_of(path)))

    def sources(self, remove: str | None = None) -> list[dict]:
        """The indexed folders with their numbers of files and chunks; with remove, that folder is first dropped with its chunks. The root can't be dropped."""
        r, paths = self._registered(), self._source_paths()
        if remove is not None:
            path = str(Path(remove).resolve())
            if path not in paths[1:]:
                raise ValueError(f"{path} is no added source")
            if not r.take(r.head() + 1, {"paths": [p for p in paths[1:] if p != path]}):
                raise Conflict("another writer changed the sources; try again")
            Folder(self.spark, self._index_of(path).root).remove("")
            paths.remove(path)
        out = []
        for p in paths:
            s = self._index_of(p)
            have = s.current() is not None
            seen = s.read("manifest", "").agg(F.count(F.lit(1)), F.max("indexed_at")).first() if have else (0, None)
            out.append({"path": p, "files": seen[0], "chunks": s.read("chunks", "").count() if have else 0, "last_indexed_at": seen[1]})
        return out

    def _chunks(self):
        """Chunks of every indexed source, and the hits of their indexes for terms."""
        chunks = self.spark.createDataFrame([], "scope string, id long, path string, start_line int, text string, search_body string")
        stores = [(p, self._index_of(p)) for p in self._source_paths()]
        stores = [(p, s) for p, s in stores if s.current()]
        for path, s in stores:
            shown = F.col("path") if path == str(self.root) else F.concat(F.lit(path + "/"), F.col("path"))
            ident = F.xxhash64("path", "ord") if path == str(self.root) else F.xxhash64(F.lit(path), F.xxhash64("path", "ord"))
            chunks = chunks.unionByName(s.read("chunks", "").select(F.lit("project").alias("scope"), ident.alias("id"), shown.alias("path"), "start_line", "text", "search_body"))

        def hits(terms: list[str]):
            out = self.spark.createDataFrame([], "id long, score double")
            for path, s in stores:
                h = s.text_index().search(terms)
                out = out.unionByName(h if path == str(self.root) else h.select(F.xxhash64(F.lit(path), "id").alias("id"), "score"))
            return out

        return chunks, hits

    def status(self) -> dict:
        chunks = self.index_store.current() and self.index_store.read("chunks", "").count()
        vectors = self._vectors()
        return {"root": str(self.root), "sources": len(self._source_paths()), "chunks": chunks or 0, "facts": self._facts().count(), "vectors": vectors.count() if vectors is not None else 0, "graph": self.graph_store.current()}

    # -- vectors
    def _vectors(self):
        return VersionedTable(self.spark, f"file://{self.root}/{STATE}/vectors", "item").read()

    def _items(self):
        c = self._chunks()[0].select(F.lit("chunk").alias("kind"), F.col("id").alias("item"), "text")
        return c.unionByName(self._facts().select(F.lit("fact").alias("kind"), F.col("id").alias("item"), "text"))

    def embed(self, embedder=None, model: str = "hash-64") -> dict:
        """Vectors of chunks and facts that have none of this model; without an embedder, the model-free hashing one."""
        t = VersionedTable(self.spark, f"file://{self.root}/{STATE}/vectors", "item")
        at = t.version()
        have = t.read(at)
        have = have if have is not None else self.spark.createDataFrame([], "kind string, item long, model string, dim int, vec array<float>")
        new = materialize(vectors.build(self._items(), have, model, embedder or vectors.hashing_embedder()), "vectors")
        n = new.count()
        if n:
            t.commit(new, expected=at)
        return {"model": model, "embedded": n}

    def recall(self, query: str, k: int = 8, semantic: bool = False, embedder=None, model: str = "hash-64", scopes=("project", "global"), kinds=("fact", "chunk"), pinned: bool = True, track: bool = True) -> list[dict]:
        """The best facts and chunks; with semantic, cosines of the model's vectors are blended in. The facts among them are counted as hits."""
        chunks, hits = self._chunks()
        facts, near = self._facts(), None
        have = self._vectors() if semantic else None
        if have is not None:
            q = (embedder or vectors.hashing_embedder())([query])[0]
            best = vectors.search(have.where(F.col("model") == model), q, max(3 * k, vectors.TOP))
            scope_of = facts.select(F.lit("fact").alias("kind"), F.col("id").alias("item"), "scope").unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("id").alias("item"), "scope"))
            near = best.select("kind", "item", "cosine").join(scope_of, ["kind", "item"]).select("kind", "scope", "item", "cosine")
        rows = [r.asDict() for r in search.recall(query, chunks, facts, k, scopes, kinds, pinned, near, stem=True, chunk_hits=hits).collect()]
        told = [(r["scope"], r["item"]) for r in rows if r["kind"] == "fact"]
        if track and told:
            hit = self.spark.createDataFrame(told, "scope string, id long")
            after = K.record_hits(facts, hit).select(facts.columns)
            for scope in {s for s, _ in told}:
                self._save(after, scope)
        return rows

    def facts_markdown(self) -> str:
        return K.markdown(self._facts())

    # -- graph
    def build(self, **options) -> dict:
        return vars(build(self.spark, f"file://{self.root}", self.graph_store, **options))

    def _agent(self, client=None, steps: int = STEPS) -> GraphAgent:
        return GraphAgent(*self.graph_store.graph(), client, self.graph_store.text_index(), steps)

    def enrich(self, client=None, model: str = "", limit: int | None = None, estimate_only: bool = False, prices: tuple[float, float] = (0.0, 0.0)) -> dict:
        """Ask a client about passages that it hasn't been asked about, and publish the graph with what it found; or only what that would cost.

        Answers are kept by digest and model. limit: at most so many passages in this run, by uid. A failing batch is told and tried again next time.
        """
        n, entry = self.graph_store.head()
        nodes, edges = self.graph_store.graph()
        chunks = nodes.where("kind = 'chunk'").select("uid", "owner", "body")
        cache = VersionedTable(self.spark, f"file://{self.root}/{STATE}/answers", "digest")
        at = cache.version()
        none = self.spark.createDataFrame([], "digest string, producer string, version string, payload string, error string")
        have = cache.read(at)
        have = none if have is None else have
        todo = enrich.passages(chunks)
        asked = have.where(F.col("version") == model).select("digest")
        fresh = todo.join(asked, "digest", "left_anti")
        fresh = fresh if limit is None else fresh.orderBy("uid").limit(limit)
        cost = enrich.estimate(fresh, *prices).first().asDict()
        if estimate_only or client is None:
            return {"estimate": cost}
        got = materialize(enrich.run(fresh, have, client, model), "answers")
        failed = got.where("payload is null").count()
        cache.commit(got.where("payload is not null").drop("error"), expected=at)
        answers = cache.read()
        new_nodes, new_edges = enrich.claims(todo, answers, model)
        name = f"snapshot-{uuid.uuid4().hex}"
        path = f"{self.graph_store.root}/{name}"
        base = self.graph_store.claims(entry["node_claims"], "by").drop("by"), self.graph_store.claims(entry["edge_claims"], "owner")
        kept = self.graph_store.read("manifest", "")
        kept.write.parquet(f"{path}/manifest")
        merged, resolved, _ = derive(base[0].unionByName(new_nodes), base[1].unionByName(new_edges.select(base[1].columns)), kept.select("path"))
        merged.write.parquet(f"{path}/nodes")
        resolved.write.parquet(f"{path}/edges")
        found = self.spark.read.parquet(f"{path}/nodes").select("uid", search.node_text(F.col("body"), F.col("name"), F.col("props")).alias("body"))
        search.TextIndex(self.spark, f"{path}/postings").write(found, "uid", "body")
        self.graph_store.publish(n, {**entry, "snapshot": name, "enriched": model})
        return {"estimate": cost, "answered": got.count() - failed, "failed": failed}

    def graph_overview(self) -> dict:
        return self._agent().overview(15)

    def graph_search(self, query: str, kind: str | None = None, limit: int = RESULTS) -> list[dict]:
        return self._agent().search(query, kind, limit)

    def graph_node(self, uid: str) -> dict:
        return self._agent().get_node(uid)

    def graph_neighbors(self, uid: str, edge_kind: str | None = None, direction: str = "both", limit: int = RESULTS) -> list[dict]:
        return self._agent().neighbors(uid, edge_kind, direction, limit)

    def graph_path(self, start: str, goal: str, max_depth: int = 6) -> list:
        return self._agent().path(start, goal, max_depth)

    def hubs(self, kind: str | None = None, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in graph.hubs(*self.graph_store.graph(), kind, limit).collect()]

    def counts(self) -> dict:
        return {r["key"]: r["n"] for r in graph.counts(*self.graph_store.graph()).collect()}

    def export(self, limit: int = 5000) -> dict:
        return json.loads(graph.export_json(*self.graph_store.graph(), str(self.root), limit))

    def ask(self, question: str, client, steps: int = STEPS) -> str:
        return self._agent(client, steps).ask(question)


#: The tools that a tool server offers.
SERVED = ("recall", "remember", "facts", "forget", "pin", "index", "status", "graph_overview", "graph_search", "graph_node", "graph_neighbors", "graph_path")


# ---------------------------------------------------------------- a tool server: JSON-RPC 2.0, one message a line

_JSON = {"str": "string", "int": "integer", "bool": "boolean", "float": "number"}
#: Parameters of tools that only make sense within this process.
_INNER = ("embedder",)


def tool_list() -> list[dict]:
    """Names, descriptions and argument schemas of SERVED."""
    out = []
    for n in SERVED:
        fn = getattr(Tools, n)
        params = [p for p in inspect.signature(fn).parameters.values() if p.name not in ("self", *_INNER)]
        kinds = {p.name: _JSON.get(str(p.annotation).split(" |")[0], "array" if "list" in str(p.annotation) or isinstance(p.default, tuple) else "string") for p in params}
        schema = {"type": "object", "properties": {k: {"type": t} for k, t in kinds.items()}, "required": [p.name for p in params if p.default is inspect.Parameter.empty]}
        out.append({"name": n, "description": " ".join((fn.__doc__ or n.replace("_", " ")).split()), "inputSchema": schema})
    return out


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to one request; None for a notification. A tool's own failure is a result with isError, an unknown method or tool is an error."""
    method, ident = message.get("method"), message.get("id")
    if ident is None:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": ident}
    if method == "initialize":
        asked = (message.get("params") or {}).get("protocolVersion", "2024-11-05")
        return {**reply, "result": {"protocolVersion": asked, "capabilities": {"tools": {}}, "serverInfo": {"name": "folioscope", "version": "1"}}}
    if method == "ping":
        return {**reply, "result": {}}
    if method == "tools/list":
        return {**reply, "result": {"tools": tool_list()}}
    if method != "tools/call":
        return {**reply, "error": {"code": -32601, "message": f"no method {method}"}}
    params = message.get("params") or {}
    if params.get("name") not in SERVED:
        return {**reply, "error": {"code": -32602, "message": f"no tool {params.get('name')}"}}
    try:
        out = getattr(tools, params["name"])(**(params.get("arguments") or {}))
        text, bad = json.dumps(out, ensure_ascii=False, default=str), False
    except Exception as e:
        text, bad = f"{type(e).__name__}: {str(e)[:500]}", True
    return {**reply, "result": {"content": [{"type": "text", "text": text}], "isError": bad}}


def serve(tools: Tools, lines=None, out=None) -> None:
    """Answer requests from lines until they end."""
    out = out or sys.stdout
    for line in lines or sys.stdin:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            reply = answer(tools, message)
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()

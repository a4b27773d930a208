"""Command line: python -m folioscope.cli <command> [arguments]; a folder alone means build."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from .operators.changes import Conflict
from .session import local_session
from .sources.files import capabilities
from .tools import Tools, serve


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope", description="Graph, search and memory over a folder.")
    p.add_argument("--root", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args, **kw):
        c = sub.add_parser(name, **kw)
        for a in args:
            c.add_argument(*a[0], **a[1])
        return c

    arg = lambda *n, **kw: (n, kw)
    js = arg("--json", action="store_true")
    client = arg("--client", help="module:function of the model client")
    add("build", arg("folder", nargs="?"), arg("--no-prune", action="store_true"), arg("--transcriber", help="module:function"), arg("--ocr", help="module:function"), arg("--keyframes", type=int, default=0), js)
    add("index", arg("folders", nargs="*"), js)
    add("reindex", js)
    add("init", arg("folder", nargs="?"), js)
    add("ask", arg("question"), client, arg("--max-steps", type=int, default=12))
    add("enrich", client, arg("--model", default="model"), arg("--limit", type=int), arg("--estimate-only", action="store_true"), arg("--price-in", type=float, default=0.0), arg("--price-out", type=float, default=0.0), js)
    add("search", arg("query"), arg("--kind"), arg("-k", type=int, default=10), js)
    add("node", arg("uid"), js)
    add("neighbors", arg("uid"), arg("--kind"), arg("--direction", default="both", choices=["out", "in", "both"]), arg("-k", type=int, default=25), js)
    add("path", arg("start"), arg("goal"), arg("--max-depth", type=int, default=6), js)
    add("hubs", arg("--kind"), arg("--limit", type=int, default=20), js)
    add("graph", js)
    add("export", arg("--limit", type=int, default=5000), arg("--out"))
    add("doctor", js)
    add("recall", arg("query"), arg("-k", type=int, default=8), arg("--facts-only", action="store_true"), arg("--no-pinned", action="store_true"), arg("--semantic", action="store_true"), arg("--scope"), js)
    add("remember", arg("text"), arg("--tag", action="append", default=[]), arg("--pin", action="store_true"), arg("--scope"), js)
    for name in ("forget", "pin", "unpin"):
        add(name, arg("id", type=int), arg("--scope"), js)
    add("facts", arg("--tag"), arg("--markdown", action="store_true"), js)
    add("status", js)
    add("sources", arg("--remove"), js)
    add("embed", arg("--model", default="hash-64"), arg("--embedder", help="module:function"), js)
    add("mcp")
    return p


def loaded(name: str | None):
    """The function that module:function names; None for None."""
    if name is None:
        return None
    module, _, attr = name.partition(":")
    if not attr:
        raise ValueError(f"{name} is not module:function")
    return getattr(importlib.import_module(module), attr)


def render(out: object) -> str:
    """Plain text for people: rows as aligned columns, mappings as lines, long texts shortened."""
    flat = lambda v: " ".join(str(v).split())
    short = lambda v: flat(v) if len(flat(v)) <= 80 else flat(v)[:79] + "…"
    if isinstance(out, str):
        return out
    if isinstance(out, dict):
        return "\n".join(f"{k}: {render(v) if isinstance(v, dict) else flat(v)}" for k, v in out.items())
    if isinstance(out, list) and out and all(isinstance(r, dict) for r in out):
        heads = list(dict.fromkeys(k for r in out for k in r))
        rows = [heads, *[[short(r.get(h, "")) for h in heads] for r in out]]
        wide = [max(len(r[i]) for r in rows) for i in range(len(heads))]
        return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows)
    if isinstance(out, list):
        return " -> ".join(map(flat, out)) if out else "nothing found"
    return flat(out)


def run(argv: list[str], spark=None) -> object:
    if argv and not argv[0].startswith("-") and argv[0] not in COMMANDS and os.path.isdir(argv[0]):
        argv = ["build", *argv]
    a = parser().parse_args(argv)
    if a.command == "doctor":
        return capabilities()
    t = Tools(spark or local_session(), getattr(a, "folder", None) or a.root)
    c = a.command
    if c in ("ask", "enrich") and not a.client and not getattr(a, "estimate_only", False):
        raise ValueError("give the model client as --client module:function")
    if c in ("pin", "unpin"):
        return t.pin(a.id, c == "pin", a.scope)
    if c == "index" and a.folders:
        return {f: t.index() if os.path.realpath(f) == str(t.root) else t.add_source(f) for f in a.folders}
    if c == "export":
        out = json.dumps(t.export(a.limit), ensure_ascii=False)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(out)
            return {"written": a.out}
        return out
    scopes = (a.scope,) if getattr(a, "scope", None) else ("project", "global")
    return {
        "build": lambda: t.build(prune=not a.no_prune, transcribe=loaded(a.transcriber), ocr=loaded(a.ocr), keyframes=a.keyframes), "index": t.index, "reindex": t.index, "init": lambda: {"index": t.index(), "graph": t.build()},
        "ask": lambda: t.ask(a.question, loaded(a.client), a.max_steps), "enrich": lambda: t.enrich(loaded(a.client), a.model, a.limit, a.estimate_only, (a.price_in, a.price_out)),
        "search": lambda: t.graph_search(a.query, a.kind, a.k), "node": lambda: t.graph_node(a.uid), "neighbors": lambda: t.graph_neighbors(a.uid, a.kind, a.direction, a.k), "path": lambda: t.graph_path(a.start, a.goal, a.max_depth),
        "hubs": lambda: t.hubs(a.kind, a.limit), "graph": t.counts, "recall": lambda: t.recall(a.query, a.k, a.semantic, scopes=scopes, kinds=("fact",) if a.facts_only else ("fact", "chunk"), pinned=not a.no_pinned),
        "remember": lambda: t.remember(a.text, a.tag, a.pin, a.scope), "forget": lambda: t.forget(a.id, a.scope), "facts": lambda: t.facts_markdown() if a.markdown else t.facts(a.tag), "status": t.status,
        "sources": lambda: t.sources(a.remove), "embed": lambda: t.embed(loaded(a.embedder), a.model), "mcp": lambda: serve(t),
    }[c]()


COMMANDS = "build index reindex init ask enrich search node neighbors path hubs graph export doctor recall remember forget pin unpin facts status sources embed mcp".split()


def main() -> int:
    argv = sys.argv[1:]
    try:
        out = run(argv)
    except (ValueError, OSError, Conflict) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if out is not None:
        print(json.dumps(out, ensure_ascii=False, indent=2, default=str) if "--json" in argv else render(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())

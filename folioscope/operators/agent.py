"""Answering questions with a language model that calls the graph queries as tools. The model client is the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, search

# Rounds of a question, results, characters of a body and of a tool's answer.
STEPS, RESULTS, BODY, ANSWER = 12, 25, 1200, 12_000
TOOLS = {
    "overview": ("Counts, documents and the most connected entities.", {}),
    "search": ("Full-text search.", {"query": "string", "kind": "string"}),
    "get_node": ("One node with its text.", {"uid": "string"}),
    "neighbors": ("Nodes one edge away.", {"uid": "string", "edge_kind": "string", "direction": "string"}),
    "path": ("A shortest path between two nodes.", {"start": "string", "goal": "string"}),
}


def tool_schemas() -> list[dict]:
    """The tools as JSON schemas."""
    return [{"name": n, "description": d, "input_schema": {"type": "object", "properties": {k: {"type": t} for k, t in a.items()}}} for n, (d, a) in TOOLS.items()]


@dataclass
class Reply:
    """What a client answers: text, and tool calls as (id, name, arguments)."""

    text: str = ""
    calls: list[tuple[str, str, dict]] = field(default_factory=list)
    refused: bool = False


Client = Callable[[list[dict], list[dict]], Reply]


class GraphAgent:
    def __init__(self, nodes: DataFrame, edges: DataFrame, client: Client | None = None, index: search.TextIndex | None = None, steps: int = STEPS):
        self.nodes, self.edges, self.client, self.index, self.steps = nodes, edges, client, index, steps

    def ask(self, question: str) -> str:
        """The answer; a refusal, a client's error and running out of steps are told as text."""
        messages: list[dict] = [{"role": "user", "content": question}]
        for _ in range(self.steps):
            try:
                reply = self.client(messages, tool_schemas())
            except Exception as e:
                return f"The model could not be asked: {e}"
            if reply.refused:
                return "The model declined to answer."
            if not reply.calls:
                return reply.text
            messages.append({"role": "assistant", "content": reply.text, "calls": reply.calls})
            messages.append({"role": "user", "results": [{"id": i, "content": self.run(name, args)} for i, name, args in reply.calls]})
        return f"No answer within {self.steps} steps."

    def run(self, name: str, args: dict) -> str:
        """One tool's answer as JSON of at most ANSWER characters; errors are answers too."""
        try:
            fn = {"overview": self.overview, "search": self.search, "get_node": self.get_node, "neighbors": self.neighbors, "path": self.path}[name]
            out = json.dumps(fn(**args), ensure_ascii=False, default=str)
        except KeyError:
            out = json.dumps({"error": f"no tool {name}"})
        except Exception as e:
            out = json.dumps({"error": str(e)[:500]})
        return out if len(out) <= ANSWER else out[: ANSWER - 30] + "… (cut; ask for less)"

    def overview(self, entities: int = 20) -> dict:
        docs = [r["name"] for r in graph.nodes_of_kind(self.nodes, "document", 60).select("name").collect()]
        hubs = [r.asDict() for r in graph.hubs(self.nodes, self.edges, "entity", entities).collect()]
        return {"counts": {r["key"]: r["n"] for r in graph.counts(self.nodes, self.edges).collect()}, "documents": docs, "entities": hubs}

    def search(self, query: str, kind: str | None = None, limit: int = RESULTS) -> list[dict]:
        """Best matches of body, name and props, stemmed and without accents; from the index where there is one. Scores are those among nodes of all kinds."""
        terms = search.parse_query(query)
        n = self.nodes if not kind else self.nodes.where(F.col("kind") == kind)
        if self.index is not None:
            hits = self.index.search(terms).withColumnRenamed("id", "uid")
            if not kind:
                hits = F.broadcast(search.top(hits, limit))  # limit rows
            hit = n.join(hits, "uid")
        else:
            found = self.nodes.withColumn("_found", search.node_text(F.col("body"), F.col("name"), F.col("props")))
            hit = search.search_scan(found, terms, "uid", "_found", stem=True)
            hit = hit if not kind else hit.where(F.col("kind") == kind)
        hit = hit.select("uid", "kind", "name", F.substring("body", 1, BODY).alias("body"), "score")
        return [r.asDict() for r in search.top(hit, limit).collect()]

    def get_node(self, uid: str) -> dict:
        r = graph.node(self.nodes, uid).select("uid", "kind", "name", F.substring("body", 1, BODY).alias("body"), "props").first()
        return r.asDict() if r else {"error": f"no node {uid}"}

    def neighbors(self, uid: str, edge_kind: str | None = None, direction: str = "both", limit: int = RESULTS) -> list[dict]:
        return [r.asDict() for r in graph.neighbors(self.nodes, self.edges, uid, [edge_kind] if edge_kind else None, direction, limit=limit).collect()]

    def path(self, start: str, goal: str, max_depth: int = 6) -> list:
        return graph.shortest_path(self.nodes, self.edges, start, goal, max_depth)

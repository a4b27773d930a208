"""Enrichment of chunks by a pluggable client: what it would cost, cached batches, write-back of entities and relations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from .merge import cache_misses

# Least length of a passage, passages and characters of a batch, length of a passage, of names and labels, characters a token, share of output.
LEAST, BATCH, BATCH_CHARS, BODY, NAME, LABEL, CHARS_PER_TOKEN, OUTPUT = 120, 12, 12_000, 4000, 120, 60, 4, 0.2
SEMANTIC = ["person", "org", "place", "product", "event", "concept"]
SYSTEM = "For every passage list the entities it names (person, org, place, product, event or concept) and the relations between them that it states. Answer with the given structure only."
PAYLOAD = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,label:string>>"
#: A client takes [(id, text), ...] and gives {"passages": [{"id", "entities": [...], "relations": [...]}]}; anything else is an error and nothing is written.
Client = Callable[[list[tuple[str, str]]], dict]


def passages(chunks: DataFrame) -> DataFrame:
    """(uid, owner, body, digest) of chunks long enough, the body cut to BODY characters."""
    return chunks.where(F.length("body") >= LEAST).select("uid", "owner", F.substring("body", 1, BODY).alias("body"), F.sha2(F.col("body"), 256).alias("digest"))


def estimate(chunks: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """One row: passages, batches, input and output tokens, cost at prices a million tokens."""
    t = chunks.where(F.length("body") >= LEAST).agg(F.count(F.lit(1)).alias("passages"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"))
    t = t.withColumn("batches", F.greatest(F.lit(1), F.floor(F.col("passages") / BATCH)).cast("long"))
    t = t.withColumn("tokens_in", F.floor(F.col("chars") / CHARS_PER_TOKEN + F.col("batches") * len(SYSTEM) / CHARS_PER_TOKEN).cast("long"))
    t = t.withColumn("tokens_out", F.floor(F.col("tokens_in") * OUTPUT).cast("long"))
    return t.withColumn("cost", F.round(F.col("tokens_in") * price_in / 1e6 + F.col("tokens_out") * price_out / 1e6, 6))


def parse(answer: object) -> dict[str, str]:
    """Payload (JSON) by passage id of a client's answer; raises ValueError for prose and other shapes."""
    if not isinstance(answer, dict) or not isinstance(answer.get("passages"), list):
        raise ValueError("the answer has no passages")
    out = {}
    for p in answer["passages"]:
        ents = [{"name": str(e["name"]).strip()[:NAME], "type": e.get("type") if e.get("type") in SEMANTIC else "concept"} for e in p.get("entities") or [] if str(e.get("name") or "").strip()]
        rels = [{"source": str(r["source"]).strip()[:NAME], "target": str(r["target"]).strip()[:NAME], "label": str(r.get("label") or "")[:LABEL]} for r in p.get("relations") or [] if r.get("source") and r.get("target")]
        out[str(p["id"])] = json.dumps({"entities": ents, "relations": rels}, ensure_ascii=False)
    return out


def run(todo: DataFrame, cache: DataFrame, client: Client, model: str) -> DataFrame:
    """Cache rows (digest, producer, version, payload, error) of the passages that the cache lacks; equal passages are asked about once.

    Batches of up to BATCH passages or BATCH_CHARS characters. A failing batch gives rows with an error and no payload, and costs no other batch.
    """
    want = todo.select("digest", F.lit("enrich").alias("producer"), F.lit(model).alias("version"), "body").dropDuplicates(["digest"])
    want = cache_misses(want, cache)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(group: list[tuple[str, str]]) -> list[tuple]:
            try:
                got = parse(client(group))
                return [(d, "enrich", model, got.get(d), None if d in got else "no answer for this passage") for d, _ in group]
            except Exception as e:  # one bad batch mustn't end the job
                return [(d, "enrich", model, None, str(e)[:500]) for d, _ in group]

        for pdf in batches:
            out, group = [], []
            for d, body in zip(pdf["digest"], pdf["body"]):
                group.append((d, body))
                if len(group) >= BATCH or sum(len(b) for _, b in group) >= BATCH_CHARS:
                    out += ask(group)
                    group = []
            if group:
                out += ask(group)
            yield pd.DataFrame(out, columns=["digest", "producer", "version", "payload", "error"])

    return want.mapInPandas(work, "digest string, producer string, version string, payload string, error string")


def claims(todo: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge claims of the cached payloads: entities with MENTIONS edges, and RELATED_TO between entities of the same passage only; provenance llm."""
    hit = todo.join(cache.where((F.col("producer") == "enrich") & (F.col("version") == model)).select("digest", F.from_json("payload", PAYLOAD).alias("p")), "digest")
    ents = hit.select("uid", "owner", F.posexplode("p.entities").alias("seq", "e")).select("uid", "owner", F.col("seq").cast("long").alias("seq"), F.col("e.name").alias("name"), F.col("e.type").alias("type"))
    ents = ents.withColumn("ent", M.entity_uid(F.col("type"), F.col("name")))
    nodes = ents.select(F.col("ent").alias("uid"), F.lit("entity").alias("kind"), "name", F.concat_ws(": ", "type", "name").alias("body"), F.create_map(F.lit("entity_type"), F.col("type"), F.lit("value"), F.col("name")).alias("props"), F.lit(None).cast("string").alias("owner"), "seq")
    tail = [F.lit(1.0).alias("weight"), F.lit("llm").alias("provenance")]
    mentions = ents.select(F.col("uid").alias("src"), F.col("ent").alias("dst"), F.lit("mentions").alias("kind"), *tail, F.create_map().cast(M.PROPS).alias("props"), "owner", "seq")
    rel = hit.select("uid", "owner", F.posexplode("p.relations").alias("seq", "r")).select("uid", "owner", F.col("seq").cast("long").alias("seq"), F.lower("r.source").alias("a"), F.lower("r.target").alias("b"), F.col("r.label").alias("label"))
    named = ents.select("uid", F.lower("name").alias("n"), "ent").groupBy("uid", "n").agg(F.min("ent").alias("ent"))
    rel = rel.join(named.select("uid", F.col("n").alias("a"), F.col("ent").alias("src")), ["uid", "a"]).join(named.select("uid", F.col("n").alias("b"), F.col("ent").alias("dst")), ["uid", "b"])
    related = rel.where("src <> dst").select("src", "dst", F.lit("related_to").alias("kind"), *tail, F.create_map(F.lit("label"), F.col("label"), F.lit("evidence"), F.col("uid")).alias("props"), "owner", "seq")
    return nodes, mentions.unionByName(related)

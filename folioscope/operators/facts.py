"""Facts: similarity, remembering with near-duplicate merging, forgetting, pinning, listing, export."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Similarity from which a fact is the same, or related; words that say nothing.
SAME, RELATED = 0.85, 0.35
NOISE = "a an the is are was were be to of in on for with and or not this that it its you your we our i my use uses used using do does don't should always never".split()

FACTS = "scope string, id long, text string, tags array<string>, origin string, created_at timestamp, updated_at timestamp, hits long, pinned boolean"


def fact_words(c: Column) -> Column:
    """Distinct content words: lower-case runs of letters, digits and underscores, of at least two characters, without noise words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(NOISE))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' content words; 0 if either has none."""
    x, y = fact_words(a), fact_words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both)).otherwise(0.0)


def related(facts: DataFrame, text: str, least: float = RELATED) -> DataFrame:
    """Facts at least that similar to a text, with their similarity. One pass: the text is a literal."""
    return facts.withColumn("similarity", similarity(F.col("text"), F.lit(text))).where(F.col("similarity") >= least)


def similar_pairs(left: DataFrame, right: DataFrame, id_col: str = "id", text_col: str = "text", least: float = RELATED) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs at least that similar, exactly.

    Prefix filter: with words ordered from rare to frequent, texts that similar share one of the first n - ceil(least * n) + 1 words of each. So
    pairs meet on rare words, and frequent ones don't make large groups. least must be above 0. Texts without content words are in no pair.
    """
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(id_col).alias(f"{name}_id"), fact_words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)

    a, b = sets(left, "left"), sets(right, "right")
    words = a.select(F.explode("ws").alias("w")).unionByName(b.select(F.explode("ws").alias("w")))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def prefixed(x: DataFrame, name: str) -> DataFrame:
        o = x.select(f"{name}_id", F.explode("ws").alias("w")).join(df, "w").groupBy(f"{name}_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda s: s["w"]).alias(f"{name}_ws"))
        keep = F.size(f"{name}_ws") - F.ceil(F.lit(least) * F.size(f"{name}_ws") - 1e-9) + 1
        return o.withColumn("w", F.explode(F.slice(f"{name}_ws", F.lit(1), F.greatest(keep.cast("int"), F.lit(1)))))

    pa, pb = prefixed(a, "left"), prefixed(b, "right")
    n, m = F.size("left_ws"), F.size("right_ws")
    pairs = pa.join(pb, "w").where((F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9)).drop("w").dropDuplicates(["left_id", "right_id"])
    both = F.size(F.array_intersect("left_ws", "right_ws"))
    return pairs.select("left_id", "right_id", (both / (n + m - both)).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def remember(facts: DataFrame, text: str, tags: Sequence[str] = (), pin: bool = False, scope: str = "project", origin: str = "agent", now=None) -> tuple[DataFrame, dict]:
    """The fact table after remembering a text, and what happened: action created or updated, the id, and ids of related facts.

    The most similar fact of the scope at SAME or above takes the new text, the union of tags, and the pin if either has it; else a new fact is added.
    Only the best and related rows (a handful) reach the driver.
    """
    text = " ".join((text or "").split())
    if not text:
        raise ValueError("a fact can't be blank")
    spark = facts.sparkSession
    stamp = F.current_timestamp() if now is None else F.lit(now)
    near = related(facts.where(F.col("scope") == scope), text).orderBy(F.desc("similarity"), "id")
    rows = near.select("id", "similarity").collect()
    same = rows[0]["id"] if rows and rows[0]["similarity"] >= SAME else None
    others = [r["id"] for r in rows if r["id"] != same and r["similarity"] < SAME or r["id"] != same]
    if same is not None:
        it = (F.col("scope") == scope) & (F.col("id") == same)
        out = facts.select(
            "scope", "id", F.when(it, F.lit(text)).otherwise(F.col("text")).alias("text"),
            F.when(it, F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags]).cast("array<string>")))).otherwise(F.col("tags")).alias("tags"),
            "origin", "created_at", F.when(it, stamp).otherwise(F.col("updated_at")).alias("updated_at"), "hits", F.when(it, F.col("pinned") | F.lit(pin)).otherwise(F.col("pinned")).alias("pinned"),
        )
        return out, {"action": "updated", "id": same, "related": others}
    new_id = (facts.agg(F.max("id")).first()[0] or 0) + 1
    row = spark.createDataFrame([(scope, new_id, text, sorted(set(tags)), origin, 0, pin)], "scope string, id long, text string, tags array<string>, origin string, hits long, pinned boolean")
    row = row.withColumn("created_at", stamp).withColumn("updated_at", stamp)
    return facts.unionByName(row.select(facts.columns)), {"action": "created", "id": new_id, "related": others}


def forget(facts: DataFrame, fact_id: int, scope: str | None = None) -> DataFrame:
    gone = F.col("id") == fact_id if scope is None else (F.col("id") == fact_id) & (F.col("scope") == scope)
    return facts.where(~gone)


def pin(facts: DataFrame, fact_id: int, pinned: bool = True) -> DataFrame:
    return facts.withColumn("pinned", F.when(F.col("id") == fact_id, F.lit(pinned)).otherwise(F.col("pinned")))


def record_hits(facts: DataFrame, hit: DataFrame) -> DataFrame:
    """hits + 1 for the facts (scope, id) in hit."""
    h = hit.select("scope", "id").distinct().withColumn("_h", F.lit(1))
    return facts.join(h, ["scope", "id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)) + F.coalesce("_h", F.lit(0))).drop("_h")


def listing(facts: DataFrame, tag: str | None = None, scopes: Sequence[str] = ("project", "global")) -> DataFrame:
    """Pinned first, then the newest."""
    f = facts.where(F.col("scope").isin(list(scopes)))
    f = f if tag is None else f.where(F.array_contains("tags", tag))
    return f.orderBy(F.desc("pinned"), F.desc("updated_at"), "id")


def markdown(facts: DataFrame) -> str:
    """Pinned facts under Always, the others by tag in order, untagged ones under general. A human-sized report of a human-sized table."""
    rows = listing(facts).select("text", "tags", "pinned").collect()
    out = ["## Always", *[f"- {r['text']}" for r in rows if r["pinned"]]] if any(r["pinned"] for r in rows) else []
    tags: dict[str, list[str]] = {}
    for r in rows:
        for t in ([] if r["pinned"] else (r["tags"] or ["general"])):
            tags.setdefault(t, []).append(r["text"])
    for t in sorted(tags):
        out += ["", f"## {t}", *[f"- {x}" for x in tags[t]]]
    return "\n".join(out).strip() + "\n"


def words_of(text: str) -> set[str]:
    """fact_words() of a plain string."""
    return {w for w in re.findall(r"[a-z0-9_]+", text.lower()) if len(w) > 1 and w not in NOISE}

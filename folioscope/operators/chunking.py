"""Line chunks of texts, and their nodes and edges."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..session import spread

# Size of a chunk, lines repeated at the start of the next, endings whose headings are Markdown's.
TARGET, OVERLAP = 1200, 2
PROSE = (".md", ".mdx", ".markdown", ".rst", ".txt")
# What makes a heading line in prose and in code.
HEADING = re.compile(r"\s{0,3}#{1,6}\s+(.*\S)")
SYMBOL = re.compile(r"[ \t]{0,4}(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected)\s+)?(?:async\s+)?(?:static\s+)?(def|class|func|function|fn|type|struct|interface|impl|trait|enum|module)\s+([A-Za-z_$][\w$]*)")


def _sections(lines: list[str], prose: bool) -> list[str | None]:
    """For each line, the heading that it stands under (its own, if it is one)."""
    label: str | None = None
    out = []
    for m in map((HEADING if prose else SYMBOL).match, lines):
        if m:
            label = m.group(1).strip() if prose else " ".join(m.groups())
        out.append(label)
    return out


def line_chunks(text: str | None, path: str) -> list[tuple[int, int, int, str | None, str]]:
    """(ord, start_line, end_line, heading, text): spans of lines of up to TARGET characters and the line that exceeds them; after a full span the next begins OVERLAP lines back.

    A span that has reached a third of the target ends before a line under another heading; one that hasn't goes on under the new heading. Lines count from 1. Blank texts have no chunks.

    Found from the running lengths: where a span that begins at a line is full is a binary search, and so is from where on a change of heading cuts it.
    """
    lines = (text or "").splitlines()
    under = _sections(lines, path.lower().endswith(PROSE))
    upto = [0, *accumulate(len(line) + 1 for line in lines)]  # characters of the first n lines, line ends counted
    turns = [i for i in range(1, len(lines)) if under[i] != under[i - 1]]
    found: list[tuple[int, int, str | None]] = []
    first = fresh = 0  # the span's first line, and the first one that isn't repeated from the span before
    while fresh < len(lines):
        full = max(bisect_left(upto, upto[first] + TARGET), fresh + 1)  # lines up to here reach the target
        ripe = bisect_left(upto, upto[first] + -(-TARGET // 3))  # and up to here a third of it
        k = bisect_left(turns, max(ripe, fresh, first + 1))
        if k < len(turns) and turns[k] < min(full, len(lines)):
            cut = turns[k]
            found.append((first, cut, under[cut - 1]))
            first = fresh = cut
        elif full <= len(lines):
            found.append((first, full, under[full - 1]))
            first, fresh = max(0, full - OVERLAP), full
        else:
            found.append((first, len(lines), under[-1]))
            break
    kept = [(a + 1, b, label, "\n".join(lines[a:b]).strip()) for a, b, label in found]
    return [(i, *c) for i, c in enumerate(c for c in kept if c[3])]


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(path, ord, start_line, end_line, heading, text) of documents (path, text). Null and blank texts give no rows; repeated paths are chunked one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *c) for p, t in zip(pdf["path"], pdf["text"]) if t for c in line_chunks(t, p or "")]
            yield pd.DataFrame(rows, columns=["path", "ord", "start_line", "end_line", "heading", "text"])

    return spread(docs.select("path", "text")).mapInPandas(run, "path string, ord int, start_line int, end_line int, heading string, text string")


def chunk_graph(chunks: DataFrame, parent: str = "parent") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of chunks (parent uid, path, ord, start_line, end_line, heading, text): one chunk node each, CONTAINS from the parent, NEXT along ord within a parent. extra, if there, is a map of further props."""
    c = chunks.withColumn("uid", M.child_uid(F.col(parent), "chunk", F.col("ord")))
    base = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"))
    props = F.map_filter(
        F.create_map(*[x for k in ("path", "start_line", "end_line", "ord", "heading") for x in (F.lit(k), F.col(k).cast("string"))]), lambda k, v: v.isNotNull()
    )
    if "extra" in chunks.columns:
        props = F.map_concat(F.map_filter("extra", lambda k, _: ~k.isin("path", "start_line", "end_line", "ord", "heading")), props)
    nodes = c.select("uid", F.lit("chunk").alias("kind"), F.concat_ws(" — ", base, "heading").alias("name"), F.col("text").alias("body"), props.alias("props"), F.col("path").alias("owner"), F.col("ord").cast("long").alias("seq"))
    before = F.lag("uid").over(Window.partitionBy(parent).orderBy("ord"))
    linked = c.withColumn("before", before)

    def edge(src, kind):
        return linked.select(src.alias("src"), F.col("uid").alias("dst"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), F.create_map().cast(M.PROPS).alias("props"), F.col("path").alias("owner"), F.col("ord").cast("long").alias("seq"))

    return nodes, edge(F.col(parent), "contains").unionByName(edge(F.col("before"), "next").where(F.col("src").isNotNull()))


def running_ordinals(parts: DataFrame) -> DataFrame:
    """Adds first_ord to (doc, page, n): the number of chunks on earlier pages of the document, so that ordinals go on across pages."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("first_ord", F.coalesce(F.sum("n").over(w), F.lit(0)))


def chunk_index(docs: DataFrame) -> DataFrame:
    """The memory side's chunk table: chunks of documents with the text that they are searched by."""
    c = chunk_documents(docs)
    return c.withColumn("search_body", X.search_body(F.col("text"), F.col("heading"), F.col("path")))


def fold_windows(heard, span: float = 45.0, chars: int = 900) -> Iterator[tuple[float, float, str]]:
    """(start, end, text) of (start, end, text) in order of time, merged until the span or the number of characters is reached. Blank texts are left out."""
    texts: list[str] = []
    begun = ended = 0.0
    for a, b, text in heard:
        text = (text or "").strip()
        if not text:
            continue
        begun, ended = (begun if texts else a), b
        texts.append(text)
        if ended - begun >= span or sum(map(len, texts)) >= chars:
            yield begun, ended, " ".join(texts)
            texts = []
    if texts:
        yield begun, ended, " ".join(texts)


def windows(segments: DataFrame, span: float = 45.0, chars: int = 900) -> DataFrame:
    """Transcript windows of segments (file, start_time, end_time, text), by fold_windows(): (file, ord, start_time, end_time, text).

    A window depends on where the last one ended, so a file is folded in order; files are independent.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["start_time", "end_time"])
        out = fold_windows(zip(rows["start_time"], rows["end_time"], rows["text"]), span, chars)
        return pd.DataFrame([(key[0], i, a, b, t) for i, (a, b, t) in enumerate(out)], columns=["file", "ord", "start_time", "end_time", "text"])

    kind = segments.schema["file"].dataType.simpleString()
    return segments.select("file", "start_time", "end_time", "text").groupBy("file").applyInPandas(run, f"file {kind}, ord int, start_time double, end_time double, text string")


def frame_segments(frames: DataFrame, wins: DataFrame) -> DataFrame:
    """(file, frame, at, ord): the first window of the file that encloses each frame (file, frame, at); null where none does. Range join within the file, pruned by minute buckets."""
    b = wins.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_time") / 60), F.floor(F.col("end_time") / 60)))).select("file", "ord", "start_time", "end_time", "_b")
    f = frames.withColumn("_b", F.floor(F.col("at") / 60))
    hit = f.join(b, ["file", "_b"]).where((F.col("start_time") <= F.col("at")) & (F.col("at") <= F.col("end_time"))).groupBy("file", "frame").agg(F.min("ord").alias("ord"))
    return frames.join(hit, ["file", "frame"], "left").select("file", "frame", "at", "ord")

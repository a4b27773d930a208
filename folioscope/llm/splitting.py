"""Cutting oversized texts into pieces at natural boundaries, by packing a structure tree.

A text is parsed into a tree: sections by heading level (Markdown or HTML headings, underlined titles), blocks between blank lines, blocks and items of markup, list items with what is set in below them, lines,
sentences, clauses, words, parts between signs, characters. Whole sibling subtrees are merged into a piece while they fit; only a node that is itself too
large is descended into, and a piece that holds a part of a section holds nothing of another section. No piece ends with a heading that something follows. Every piece after the first begins with the end of the piece before.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults of the test data's problem statement.
LIMIT, OVERLAP_LINES, OVERLAP_CHARS = 2000, 2, 120

FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
#: Headings: number signs, a line underlined with = or -, HTML.
HEADING = re.compile(r"^(?P<hash>#{1,6})[ \t]+(?P<title>\S.*)$|^(?P<over>[^\s#>|*+-][^\n]*)\n(?P<under>={3,}|-{3,})[ \t]*$|^[ \t]*<h(?P<h>[1-6])\b[^>]*>(?P<inner>.*?)</h[1-6]>[ \t]*$", re.M | re.I)
BULLET = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,3}[.)]|[a-z][.)])[ \t]+\S", re.M)
_BLOCK = re.compile(r"\n[ \t]*\n\s*")
_OUTER = re.compile(r"</(?:p|div|ul|ol|dl|table|section|article|blockquote|pre|form|header|footer|main|nav)>\s*", re.I)
_INNER = re.compile(r"</(?:li|tr|dd|h[1-6])>\s*|<br\s*/?>\s*", re.I)
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?![a-zà-ÿ])|[。！？]+[”’」』)]*\s*")
_CLAUSE = re.compile(r"[;:,][\"'”’»)\]]*\s+|\s+[–—]\s+|[、，；]")
_WORD = re.compile(r"\s+")
_SIGN = re.compile(r"[,;|}\])>]+")  # data without white space
#: A character with the marks, joiners and selectors that belong to it.
CLUSTER = re.compile(r".[̀-ͯ᪰-᫿⃐-⃿︀-️‍\U0001f3fb-\U0001f3ff]*", re.S)
# Levels: 0 root, 1..6 sections under a heading of that depth, then these.
BLOCK, ITEM, CHARACTER = 7, 10, 16
_ENDS = {7: _BLOCK, 8: _OUTER, 9: _INNER, 11: _LINE, 12: _SENTENCE, 13: _CLAUSE, 14: _WORD, 15: _SIGN, 16: CLUSTER}


def headings(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, depth, title) of the headings outside fenced code."""
    fences = [m.span() for m in FENCE.finditer(text)]
    out, k = [], 0
    for m in HEADING.finditer(text):
        while k < len(fences) and fences[k][1] <= m.start():
            k += 1
        if k < len(fences) and fences[k][0] <= m.start():
            continue
        if m["hash"]:
            out.append((m.start(), m.end(), len(m["hash"]), m["title"].strip()))
        elif m["over"]:
            out.append((m.start(), m.end(), 1 if m["under"][0] == "=" else 2, m["over"].strip()))
        else:
            out.append((m.start(), m.end(), int(m["h"]), re.sub(r"<[^>]+>", "", m["inner"]).strip()))
    return out


class Node:
    """A span [a, b) of the text; level 0 is the root. Its children are only made when they are needed."""

    __slots__ = ("a", "b", "level")

    def __init__(self, a: int, b: int, level: int):
        self.a, self.b, self.level = a, b, level


def _items(text: str, a: int, b: int) -> list[int]:
    """Where the outermost list items of a span begin, behind its first line."""
    first = text.find("\n", a, b)
    found = [(len(m[1].expandtabs()), m.start()) for m in BULLET.finditer(text, first + 1, b)] if first >= 0 else []
    least = min((i for i, _ in found), default=0)
    return [at for i, at in found if i == least]


def children(text: str, node: Node, heads: list[tuple[int, int, int, str]]) -> list[Node]:
    """The next finer parts of node; they cover it without gaps. A level at which there is nothing to cut is skipped; lists are cut item by item as deep as they go."""
    a, b = node.a, node.b
    inside = heads[bisect_left(heads, (a,)) : bisect_left(heads, (b,))]
    ends = [h[1] for h in inside]
    level = node.level if node.level == ITEM else node.level + 1
    while level <= CHARACTER:
        if level < BLOCK:
            cuts = [h[0] for h in inside if h[2] == level]
        elif level == ITEM:
            cuts = _items(text, a, b)
        else:
            cuts = [m.end() for m in _ENDS[level].finditer(text, a, b)]
        if level < CHARACTER and inside:  # no cut inside a heading (but between its words) or right behind one
            kept = []
            for c in cuts:
                k = bisect_right(ends, c) - 1
                behind = k >= 0 and c < b and not text[ends[k] : c].strip()
                k = bisect_left(ends, c)
                within = level < 14 and k < len(inside) and inside[k][0] < c < inside[k][1]
                if not behind and not within:
                    kept.append(c)
            cuts = kept
        at = sorted({a, *(c for c in cuts if a < c < b), b})
        if len(at) > 2:
            return [Node(x, y, level) for x, y in zip(at, at[1:])]
        level += 1
    return []


def overlap_start(text: str, s: int, e: int, limit: int, lines: int, chars: int) -> int:
    """Where the overlap of the piece [s, e) begins: its last lines, or its last characters where those would not fit into half the limit."""
    at = e
    for _ in range(lines):
        at = text.rfind("\n", s, at)
        if at < 0:
            break
    start = s if at < 0 else at + 1
    return start if e - start <= limit // 2 else max(s, e - chars)


def split_text(text: str, limit: int = LIMIT, lines: int = OVERLAP_LINES, chars: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """Pieces (start, end, start of what is new) of at most limit characters that together cover the text; one piece if it is short enough."""
    if len(text) <= limit:
        return [(0, len(text), 0)]
    if limit < 4 or chars > limit // 2:
        raise ValueError("the limit is too small for the overlap")
    heads = headings(text)
    pieces: list[tuple[int, int, int]] = []
    start = new = end = 0  # the open piece: text[start:end], new content from new on

    def ending() -> int:
        e = end
        while e > new and text[e - 1] in "\n ":
            e -= 1
        return e if text[new:e].strip() else end  # nothing but white space: keep it whole

    def close() -> None:
        nonlocal start, new, end
        e = ending()
        pieces.append((start, e, new))
        start, new, end = overlap_start(text, start, e, limit, lines, chars), e, max(e, end)

    stack: list[Node | None] = [Node(0, len(text), 0)]  # None closes the open piece: a section ends
    while stack:
        node = stack.pop()
        if node is None:
            if text[new:end].strip():
                close()
            continue
        if node.b - start <= limit:
            end = node.b
            continue
        section = 0 < node.level < BLOCK
        if end > new and text[new:end].strip():
            e = ending()
            fresh = node.b - overlap_start(text, start, e, limit, lines, chars) <= limit and node.level <= CHARACTER
            if fresh or section or node.level == CHARACTER:
                close()
            if fresh:
                end = node.b
                continue
        parts = children(text, node, heads)
        if not parts:  # a character that doesn't fit beside the overlap: drop the overlap
            start = new
            end = node.b
            continue
        if section:
            stack.append(None)
        stack.extend(reversed(parts))
    if end > new or not pieces:
        pieces.append((start, len(text), new))
    return pieces


def split_rows(text: str | None, heading: str | None, start_line: int | None, limit: int = LIMIT, lines: int = OVERLAP_LINES, chars: int = OVERLAP_CHARS) -> list[tuple]:
    """(piece, start_line, end_line, heading, text) of one item. The heading is the last one at or above the first new line of the piece."""
    if text is None:
        return []
    out = []
    heads = headings(text)
    k, current = 0, heading
    for i, (a, b, new) in enumerate(split_text(text, limit, lines, chars)):
        first = new
        while first < b and text[first] in "\n \t\r":
            first += 1
        while k < len(heads) and heads[k][0] <= first:
            current = heads[k][3]
            k += 1
        line = None if start_line is None else start_line + text.count("\n", 0, a)
        out.append((i, line, None if line is None else line + text.count("\n", a, b), current, text[a:b]))
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, lines: int = OVERLAP_LINES, chars: int = OVERLAP_CHARS) -> DataFrame:
    """(chunk_id, piece, start_line, end_line, heading, text) of every chunk whose text is longer than limit.

    Needs id, text, heading and start_line; other columns don't matter. Rows with equal ids are cut one by one. Null texts are not oversized;
    a null start_line gives null lines. Only oversized rows reach Python.
    """
    big = chunks.where(F.length("text") > limit).select("id", "text", "heading", F.col("start_line").cast("int").alias("start_line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, t, h, s in zip(pdf["id"], pdf["text"], pdf["heading"], pdf["start_line"]) for r in split_rows(t, None if h is None or h != h else h, None if s != s or s is None else int(s), limit, lines, chars)]
            out = pd.DataFrame(rows, columns=["chunk_id", "piece", "start_line", "end_line", "heading", "text"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    kind = chunks.schema["id"].dataType.simpleString()
    return big.mapInPandas(run, f"chunk_id {kind}, piece int, start_line int, end_line int, heading string, text string")


def split_found(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id of the items that were cut."""
    return split_oversized(chunks, limit).where("piece = 0").select("chunk_id")

"""Documents: HTML, titles, links, folder mirroring, document nodes, segments in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X

# What a link is, and how titles are written.
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"
HTML_LINK = r"(?i)(?:href|src)=[\"']([^\"'>]+)[\"']"
TITLE_LINE = r"(?m)^\s{0,3}#\s+(.+?)\s*$"
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"


def html_text(raw: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags as spaces, entities unescaped (the Arrow UDF sees only texts that have an ampersand), cleaned."""
    x = F.regexp_replace(raw, "(?is)<(script|style)\\b[^>]*>.*?</\\1>", " ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    return X.clean(F.when(x.contains("&"), X.unescape(F.when(x.contains("&"), x))).otherwise(x))


def title(raw: Column, path: Column, is_html: Column) -> Column:
    """The title tag of HTML, else the first level-one heading, else the file's name; at most 200 characters."""
    tag = X.unescape(X.clean(F.regexp_replace(F.regexp_extract(raw, TITLE_TAG, 1), "<[^>]+>", "")))
    head = F.regexp_extract(raw, TITLE_LINE, 1)
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(is_html & raw.rlike(TITLE_TAG), F.substring(X.strip(tag), 1, 200)).when(head != "", F.substring(X.strip(head), 1, 200)).otherwise(name)


def normal_path(path: Column) -> Column:
    """A relative path without empty parts and '.', with '..' taking the part before it."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(up, "/")


def link_edges(docs: DataFrame) -> DataFrame:
    """(src, dst, target): references of documents (path, raw) by relative Markdown and HTML links, each target once a document, none to itself.

    Only relative targets count: nothing with a scheme, none that begins with a slash. Targets need not exist; resolve_edges() drops those that don't.
    """
    targets = F.concat(F.regexp_extract_all("raw", F.lit(MARKDOWN_LINK), F.lit(1)), F.regexp_extract_all("raw", F.lit(HTML_LINK), F.lit(1)))
    t = docs.select("path", F.explode(F.array_distinct(F.transform(targets, lambda x: X.strip(F.regexp_replace(x, "[#?].*$", ""))))).alias("target"))
    t = t.where(~F.col("target").rlike("^$|://|^(?:mailto:|tel:|data:|/|#)"))
    base = F.regexp_replace("path", "/?[^/]*$", "")
    t = t.select(M.document_uid(F.col("path")).alias("src"), M.document_uid(normal_path(F.concat_ws("/", base, "target"))).alias("dst"), "target")
    return t.where("src <> dst").groupBy("src", "dst").agg(F.min("target").alias("target"))


def folder_graph(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder nodes above paths, and the CONTAINS edges of folders to folders and to documents."""
    from .merge import live_folders

    f = live_folders(paths)
    none = F.lit(None).cast("string")
    name = F.when(F.col("path") == "", ".").otherwise(F.element_at(F.split("path", "/"), -1))
    nodes = f.select("uid", F.lit("folder").alias("kind"), name.alias("name"), F.lit("").alias("body"), F.map_filter(F.create_map(F.lit("path"), F.col("path"), F.lit("root"), F.when(F.col("path") == "", "true")), lambda k, v: v.isNotNull()).alias("props"), none.alias("owner"), F.lit(0).cast("long").alias("seq"))
    up = f.where("parent is not null").select(F.col("parent").alias("src"), F.col("uid").alias("dst"), none.alias("owner"))
    docs = paths.select(M.folder_uid(F.regexp_replace(M.norm_path(F.col("path")), "/?[^/]*$", "")).alias("src"), M.document_uid(F.col("path")).alias("dst"), F.col("path").alias("owner")).distinct()
    edges = up.unionByName(docs).select("src", "dst", F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), F.create_map().cast(M.PROPS).alias("props"), "owner", F.lit(0).cast("long").alias("seq"))
    return nodes, edges


# Fixed value: metadata that a document is found by.
FOUND_BY = ("author", "subject", "keywords", "artist", "album", "camera_model")


def document_nodes(docs: DataFrame) -> DataFrame:
    """Nodes of documents (path, title, text, modality, size, digest, warnings, seq): searchable by title, path words, FOUND_BY and the first 1,000 characters.

    Optional columns become props: fmt (the format that the bytes show), unreadable, mislabelled, extra (a map: what the reader found out); extra wins over none of the others.
    """
    have = lambda c, kind="string": F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    extra = F.coalesce(have("extra", "map<string,string>"), F.create_map().cast(M.PROPS))
    body = F.concat_ws("\n", "title", X.path_words(F.col("path")), *[extra[k] for k in FOUND_BY], F.substring(F.coalesce("text", F.lit("")), 1, 1000))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, "(\\.[^.]+)$", 1))
    warn = F.when(F.size("warnings") > 0, F.to_json("warnings"))
    own = {
        "path": F.col("path"), "name": name, "extension": ext, "modality": F.col("modality"), "size": F.col("size").cast("string"), "digest": F.col("digest"), "detected_format": have("fmt"),
        "unreadable": have("unreadable"), "mislabelled": have("mislabelled"), "warnings": warn,
    }
    props = F.map_filter(F.map_concat(F.map_filter(extra, lambda k, _: ~k.isin(list(own))), F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])), lambda _, v: v.isNotNull())
    return docs.select(M.document_uid(F.col("path")).alias("uid"), F.lit("document").alias("kind"), F.coalesce("title", name).alias("name"), body.alias("body"), props.alias("props"), F.col("path").alias("owner"), "seq")


def next_edges(parts: DataFrame, parent: str, uid: str, order: str) -> DataFrame:
    """(src, dst): NEXT from each part to the following one of its parent."""
    w = Window.partitionBy(parent).orderBy(order, uid)
    return parts.withColumn("_b", F.lag(uid).over(w)).where("_b is not null").select(F.col("_b").alias("src"), F.col(uid).alias("dst"))


def caption(path: Column, reader: Column, props: Column) -> Column:
    """A sentence that an image, sound or video without text is found by: path words, what it is, its size or length, and what its metadata says."""
    wide = F.when(props["width"].isNotNull(), F.concat(props["width"], F.lit("x"), props["height"], F.lit(" pixels")))
    what = F.when(reader == "image", F.when(props["format"].isNotNull(), F.concat(props["format"], F.lit(" image")))).otherwise(F.concat(reader, F.lit(" file")))
    length = F.when(props["duration"].cast("double") > 0, F.concat(F.lit("duration "), X.timestamp_label(props["duration"].cast("double"))))
    place = F.when(props["lat"].isNotNull(), F.concat(F.lit("located at "), props["lat"], F.lit(", "), props["lon"]))
    return F.concat_ws(" · ", X.path_words(path), what, wide, length, *[props[k] for k in ("title", "artist", "album", "make", "camera_model", "taken")], place)

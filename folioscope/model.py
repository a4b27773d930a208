"""Vocabulary and identity of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X

# Kinds of nodes and edges, provenances, modalities and entity types.
NODE_KINDS = "folder document page sheet column row chunk segment frame entity topic fact".split()
EDGE_KINDS = "contains next derived_from mentions references related_to has_frame similar_to".split()
PROVENANCES = "extracted inferred llm asserted".split()
MODALITIES = "text pdf sheet slides image audio video archive unknown".split()
ENTITY_TYPES = "email url path date money phone identifier person org place product event concept".split()

PROPS = T.MapType(T.StringType(), T.StringType())
NODES = T.StructType([T.StructField("uid", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("body", T.StringType()), T.StructField("props", PROPS), T.StructField("owner", T.StringType()), T.StructField("seq", T.LongType())])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("provenance", T.StringType()), T.StructField("props", PROPS), T.StructField("owner", T.StringType()), T.StructField("seq", T.LongType())])


def norm_path(c: Column) -> Column:
    """Forward slashes, none at the ends."""
    return F.regexp_replace(F.translate(c, "\\", "/"), "^/+|/+$", "")


def folder_uid(path: Column) -> Column:
    p = norm_path(path)
    return F.concat(F.lit("dir:"), F.when(p == "", ".").otherwise(p))


def document_uid(path: Column) -> Column:
    return F.concat(F.lit("doc:"), norm_path(path))


def child_uid(parent: Column, kind: str, key: Column) -> Column:
    return F.concat(parent, F.lit(f"#{kind}:"), key.cast("string"))


def entity_uid(etype: Column, value: Column) -> Column:
    return F.concat(F.lit("ent:"), etype, F.lit(":"), X.normal_name(value))

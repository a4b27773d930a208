"""Literal entities in text: nine families of patterns as Spark expressions, their identities, and mention edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..session import spread

# Least length of a text, most entities of a text, patterns, months, currencies, hosts that say nothing.
MIN_TEXT, MOST = 20, 40
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b"
URL = r"(?i)\bhttps?://[^\s<>\"'{}|\\^`\[\]]+"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
MONTHS = "January February March April May June July August September October November December".split()
LONG_DATE = r"(?i)\b(?:" + "|".join([*MONTHS, "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"]) + r")\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b"
US_DATE = r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
CODES = "USD|EUR|GBP|JPY|INR|CAD|AUD|CHF"
MONEY = r"(?i)(?<![\w.])(?:[$€£¥₹]\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*(?:\.\d{1,2})?\s?(?:" + CODES + r"))(?!\w)"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]\d{3,4}(?![\w.])"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
IDENTIFIER = r"\b[A-Z][A-Z0-9]{1,9}[-_]\d{1,8}(?:[-_]\d{1,8})*\b"
CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
DULL_HOSTS = ["www.w3.org", "schemas.microsoft.com", "schemas.openxmlformats.org", "localhost"]

MENTION = "array<struct<type:string,value:string,display:string>>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def _found(displays: Column, etype: str, value) -> Column:
    return F.filter(F.transform(displays, lambda d: F.struct(F.lit(etype).alias("type"), value(d).alias("value"), d.alias("display"))), lambda m: m["value"].isNotNull())


def _iso(y: Column, m: Column, d: Column) -> Column:
    """An ISO date of three digit strings, null where there is no such day or the year is out of 1900 to 2200."""
    day = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.when((F.year(day) >= 1900) & (F.year(day) <= 2200), F.date_format(day, "yyyy-MM-dd"))


def _month(d: Column) -> Column:
    table = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3].lower()), F.lit(str(i + 1)))])
    return F.element_at(table, F.lower(F.substring(d, 1, 3)))


def _money(d: Column) -> Column:
    sign = F.element_at(F.create_map(*[x for k, v in CURRENCY.items() for x in (F.lit(k), F.lit(v))]), F.substring(d, 1, 1))
    code = F.coalesce(sign, F.upper(F.regexp_extract(d, f"(?i)({CODES})$", 1)))
    return F.concat_ws(" ", code, F.regexp_replace(F.regexp_extract(d, "(?U)\\d[\\d,]*(?:\\.\\d{1,2})?", 0), ",", ""))


def mentions(text: Column, limit: int | None = MOST) -> Column:
    """array<struct<type, value, display>>: entities of a text, family by family, the first of equal (type, value), at most limit.

    Texts shorter than MIN_TEXT characters, and null, have none. Without a limit repeats stay.
    """
    email = F.transform(_all(text, EMAIL), lambda d: F.regexp_replace(d, "\\.+$", ""))
    url = F.transform(_all(text, URL), lambda d: F.regexp_replace(d, "[.,;:)\\]}\"']+$", ""))
    host = lambda u: F.regexp_extract(F.lower(u), "^[^:]+://([^/:]*)", 1)
    url = F.filter(url, lambda u: (host(u) != "") & ~host(u).isin(DULL_HOSTS))
    part = lambda d, i: F.element_at(F.split(d, "[-/]"), i)
    digits = lambda d: F.regexp_replace(d, "(?U)\\D", "")
    found = F.concat(
        _found(email, "email", F.lower),
        _found(url, "url", F.lower),
        _found(_all(text, ISO_DATE), "date", lambda d: _iso(part(d, 1), part(d, 2), part(d, 3))),
        _found(_all(text, LONG_DATE), "date", lambda d: _iso(F.regexp_extract(d, "(?U)(\\d{4})$", 1), _month(d), F.regexp_extract(d, "(?U)\\s(\\d{1,2})", 1))),
        _found(_all(text, US_DATE), "date", lambda d: _iso(part(d, 3), part(d, 1), part(d, 2))),
        _found(_all(text, MONEY), "money", _money),
        _found(_all(text, PHONE), "phone", lambda d: F.when(F.length(digits(d)).between(7, 15), digits(d))),
        _found(_all(text, UUID), "identifier", F.lower),
        _found(_all(text, IDENTIFIER), "identifier", F.lower),
    )
    if limit is None:
        return F.when(F.length(text) >= MIN_TEXT, found).otherwise(F.array().cast(MENTION))
    # The fold evaluates the matches once; what it has kept is never longer than the limit.
    known = lambda acc, m: F.exists(acc, lambda k: (k["type"] == m["type"]) & (k["value"] == m["value"]))
    first = F.aggregate(found, F.array().cast(MENTION), lambda acc, m: F.when((F.size(acc) >= limit) | known(acc, m), acc).otherwise(F.concat(acc, F.array(m))))
    return F.when(F.length(text) >= MIN_TEXT, first).otherwise(F.array().cast(MENTION))


def mention_rows(rows: DataFrame, id_col: str, text_col: str, limit: int | None = MOST) -> DataFrame:
    """(id, type, value, display), one row a mention; without a limit one row per (id, type, value), with the least display."""
    m = spread(rows.select(id_col, text_col)).select(F.col(id_col), F.explode(mentions(F.col(text_col), limit)).alias("m")).select(id_col, "m.type", "m.value", "m.display")
    return m if limit is not None else m.groupBy(id_col, "type", "value").agg(F.min("display").alias("display"))


def link_entities(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity nodes and MENTIONS edges of chunks (uid, body, owner, seq). An entity belongs to no file (by says which one claims it); the edge belongs to the chunk's."""
    m = chunks.select("uid", "owner", "seq", F.posexplode(mentions(F.col("body"))).alias("k", "m"))
    m = m.select("uid", "owner", "seq", "k", F.col("m.type").alias("type"), F.col("m.value").alias("value"), F.col("m.display").alias("display"))
    m = m.withColumn("ent", M.entity_uid(F.col("type"), F.col("value")))
    nodes = m.select(
        F.col("ent").alias("uid"), F.lit("entity").alias("kind"), F.col("display").alias("name"), F.concat_ws(": ", "type", "display").alias("body"),
        F.create_map(F.lit("entity_type"), F.col("type"), F.lit("value"), F.col("value")).alias("props"), F.lit(None).cast("string").alias("owner"), (F.col("seq") * 100 + F.col("k")).cast("long").alias("seq"), F.col("owner").alias("by"),
    )
    edges = m.select(
        F.col("uid").alias("src"), F.col("ent").alias("dst"), F.lit("mentions").alias("kind"), F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"),
        F.create_map().cast(M.PROPS).alias("props"), "owner", (F.col("seq") * 100 + F.col("k")).cast("long").alias("seq"),
    )
    return nodes, edges


def shared_entities(mentions_: DataFrame, doc_col: str) -> DataFrame:
    """(type, value, n_docs) of entities in more than one document: the join across formats, by counting instead of pairing."""
    return mentions_.groupBy("type", "value").agg(F.count_distinct(doc_col).alias("n_docs")).where("n_docs > 1")


def through_entities(mentions_: DataFrame, doc_col: str, start: list) -> DataFrame:
    """(start, other, n): documents that share entities with the given ones. Only the start documents' entities are expanded."""
    a = mentions_.where(F.col(doc_col).isin(start)).select(F.col(doc_col).alias("start"), "type", "value").distinct()
    b = mentions_.select(F.col(doc_col).alias("other"), "type", "value").distinct()
    return a.join(b, ["type", "value"]).where("start <> other").groupBy("start", "other").agg(F.count(F.lit(1)).alias("n"))

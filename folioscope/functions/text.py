"""Text expressions: Spark columns where Spark has the function, small Arrow UDFs where it hasn't."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Separators of str.splitlines() besides line feed; a carriage return before a line feed belongs to it.
LINE_BREAKS = "\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
SPACE = "(?U)\\s"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, "(?U)^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, "(?U)[\\s\\x1C-\\x1F]+", " "))


def clean(c: Column, limit: int | None = None) -> Column:
    """Extracted text without NUL and soft hyphens, form feeds as line ends, no trailing blanks, at most one blank line in a row. Null gives ''."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00\\u00AD]", "")
    x = F.regexp_replace(x, LINE_BREAKS, "\n")
    x = F.regexp_replace(x, "(?U)[\\s&&[^\\n]]+(?=\\n|$)", "")
    x = strip(F.regexp_replace(x, "\\n{3,}", "\n\n"))
    return F.substring(x, 1, limit) if limit else x


def preview(c: Column, width: int = 240) -> Column:
    """One line of at most width characters, with an ellipsis where it was cut."""
    flat = squeeze(c)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, width - 1), "(?U)\\s+$", ""), F.lit("…")))


def path_words(c: Column) -> Column:
    """A path with its separators as spaces."""
    return F.translate(c, "/_-", "   ")


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def timestamp_label(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    s = F.floor(seconds).cast("long")
    h, m, x = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60
    tail = F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0"), tail)).otherwise(F.concat_ws(":", m.cast("string"), tail))


def identifier_parts(c: Column) -> Column:
    """Lower-case parts, longer than two letters, of camel-case words of at least two such parts: sorted and distinct."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    parts = F.transform(words, lambda w: F.filter(F.split(w, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), lambda p: F.length(p) > 2))
    many = F.filter(parts, lambda p: F.size(p) > 1)
    return F.array_sort(F.array_distinct(F.transform(F.flatten(many), lambda p: F.lower(p))))


def search_body(text: Column, heading: Column, path: Column) -> Column:
    """What a chunk is found by: text, words of the path, heading, parts of identifiers."""
    extra = F.concat_ws(" ", identifier_parts(text))
    return F.concat_ws("\n", text, path_words(path), F.when(heading != "", heading), F.when(extra != "", extra))


def ascii_only(c: Column) -> Column:
    return ~c.rlike("[^\\x00-\\x7F]")


# ---------------------------------------------------------------- Arrow UDFs


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def plain_letters(x: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


_EDGE = re.compile(r"""^[\s"'(\[]+|[\s"'),.\];:!?]+$""")


def entity_name(x: str) -> str:
    """Identity of an entity's name: no accents, no marks around it, single spaces, case folded."""
    return " ".join(_EDGE.sub("", plain_letters(x)).split()).casefold()


@F.pandas_udf(StringType())
def _normal_name(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else entity_name(x))


def normal_name(c: Column) -> Column:
    """entity_name() of a column: JVM expressions for ASCII, the Arrow UDF for the rest only."""
    edges = "^[\\s\"'(\\[]+|[\\s\"'),.\\];:!?]+$"
    plain = F.lower(squeeze(F.regexp_replace(c, edges, "")))
    return F.when(ascii_only(c), plain).otherwise(_normal_name(F.when(~ascii_only(c), c)))


# ---------------------------------------------------------------- Porter's stemmer (Porter 1980), written from the paper's rules

_VOWELS = "aeiou"


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    return c != "y" or i == 0 or not _is_cons(w, i - 1)


def _measure(w: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = "".join("c" if _is_cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _is_cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _is_cons(w, len(w) - 1) and not _is_cons(w, len(w) - 2) and _is_cons(w, len(w) - 3) and w[-1] not in "wxy"


# Suffix rules of steps 2 and 3, and the suffixes of step 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _longest(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in rules:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _measure(stem) > least else w
    return w


_RULES2, _RULES3 = (sorted((tuple(r.split(":")) for r in s.split()), key=lambda r: -len(r[0])) for s in (_STEP2, _STEP3))
_ENDS4 = sorted(_STEP4.split(), key=len, reverse=True)


def porter(w: str) -> str:
    """Stem of a lower-case ASCII word; other words come back as they are."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _is_cons(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(w, _RULES2, 0)
    w = _longest(w, _RULES3, 0)
    for end in _ENDS4:
        if w.endswith(end):
            if _measure(w[: -len(end)]) > 1:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) > 3 and w[-4] in "st" and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_term(s: pd.Series) -> pd.Series:
    """Index form of a token: no diacritics, case folded, stemmed. For distinct tokens."""
    return s.map(lambda x: None if x is None else porter(plain_letters(x.casefold())))

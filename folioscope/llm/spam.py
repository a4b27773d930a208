"""Keyword-stuffed and link-list pages.

Each document is measured once: how much of it is sentences, records (table rows, log lines, code) or links; and of the
rest, how repetitive it is (top-word share, repeated n-grams, duplicate lines, variety of words in a sliding window), how dense in
separators and how poor in function words. The thresholds are set per language from the measures of all ordinary documents of that
language; those of the top word and the n-grams also per class of length, because both change with it. Variety, top word, n-grams and
duplicate lines each decide alone; separators and missing function words, which honest lists have too, only together and with
n-grams repeated more than usual. "Most of the text" is half of it, for links and tags too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of and to in is was were are be been has have had for with on by at from that this it its as or but not no so which who when while although because after before during under over between into than then there their they we you he she will can may must should would still per each about",
    "fr": "le la les l de d des du un une et en à au aux est sont été a ont pour par sur avec dans que qui ne pas ce cette ces son sa ses leur mais ou où car après avant pendant depuis sans sous entre plus il elle ils elles on nous vous se si comme bien lors voir près",
    "de": "der die das den dem des ein eine einen einem einer und in im ist war sind waren wurde wird hat haben für mit auf von vom zu zum zur bei nach vor seit während ohne über unter zwischen dass weil aber oder nicht kein keine so als auch sich es er sie wir ihr noch nur obwohl sodass am an aus bis gemäß je siehe",
    "es": "el la los las un una unos unas de del y e en a al es son fue era ha han para por con sin sobre que se no lo su sus como más pero o porque aunque después antes durante desde hasta entre tras cuando según ya aún este esta estos estas ese esa muy así véase",
}
_FW = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_FW_ALL = frozenset().union(*_FW.values())

URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[url=[^\]]*\].*?\[/url\]|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\"')\]]+", re.I | re.S)
WORD = re.compile(r"[^\W\d_]+|\d+")
FOREIGN, FOREIGN_WORD = re.compile(r"[^\x00-\u024f]"), re.compile(r"[^\x00-\u024f\u2000-\u20cf]")
#: Words, those in camel case part by part.
PART = re.compile(r"[A-ZÀ-Þ]+[^\W\d_A-ZÀ-Þ]*|[^\W\d_A-ZÀ-Þ]+|\d+")
HASHTAG = re.compile(r"#\w+")
SEP = re.compile(r"[,;|/•·#>»\n]")
SENTENCE_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)")
START = re.compile(r"[\"'“”‘’«»(\[¿¡*\-–—\s]*([A-ZÀ-Þ0-9]|[^\x00-\u024f])")
LOG = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4})[T ]\d\d:\d\d")
CODE = re.compile(r"^(?:\t| {4})\S|^\s*(?:def|class|func|fn|function|import|from|return|if|for|while|const|let|var|public|private|SELECT)\b.*[(:;={]|[{};]\s*$|^\s*(?:#include|//|/\*)")
#: A line with none of these, and not set in, is no code.
CODE_SIGNS = frozenset("(:;={}#/\t")
WINDOW = 50
#: What makes a repetition and a list: words that stood before, and links or tags.
REPEATED, LIST = 5, 3
#: Least number of ordinary documents that a threshold is taken from.
ENOUGH = 30
#: Classes of length: the binary logarithm of the number of words, between these.
CLASSES = (2, 10)


class Repeats:
    """How repetitive a list of words is. Words are numbered once; every measure is taken from the numbers."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.words = list(dict.fromkeys(words))
        number = dict(zip(self.words, range(len(self.words))))
        self.ids = np.array(list(map(number.__getitem__, words)), dtype=np.int64)
        self.counts = np.bincount(self.ids, minlength=len(self.words))
        self.figures = np.array(list(map(str.isdigit, self.words)), dtype=bool)

    def repeated(self) -> int:
        """Words that stood before."""
        return self.n - len(self.words)

    def variety(self, window: int = WINDOW) -> float:
        """Mean share of different words in a sliding window; 1 for fewer than 8 words.

        A word counts in those windows in which it stands and its last occurrence before doesn't, so each word's share is a difference of positions.
        """
        n = self.n
        if n < 8:
            return 1.0
        if n <= window:
            return len(self.words) / n
        order = np.argsort(self.ids, kind="stable")
        before = np.full(n, -1, dtype=np.int64)
        same = self.ids[order[1:]] == self.ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        at = np.arange(n)
        first = np.maximum(np.maximum(at - window + 1, 0), before + 1)
        total = np.maximum(np.minimum(at, n - window) - first + 1, 0).sum()
        return float(total) / (n - window + 1) / window

    def top(self) -> float:
        """Share of the most frequent word among those that are neither function words nor figures."""
        content = [k for w, k, d in zip(self.words, self.counts.tolist(), self.figures.tolist()) if not d and w not in _FW_ALL]
        return max(content, default=0) / max(1, sum(content))

    def grams(self, fold: bool = False) -> float:
        """Share of word pairs that stood before; with fold, all figures are one word."""
        if self.n < 2:
            return 0.0
        ids = np.where(self.figures[self.ids], len(self.words), self.ids) if fold else self.ids
        pairs = ids[:-1] * (len(self.words) + 1) + ids[1:]
        return 1 - len(np.unique(pairs)) / (self.n - 1)


def _is_record(line: str) -> bool:
    """A table row, log line or line of code."""
    if LOG.match(line) or (not CODE_SIGNS.isdisjoint(line) or line.startswith("    ")) and CODE.search(line):
        return True
    for sep in (";", "\t", "|", ","):
        if line.count(sep) < 2:
            continue
        cells = line.strip("| ").split(sep)
        if len(cells) >= 3:
            figures = sum(1 for c in cells if c.strip() and not re.search(r"[^\W\d_]{2,}", c))
            if figures >= 2 and figures * 3 >= len(cells):
                return True
    return False


def _is_sentence(s: str, words: list[str]) -> bool:
    """Whether s, whose lower-case words are given, is a sentence."""
    if len(words) < 4 or not START.match(s):
        return FOREIGN.search(s) is not None and sum(not w.isdigit() for w in words) < 6  # scripts that we have no function words for
    hits = sum(map(_FW_ALL.__contains__, words))
    return hits >= 2 or (hits == 1 and sum(not w.isdigit() for w in words) <= 6) or FOREIGN_WORD.search(s) is not None


def _parts(line: str) -> list[tuple[bool, str, list[str]]]:
    """The line cut after sentence ends: (whether it is a sentence, the part, its lower-case words). The last part is none."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(line):
        s = line[at : m.end()]
        words = WORD.findall(s.lower())
        out.append((_is_sentence(s, words), s, words))
        at = m.end()
    tail = line[at:]
    if tail:
        out.append((False, tail, WORD.findall(tail.lower())))
    return out


def size(s: str) -> int:
    """Characters that are no white space."""
    return len("".join(s.split()))


def measure(text: str | None) -> dict:
    """The measures of one text; shares are of its characters without white space. Every line is cut, and every part of it made words, once."""
    t = text or ""
    linked = any(x in t for x in ("://", "www.", "WWW.", "](", "<a", "<A", "[url", "[URL"))
    total = record = sentence = link = left = n_links = 0
    rest: list[str] = []
    lines: list[str] = []
    words: list[str] = []
    for line in t.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        lines.append(bare)
        spans = [m.span() for m in LINK.finditer(line)] if linked else []
        if not spans and _is_record(line):
            n = size(line)
            total += n
            record += n
            words += WORD.findall(line.lower())
            continue
        plain = line
        if spans:
            ends = [0, *(b for _, b in spans)]
            plain = " ".join([line[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(line)])])
            words += WORD.findall(line.lower())
        good = other = 0
        kept = []
        for fine, part, own in _parts(plain):
            if not spans:
                words += own
            n = size(part)
            if fine:
                good += n
            elif n:
                other += n
                kept.append(part)
        links = sum(size(line[a:b]) for a, b in spans)
        n_links += len(spans)
        sentence += good
        total += good + other + links
        if links * 10 >= (good + other + links) * 4 and spans:
            link += other + links
            continue
        link += links
        if kept:
            rest.append(" ".join(kept))
            left += other
    n = max(1, total)
    body = "\n".join(rest)
    mine = Repeats(["0" if w.isdigit() else w for w in "\n".join(PART.findall(body)).lower().split("\n") if w] if left else [])
    every = Repeats(words)
    letters = int(every.counts[~every.figures].sum())
    common = [(w, k) for w, k in zip(every.words, every.counts.tolist()) if w in _FW_ALL]
    by_lang = {lang: sum(k for w, k in common if w in fw) for lang, fw in _FW.items()}
    lang = max(by_lang, key=lambda k: (by_lang[k], k == "en")) if letters else None
    tags = len(HASHTAG.findall(body))
    return {
        "guess": lang if lang and by_lang[lang] >= max(2, letters // 50) else None,
        "n_words": every.n,
        "fw": by_lang[lang] / letters if letters else 0.0,
        "sentence": sentence / n,
        "record": record / n,
        "link": link / n,
        "n_links": n_links,
        "rest": left / n,
        "rest_words": mine.n,
        "rest_repeated": mine.repeated(),
        "rest_fw": sum(k for w, k in zip(mine.words, mine.counts.tolist()) if w in _FW_ALL) / mine.n if mine.n else 0.0,
        "variety": mine.variety(),
        "top": mine.top(),
        "grams": mine.grams(),
        "dup": 1 - len(set(rest)) / len(rest) if rest else 0.0,
        "sep": len(SEP.findall(body)) / max(1, mine.n),
        "tags": tags / max(1, len(body.split())),
        "n_tags": tags,
        "prose_variety": every.variety(),
        "prose_top": every.top(),
        "prose_grams": every.grams(True),
        "prose_dup": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "prose_sep": (sum(map(t.count, ",;|/•·#>»")) + max(0, len(lines) - 1)) / max(1, every.n),
    }


COLUMNS = "guess string, n_words int, fw double, sentence double, record double, link double, n_links int, rest double, rest_words int, rest_repeated int, rest_fw double, variety double, top double, grams double, dup double, sep double, tags double, n_tags int, prose_variety double, prose_top double, prose_grams double, prose_dup double, prose_sep double"


def measures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row of measures a document; language is guessed from function words, else taken from lang_col, else 'und'."""
    kind = documents.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    slim = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), lang.alias("_l"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([measure(t) for t in pdf["_t"]], columns=[c.split()[0] for c in COLUMNS.split(", ")])
            out.insert(0, "_l", pdf["_l"].to_numpy())
            out.insert(0, "_id", pdf["_id"].to_numpy())
            yield out

    out = spread(slim).mapInPandas(run, f"_id {kind}, _l string, {COLUMNS}")
    return out.withColumn("language", F.coalesce("guess", "_l", F.lit("und"))).drop("_l").withColumnRenamed("_id", id_col)


def length_class(n: str) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.greatest(F.col(n), F.lit(1)))), F.lit(CLASSES[0])), F.lit(CLASSES[1])).cast("int")


def _over(q: Column, by: float = 0.25) -> Column:
    """A quarter beyond the share q that ordinary documents reach, or a quarter of the way to 1 where that is less."""
    return q + F.least(q, 1 - q) * by


def thresholds(measured: DataFrame) -> DataFrame:
    """Per language and class of length: the least variety and function-word share, and the largest shares of top word, pairs, duplicate lines
    and separators, that are still ordinary, from the documents that are mostly sentences."""
    plain = measured.where((F.col("sentence") > 0.7) & (F.col("n_words") >= 40))
    q = plain.groupBy("language").agg(
        F.percentile_approx("prose_variety", 0.5, 1000).alias("v"), F.percentile_approx("fw", 0.5, 1000).alias("f"),
        F.percentile_approx("prose_dup", 0.99, 1000).alias("d"), F.percentile_approx("prose_sep", 0.99, 1000).alias("s"), F.count(F.lit(1)).alias("n"),
    )
    # A language with few plain documents gets the figures of all of them.
    every = plain.agg(F.percentile_approx("prose_variety", 0.5, 1000).alias("v0"), F.percentile_approx("fw", 0.5, 1000).alias("f0"), F.percentile_approx("prose_dup", 0.99, 1000).alias("d0"), F.percentile_approx("prose_sep", 0.99, 1000).alias("s0"))
    # So does a class of length of a language: first those of the class in all languages, then those of all classes.
    sized = measured.where((F.col("sentence") > 0.7) & (F.col("n_words") >= 4)).withColumn("size_class", length_class("n_words"))
    shares = lambda i: [F.percentile_approx("prose_top", 0.99, 1000).alias(f"t{i}"), F.percentile_approx("prose_grams", F.array(F.lit(0.9), F.lit(0.99)), 1000).alias(f"g{i}"), F.count(F.lit(1)).alias(f"n{i}")]
    classes = measured.sparkSession.range(CLASSES[0], CLASSES[1] + 1).select(F.col("id").cast("int").alias("size_class"))
    q = measured.select("language").distinct().join(q, "language", "left").crossJoin(F.broadcast(every)).crossJoin(F.broadcast(sized.agg(*shares(0)))).crossJoin(F.broadcast(classes))  # one row, one row, nine rows
    q = q.join(sized.groupBy("language", "size_class").agg(*shares(2)), ["language", "size_class"], "left").join(F.broadcast(sized.groupBy("size_class").agg(*shares(1))), "size_class", "left")  # nine rows
    few = F.coalesce("n", F.lit(0)) < ENOUGH

    def own(k: str, default: float) -> Column:
        return F.coalesce(F.when(few, F.col(k + "0")).otherwise(F.col(k)), F.lit(default))

    def sized_own(k: Callable[[int], Column], default: float) -> Column:
        return F.coalesce(*(F.when(F.col(f"n{i}") >= ENOUGH, k(i)) for i in (2, 1)), k(0), F.lit(default))

    return q.select(
        "language",
        "size_class",
        (own("v", 0.72) * 0.85).alias("min_variety"),
        (own("f", 0.3) * 0.5).alias("min_fw"),
        # ordinary documents of one line each say nothing of repeated lines
        F.greatest(_over(own("d", 0.3)), F.lit(0.3)).alias("max_dup"),
        _over(own("s", 0.24)).alias("max_sep"),
        # twice: honest lists name one thing more often than sentences do
        _over(sized_own(lambda i: F.col(f"t{i}"), 0.15), 1.0).alias("max_top"),
        sized_own(lambda i: F.col(f"g{i}")[0], 0.3).alias("usual_grams"),
        _over(sized_own(lambda i: F.col(f"g{i}")[1], 0.5)).alias("max_grams"),
    )


def spam_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The measures, the thresholds of the document's language and is_spam, for every document.

    Null and empty texts are no spam. A text of any length is, whose greater part repeats words (at least REPEATED of them), or is a list of at least LIST links or tags. Copies get equal results. Measures are written once to the shared folder (a few numbers a document).
    """
    m = materialize(measures(documents, id_col, text_col, lang_col), "spam")
    m = m.withColumn("size_class", length_class("rest_words")).join(F.broadcast(thresholds(m)), ["language", "size_class"], "left")  # nine rows a language
    listed = (F.col("sep") > F.col("max_sep")) & (F.col("rest_fw") < F.col("min_fw")) & (F.col("grams") > F.col("usual_grams"))
    repeated = (F.col("variety") < F.col("min_variety")) | (F.col("top") > F.col("max_top")) | (F.col("grams") > F.col("max_grams")) | (F.col("dup") > F.col("max_dup"))
    again, tagged, linked = F.col("rest_repeated") >= REPEATED, (F.col("tags") > 0.5) & (F.col("n_tags") >= LIST), F.col("n_links") >= LIST
    stuffed = (F.col("rest") > 0.5) & (((repeated | listed) & again) | tagged)
    links = linked & (F.col("link") > 0.5) & (F.col("sentence") < 0.3)
    both = (linked | again) & ((F.col("link") + F.when(F.col("variety") < F.col("min_variety"), F.col("rest")).otherwise(0.0)) > 0.6)
    return m.withColumn("is_spam", stuffed | links | both)


def find_spam(documents: DataFrame) -> DataFrame:
    """doc_id of spam documents."""
    return spam_scores(documents).where("is_spam").select("doc_id")

"""Noise in text from scanned pages: words broken across lines, misread characters, running headers and footers, page numbers.

Misread words are looked up in a symmetric-delete index over the corpus's frequency lexicon: word and lexicon entry meet on
a shared key, the word's skeleton (characters that scanners confuse folded together) with at most one character deleted. A weighted edit
distance, in which confusions are cheap, accepts or rejects each candidate; among several the bigrams of the corpus choose. A form that also stands in clean text, where no count tells a misreading from a
rare word, is one only where the bigrams of clean text say so.
Everything that grows with the corpus is joined, not broadcast; only the most frequent words go to the workers, to spare the join.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, parallel, spread

#: Times that a word must stand in text that isn't from pages to be proposed as a repair, and times that its neighbours must have stood beside it there to outweigh a form that is a word itself.
PROPOSED, BESIDE = 2, 2
#: A misread form is at least this many times rarer than the word it stands for.
RARER = 5
#: Skeletons longer than this are looked up as they are, without deletions.
LONGEST = 40
#: Most frequent known words that the page pass carries; all other words go through the join, so the number changes no result.
COMMON = 50_000
#: Cost of a confusion and of any other edit, and the cost allowed a letter.
CONFUSION, EDIT = 0.3, 1.0

# What scanners make of letters (misread form -> letter or letters).
MULTI = {"rn": "m", "nn": "m", "vv": "w", "cl": "d", "ii": "u", "li": "h", "ri": "n", "i-": "r", "ci": "a", "in": "m", "tl": "h", "fi": "h"}
CLASSES = ("il1!|j", "eco06", "tf+7", "as@5", "hb8", "nu", "gq9", "vy")
_CLASS = {c: k[0] for k in CLASSES for c in k}
#: Folding first maps characters, with h and n as one since both may come from two strokes, then the pairs of folded characters that stand for one letter.
_FOLD = {**_CLASS, **dict.fromkeys("hb8nu", "n")}
FOLD_PAIRS = (("vv", "w"), ("rn", "m"), ("nn", "m"), ("i-", "r"), ("ri", "n"), ("ii", "n"), ("ei", "d"))

_STRIP = ".,;:?\"“”„‘«»()[]{}<>…—–·*#•"
_OK = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿœŒßẞ0-9!|+@$'’-]+")
_HAS_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿœŒß]")
BREAK = re.compile(r"([^\W\d_]|[!|+@0-9])([-‐­¬])[ \t]*$")
PAGE_NO = re.compile(r"[\W_]*(?:(?:page|p|pp|seite|s|pág|pag|página|pagina|fol|bl)\.?\s*)?(?:\d{1,5}|[ivxlc]{1,7})(?:\s*(?:of|von|de|sur|/)\s*\d{1,5})?[\W_]*", re.I)
PAGE_NO_SIDE = re.compile(r"\d{1,5}\s*\|\s*\w+|\w+\s*\|\s*\d{1,5}")
DATED = re.compile(r".{2,80}\s[·•|–-]\s(?:19|20)\d\d(?:\s{1,4}\d{1,4})?$")
NUMBERED = re.compile(r"(?:\d{1,4}\s{2,}(?P<a>\S.{2,90}))|(?:(?P<b>\S.{2,90}?)\s{2,}\d{1,4})")
JUNK = re.compile(r"[.,;:~'`^*_|°·\\/-]+(?:\s[.,;:~'`^*_|°·\\/-]+)+|[~`^_|\\]+")
SPACED = re.compile(r"(?:\S\s){3,}\S(?:\s{2,}(?:\S\s)*\S)*(?:\s{2,}\d{1,4})?")


def fold(word: str) -> str:
    """Skeleton of a word: case, accents and confusions folded. Misread and right form usually share it."""
    w = "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))
    w = "".join([_FOLD.get(c, c) for c in w])
    for a, b in FOLD_PAIRS:
        if a in w:
            w = w.replace(a, b)
    return w


def keys(word: str) -> list[str]:
    """Keys of the symmetric-delete index: the skeleton, and for those of 3 to LONGEST characters also every single deletion."""
    s = fold(word)
    return [s] if not 3 <= len(s) <= LONGEST else [s, *{s[:i] + s[i + 1 :] for i in range(len(s))}]


def distance(seen: str, word: str, most: float = 9.0) -> float:
    """Weighted edit distance from a misread form to a word; most: give up beyond."""
    a, b = seen.casefold(), word.casefold()
    n, m = len(a), len(b)
    prev2: list[float] = []
    prev = [j * EDIT for j in range(m + 1)]
    base = lambda c: unicodedata.normalize("NFD", c)[0]
    for i in range(1, n + 1):
        cur = [i * EDIT] + [0.0] * m
        x = a[i - 1]
        two = a[i - 2 : i] if i > 1 else ""
        goal = MULTI.get(two)
        for j in range(1, m + 1):
            y = b[j - 1]
            if x == y:
                d = prev[j - 1]
            else:
                fx, fy = _CLASS.get(base(x), base(x)), _CLASS.get(base(y), base(y))
                d = prev[j - 1] + (CONFUSION if fx == fy else EDIT)
            d = min(d, prev[j] + EDIT, cur[j - 1] + EDIT)
            if goal is not None and goal == base(y):
                d = min(d, prev2[j - 1] + CONFUSION)
            if j > 1 and MULTI.get(b[j - 2 : j]) == base(x):  # two letters run together
                d = min(d, prev[j - 2] + CONFUSION)
            cur[j] = d
        if min(cur) > most and (not prev or min(prev) > most):
            return most + 1
        prev2, prev = prev, cur
    return prev[m]


def allowed(word: str) -> float:
    """Largest accepted distance: one confusion for each two letters, and room for another edit only from eight letters on."""
    return CONFUSION * max(1, (len(word) + 1) // 2) if len(word) < 8 else max(CONFUSION * (len(word) // 2), EDIT)


_PART = re.compile(r"[^\s’'/]+")


def words(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, word) of words without surrounding marks; white space, apostrophes and slashes part them."""
    for m in _PART.finditer(text):
        w = m.group()
        core = w.lstrip(_STRIP)
        a = m.end() - len(core)
        core = core.rstrip(_STRIP)
        if core:
            yield a, a + len(core), core


def plain_words(text: str) -> list[str]:
    """The words alone."""
    return [w for w in [p.strip(_STRIP) for p in _PART.findall(text)] if w]


def is_candidate(w: str) -> bool:
    """Whether a word may be a misread one: mostly Latin letters, and no short code in capitals."""
    if len(w) <= 4 and w.isalpha() and w.isupper():
        return False
    return len(w) >= 2 and _OK.fullmatch(w) is not None and _HAS_LETTER.search(w) is not None and sum(c.isdigit() for c in w) * 2 <= len(w)


def lines_of(body: str) -> list[str]:
    return body.split("\n")


def layout(body: str, page: int | None) -> tuple[list[int], list[int], bool]:
    """Indexes of lines that are surely headers, footers, page numbers or junk; of lines that may be a running title; and whether a page number was seen.

    A title-like first line followed by a blank line on a first page is a title. Table rows are no page numbers.
    """
    lines = lines_of(body)
    full = [i for i, s in enumerate(lines) if s.strip()]
    sure, maybe, number = [], [], False
    if not full:
        return sure, maybe, number
    for i in full:
        if JUNK.fullmatch(lines[i].strip()) and len(full) > 1:
            sure.append(i)
    rest = [i for i in full if i not in sure]
    edge = []
    for k in (0, 1):
        if len(rest) > k:
            edge.append((rest[k], True, k))
            edge.append((rest[-1 - k], False, k))
    flagged: set[int] = set()
    for i, top, k in edge:
        if k == 1 and (rest[0] if top else rest[-1]) not in flagged:
            continue  # the second line counts only behind a header or footer
        if i in flagged:
            continue
        s = lines[i].strip()
        if "\t" in lines[i] or ";" in s:
            continue
        m = NUMBERED.fullmatch(s)
        inner = (m.group("a") or m.group("b")) if m else s
        ends = s[-1] in ".!?…”»:;,"
        caps = len(inner) >= 3 and inner.lower() != inner.upper() == inner and not any(c.isdigit() for c in inner) and len(inner) <= 90 and not ends
        if (PAGE_NO.fullmatch(s) and len(full) > 1 and not ends) or PAGE_NO_SIDE.fullmatch(s):
            number = True
        elif DATED.fullmatch(s) or DATED.fullmatch(inner) or (caps and (len(inner) > 5 or m)) or SPACED.fullmatch(s):
            pass
        elif len(s) <= 70 and len(rest) > 1 and s[0].isupper() and not ends and len(s.split()) <= 8 and not any(c.isdigit() for c in inner) and "@" not in s and ":" not in s:
            follows_blank = top and i + 1 < len(lines) and not lines[i + 1].strip()
            after = lines[i + 1].strip() if top and i + 1 < len(lines) else ""
            short = len(s) <= 0.6 * max(len(lines[j]) for j in rest)
            if m or (top and not follows_blank and short and after and not after[0].islower()):
                pass
            elif not (top and follows_blank):
                maybe.append(i)
                continue
            else:
                continue
        else:
            continue
        flagged.add(i)
    return sorted({*sure, *flagged}), maybe, number


def normal_line(s: str) -> str:
    return re.sub(r"\W+", "", re.sub(r"\d+", "0", s.casefold()))


def breaks(lines: list[str], skip: set[int]) -> list[tuple[int, str, str, str]]:
    """(line, left part, sign, right part) of words broken at a line's end."""
    out = []
    for i in range(len(lines) - 1):
        m = BREAK.search(lines[i]) if i not in skip else None
        if not m:
            continue
        j = i + 1
        while j < len(lines) and (j in skip or not lines[j].strip()):
            j += 1
        if j >= len(lines):
            continue
        left = re.search(r"[^\s]+$", lines[i][: m.end(1)]).group().lstrip(_STRIP)
        right = re.match(r"\s*([^\s]+)", lines[j]).group(1).rstrip(_STRIP)
        right = re.split(r"[’'/]", right)[0]
        left = re.split(r"[’'/]", left)[-1]
        if left and right and (right[0].islower() or not right[0].isalpha() or left.isupper()):
            out.append((i, left, m.group(2), right))
    return out


def counted(texts: DataFrame) -> DataFrame:
    """(a, b, clean_n, page_n) over texts (text, is_page): how often a word a (b is ''), or a pair of neighbours a b, stands in pages and elsewhere, combined in each task. The lexicon and the bigrams of the corpus in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones: tuple[Counter, Counter] = (Counter(), Counter())
        twos: tuple[Counter, Counter] = (Counter(), Counter())
        fit: dict[str, bool] = {}

        def frame() -> pd.DataFrame:
            rows = []
            for page in (0, 1):
                for w, n in ones[page].items():
                    ok = fit[w] = is_candidate(w)
                    if ok:
                        rows.append((w, "", n * (1 - page), n * page))
                rows += [(a, b, n * (1 - page), n * page) for (a, b), n in twos[page].items() if fit.get(a, False) or fit.get(b, False)]
                ones[page].clear()
                twos[page].clear()
            fit.clear()
            return pd.DataFrame(rows, columns=["a", "b", "clean_n", "page_n"])

        for pdf in batches:
            for text, page in zip(pdf["text"], pdf["is_page"]):
                if text:
                    ws = plain_words(text)
                    low = "\n".join(ws).casefold().split("\n")
                    ones[page].update(low if not page else [x for w, x in zip(ws, low) if len(w) > 4 or not w.isupper()])
                    twos[page].update(zip(low, low[1:]))
            if len(twos[0]) + len(twos[1]) > 600_000:
                yield frame()
        yield frame()

    part = spread(texts.select("text", F.col("is_page").cast("int").alias("is_page"))).mapInPandas(run, "a string, b string, clean_n long, page_n long")
    return part.groupBy("a", "b").agg(F.sum("clean_n").alias("clean_n"), F.sum("page_n").alias("page_n"))


def corrections(lex: DataFrame) -> DataFrame:
    """(word, fix, cost, n, own_clean) of words of pages: their candidates, at least RARER times as frequent, within the allowed distance and at most a confusion dearer than the best. own_clean: times that the form stands in clean text."""
    forms = lex.where("page_n > 0").select("word", (F.col("clean_n") + F.col("page_n")).alias("own"), F.col("clean_n").alias("own_clean"))
    known = lex.where(F.col("clean_n") >= PROPOSED).select(F.col("word").alias("fix"), (F.col("clean_n") + F.col("page_n")).alias("n"))

    def index(col: str, extra: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(k, *r) for r in pdf.itertuples(index=False, name=None) for k in keys(r[0])]
                yield pd.DataFrame(rows, columns=["key", col, *extra])

        return run

    left = forms.mapInPandas(index("word", ["own", "own_clean"]), "key string, word string, own long, own_clean long")
    right = known.mapInPandas(index("fix", ["n"]), "key string, fix string, n long")
    pairs = left.join(right, "key").where((F.col("n") >= RARER * F.col("own")) & (F.col("word") != F.col("fix"))).select("word", "fix", "n", "own_clean")
    pairs = parallel(pairs, "word", "fix", "n", "own_clean").distinct()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cost = [distance(w, f, allowed(f)) for w, f in zip(pdf["word"], pdf["fix"])]
            pdf = pdf.assign(cost=cost)
            pdf = pdf[[c <= allowed(f) + 1e-9 and not (len(w) < 3 and n < 50) and not (w.replace("-", "") == f) for c, w, f, n in zip(pdf["cost"], pdf["word"], pdf["fix"], pdf["n"])]]
            yield pdf[["word", "fix", "cost", "n", "own_clean"]]

    good = materialize(pairs.mapInPandas(weigh, "word string, fix string, cost double, n long, own_clean long"), "weighed")  # read twice
    best = good.groupBy("word").agg(F.min("cost").alias("least"))
    return good.join(best, "word").where(F.col("cost") <= F.col("least") + CONFUSION + 1e-9).drop("least")


def page_facts(pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """One pass over pages (node_id, file_id, page, text): rows (node_id, file_id, what, word, left, right, at, stop).

    what: layout (surely scanned), title (maybe a running title; word is its normal form), break (word joined, left the compound with hyphen), token
    (a word that isn't among the common ones, with its neighbours).
    """
    shared = pages.sparkSession.sparkContext.broadcast(common)  # at most COMMON words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            out: list[tuple] = []
            for node, file, page, text in zip(pdf["node_id"], pdf["file_id"], pdf["page"], pdf["text"]):
                if not text:
                    continue
                page = None if page is None or page != page else int(page)
                file = None if file is None or file != file else int(file)
                lines = lines_of(text)
                sure, maybe, _ = layout(text, page)
                if sure:
                    out.append((node, file, "layout", "", "", "", sure[0], -1))
                for i in maybe:
                    out.append((node, file, "title", normal_line(lines[i]), "", "", i, -1))
                skip = {*sure}
                broken = breaks(lines, skip)
                for i, left, sign, right in broken:
                    w = (left + right).casefold()
                    out.append((node, file, "break", w, (left + "-" + right).casefold() if sign in "-‐" else "", "", i, -1))
                dropped = {i for i, *_ in broken}
                at = 0
                for i, line in enumerate(lines):
                    if i not in skip and not known.issuperset("\n".join(plain_words(line)).casefold().split("\n")):
                        ws = list(words(line))
                        for k, (a, b, w) in enumerate(ws):
                            lw = w.casefold()
                            if lw in known or not is_candidate(w) or (k == len(ws) - 1 and i in dropped) or (k == 0 and i - 1 in dropped):
                                continue
                            prev = ws[k - 1][2].casefold() if k else ""
                            nxt = ws[k + 1][2].casefold() if k + 1 < len(ws) else ""
                            out.append((node, file, "token", lw, prev, nxt, at + a, at + b))
                    at += len(line) + 1
            yield pd.DataFrame(out, columns=["node_id", "file_id", "what", "word", "left", "right", "at", "stop"]).astype({"file_id": "Int64"})

    return spread(pages.select("node_id", "file_id", "page", "text")).mapInPandas(run, "node_id long, file_id long, what string, word string, left string, right string, at int, stop int")


class ScanNoise:
    """The tables of one run: lex, grams, fixes, facts. Each is written once to the shared folder."""

    def __init__(self, texts: DataFrame, pages: DataFrame):
        """texts: (text, is_page) for the lexicon and the bigrams; pages: (node_id, file_id, page, text)."""
        self.pages = pages
        n = materialize(counted(texts), "counted")
        self.lex = n.where("b = ''").select(F.col("a").alias("word"), "clean_n", "page_n")
        self.grams = n.where("b <> ''")
        self.fixes = materialize(corrections(self.lex), "fixes")
        doubtful = self.fixes.select("word").distinct()
        top = self.lex.where("clean_n > 0").join(doubtful, "word", "left_anti").orderBy(F.desc("clean_n"), "word").limit(COMMON)
        self.facts = materialize(page_facts(pages, frozenset(r["word"] for r in top.select("word").collect())), "page-facts")
        self._misread: DataFrame | None = None

    def broken(self) -> DataFrame:
        """(node_id, at) of broken words: joined they are a word, or the hyphen isn't that of a known compound."""
        b = self.facts.where("what = 'break'").select("node_id", "at", "word", F.col("left").alias("compound"))
        lex = self.lex.select("word", "clean_n")
        b = b.join(lex.withColumnRenamed("clean_n", "joined_n"), "word", "left").join(lex.select(F.col("word").alias("compound"), F.col("clean_n").alias("compound_n")), "compound", "left")
        return b.where((F.coalesce("compound_n", F.lit(0)) < 1) | (F.coalesce("joined_n", F.lit(0)) > F.col("compound_n"))).select("node_id", "at", "word")

    def _beside(self, m: DataFrame, word: str) -> DataFrame:
        """m with n_left and n_right, and c_left and c_right in clean text alone: how often word stands beside the token's neighbours."""
        before = self.grams.select(F.col("a").alias("left"), F.col("b").alias(word), (F.col("clean_n") + F.col("page_n")).alias("n_left"), F.col("clean_n").alias("c_left"))
        after = self.grams.select(F.col("a").alias(word), F.col("b").alias("right"), (F.col("clean_n") + F.col("page_n")).alias("n_right"), F.col("clean_n").alias("c_right"))
        m = m.join(before, ["left", word], "left").join(after, [word, "right"], "left")
        return m.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_left", "n_right", "c_left", "c_right")})

    def misread(self) -> DataFrame:
        """(node_id, at, stop, word, left, right, fix, cost, n) of misread words with their candidates. Forms of clean text count where a candidate stood BESIDE its neighbours in clean text, and the form itself never."""
        if self._misread is None:
            t = self.facts.where("what = 'token'").select("node_id", "at", "stop", "word", "left", "right").join(self.fixes, "word")
            sure = t.where("own_clean = 0").drop("own_clean")
            maybe = self._beside(t.where("own_clean > 0").drop("own_clean"), "fix").where(F.col("c_left") + F.col("c_right") >= BESIDE)
            maybe = self._beside(maybe.drop("n_left", "n_right", "c_left", "c_right"), "word").where("c_left + c_right = 0").select(sure.columns)
            self._misread = materialize(sure.unionByName(maybe), "misread")
        return self._misread

    def titles(self) -> DataFrame:
        """(node_id, at) of title-like lines that stand on several pages of their file."""
        t = self.facts.where("what = 'title' and file_id is not null and word <> ''")
        often = t.groupBy("file_id", "word").agg(F.count_distinct("node_id").alias("k")).where("k >= 2").drop("k")
        return t.join(often, ["file_id", "word"], "left_semi").select("node_id", "at")

    def found(self) -> DataFrame:
        sure = self.facts.where("what = 'layout'").select("node_id")
        return sure.unionByName(self.broken().select("node_id")).unionByName(self.misread().select("node_id")).unionByName(self.titles().select("node_id")).distinct()

    def chosen(self) -> DataFrame:
        """(node_id, at, stop, fix): the repair of each misread word; among several the bigrams of the corpus choose, then cost, then frequency."""
        m = self._beside(self.misread(), "fix")
        s = F.log1p("n_left") + F.log1p("n_right") + 0.3 * F.log1p("n") - 6 * F.col("cost")
        return m.groupBy("node_id", "at", "stop").agg(F.max_by("fix", F.struct(s.alias("s"), F.col("n"), F.col("fix"))).alias("fix"))

    def repaired(self) -> DataFrame:
        """(node_id, text) of the pages found: continuous paragraphs without headers, footers, page numbers, breaks and misread words."""
        fix = self.chosen().groupBy("node_id").agg(F.collect_list(F.struct("at", "stop", "fix")).alias("fixes"))
        cut = self.titles().groupBy("node_id").agg(F.collect_list("at").alias("titles"))
        joins = self.broken().groupBy("node_id").agg(F.collect_list("at").alias("joins"))
        p = self.pages.join(self.found(), "node_id").join(fix, "node_id", "left").join(cut, "node_id", "left").join(joins, "node_id", "left")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seq = lambda x: [] if x is None or isinstance(x, float) else list(x)
            for pdf in batches:
                texts = [repair_page(t, None if g is None or g != g else int(g), [(f["at"], f["stop"], f["fix"]) for f in seq(fx)], set(seq(ti)), set(seq(jo))) for t, g, fx, ti, jo in zip(pdf["text"], pdf["page"], pdf["fixes"], pdf["titles"], pdf["joins"])]
                yield pd.DataFrame({"node_id": pdf["node_id"], "text": texts})

        return p.select("node_id", "page", "text", "fixes", "titles", "joins").mapInPandas(run, "node_id long, text string")


def like_case(seen: str, fix: str) -> str:
    if len(seen) > 1 and seen.upper() == seen and any(c.isalpha() for c in seen[1:]):
        return fix.upper()
    return fix[:1].upper() + fix[1:] if seen[:1].isupper() else fix


def repair_page(text: str, page: int | None, fixes: list[tuple[int, int, str]], titles: set[int], joins: set[int]) -> str:
    """Rebuild one page: apply the fixes, drop header and footer lines, join broken words and wrapped lines; blank lines and table rows stay."""
    for a, b, fix in sorted(fixes, reverse=True):
        text = text[:a] + like_case(text[a:b], fix) + text[b:]
    lines = lines_of(text)
    sure, _, _ = layout(text, page)
    drop = {*sure, *titles}
    out, para, glue = [], "", False
    for i, line in enumerate(lines):
        if i in drop:
            continue
        s = line.strip()
        if not s:
            if not glue:
                if para:
                    out.append(para)
                para = ""
            continue
        table = "\t" in line
        if table and para and not glue:
            out.append(para)
            para = ""
        para = para + s if glue else f"{para}\n{s}" if para and table else f"{para} {s}" if para else s
        glue = i in joins and bool(BREAK.search(line))
        if glue:
            para = para.rstrip()[:-1]
    if para:
        out.append(para)
    return "\n\n".join(out)

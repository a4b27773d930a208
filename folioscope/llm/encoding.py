"""Text decoded with the wrong character encoding: finding it and restoring it.

An unknown code-page swap is a substitution cipher: a symbol (one character, or the run of characters that a multi-byte character
turned into) stands for one letter. Per source, expectation-maximization learns for each symbol which letter it stands for,
from the characters around it and a bigram model of the corpus; symbols that stand for themselves are ordinary text. A place is
garbled where the learned letter differs from the symbol with high posterior. Code pages propose letters; a swap of pages that aren't listed is learned all the same: any letter of the language
model may be the one where no proposed one is, and is if the symbol's contexts in the source, taken together, speak for it (SPEAKS). U+FFFD, whose original is
lost, may stand for any letter.

Steps: (1) one pass counts (source, symbol, neighbours), combined in each task; (2) the bigram model is summed over all sources,
a table bounded by the alphabet; (3) EM runs on those counts, symbol by symbol of each source, so that no source, however large, is one task; (4) a second pass emits
the places that may be garbled (a bitmap of fixed size tells which can't), joins them with their own source's decisions, and rebuilds the affected rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize, parallel, spread

# The code pages that propose candidate letters.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "iso8859_2", "cp866", "koi8_r")
#: Bits of the bitmap of decided places that the second pass carries, whatever the size of the data: of a place whose bit isn't set nothing is emitted, the join decides on the others.
BITS = 1 << 24
ROUNDS = 6
#: For letters that no code page proposes: the least log-likelihood ratio over all contexts of the symbol in its source that one must reach against the symbol itself, and the least share of them where it fits better.
SPEAKS, MOSTLY = 15.0, 0.7
#: Posterior from which on a place counts as garbled.
SURE = 0.9
LOST = "�"


def _byte_of() -> dict[str, dict[str, str]]:
    out = {}
    for page in PAGES:
        m = {chr(b): chr(b) for b in range(0x80, 0xA0)}  # undefined bytes show as control characters
        for b in range(0x80, 0x100):
            try:
                m[bytes([b]).decode(page)] = chr(b)
            except UnicodeDecodeError:
                pass
        out[page] = m
    return out


BYTE_OF = _byte_of()
CHAR_OF = {page: {v: k for k, v in m.items() if not ("\x80" <= k <= "\x9f") or v not in [m[x] for x in m if x > "\x9f"]} for page, m in BYTE_OF.items()}
REPERTOIRE = frozenset(c for m in BYTE_OF.values() for c in m)
LETTERS = REPERTOIRE - {chr(b) for b in range(0x80, 0xA0)}
#: What is looked at one by one: characters of the code pages, and Latin, Greek and Cyrillic letters, which pages that aren't listed may show.
SYMBOLS = REPERTOIRE | {chr(o) for o in range(0xAA, 0x530) if chr(o).isalpha()}
_LEAD = "".join(sorted({c for m in BYTE_OF.values() for c, b in m.items() if "\xc2" <= b <= "\xf4"}))
_TRAIL = "".join(sorted({c for m in BYTE_OF.values() for c, b in m.items() if "\x80" <= b <= "\xbf"}))
MAYBE = re.compile(f"[{re.escape(_LEAD)}][{re.escape(_TRAIL)}]")
RUN = re.compile("[^\x00-\x7f]+")
UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def plausible(sym: str, c: str) -> bool:
    """Whether a decoded character may be text at all: a letter or sign of the code pages, Latin, East Asian or Semitic, punctuation, symbols, pictures, or U+FFFD. A word of one script must decode to the code pages' own letters."""
    o = ord(c)
    if c in REPERTOIRE:
        return True
    if sym.isalpha() and len({script(x) for x in sym}) == 1 and script(sym[0]) in "CG":
        return False
    return 0x100 <= o < 0x250 or 0x2000 <= o < 0x27C0 or o >= 0x1F000 or c == LOST or script(c) in "AJ" and c.isalpha() or script(c) == "J"


def units(run: str) -> list[tuple[str, str]]:
    """A run of non-ASCII characters as (symbol, proposed character); they are equal unless the symbol has the shape of a multi-byte character read byte by byte, once or repeatedly."""
    items = [(c, c) for c in run]
    for _ in range(3):
        cur = "".join(c for _, c in items)
        if not MAYBE.search(cur):
            break
        best: list[tuple[int, int, str]] = []
        most = 0
        for page in PAGES:
            get = BYTE_OF[page].get
            raw = "".join([get(c, "Ā") for c in cur])
            found = []
            for m in UTF8.finditer(raw):
                try:
                    c = m.group().encode("latin-1").decode()
                except UnicodeDecodeError:
                    continue
                if plausible(cur[m.start() : m.end()], c):
                    found.append((m.start(), m.end(), c))
            size = sum(b - a for a, b, _ in found)
            if size > most:
                best, most = found, size
        if not best:
            break
        new, at = [], 0
        for a, b, c in best:
            new += items[at:a]
            new.append(("".join(o for o, _ in items[a:b]), c))
            at = b
        items = new + items[at:]
    return items


def script(c: str) -> str:
    """L Latin, C Cyrillic, G Greek, A Semitic scripts, J East Asian, S anything else."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L" if c.isalpha() and c not in "ªº" else "S"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if c.isalpha() else "S"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x590 <= o < 0x780:
        return "A"
    if 0x2E80 <= o < 0xA4D0 or 0xAC00 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or 0xFF00 <= o < 0x10000 and c.isalpha():
        return "J"
    return "S"


_CLS: dict[str, str] = {}


def neighbour(c: str) -> str:
    """A neighbouring character as context: ASCII letters and marks as they are, digits 0, white space a space, Latin letters by their base, other scripts by script."""
    k = _CLS.get(c)
    if k is None:
        if not c or c.isspace():
            k = " "
        elif c.isdigit():
            k = "0"
        elif c < "\x7f":
            k = c
        else:
            s = script(c)
            base = unicodedata.normalize("NFD", c)[0]
            k = base if s == "L" and base < "\x7f" else {"L": "ə", "C": "Ж", "G": "Ω", "A": "ع", "J": "字"}.get(s, "¤")
        if len(_CLS) < 70_000:
            _CLS[c] = k
    return k


def kind(c: str) -> str:
    """Class of a symbol or letter, for smoothing: its script, with the case for letters that have one."""
    if len(c) != 1:
        return "M"
    s = script(c)
    return s + ("u" if c.isupper() else "l") if s in "LCG" else s


def symbol_key(sym: str, char: str) -> tuple[str, str]:
    """Long symbols whose proposed character is outside the code pages are pooled by script, so that their number stays bounded. Those that could be a word of one script are not."""
    if len(sym) > 2 and char not in REPERTOIRE and char != LOST and not (sym.isalpha() and len({script(c) for c in sym}) == 1):
        return "*" + script(char), "*" + script(char)
    return sym, char


def spaced(text: str, a: int) -> bool:
    """Whether the character at a stands in a l e t t e r - s p a c e d word."""
    return 2 <= a < len(text) - 2 and text[a - 2].isalpha() and text[a + 2].isalpha() and text[a - 3 : a - 2] in ("", " ", "\n") and text[a + 3 : a + 4] in ("", " ", "\n")


def places(text: str, memo: dict[str, list[tuple[str, str]]]) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, symbol, proposed, left, right) of every symbol of the text; honest characters outside the code pages are none."""
    n = len(text)
    for m in RUN.finditer(text):
        a, b = m.span()
        if b - a == 1:
            c = m.group()
            if c in SYMBOLS or c == LOST:
                left, right = text[a - 1] if a else "", text[b] if b < n else ""
                if left == right == " " and spaced(text, a):
                    left, right = text[a - 2], text[b + 1]
                yield a, b, c, c, left, right
            continue
        run = m.group()
        us = memo.get(run)
        if us is None:
            us = units(run)
            if len(memo) > 50_000:
                memo.clear()
            if b - a < 200:
                memo[run] = us
        at = a
        for i, (sym, char) in enumerate(us):
            end = at + len(sym)
            if len(sym) > 1 or char in SYMBOLS or char == LOST:
                left = us[i - 1][1] if i else (text[a - 1] if a else "")
                right = us[i + 1][1] if i + 1 < len(us) else (text[b] if b < n else "")
                yield at, end, sym, char, left, right
            at = end


def context_counts(rows: DataFrame) -> DataFrame:
    """(source, clean, sym, char, l, r, n), combined within each task before the shuffle. rows: source, text. clean: no place of the text looks foreign to its word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        counts: Counter = Counter()
        fit: dict[tuple, bool] = {}

        def flush() -> pd.DataFrame:
            folded: Counter = Counter()
            for (src, clean, sym, char, a, b), n in counts.items():
                s, e = symbol_key(sym, char)
                folded[(src, clean, s, e, neighbour(a), neighbour(b))] += n
            counts.clear()
            return pd.DataFrame([(*k, n) for k, n in folded.items()], columns=["source", "clean", "sym", "char", "l", "r", "n"])

        for pdf in batches:
            for src, text in zip(pdf["source"], pdf["text"]):
                if text and not text.isascii():
                    seen, clean = [], True
                    for _, _, sym, char, left, right in places(text, memo):
                        seen.append((sym, char, left, right))
                        if clean:
                            k = (sym, left, right)
                            ok = fit.get(k)
                            if ok is None:
                                ok = len(sym) == 1 and sym != LOST and honest(sym, neighbour(left), neighbour(right))
                                if len(fit) < 200_000:
                                    fit[k] = ok
                            clean = ok
                    for k in seen:
                        counts[(src, clean, *k)] += 1
            if len(counts) > 300_000:
                yield flush()
        yield flush()

    part = spread(rows.select("source", "text")).mapInPandas(run, "source long, clean boolean, sym string, char string, l string, r string, n long")
    return part.groupBy("source", "clean", "sym", "char", "l", "r").agg(F.sum("n").alias("n"))


def honest(e: str, left: str, right: str) -> bool:
    """Whether a letter's context is fit for the language model: no capital after a small letter, no mixing of scripts inside a word."""
    s = script(e)
    if s == "L":
        return not (e.isupper() and left.isalpha() and left.islower()) and left not in "ЖΩع" and right not in "ЖΩع"
    if s in "CGA":
        own = {"C": "Ж", "G": "Ω", "A": "ع"}[s]
        return not (left.isalpha() and left != own) and not (right.isalpha() and right != own)
    return "\x80" > e or e > "\x9f"


class BigramModel:
    """P(letter), P(left | letter), P(right | letter), smoothed by the letter's class. Built from sums over all sources."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.n: Counter = Counter()
        self.lr: dict[str, tuple[Counter, Counter]] = {}
        by_kind: dict[str, tuple[Counter, Counter]] = {}
        for e, side, c, n in rows:
            if side == "l":
                self.n[e] += n
            self.lr.setdefault(e, (Counter(), Counter()))[side == "r"][c] += n
            by_kind.setdefault(kind(e), (Counter(), Counter()))[side == "r"][c] += n
        self.total = max(1, sum(self.n.values()))
        self.kinds = {k: tuple({c: x / sum(side.values()) for c, x in side.items()} for side in v) for k, v in by_kind.items()}

    def letter(self, e: str) -> float:
        return (self.n[e] + 0.05) / (self.total + 50)

    def side(self, e: str, c: str, right: bool) -> float:
        base = self.kinds.get(kind(e), ({}, {}))[right].get(c, 0.0) * 0.99 + 1e-4
        mine = self.lr.get(e)
        if mine is None:
            return base
        side = mine[right]
        k = 20 + 0.02 * self.n[e]
        return (side[c] + k * base) / (self.n[e] + k)

    def letters(self) -> list[str]:
        """The letters of clean texts, in a fixed order."""
        return sorted(e for e in self.n if len(e) == 1 and e in SYMBOLS and not "\x80" <= e <= "\x9f")

    def sides(self, e: str, contexts: list[str], right: bool) -> np.ndarray:
        return np.array([self.side(e, c, right) for c in contexts])


def language_model(counts: DataFrame) -> BigramModel:
    """Sums of the contexts of clean texts over all sources: at most letters x contexts x 2 rows, whatever the corpus."""
    pooled = counts.where("clean").groupBy("sym", "l", "r").agg(F.sum("n").alias("n"))
    both = pooled.select("sym", F.explode(F.array(F.struct(F.lit("l").alias("s"), F.col("l").alias("c")), F.struct(F.lit("r").alias("s"), F.col("r").alias("c")))).alias("x"), "n")
    return BigramModel([(r["sym"], r["s"], r["c"], r["n"]) for r in both.groupBy("sym", "x.s", "x.c").agg(F.sum("n").alias("n")).collect()])


def candidates(sym: str, char: str, lm: BigramModel, letters: list[str]) -> dict[str, float]:
    """Letters that a symbol may stand for, with prior weights; the symbol itself is among them unless it can't be text. letters: those of the language model."""
    if sym.startswith("*"):
        return {sym: 1.0}
    if sym == LOST or char == LOST:
        return {e: 1.0 for e in letters} or {LOST: 1.0}
    if len(sym) > 1:
        return {char: 1.0, sym: 1.0}
    control = "\x80" <= sym <= "\x9f"
    out = {sym: 1e-6 if control else 1.0}
    for wrong in PAGES:
        b = BYTE_OF[wrong].get(sym)
        if b is None:
            continue
        for true in PAGES:
            e = CHAR_OF[true].get(b)
            if e is not None and e != sym and e in LETTERS and lm.n[e] > 0:
                out[e] = 0.002
    return out


def learn(sym: str, char: str, ls: list[str], rs: list[str], n: np.ndarray, lm: BigramModel, letters: list[str]) -> list[tuple[str, str, str, str, float]]:
    """EM over the counted contexts (left, right, times) of one symbol in one source: the decisions (sym, l, r, letter, p) where the letter isn't the symbol."""
    cand = candidates(sym, char, lm, letters)
    names = list(cand)
    if sym.startswith("*") or sym == LOST and names == [LOST]:
        return [(sym, a, b, sym if sym == LOST else "", 1.0) for a, b in zip(ls, rs)]
    left, right = sorted(set(ls)), sorted(set(rs))
    at_l, at_r = np.array([left.index(x) for x in ls]), np.array([right.index(x) for x in rs])

    def fit(e: str) -> np.ndarray:
        mid = 1.0
        if len(e) > 1:  # the symbol read as it stands, one character after the other
            for x, y in zip(e, e[1:]):
                mid *= lm.letter(y) * min(1.0, lm.side(x, neighbour(y), True) * 4)
            mid *= lm.letter(e[0])
        return lm.sides(e[0], left, False)[at_l] * lm.sides(e[-1], right, True)[at_r] * mid

    like = np.array([fit(e) for e in names])
    prior = np.array([cand[e] * (1.0 if len(e) > 1 else lm.letter(e)) for e in names])
    prior = np.maximum(prior, 1e-300)
    theta = prior / prior.sum()
    for _ in range(ROUNDS):
        q = like * theta[:, None]
        q /= np.maximum(q.sum(0), 1e-300)
        theta = (q * n).sum(1) + 2 * prior / prior.sum()
        theta /= theta.sum()
    q = like * theta[:, None]
    q /= np.maximum(q.sum(0), 1e-300)
    own = names.index(sym) if sym in cand else -1
    best = q.argmax(0)
    wrong = np.broadcast_to(1 - (q[own] if own >= 0 else 0.0), (len(n),))
    out = []
    for j in np.flatnonzero((wrong >= SURE) & (best != own)):
        e = names[best[j]]
        out.append((sym, ls[j], rs[j], LOST if sym == LOST and q[best[j], j] < 0.5 else e, float(wrong[j])))
    if out or len(sym) > 1 or own < 0 or not sym.isalpha():
        return out
    free = [e for e in letters if e.isalpha() and e not in cand]
    if not free:
        return out
    ratio = np.array([np.log(fit(e)) for e in free]) - np.log(like[own])
    total = (ratio * n).sum(1)
    e = int(total.argmax())
    if total[e] >= SPEAKS and ((ratio[e] > 0) * n).sum() >= MOSTLY * n.sum():
        out = [(sym, a, b, free[e], 1 - float(np.exp(-x))) for a, b, x in zip(ls, rs, ratio[e]) if x >= -np.log(1 - SURE)]
    return out


def decisions(counts: DataFrame) -> DataFrame:
    """(source, sym, l, r, letter, p): what each source's places stand for, where that isn't themselves. Letter is empty for pooled symbols (their own proposal holds)."""
    shared = counts.sparkSession.sparkContext.broadcast(language_model(counts))  # bounded by the alphabet
    key = ["source", "sym", "char"]
    sums = parallel(counts, *key).groupBy(*key, "l", "r").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = shared.value
        letters = lm.letters()
        held: list[tuple] = []  # the contexts of the symbol that is being read: at most as many as there are pairs of neighbours
        at = None

        def decide() -> list[tuple]:
            if at is None:
                return []
            ls, rs, n = zip(*held)
            return [(at[0], *d) for d in learn(at[1], at[2], list(ls), list(rs), np.array(n, dtype=float), lm, letters)]

        cols = ["source", "sym", "l", "r", "letter", "p"]
        for pdf in batches:
            out = []
            for src, sym, char, a, b, n in pdf.itertuples(index=False, name=None):
                if (src, sym, char) != at:
                    out += decide()
                    at, held = (src, sym, char), []
                held.append((a, b, n))
            yield pd.DataFrame(out, columns=cols)
        yield pd.DataFrame(decide(), columns=cols)

    sorted_ = sums.select(*key, "l", "r", "n").sortWithinPartitions(*key, "l", "r")
    return sorted_.mapInPandas(run, "source long, sym string, l string, r string, letter string, p double")


def _place_key(src, sym: str, left: str, right: str) -> int:
    return zlib.crc32(f"{src}\x1f{sym}\x1f{left}\x1f{right}".encode()) % BITS


def _bitmap(decided: DataFrame) -> bytes:
    """One bit for each decided place: BITS / 8 bytes, put together in the tasks."""
    at = F.crc32(F.encode(F.concat_ws("\x1f", F.col("source").cast("string"), "sym", "l", "r"), "UTF-8")) % BITS + 1  # bitmaps number from 1
    maps = decided.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(BITS // 8 + 4096)
    for r in maps.collect():  # at most BITS / 32,768 rows of 4 kB
        start = (r["bucket"] - 1) * 4096
        out[start : start + 4096] = r["bits"]
    return bytes(out)


def garbled_places(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(tbl, row_id, start, end, letter) of every garbled place. rows: tbl, row_id, source, text; decided: decisions()."""
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(decided))  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        bits = bitmap.value
        may: dict[tuple, bool] = {}
        for pdf in batches:
            out = []
            for tbl, row, src, text in zip(pdf["tbl"], pdf["row_id"], pdf["source"], pdf["text"]):
                if text and not text.isascii():
                    for a, b, sym, char, left, right in places(text, memo):
                        sym = sym if b - a == 1 else symbol_key(sym, char)[0]
                        k = (src, sym, neighbour(left), neighbour(right))
                        ok = may.get(k)
                        if ok is None:
                            h = _place_key(*k)
                            ok = bits[h >> 3] >> (h & 7) & 1 == 1
                            if len(may) > 300_000:
                                may.clear()
                            may[k] = ok
                        if ok:
                            out.append((tbl, row, src, a, b, *k[1:], char))
            yield pd.DataFrame(out, columns=["tbl", "row_id", "source", "start", "end", "sym", "l", "r", "char"])

    spots = spread(rows.select("tbl", "row_id", "source", "text")).mapInPandas(run, "tbl string, row_id long, source long, start int, end int, sym string, l string, r string, char string")
    hit = spots.join(decided.select("source", "sym", "l", "r", "letter"), ["source", "sym", "l", "r"])
    return hit.select("tbl", "row_id", "start", "end", F.when(F.col("letter") == "", F.col("char")).otherwise(F.col("letter")).alias("letter"))


def with_source(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds source (0 where unknown) to rows with file_id. The file table is broadcast only below the size limit; else the join shuffles."""
    f = files.select(F.col("id").alias("file_id"), F.col("source_id").cast("long").alias("source")).dropDuplicates(["file_id"])
    return rows.join(broadcast_if_small(f), "file_id", "left").withColumn("source", F.coalesce("source", F.lit(0)))


def find_garbled(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Garbled places of all rows (tbl, row_id, file_id, text): null, empty and ASCII texts have none."""
    rows = with_source(rows.where(F.col("text").rlike("[^\\x00-\\x7F]")), files)
    counts = materialize(context_counts(rows), "contexts")
    decided = materialize(decisions(counts), "decisions")
    return garbled_places(rows, decided)


def found(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(tbl, row_id) with at least one garbled place."""
    return find_garbled(rows, files).select("tbl", "row_id").distinct()


def restore_text(text: str, spots: list[tuple[int, int, str]]) -> str:
    """Apply decisions: symbols of several characters are first put into one private character each; translate() then turns every marked character into its letter."""
    table, out, at = {}, [], 0
    for a, b, letter in sorted(spots):
        mark = chr(0xF0000 + len(table))
        known = next((k for k, v in table.items() if v == letter), None)
        if known is None:
            table[ord(mark)] = letter
            known = ord(mark)
        out += [text[at:a], chr(known)]
        at = b
    out.append(text[at:])
    return "".join(out).translate(table)


def restore(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(tbl, row_id, n_garbled, n_lost, text) of affected rows, with their original text as far as it can be told; n_lost places stay U+FFFD."""
    spots = find_garbled(rows, files).groupBy("tbl", "row_id").agg(F.collect_list(F.struct("start", "end", "letter")).alias("spots"))
    hit = rows.select("tbl", "row_id", "text").join(spots, ["tbl", "row_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, lost = [], []
            for text, s in zip(pdf["text"], pdf["spots"]):
                s = [(x["start"], x["end"], x["letter"]) for x in s]
                texts.append(restore_text(text, s))
                lost.append(sum(x[2] == LOST for x in s))
            yield pd.DataFrame({"tbl": pdf["tbl"], "row_id": pdf["row_id"], "n_garbled": [len(s) for s in pdf["spots"]], "n_lost": lost, "text": texts})

    return hit.mapInPandas(run, "tbl string, row_id long, n_garbled int, n_lost int, text string")

"""Personal information in free text: finding it and replacing it by typed placeholders.

Bootstrapped contextual extraction. One pass over the texts emits candidates: anything with the shape of an email address,
phone or identity number, street address or name, with the words around it. Shapes that can be nothing else, labelled identity
numbers and listed given names are seeds. The candidates form a graph of patterns (the words to the left, to the right, and both) and instances
(number shapes, given names, surnames). Spark scores it in rounds: a pattern is as good as the seeds and accepted instances among
its candidates; names in good patterns, and surnames seen with several given names, become instances of their own. A candidate is
an item if its shape is a seed, its name is known, or its pattern is good enough.

A learned name that no list has may stand alone, or reversed beside an unknown one. The pass also notes each text's capitalised words that are in no
such candidate yet; texts in which one of them turns out to be a learned name are read once more with the learned names, so what is
found doesn't depend on the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, broadcast_if_small, materialize, plan_bytes, spread

ROUNDS = 3
#: Score from which on a pattern vouches for its candidates, and least number of different instances behind it.
TRUST, SUPPORT = 0.5, 3
#: The same for numbers, addresses and mail addresses, whose seeds are only the shapes that need no context.
TRUST_NUMBER = 0.2
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

_U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĘĚŁŃŇÓŐŘŚŠŤŮŰŹŻŽ"
_DOT = r"(?:\.|\s?[(\[{]dot[)\]}]\s?|\s+dot\s+)"
EMAIL = re.compile(
    r"(?<![\w.+@/-])[A-Za-z0-9](?:[\w.+-]*[\w+-])?"
    r"(?:@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|\s?[(\[{](?:at|AT)[)\]}]\s?[A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)*" + _DOT + r"[A-Za-z]{2,}"
    r"|\s+(?:at|AT)\s+[A-Za-z0-9-]+(?:\s+(?:dot|DOT)\s+[A-Za-z0-9-]+)*\s+(?:dot|DOT)\s+[A-Za-z]{2,})(?![\w@])"
)
EMAIL_HINT = re.compile(r"@|[(\[{]at[)\]}]|\sdot\s|\sDOT\s", re.I)

# Words that make a street name.
_EN = "Street|St|Road|Rd|Lane|Ln|Close|Row|Avenue|Ave|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Crescent|Boulevard|Blvd|Hill|Mews|Walk|Parade|Quay"
_DE = "stra(?:ß|ss)e|str\\.|gasse|weg|platz|allee|ufer|damm|ring|steig|markt"
_FR = "rue|avenue|av\\.|ave\\.|boulevard|bd|boul\\.|chemin|ch\\.|place|pl\\.|impasse|allée|quai|route|cours|passage|square"
_ES = "Calle|C/|C\\.|Cl\\.|Avenida|Avda\\.?|Av\\.|Plaza|Pl\\.|Pza\\.|Paseo|P\\.º|Camino|Cno\\.|Ronda|Travesía|Carretera|Ctra\\."
#: A text without any of these holds no address.
STREET_WORDS = tuple(" " + w for w in _EN.split("|")) + ("stra", "str.", "gasse", "weg ", "platz ", "allee ", "ufer ", "damm ", "ring ", "steig ", "markt ") + tuple(w.replace("\\", "") + " " for w in _FR.split("|")) + ("Calle", "C/", "C.", "Cl.", "Aven", "Av", "Plaza", "Pl.", "Pza.", "Paseo", "P.º", "Camino", "Cno.", "Ronda", "Traves", "Carretera", "Ctra.")
ADDRESS = re.compile(
    r"(?:(?<![\w/-])(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room)\s\w{1,4},?\s)?\d{1,4}[A-Za-z]?\s(?:[" + _U + r"][\w'’-]*\.?\s){1,4}?(?:" + _EN + r")\b\.?(?:\s(?:" + _EN + r")\b\.?)*(?:,\s(?:Apt|Flat|Unit|Suite)\.?\s\w{1,4})?)"
    r"|(?:(?<![\w/-])\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s(?:" + _FR + r")\s(?:de\sla\s|de\sl[’']|du\s|des\s|de\s|d[’'])?[" + _U + r"][\w’'-]*(?:[\s-][" + _U + r"][\w’'-]*)*)"
    r"|(?:(?<!\w)[" + _U + r"][\w-]*(?:" + _DE + r")\s\d{1,4}\s?[a-z]?(?!\w))"
    r"|(?:(?<!\w)(?:" + _ES + r")\s?(?:(?:de|del|la|las|los|el|San|Santa|de\sla|de\slos)\s)*[" + _U + r"][\w’'-]*(?:\s[" + _U + r"][\w’'-]*)*,?\s(?:n\.?\s?[ºo°]\s?)?\d{1,4}(?:,?\s\d{1,2}\.?[ºª°]\s?[A-Z]?)?)"
)
#: Addresses that are seeds: those that name a street as such. A word like Ring, Hill or Place with a number may be anything else.
STREET_SEED = re.compile(r"street|\bst\b|road|\brd\b|lane|avenue|\bave\b|stra(?:ß|ss)e|str\.|gasse|allee|\brue\b|boulevard|\bbd\b|chemin|close|\brow\b|terrace|crescent|square|mews|calle|c/|avenida|avda|paseo|camino", re.I)
PHONE = re.compile(
    r"(?<![\w.+/@#:-])(?:tel:)?("
    r"\+\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d(?:[\s./-]?\d){5,12}"
    r"|00\d{2}[\s.-]\d(?:[\s./-]?\d){6,12}"
    r"|\(\d{2,5}\)[\s.-]?\d{2,4}(?:[\s./-]?\d{2,5}){1,3}"
    r"|1-\d{3}-\d{3}-\d{4}"
    r"|0\d{1,4}/\d{3,8}(?:-\d{1,5})?"
    r"|0\d(?:\.\d\d){4}|0\d(?:\s\d\d){4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|0\d{2,4}\s\d{3,4}\s\d{3,4}"
    r"|\d{3}-\d{4}"
    r"|\d{3}\s\d{2,5}\s\d{2,5}"
    r")(?:\s?(?:ext|x|Ext|Durchwahl|poste)\.?\s?\d{1,5})?(?![\w/@-]|\.\d)"
)
ID = re.compile(
    r"(?<![\w./@#+-])(?<!\d\s)("
    r"[A-Z]{2}\s\d\d\s\d\d\s\d\d\s[A-Z]|[A-Z]{1,2}\d{6,8}[A-Z]?"
    r"|[12]\s\d\d\s\d\d\s\d\d\s\d{3}\s\d{3}(?:\s\d\d)?"
    r"|\d\d\s\d{3}\s\d{3}\s\d{3}|\d{3}[\s-]\d\d[\s-]\d{4}"
    r"|\d{1,2}\.\d{3}\.\d{3}-[\dkK]|\d{7,8}-?[A-Z]|\d{8,15}"
    r")(?![\w@/-]|\.\d)"
)
# Words that announce an identity number, before or after it.
LABEL = re.compile(r"passport|licen[cs]e|\bssn\b|social\ssec|identit|identid|national\s(?:id|ins)|\btax\s(?:id|n)|\bdni\b|\bnie\b|\bnif\b|\bnir\b|\bcif\b|\brut\b|steuer|ausweis|carte\sn|\bcni\b|pasaporte|passeport|permis\b|permiso|f[üu]hrerschein|reisepass|sozialvers|s[ée]curit[ée]\ssociale|seguridad\ssocial|fiscal|\bid\s?[=:#]|\bid\sno", re.I)
# Titles, which are no part of a name, and words that begin sentences or name things.
TITLES = frozenset("mr mrs ms miss dr prof sir frau herr mme mlle monsieur madame sra sr srta don doña señor señora".split())
NOT_NAMES = frozenset(
    "the a an this that these those and or but in on at by for from with to of as if when while before after under over between is are was were see run version page total "
    "der die das den dem des ein eine im am und aber wenn nach vor seit laut gemäß siehe "
    "le la les l un une des du de d et ou d’après d'après mais après avant pendant depuis où dès voir selon "
    "el los las un una unos y o pero según tras durante desde véase "
    "call ask well contact old please write return deliver minutes signed present présents signé firmado gezeichnet anwesend asistentes joindre llame bitte merci escriba moved neue nueva nouvelle "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december freitag vendredi viernes "
    "north south east west street road lane port mill hill harbour depot basin bridge dock bay park house tower island quay square hall station unit flat apt info warn error debug".split()
)
#: Words that make a name beside them that of a place or building.
PLACES = frozenset("street st road rd lane port mill hill harbour basin bridge dock bay park house tower island quay depot station square hall river lake row close court".split())
_WORD = "[" + _U + r"][\w’'-]*"
_PART = r"(?:(?:van\sder|van\sden|van|von\sder|von|de\sla|de\slos|del|de|di|da|VAN\sDER|VAN|VON|DE\sLA|DE)\s)"
_INIT = "[" + _U + r"]\."
#: Names: given (initials) surname; initials surname; surname, given; given alone.
SEQ = re.compile(rf"(?<![\w@.’'_/&#-])(?:{_INIT}|{_PART}?{_WORD})(?:,? ?(?:{_INIT}|{_PART}?{_WORD}))*(?![\w@_/])")
TOKEN = re.compile(rf"({_INIT})|({_PART}?{_WORD})|(,)")


def _tokens(seq: str) -> list[tuple[int, int, str, str]]:
    return [(m.start(), m.end(), "i" if m.group(1) else "w" if m.group(2) else ",", m.group()) for m in TOKEN.finditer(seq)]


def _is_word(tok: tuple[int, int, str, str]) -> bool:
    return tok[2] == "w" and tok[3].casefold().rstrip("'’") not in TITLES and tok[3].casefold() not in NOT_NAMES


def parse_names(seq: str, given: frozenset[str], surnames: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str, str]]:
    """Names in a run of capitalised words: (start, end, form, given, surname), both case-folded.

    Forms: gs given + surname, g given alone, is initials + surname, sg surname + given. Only runs that hold a known given name, an initial, or
    two words side by side, or a known surname, a comma and a word are considered; whether those are names is decided later.
    """
    toks = _tokens(seq)
    out, i, n = [], 0, len(toks)

    def is_word(k: int) -> bool:
        return k < n and _is_word(toks[k])

    while i < n:
        a, b, kind, w = toks[i]
        if kind == "i":
            j = i
            while j < n and toks[j][2] == "i":
                j += 1
            if is_word(j):
                out.append((a, toks[j][1], "is", "", toks[j][3].casefold()))
                i = j + 1
            else:
                i = j
            continue
        if kind == "," or not is_word(i):
            i += 1
            continue
        g = w.casefold()
        j = i + 1
        while j < n and toks[j][2] == "i":
            j += 1
        if is_word(j) and toks[j][2] == "w":
            s = toks[j][3].casefold()
            if g in given or s not in given or j > i + 1:
                out.append((a, toks[j][1], "gs", g, s))
                i = j + 1
                continue
        if g in given:
            after = toks[i + 1] if i + 1 < n else None
            if not (after and after[2] == "w" and after[3].casefold() in PLACES) and not (i and toks[i - 1][2] == "w" and toks[i - 1][3].casefold() in PLACES):
                out.append((a, b, "g", g, ""))
            i += 1
            continue
        if i + 2 < n and toks[i + 1][2] == "," and (is_word(i + 2) or toks[i + 2][2] == "i"):
            k = i + 2
            if toks[k][2] == "i":
                while k + 1 < n and toks[k + 1][2] == "i":
                    k += 1
                out.append((a, toks[k][1], "sg", "", g))
                i = k + 1
                continue
            h = toks[k][3].casefold()
            after = toks[k + 1][2] if k + 1 < n else ""
            if h in given and not (after == "w" and toks[k + 1][3].casefold() not in given):
                while k + 1 < n and toks[k + 1][2] == "i":
                    k += 1
                out.append((a, toks[k][1], "sg", h, g))
                i = k + 1
                continue
            if h not in NOT_NAMES and (w.isupper() or g in surnames) and after != "w":
                out.append((a, toks[k][1], "sg", h, g))
                i = k + 1
                continue
        i += 1
    return out


def loose_words(seq: str, names: list[tuple[int, int, str, str, str]], given: frozenset[str]) -> list[str]:
    """Words of the run, case-folded, that would make other names of it if they were known: as given names, or, marked by a comma, as surnames before one."""
    toks = _tokens(seq)
    firm: set[int] = set()  # where words start that stay what they are
    for a, b, form, g, s in names:
        inside = [t for t in toks if a <= t[0] < b]
        if form == "gs":
            firm.add(a)
            if g in given or len(inside) > 2:
                firm.add(inside[-1][0])
        elif form == "is":
            firm.update(t[0] for t in inside)
    taken = {t[0] for a, b, *_ in names for t in toks if a <= t[0] < b}
    out = []
    for k, t in enumerate(toks):
        if not _is_word(t) or t[0] in firm:
            continue
        w = t[3].casefold()
        if w not in given:
            out.append(w)
        if t[0] not in taken and k + 2 < len(toks) and toks[k + 1][2] == "," and _is_word(toks[k + 2]):
            out.append(w + ",")
    return out


_LEFT = re.compile(r"([\w’'=-]+|[^\w\s])\s*$")
_RIGHT = re.compile(r"\s*([\w’'=-]+|[^\w\s])")
_CLAUSE = re.compile(r"[\n,;|]|\.\s(?=[A-ZÀ-Þ])")
_DIGITS = re.compile(r"\d+")


def context(text: str, a: int, b: int) -> tuple[str, str]:
    """The word (or sign) before and after a span, on its line: case-folded, digits as 0."""
    left = text[max(0, a - 24) : a]
    k = left.rfind("\n")
    left = left[k + 1 :] if k >= 0 else left
    m = _LEFT.search(left)
    lw = m.group(1) if m else "^"
    right = text[b : b + 24]
    k = right.find("\n")
    right = right[:k] if k >= 0 else right
    m = _RIGHT.match(right)
    rw = m.group(1) if m else "$"
    return _DIGITS.sub("0", lw.casefold()), _DIGITS.sub("0", rw.casefold())


def shape(s: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "0", s))


def candidates(text: str, given: frozenset[str], memo: dict, learned: frozenset[str] = frozenset(), surnames: frozenset[str] = frozenset()) -> list[tuple]:
    """(kind, start, end, seed, form, given, surname, left, right) of one text; spans don't overlap.

    Listed given names are seeds, learned ones none. Where nothing is learned yet, a last row of kind 'word' holds the text's loose words in place of the form.
    """
    first = not (learned or surnames)
    known = given | learned if learned else given
    loose: set[str] = set()
    out: list[tuple] = []
    busy: list[tuple[int, int]] = []
    plain = text

    def mask(a: int, b: int) -> None:
        nonlocal plain
        plain = plain[:a] + "\x01" * (b - a) + plain[b:]

    if EMAIL_HINT.search(text):
        for m in EMAIL.finditer(text):
            a, b = m.span()
            s = m.group()
            out.append(("email", a, b, any(x in s for x in "@([{") or NOT_NAMES.isdisjoint(s.casefold().replace(" at ", " ").split()), "at" if "@" in s else "marked" if s[-1] in ")]}" or "[" in s or "(" in s or "{" in s else "spelled", "", "", *context(text, a, b)))
            busy.append((a, b))
        for a, b in busy:
            mask(a, b)
    spans = []
    for m in ADDRESS.finditer(plain) if any(w in text for w in STREET_WORDS) else ():
        a, b = m.span()
        out.append(("address", a, b, STREET_SEED.search(m.group()) is not None, shape(m.group())[:12], "", "", *context(text, a, b)))
        spans.append((a, b))
    for a, b in spans:
        mask(a, b)
    spans = []
    for m in ID.finditer(plain):
        a, b = m.span(1)
        around = _CLAUSE.split(plain[max(0, a - 34) : a])[-1]
        after = _CLAUSE.split(plain[b : b + 36])[0]
        labelled = bool(LABEL.search(around) or LABEL.search(after))
        out.append(("id_number", a, b, labelled, shape(m.group(1)), "", "", *context(text, a, b)))
        if labelled:
            spans.append((a, b))
    for a, b in spans:
        mask(a, b)
    spans = []
    for m in PHONE.finditer(plain):
        a, b = m.start(1), m.end()
        s = m.group(1)
        seed = s[0] in "+(" or s.startswith("00") or m.group().startswith("tel:")
        out.append(("phone", a, b, seed, shape(s), "", "", *context(text, a, b)))
        spans.append((a, b))
    for a, b in spans:
        mask(a, b)
    for m in SEQ.finditer(plain):
        seq = m.group()
        got = memo.get(seq)
        if got is None:
            names = parse_names(seq, known, surnames)
            got = names, loose_words(seq, names, known) if first else ()
            if len(memo) > 300_000:
                memo.clear()
            memo[seq] = got
        loose.update(got[1])
        for a, b, form, g, s in got[0]:
            a, b = a + m.start(), b + m.start()
            tail = plain[b : b + 2]
            if tail[:1] in "-’'" and tail[1:2].isalpha():
                continue
            out.append(("person", a, b, g in given, form, g, s, *context(text, a, b)))
    if loose:
        out.append(("word", 0, 0, False, "\x02".join(sorted(loose)), "", "", "", ""))
    return out


CANDIDATE = "kind string, start int, stop int, seed boolean, form string, given string, surname string, lw string, rw string"


def extract(rows: DataFrame, given: frozenset[str], learned: frozenset[str] = frozenset(), surnames: frozenset[str] = frozenset()) -> DataFrame:
    """Candidates of all rows (tbl, row_id, text). Null and empty texts have none."""
    # the given short list of name forms, of fixed size, and the learned names that stand loose somewhere, at most the names of the texts
    names = rows.sparkSession.sparkContext.broadcast((given, learned, surnames))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        listed, more, last = names.value
        cols = ["tbl", "row_id"] + [c.split()[0] for c in CANDIDATE.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(t, r, *c) for t, r, x in zip(pdf["tbl"], pdf["row_id"], pdf["text"]) if x for c in candidates(x, listed, memo, more, last)], columns=cols)

    return spread(rows.select("tbl", "row_id", "text")).mapInPandas(run, f"tbl string, row_id long, {CANDIDATE}")


def _known(x: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """x with the columns of table (key, ...) for its key; rows whose key is '' (all kinds but names, and lone names) have none and join nothing, so they don't meet in one task."""
    if plan_bytes(table) <= BROADCAST_BYTES:  # no row moves
        return x.join(F.broadcast(table), key, "left")
    more = [c for c in table.columns if c != key]
    named = x.where(F.col(key) != "").join(broadcast_if_small(table), key, "left")
    return named.unionByName(x.where(F.col(key) == "").select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in more]))


def _patterns(conf: DataFrame) -> DataFrame:
    """(kind, side, word, trust) of the graph with conf: how much of a pattern's candidates is confirmed. Frequent instances count five times at most, so that one can't carry a pattern."""
    n = F.least(F.col("n"), F.lit(5))
    pair = conf.groupBy("kind", "lw", "rw").agg(F.sum(n * F.col("conf")).alias("w"), F.sum(n).alias("n"), F.count_distinct(F.when(F.col("conf") > 0.5, F.concat_ws("|", "form", "given", "surname"))).alias("k"))
    sides = F.array(F.struct(F.lit("b").alias("side"), F.concat_ws("\x02", "lw", "rw").alias("word")), F.struct(F.lit("l").alias("side"), F.col("lw").alias("word")), F.struct(F.lit("r").alias("side"), F.col("rw").alias("word")))
    each = pair.select("kind", F.explode(sides).alias("s"), "w", "n", "k").groupBy("kind", "s.side", "s.word").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    return each.where((F.col("k") >= SUPPORT) | (F.col("n") >= 10)).select("kind", "side", "word", (F.col("w") / (F.col("n") + 0.5)).alias("trust"))


def _trusted(x: DataFrame, patterns: DataFrame) -> DataFrame:
    """x with t_l and trust: the trust of the pattern on the left, and of both sides: of the pair as such, else the mean of the two."""
    pick = lambda side, name: broadcast_if_small(patterns.where(F.col("side") == side).select("kind", F.col("word").alias(name), F.col("trust").alias(f"t_{side}")))
    x = x.withColumn("bw", F.concat_ws("\x02", "lw", "rw"))
    x = x.join(pick("b", "bw"), ["kind", "bw"], "left").join(pick("l", "lw"), ["kind", "lw"], "left").join(pick("r", "rw"), ["kind", "rw"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.withColumn("trust", F.greatest(zero("t_b"), F.sqrt(zero("t_l") * zero("t_r")))).withColumn("t_l", zero("t_l")).drop("bw", "t_b", "t_r")


def score(cands: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of patterns (kind, side, word, trust), of surnames and of given names.

    The graph is the table of distinct (kind, instance, pattern) with counts; instances repeat, so it is far smaller than the
    candidates. Each round, written to the shared folder: patterns from the instances' confidence; surnames and given names from patterns and each other; then the confidence of every
    instance in its pattern anew: names by what is known of their parts, numbers, addresses and mail addresses by their seeds and by the patterns that they stand in.
    """
    graph = cands.groupBy("kind", "form", "given", "surname", "lw", "rw").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    graph = materialize(graph, "pii-graph")
    conf = graph.withColumn("conf", F.col("seed").cast("double"))
    for r in range(rounds):
        patterns = materialize(_patterns(conf), "pii-patterns")
        people = conf.where("kind = 'person' and surname <> ''")
        surnames = (
            people.groupBy("surname")
            .agg(F.count_distinct(F.when(F.col("conf") > 0.5, F.col("given"))).alias("k"), (F.sum(F.when(F.col("form") != "is", F.col("n") * F.col("conf"))) / F.sum(F.when(F.col("form") != "is", F.col("n")))).alias("p"))
            .where((F.col("k") >= 2) & (F.col("p") >= 0.4))
            .select("surname", F.lit(True).alias("known_s"))
        )
        surnames = materialize(surnames, "pii-surnames")
        givens = (
            people.where("given <> '' and form in ('gs', 'sg')").join(broadcast_if_small(surnames), "surname", "left")
            .groupBy("given").agg(F.max("seed").alias("seed"), F.count_distinct(F.when(F.col("known_s"), F.col("surname"))).alias("k"), (F.sum(F.when(F.col("known_s"), F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))
            .where(F.col("seed") | ((F.col("k") >= 2) & (F.col("p") >= 0.5)))
            .select("given", F.lit(True).alias("known_g"))
        )
        givens = materialize(givens, "pii-givens")
        if r + 1 < rounds:
            x = _known(_known(_trusted(graph, patterns), surnames, "surname"), givens, "given")
            ks, kg = F.coalesce("known_s", F.lit(False)), F.coalesce("known_g", F.lit(False))
            person = F.when(kg & (ks | (F.col("surname") == "")), 1.0).when(ks, 0.8).otherwise(F.col("seed").cast("double") * 0.5)
            shaped = F.when(F.col("seed") | (F.col("trust") >= TRUST), 1.0).otherwise(0.0)
            conf = x.withColumn("conf", F.when(F.col("kind") == "person", person).otherwise(shaped)).select(*graph.columns, "conf")
    return patterns, surnames, givens


def with_learned(rows: DataFrame, given: frozenset[str], cands: DataFrame, words: DataFrame, surnames: DataFrame, givens: DataFrame) -> DataFrame:
    """The candidates, those of texts with loose learned names found anew."""
    key = ["tbl", "row_id"]
    names = givens.select(F.col("given").alias("word")).unionByName(surnames.select(F.concat("surname", F.lit(",")).alias("word")))
    loose = words.select(*key, F.explode(F.split("form", "\x02")).alias("word"))
    hits = materialize(loose.join(broadcast_if_small(names), "word"), "pii-loose")
    learned = [r["word"] for r in hits.select("word").distinct().collect()]  # at most the learned names
    if not learned:
        return cands
    again = broadcast_if_small(hits.select(*key).distinct())
    texts = materialize(rows.select(*key, "text").join(again, key, "left_semi"), "pii-again")
    anew = extract(texts, given, frozenset(w for w in learned if not w.endswith(",")), frozenset(w[:-1] for w in learned if w.endswith(",")))
    return cands.join(again, key, "left_anti").unionByName(anew)


def find(rows: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(tbl, row_id, pii_kind, start_at, stop_at) of every item."""
    given = frozenset(x.casefold() for r in name_forms.select("form", "full_form").collect() for x in r if x)  # a fixed list of short forms
    first = materialize(extract(rows, given), "pii-candidates")
    cands = first.where("kind <> 'word'")
    p, surnames, givens = score(cands)
    cands = with_learned(rows, given, cands, first.where("kind = 'word'"), surnames, givens)
    x = _known(_known(_trusted(cands, p), surnames, "surname"), givens, "given")
    trust = F.col("trust")
    ks, kg = F.coalesce("known_s", F.lit(False)), F.coalesce("known_g", F.lit(False)) | F.col("seed")
    person = (
        F.when(F.col("form") == "g", kg & (F.greatest(trust, F.col("t_l") * 0.7) >= TRUST))
        .when(F.col("form") == "is", ks | (trust >= 0.7))
        .when(F.col("form") == "sg", (ks & (kg | (F.col("given") == "") | (trust >= TRUST))) | (kg & (trust >= TRUST)))
        .otherwise((kg & (ks | (trust >= TRUST))) | ks)
    )
    ok = F.when(F.col("kind") == "person", person).otherwise(F.col("seed") | (trust >= TRUST_NUMBER))
    x = x.where(ok).select("tbl", "row_id", "kind", "start", "stop")
    # An identity number that is also a phone number is what more of its candidates say: labelled ones were set aside already, so the phone holds.
    w = F.struct(F.when(F.col("kind") == "id_number", 0).otherwise(1).alias("o"), F.col("stop"), F.col("kind"))
    return x.groupBy("tbl", "row_id", "start").agg(F.max(w).alias("w")).select("tbl", "row_id", F.col("w.kind").alias("pii_kind"), F.col("start").alias("start_at"), F.col("w.stop").alias("stop_at"))


def found(rows: DataFrame, name_forms: DataFrame) -> DataFrame:
    return find(rows, name_forms).select("tbl", "row_id", "pii_kind", "start_at")


def redact_text(text: str, items: list[tuple[int, int, str]]) -> str:
    """Put the placeholder of its kind in the place of each item; of overlapping items the first holds."""
    out, at = [], 0
    for a, b, kind in sorted(items):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[kind]]
            at = b
    return "".join([*out, text[at:]])


def redact(rows: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(tbl, row_id, n_items, text) of the rows that hold items."""
    items = find(rows, name_forms).groupBy("tbl", "row_id").agg(F.collect_list(F.struct("start_at", "stop_at", "pii_kind")).alias("items"))
    hit = rows.select("tbl", "row_id", "text").join(items, ["tbl", "row_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [redact_text(t, [(i["start_at"], i["stop_at"], i["pii_kind"]) for i in s]) for t, s in zip(pdf["text"], pdf["items"])]
            yield pd.DataFrame({"tbl": pdf["tbl"], "row_id": pdf["row_id"], "n_items": [len(s) for s in pdf["items"]], "text": texts})

    return hit.mapInPandas(run, "tbl string, row_id long, n_items int, text string")

"""Variant spellings of the names of people and organisations: linking those that mean the same one.

A name is parsed into a stem (surname, or the proper part of an organisation's name) and the rest (given name; trade). Stems are joined
by the edit distance: from LONG letters on within radius RADIUS of the Levenshtein distance, a true metric; shorter ones, from SHORTEST letters on, within one slip (an edit or a swap of
neighbours). Nearest-pivot cells alone don't part such stems: their distances
to any pivot lie so close together that the triangle inequality copies nearly every stem into nearly every cell (see README). So the
cells are those of the pigeonhole principle (of RADIUS + 1 segments of a long stem one is unharmed) and of single deletions (short ones); inside a cell the distances to fixed pivots
prune by the triangle inequality, and the exact distance decides. The join is exact.

Records of a person are then linked pair by pair, by joins: stems that are neighbours, given names that are equal, share a full form or differ by typing errors. Classes are the
connected components of those links. Abbreviations, initials and lone surnames look up the classes that they fit by (stem, start of the given name). No step gathers a surname's records in one place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import BROADCAST_BYTES, materialize, parallel, plan_bytes

#: Times its Parquet files that a table of names takes as a broadcast (measured: 10 to 15).
PACKED = 16
#: Radius of the stem join.
RADIUS = 2
#: Number of pivots, whatever the size of the data.
PIVOTS = 6
#: Stems of at least LONG letters are joined within the radius; of a pair with a shorter one, both within one slip; stems below SHORTEST letters, which one slip turns into any other, only if equal.
LONG, SHORTEST = 6, 3

# Titles and additions of people; legal forms, additions and trades of organisations with their short forms.
TITLES = frozenset("mr mrs ms miss dr prof sir madam mme mlle m herr frau hr fr sr sra srta don dona ing dipl".split())
SUFFIXES = frozenset("phd md jr sr esq msc bsc ma ba mba dds ii iii iv".split())
LEGAL = (
    ("gmbh", r"\bg\.?\s?m\.?\s?b\.?\s?h\b\.?|\bges(?:ellschaft)?\.?\s?m\.?\s?b\.?\s?h\b\.?"),
    ("sa", r"\bs\.\s?a\.?(?=\W|$)|\bsa\b|\bsoci[eé]t[eé]\s+anonyme\b|\bsociedad\s+an[oó]nima\b"),
    ("ltd", r"\blimited\b|\bltd\b\.?"),
    ("inc", r"\bincorporated\b|\binc\b\.?"),
    ("coop", r"\bco-?operative\b|\bco-?op\b\.?"),
    ("sons", r"(?:&|\band\b|\+|,)\s*(?:\+\s*)?sons\b"),
    ("co", r"\bcompany\b|\bco\b\.?(?!-)|\bgroup\b|\bcorp(?:oration)?\b\.?|\bholding(?:s)?\b"),
)
TRADES = {
    "laboratories": "labs lab laboratory", "services": "svcs svc serv", "consulting": "cons consult", "engineering": "eng engg engrg", "foundation": "fdn found fnd",
    "freight": "frt frght", "instruments": "instr inst instrs", "logistics": "log logist lgs", "manufacturing": "mfg manuf mfrg", "museum": "mus",
    "shipping": "shpg ship shp", "university": "univ uni", "institute": "instit", "trading": "trdg trad", "systems": "sys syst", "partners": "ptnrs",
    "association": "assoc assn", "insurance": "ins insur", "hospital": "hosp", "bank": "bk",
}
_TRADE = {a: t for t, short in TRADES.items() for a in [t, *short.split()]}


def ascii_fold(s: str) -> str:
    s = s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("ł", "l").replace("’", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def slipped(a: str, b: str) -> int:
    """Typing errors between two words: like the edit distance, but a swap of neighbours counts once."""
    if a == b:
        return 0
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, cur[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            cur.append(d)
        rows.append(cur)
    return rows[-1][-1]


def parse_person(name: str, given: frozenset[str]) -> tuple[str, str, str]:
    """(stem, form, given): the surname without marks, and the given name: full, an abbreviation ('abi.'), an initial or none."""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name).strip()
    s = re.sub(r"@\S+$", "", s)
    if " " not in s and re.fullmatch(r"[^\W\d_]+(?:[._][^\W\d_'-]+)+", s):
        s = re.sub(r"[._]", " ", s)
    head, _, tail = s.partition(",")
    tail = tail.strip()
    while tail and ascii_fold(tail.rsplit(",")[-1]).replace(".", "").strip() in SUFFIXES:
        tail = tail.rpartition(",")[0].strip()
    caps = [w for w in head.split() if len(w) > 2 and w.isupper()]
    words = [w for w in head.split() if ascii_fold(w).strip(".") not in TITLES or len(head.split()) == 1]
    if tail:
        surname, first = " ".join(words), tail.split()
    elif len(words) < 2:
        surname, first = " ".join(words), []
    elif caps and len(caps) < len(words) and words[0] == caps[0]:
        k = next(i for i, w in enumerate(words) if w not in caps)
        surname, first = " ".join(words[:k]), words[k:]
    elif ascii_fold(words[-1]) in given and ascii_fold(words[0]) not in given and not words[0].endswith("."):
        surname, first = words[0], words[-1:]
    else:
        k = 1
        while k < len(words) - 1 and re.fullmatch(r"\w\.?|(?:\w\.)+", words[k]):
            k += 1
        surname, first = " ".join(words[k:]), words[:k]
    stem = re.sub(r"[^\w]", "", ascii_fold(surname)).replace("_", "")
    g = ascii_fold(first[0]) if first else ""
    g = ascii_fold(first[1]) if g.strip(".") in TITLES and len(first) > 1 else g
    letters = re.sub(r"[^\w]", "", g)
    form = "none" if not letters else "initial" if len(letters) == 1 else "short" if g.endswith(".") else "full"
    return stem, form, letters


def parse_org(name: str) -> tuple[str, str, str]:
    """(stem, trade, legal form): the proper words joined; the trade by its full name, '' if there is none."""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name)
    low = ascii_fold(s)
    legal = ""
    for form, pattern in LEGAL:
        new = re.sub(pattern, " ", low)
        if new != low:
            legal, low = legal or form, new
    words = [w for w in re.findall(r"[^\W_]+", low.replace("'", "")) if w not in ("the", "and")]
    at = next((i for i in reversed(range(len(words))) if words[i] in _TRADE), None)
    if at is None and len(words) > 1:
        at = next((i for i in (len(words) - 1, 0) for t in TRADES if len(words[i]) > 5 and slipped(words[i], t) <= 1), None)
        trade = next((t for t in TRADES if at is not None and slipped(words[at], t) <= 1), "")
    else:
        trade = _TRADE[words[at]] if at is not None else ""
    if at is not None:
        words = words[:at] + words[at + 1 :]
    return "".join(words), trade, legal


def parsed(entities: DataFrame, given: frozenset[str]) -> DataFrame:
    """(id, kind, stem, form, rest) of entities (id, name, kind person or org). Names without letters have an empty stem and link to nothing."""
    names = entities.sparkSession.sparkContext.broadcast(given)  # the short list of name forms, of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = names.value
        for pdf in batches:
            out = []
            for i, name, kind in zip(pdf["id"], pdf["name"], pdf["kind"]):
                if not name:
                    out.append((i, kind, "", "", ""))
                elif kind == "org":
                    stem, trade, legal = parse_org(name)
                    out.append((i, kind, stem, legal, trade))
                else:
                    stem, form, g = parse_person(name, known)
                    out.append((i, kind, stem, form, g))
            yield pd.DataFrame(out, columns=["id", "kind", "stem", "form", "rest"])

    return entities.select("id", "name", "kind").mapInPandas(run, "id long, kind string, stem string, form string, rest string")


def segments(length: int, parts: int = RADIUS + 1) -> list[tuple[int, int]]:
    """Start and length of the nearly equal segments of a stem."""
    base, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (1 if i >= parts - more else 0)
        out.append((at, size))
        at += size
    return out


def index_keys(s: str) -> list[str]:
    return [f"{len(s)}.{i}.{s[a : a + n]}" for i, (a, n) in enumerate(segments(len(s)))]


def probe_keys(s: str) -> list[str]:
    """Every key under which a stem at most as long as s, and within the radius, has an unharmed segment."""
    out = set()
    for length in range(max(LONG, len(s) - RADIUS), len(s) + 1):
        for i, (a, n) in enumerate(segments(length)):
            for x in range(max(0, a - RADIUS), min(len(s) - n, a + RADIUS) + 1):
                out.add(f"{length}.{i}.{s[x : x + n]}")
    return list(out)


def deletions(s: str) -> list[str]:
    """The word and every single deletion of it: words within one slip share one."""
    return list({s, *(s[:i] + s[i + 1 :] for i in range(len(s)))})


def _keyed(words: DataFrame, fn, name: str) -> DataFrame:
    """(block, key, name, d_name) of words (block, stem, d) for every key that fn gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(b, k, s, x) for b, s, x in zip(pdf["block"], pdf["stem"], pdf["d"]) for k in fn(s)]
            yield pd.DataFrame(rows, columns=["block", "key", name, f"d_{name}"])

    return words.mapInPandas(run, f"block string, key string, {name} string, d_{name} array<int>")


def _sorted_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """A join of two _keyed() sides that sorts both. Spark takes a Python step to yield as many rows as it gets, so by its estimate it would broadcast keys that are a hundred times larger."""
    return left.join(right.hint("merge"), on)


def _written(df: DataFrame, name: str) -> DataFrame:
    """materialize(), for tables that grow with the input: Spark judges one by its compressed files, so the joins of one that would unpack beyond BROADCAST_BYTES are told to sort."""
    table = materialize(df, name)
    return table.hint("merge") if plan_bytes(table) * PACKED > BROADCAST_BYTES else table


def _slips(pairs: DataFrame) -> DataFrame:
    """Adds slip, the number of typing errors between a and b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(slip=[slipped(a, b) for a, b in zip(pdf["a"], pdf["b"])])

    return pairs.select("block", "a", "b").mapInPandas(run, "block string, a string, b string, slip int")


def stem_links(stems: DataFrame) -> DataFrame:
    """(block, a, b, slip), a < b, of different stems of one block that are near; stems: distinct (block, stem). Exact: see LONG and SHORTEST."""
    pivots = [r["stem"] for r in stems.select("stem").distinct().orderBy(F.xxhash64("stem")).limit(PIVOTS).collect()]
    d = [F.levenshtein(F.col("stem"), F.lit(p)) for p in pivots]
    base = parallel(stems, "block", "stem").select("block", "stem", F.array(*d).alias("d") if d else F.array().cast("array<int>").alias("d"))
    long, short = base.where(F.length("stem") >= LONG), base.where(F.length("stem").between(SHORTEST, LONG))

    def met(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
        cond = (left["block"] == right["block"]) & (left["key"] == right["key"]) & (F.col("a") != F.col("b"))
        for i in range(len(pivots)):
            cond = cond & (F.abs(F.col("d_a")[i] - F.col("d_b")[i]) <= radius)  # |d(a, p) - d(b, p)| <= d(a, b): the triangle inequality
        cond = cond & (F.levenshtein(F.col("a"), F.col("b"), radius) >= 0)
        return _sorted_join(left, right, cond).select(left["block"], F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    far = met(_keyed(long, index_keys, "a"), _keyed(long, probe_keys, "b"), RADIUS)
    near = met(_keyed(short, deletions, "a"), _keyed(short, deletions, "b"), 2)  # a swap is two edits
    near = near.where(F.least(F.length("a"), F.length("b")) < LONG)
    return _slips(parallel(far.unionByName(near), "block", "a", "b").distinct()).where((F.col("slip") <= 1) | (F.least(F.length("a"), F.length("b")) >= LONG))


def _directed(links: DataFrame) -> DataFrame:
    """links (block, a, b, ...) in both directions. One reference to links: a union of two would plan, and where nothing is reused run, all that is behind them twice."""
    rest = [c for c in links.columns if c not in ("block", "a", "b")]
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    return links.select("block", ends, *rest).select("block", "x.a", "x.b", *rest)


def components(links: DataFrame) -> DataFrame:
    """(block, stem, cluster) of the nodes that links (block, a, b) touch: the least node that hangs together with each.

    Labels spread along links and jump along themselves until none changes, which takes about the logarithm of the longest chain; labels only fall, so it ends. Every round is written to
    the shared folder.
    """
    both = _written(_directed(links.select("block", "a", "b")).distinct(), "links")
    label = both.select("block", F.col("a").alias("stem")).distinct().withColumn("cluster", F.col("stem"))
    while True:
        spread = both.join(label.withColumnRenamed("stem", "b"), ["block", "b"]).groupBy("block", F.col("a").alias("stem")).agg(F.min("cluster").alias("near"))
        step = label.join(spread, ["block", "stem"]).select("block", "stem", F.least("cluster", "near").alias("cluster"), F.col("cluster").alias("was"))
        jump = step.select("block", F.col("stem").alias("cluster"), F.col("cluster").alias("far"))
        new = step.join(jump, ["block", "cluster"], "left").select("block", "stem", F.least(F.col("cluster"), F.coalesce("far", "cluster")).alias("cluster"), "was")
        new = _written(new, "labels")
        label = new.drop("was")
        if new.where(F.col("cluster") != F.col("was")).isEmpty():
            return label


#: Learning short forms: least number of surnames that share a pair; least share of the short form's surnames; least ratio of shared surnames to those that chance would give.
LEARN_LEAST, LEARN_SHARE, LEARN_LIFT = 2, 0.5, 4


def learned_forms(people: DataFrame, full: DataFrame) -> DataFrame:
    """(short, full) given names that stand for each other though no list says so: one stands beside the other under several surnames, and mostly beside that one.

    people: distinct (surname, g). full: (g) listed full forms, which are no short forms of others. All surnames count, also those with many given names. Pairs are not made of all the
    given names of a surname: a partner must share at least need = max(LEARN_LEAST, LEARN_SHARE n) of a name's n surnames, so it stands under one of the n - need + 1 surnames with the
    fewest given names, and only those propose partners; the shared surnames of the proposed pairs are then counted in full.
    """
    size = people.groupBy("surname").agg(F.count(F.lit(1)).alias("k"))
    n = people.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    names = people.join(n.where(F.col("n") >= LEARN_LEAST), "g").join(full, "g", "left_anti")  # possible short forms
    sized = names.join(size, "surname").where("k > 1")
    per = sized.groupBy("g", "n").agg(F.array_sort(F.collect_list(F.struct("k", "surname"))).alias("s"))  # the surnames of one given name
    need = F.greatest(F.lit(LEARN_LEAST), F.ceil(F.col("n") * LEARN_SHARE))
    prefix = per.withColumn("room", (F.col("n") - need + 1 - (F.col("n") - F.size("s"))).cast("int")).where("room > 0")  # surnames with no other given name offer none
    prefix = prefix.select("g", "n", F.explode(F.slice("s", F.lit(1), F.col("room"))).alias("x")).select("g", "n", F.col("x.surname").alias("surname"))
    pairs = prefix.join(people.withColumnRenamed("g", "h"), "surname").where("g <> h").select("g", "n", "h").distinct()
    pairs = pairs.join(n.select(F.col("g").alias("h"), F.col("n").alias("m")), "h").where(F.col("m") >= F.col("n") * LEARN_SHARE)
    both = pairs.join(people, "g").join(people.withColumnRenamed("g", "h"), ["h", "surname"], "left_semi").groupBy("g", "h", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    total = F.broadcast(size.agg(F.count(F.lit(1)).alias("t")))  # one row
    both = both.crossJoin(total).where((F.col("k") >= LEARN_LEAST) & (F.col("k") >= LEARN_SHARE * F.col("n")) & (F.col("k") * F.col("t") >= LEARN_LIFT * F.col("n") * F.col("m")))
    return both.select(F.col("g").alias("short"), F.col("h").alias("full"))


def _near(links: DataFrame, block: str, own: DataFrame) -> DataFrame:
    """(a, b, slip) in both directions and of every word with itself; own: distinct (stem)."""
    x = _directed(links.where(F.col("block") == block))
    return x.select("a", "b", "slip").unionByName(own.select(F.col("stem").alias("a"), F.col("stem").alias("b"), F.lit(0).alias("slip")))


def same_person(full: DataFrame, near: DataFrame, canon: DataFrame, given: DataFrame, listed: DataFrame) -> DataFrame:
    """(block, a, b): links of records with full given names; a record is 'stem.given'.

    full: distinct (s, g). near: neighbouring stems. canon: (g, f), every given name with the full forms that it may stand for. given: neighbouring given names. Two records are one person if
    their stems are within two typing errors and their given names share a form; or if a given name that no list has differs by one error (stems by one at most), or two unlisted
    ones of six letters or more by two and the stems are equal.
    """
    record = lambda s, g: F.concat_ws(".", s, g)
    formed = full.join(canon, "g")
    x = formed.join(near.where("slip <= 2").select(F.col("a").alias("s"), F.col("b").alias("t")), "s")
    y = formed.select(F.col("s").alias("t"), F.col("g").alias("h"), "f")
    alike = x.join(y, ["t", "f"]).select(record("s", "g").alias("a"), record("t", "h").alias("b"))
    typo = given.where((F.col("slip") > 0) & (F.least(F.length("a"), F.length("b")) >= 3)).select(F.col("a").alias("g"), F.col("b").alias("h"), F.col("slip").alias("k"))
    mark = listed.withColumn("_l", F.lit(1))
    typo = typo.join(mark, "g", "left").join(mark.select(F.col("g").alias("h"), F.col("_l").alias("_m")), "h", "left")
    typo = typo.where(((F.col("k") == 1) & (F.col("_l").isNull() | F.col("_m").isNull())) | ((F.col("k") == 2) & F.col("_l").isNull() & F.col("_m").isNull() & (F.least(F.length("g"), F.length("h")) >= 6)))
    z = full.join(typo.select("g", "h", "k"), "g").join(near.select(F.col("a").alias("s"), F.col("b").alias("t"), "slip"), "s")
    z = z.where((F.col("slip") == 0) | (F.col("k") == 1) & (F.col("slip") <= 1))
    erred = z.join(full.select(F.col("s").alias("t"), F.col("g").alias("h")), ["t", "h"], "left_semi").select(record("s", "g").alias("a"), record("t", "h").alias("b"))
    return alike.unionByName(erred).where("a < b").distinct().select(F.lit("person").alias("block"), "a", "b")


def placed(rest: DataFrame, full: DataFrame, near: DataFrame, canon: DataFrame) -> DataFrame:
    """(s, form, g, entity) of the records without a full given name: distinct (s, form, g), form short, initial or none.

    full: (s, g, entity). A record joins the only entity whose given names begin like its own (a lone surname: the only entity of its stem and the neighbouring ones). If it fits several: the only one that fits
    of its own stem, first by given names as they stand. Else it stays with those of its stem and first letter. Entities are looked up by (stem, start of a given
    name); of each only the least and the greatest is kept, which tells none, one or several apart, so a surname with many given names costs a row a name.
    """
    starts = full.join(canon, "g").select("s", "entity", F.col("f").alias("name"), (F.col("f") == F.col("g")).alias("own"))
    starts = starts.select("s", "entity", "own", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring("name", F.lit(1), n))).alias("p"))
    lo, hi = (lambda c: F.min(c)), (lambda c: F.max(c))
    direct = F.when(F.col("own"), F.col("entity"))
    index = starts.groupBy("s", "p").agg(lo("entity").alias("lo"), hi("entity").alias("hi"), lo(direct).alias("own_lo"), hi(direct).alias("own_hi"))
    # Abbreviations of three letters or more may hold one typing error.
    words = rest.where("form = 'short' and length(g) > 2").select(F.col("g").alias("stem")).distinct()
    heads = starts.where(F.length("p") > 2).select(F.col("p").alias("stem")).distinct()
    none = F.array().cast("array<int>")
    keyed = lambda df, name: _keyed(df.select(F.lit("").alias("block"), "stem", none.alias("d")), deletions, name)
    met = _sorted_join(keyed(words, "a"), keyed(heads, "b"), ["block", "key"]).where((F.col("a") != F.col("b")) & (F.length("a") == F.length("b"))).select("block", "a", "b").distinct()
    odd = _slips(met).where("slip <= 1").select(F.col("a").alias("g"), F.col("b").alias("p"))
    asked = rest.select("g").distinct().select("g", F.col("g").alias("p")).unionByName(odd)
    x = rest.join(near.where("slip <= 2").select(F.col("a").alias("s"), F.col("b").alias("t")), "s").join(asked, "g")
    x = x.join(index.withColumnRenamed("s", "t"), ["t", "p"])
    same = F.col("t") == F.col("s")
    exact = same & (F.col("p") == F.col("g"))
    k = x.groupBy("s", "form", "g").agg(
        F.min("lo").alias("a_lo"), F.max("hi").alias("a_hi"), F.min(F.when(same, F.col("lo"))).alias("b_lo"), F.max(F.when(same, F.col("hi"))).alias("b_hi"),
        F.min(F.when(exact, F.col("own_lo"))).alias("c_lo"), F.max(F.when(exact, F.col("own_hi"))).alias("c_hi"),
    )
    only = lambda c: F.when(F.col(f"{c}_lo") == F.col(f"{c}_hi"), F.col(f"{c}_lo"))
    named = F.col("form") != "none"
    hit = F.coalesce(only("a"), F.when(named, only("c")), F.when(named, only("b")))
    alone = F.concat_ws("|", F.lit("person~"), "s", F.substring("g", 1, 1), F.when(F.col("a_lo").isNotNull(), "several").otherwise("none"))
    return rest.join(k, ["s", "form", "g"], "left").select("s", "form", "g", F.coalesce(hit, alone).alias("entity"))


def entities(nodes: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(id, entity): one row an entity node (id, name, kind), with the class it belongs to. Names that are null, or have no letters, are in none."""
    rows = [(ascii_fold(r["form"]), ascii_fold(r["full_form"])) for r in name_forms.select("form", "full_form").collect() if r["form"] and r["full_form"]]  # a fixed list
    spark = nodes.sparkSession
    p = _written(parsed(nodes, frozenset(x for r in rows for x in r)).where("stem <> ''"), "names")
    p = p.withColumn("block", F.when(F.col("kind") == "org", F.concat(F.lit("org."), F.col("rest"))).otherwise(F.lit("person")))
    persons = _written(p.where("kind = 'person'").groupBy(F.col("stem").alias("s"), "form", F.col("rest").alias("g")).agg(F.count(F.lit(1)).alias("n")), "people")
    full = persons.where("form = 'full'").select("s", "g")
    # Surnames, organisations' stems and given names are three kinds of blocks of one join. What later steps read more than once is written: the driver plans, compiles and reports every copy of an expression.
    stems = p.select("block", "stem").unionByName(full.select(F.lit("given").alias("block"), F.col("g").alias("stem")))
    stems = _written(stems.groupBy("block", "stem").agg(F.count(F.lit(1)).alias("n")), "stems")
    links = _written(stem_links(stems.select("block", "stem")), "stem-links")
    near = _written(_near(links, "person", stems.where("block = 'person'").select("stem")), "near")
    given = _near(links, "given", full.select(F.col("g").alias("stem")).limit(0))

    pairs = spark.createDataFrame(rows, "short string, full string")
    listed_full = pairs.select(F.col("full").alias("g")).distinct()
    # A surname and its rarer misspellings are one surname here: each stem counts as the most frequent of its neighbours.
    often = stems.where("block = 'person'").select(F.col("stem").alias("b"), "n")
    lead = near.join(often, "b").groupBy(F.col("a").alias("s")).agg(F.max_by("b", F.struct("n", "b")).alias("surname"))
    surnames = _written(full.join(lead, "s").select("surname", "g").distinct(), "surnames")
    learned = materialize(learned_forms(surnames, listed_full), "forms")
    forms = pairs.unionByName(learned).distinct()
    # A learned short form stands for what its partner stands for, too.
    further = learned.join(pairs.select(F.col("short").alias("full"), F.col("full").alias("f")), "full").select("short", F.col("f").alias("full"))
    vocabulary = full.select("g").distinct()
    canon = _written(vocabulary.select("g", F.col("g").alias("f")).unionByName(forms.unionByName(further).select(F.col("short").alias("g"), F.col("full").alias("f"))).distinct(), "canon")
    listed = materialize(forms.select(F.explode(F.array("short", "full")).alias("g")).distinct(), "listed")

    # A short stem of an organisation, which no given name confirms, only joins a stem that stands at least twice as often.
    org = links.where(F.col("block").startswith("org."))
    n = stems.select("block", F.col("stem").alias("a"), F.col("n").alias("n_a"))
    org = org.join(n, ["block", "a"]).join(n.select("block", F.col("a").alias("b"), F.col("n_a").alias("n_b")), ["block", "b"])
    org = org.where((F.least(F.length("a"), F.length("b")) >= LONG) | (F.greatest("n_a", "n_b") >= 2 * F.least("n_a", "n_b"))).select("block", "a", "b")
    classes = components(same_person(full, near, canon, given, listed).unionByName(org))

    orgs = p.where("kind = 'org'").join(classes, ["block", "stem"], "left").select("id", F.concat_ws("|", "block", F.coalesce("cluster", "stem")).alias("entity"))
    mine = classes.where("block = 'person'").select(F.col("stem").alias("r"), "cluster")
    whole = full.withColumn("r", F.concat_ws(".", "s", "g")).join(mine, "r", "left").select("s", "g", F.concat_ws("|", F.lit("person"), F.coalesce("cluster", "r")).alias("entity"))
    whole = _written(whole, "whole")
    others = placed(persons.where("form <> 'full'").select("s", "form", "g"), whole, near, canon)
    every = whole.select("s", F.lit("full").alias("form"), "g", "entity").unionByName(others)
    people = p.where("kind = 'person'").select("id", F.col("stem").alias("s"), "form", F.col("rest").alias("g"))
    return orgs.unionByName(people.join(every, ["s", "form", "g"]).select("id", "entity"))


def linked_pairs(nodes: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of nodes of one entity. An entity with many nodes is cut into shards (skew_join); entities() gives the classes without the pairs."""
    e = materialize(entities(nodes, name_forms), "entities")
    a, b = e.select(F.col("id").alias("id_a"), "entity"), e.select(F.col("id").alias("id_b"), "entity")
    return skew_join(a, b, ["entity"], ["id_a"]).where("id_a < id_b").select("id_a", "id_b")

"""Full-text search: tokens, postings, BM25 with phrases, recall over facts and chunks with fusion."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread

# BM25's parameters, the least idf, and the weights of recall.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FACT, CHUNK, PROJECT, GLOBAL, PINNED, SEMANTIC = 1.30, 1.0, 1.0, 0.82, 10.0, 0.75
FLOOR = 0.35

TOKEN = "[\\p{L}\\p{N}]+"
_WORDS = re.compile(r"[A-Za-z0-9_]+")
_QUOTED = re.compile(r'"([^"]+)"')
_TERM = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_./-]*")
_TOKEN = re.compile(r"[^\W_]+")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits; every other character separates."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def parse_query(query: str) -> list[str]:
    """The graph search's terms: ASCII words of more than one character, repeats kept; a word with an underscore is a phrase of its parts."""
    return [w for w in _WORDS.findall(query) if len(w) > 1]


def parse_recall(query: str) -> list[str]:
    """Recall's terms: quoted phrases, and words without leading or trailing dots, slashes and hyphens, of at least two characters; [] if there is none."""
    out = [p.strip() for p in _QUOTED.findall(query) if p.strip()]
    return out + [w for w in (w.strip("./-") for w in _TERM.findall(_QUOTED.sub(" ", query))) if len(w) >= 2]


def phrase(term: str, stem: bool = True) -> list[str]:
    """The tokens that a quoted term stands for."""
    words = _TOKEN.findall(X.plain_letters(term).lower() if stem else term.lower())
    return [X.porter(w) for w in words] if stem else words


def _also(word: str):
    return lambda so_far, t: so_far & (t == word)


def _hits(toks: Column, words: list[str]) -> Column:
    """How often a phrase stands in a token array."""
    if len(words) == 1:
        return F.size(F.filter(toks, lambda t: t == words[0]))
    here = F.transform(toks, lambda t: t == words[0])
    for k, w in enumerate(words[1:], 2):  # zipped with the tokens k - 1 places on, so the tokens are made a few times a row, not once a position
        here = F.zip_with(here, F.slice(toks, k, 1 << 30), _also(w))
    return F.size(F.filter(here, lambda x: F.coalesce(x, F.lit(False))))


def _bm25(tf: Column, n: Column, dl: Column, total: Column, mean: Column) -> Column:
    idf = F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))).otherwise(0.0)


def search_scan(docs: DataFrame, terms: Sequence[str], id_col: str = "uid", text_col: str = "body", stem: bool = False) -> DataFrame:
    """All rows of docs that hold a term or phrase, with their BM25 score. One pass over the texts and one row of totals; nothing is shuffled but that row.

    Equal terms count twice. The totals are those of all rows, so filter afterwards to search within a kind. No usable terms, or no rows: no result.
    With stem, a token's index form comes from an Arrow UDF over the distinct tokens; use search_index() for repeated searches instead.
    """
    wanted = [w for w in (phrase(t, stem) for t in terms) if w]
    if not wanted:
        return docs.limit(0).withColumn("score", F.lit(0.0))
    docs = spread(docs)
    if stem:
        base = _stemmed(docs, id_col, text_col).withColumn("_dl", F.size("_t").cast("double"))
        for i, w in enumerate(wanted):
            base = base.withColumn(f"_f{i}", _hits(F.col("_t"), w))
        base = base.drop("_t")
    else:  # tokens are made of texts that hold a phrase's letters at all; the others are only counted
        low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        base = docs.withColumn("_dl", F.regexp_count(low, F.lit(TOKEN)).cast("double"))
        for i, w in enumerate(wanted):
            may = low.contains(w[0])
            for x in w[1:]:
                may = may & low.contains(x)
            base = base.withColumn(f"_f{i}", F.when(may, _hits(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), w)).otherwise(0))
    tot = base.agg(F.count(F.lit(1)).cast("double").alias("_N"), F.avg("_dl").alias("_mean"), *[F.sum((F.col(f"_f{i}") > 0).cast("int")).cast("double").alias(f"_n{i}") for i in range(len(wanted))])
    hit = base.where(F.expr(" or ".join(f"_f{i} > 0" for i in range(len(wanted))))).crossJoin(F.broadcast(tot))  # one row
    score = sum((_bm25(F.col(f"_f{i}"), F.col(f"_n{i}"), F.col("_dl"), F.col("_N"), F.col("_mean")) for i in range(len(wanted))), F.lit(0.0))
    return hit.withColumn("score", score).select(*docs.columns, "score")


def _stemmed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _t, the index forms of their tokens in order. Distinct tokens are stemmed once and joined back."""
    raw = docs.select(id_col, F.posexplode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("_p", "_w"))
    vocab = raw.select("_w").distinct().withColumn("_s", X.stem_term("_w"))
    toks = raw.join(vocab, "_w").groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda x: x["_s"]).alias("_t"))
    return docs.join(toks, id_col, "left").withColumn("_t", F.coalesce("_t", F.array().cast("array<string>")))


def postings(docs: DataFrame, id_col: str = "uid", text_col: str = "body", stem: bool = True) -> DataFrame:
    """(term, id, tf, positions, dl): the inverted index. Write it partitioned or bucketed by term; a search then reads its terms only."""
    raw = docs.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("p", "w"), F.size(tokens(F.col(text_col))).alias("dl"))
    per = raw.groupBy(id_col, "w", "dl").agg(F.collect_list("p").alias("ps"))
    if not stem:
        return per.select(F.col("w").alias("term"), id_col, F.size("ps").alias("tf"), F.array_sort("ps").alias("positions"), "dl")
    vocab = per.select("w").distinct().withColumn("term", X.stem_term("w"))
    both = per.join(vocab, "w").groupBy("term", id_col, "dl").agg(F.array_sort(F.flatten(F.collect_list("ps"))).alias("positions"))
    return both.select("term", id_col, F.size("positions").alias("tf"), "positions", "dl")


def doc_stats(docs: DataFrame, text_col: str = "body") -> DataFrame:
    """One row: n_docs and mean length, over all rows."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg(F.size(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("mean"))


def search_index(index: DataFrame, stats: DataFrame, terms: Sequence[str], id_col: str = "uid", stem: bool = True) -> DataFrame:
    """(id, score) from postings: each term's rows are read once, phrases by their positions."""
    wanted = [w for w in (phrase(t, stem) for t in terms) if w]
    out = None
    for words in wanted:
        if len(words) == 1:
            hit = index.where(F.col("term") == words[0]).select(id_col, "dl", F.col("tf").alias("tf"))
        else:
            rows = index.where(F.col("term").isin(words)).select(id_col, "dl", "term", F.explode("positions").alias("p"))
            offs = F.create_map(*[x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(words) if v == w]))])
            starts = rows.withColumn("o", F.explode(F.element_at(offs, F.col("term")))).groupBy(id_col, "dl", (F.col("p") - F.col("o")).alias("s")).agg(F.count_distinct("o").alias("k"))
            hit = starts.where(F.col("k") == len(words)).groupBy(id_col, "dl").agg(F.count(F.lit(1)).alias("tf"))
        n = hit.agg(F.count(F.lit(1)).cast("double").alias("n"))
        one = hit.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(stats)).select(id_col, _bm25(F.col("tf"), F.col("n"), F.col("dl"), F.col("n_docs"), F.col("mean")).alias("s"))  # one row each
        out = one if out is None else out.unionByName(one)
    if out is None:
        return index.select(id_col).limit(0).withColumn("score", F.lit(0.0))
    return out.groupBy(id_col).agg(F.sum("s").alias("score"))


# Fixed value: props that a node is found by, beside its body and name.
FOUND_BY = ("path", "heading", "title", "sheet", "speaker", "alias")


def node_text(body: Column, name: Column, props: Column) -> Column:
    """What a node is found by: its body, the words of its name, and those of FOUND_BY; blank parts are left out."""
    words = lambda c, signs: F.when(c != "", F.translate(c, signs, " " * len(signs)))
    return F.concat_ws("\n", F.when(body != "", body), words(name, "/_-"), *[words(props[k], "/_") for k in FOUND_BY])


class TextIndex:
    """Stemmed postings on disk, with the totals of all rows. Files hold ranges of (term, id), sorted, so a search skips all but the row groups of its terms, and a frequent term is spread over several files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Replace the index by that of docs. Null texts are empty texts: they count among the totals."""
        d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        p = postings(d, "id", "text")
        p.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{self.path}/terms")
        doc_stats(d, "text").write.mode("overwrite").parquet(f"{self.path}/totals")

    def search(self, terms: Sequence[str]) -> DataFrame:
        """(id, score) of the rows that hold a term or phrase."""
        return search_index(self.spark.read.parquet(f"{self.path}/terms"), self.spark.read.parquet(f"{self.path}/totals"), terms, "id")


def top(scored: DataFrame, k: int = 20, id_col: str = "uid") -> DataFrame:
    """The k best; equal scores by id."""
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def normalised(pool: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Scores of a pool mapped to 0.35..1 by min and max within by; 1 where all are equal. The pool is one of top rows, so a window holds few."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return pool.withColumn(score, FLOOR + (1 - FLOOR) * F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0))


def recall(query: str, chunks: DataFrame, facts: DataFrame, k: int = 8, scopes: Sequence[str] = ("project", "global"), kinds: Sequence[str] = ("fact", "chunk"), include_pinned: bool = True, vectors: DataFrame | None = None, stem: bool = False, chunk_hits: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """The k best facts and chunks for a query: (kind, scope, item, path, start_line, text, pinned, score), best first.

    chunks: scope, id, path, start_line, text, search_body. facts: scope, id, text, tags, pinned. vectors: (kind, scope, item, cosine) of a semantic search; a
    positive cosine adds SEMANTIC x cosine x scope weight to a hit, or admits one that no word found. Pinned facts come first, at 10 x scope weight, whatever the query.
    chunk_hits: terms to (id, score), where an index of the chunks is at hand; it must cover the chunks of one scope. Else their texts are read.
    Of equal (kind, scope, path, start_line) or fact the best stays. An empty query gives the pinned facts only.
    """
    terms = parse_recall(query)
    pool_size = max(3 * k, 20)
    weight = F.when(F.col("scope") == "global", GLOBAL).otherwise(PROJECT)
    cols = ["kind", "scope", "item", "path", "start_line", "text", "pinned"]
    c = chunks.where(F.col("scope").isin(list(scopes))).select(F.lit("chunk").alias("kind"), "scope", F.col("id").alias("item"), "path", "start_line", "text", F.lit(False).alias("pinned"), F.col("search_body").alias("_body"))
    f = facts.where(F.col("scope").isin(list(scopes))).select(F.lit("fact").alias("kind"), "scope", F.col("id").alias("item"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("start_line"), "text", "pinned", F.concat_ws("\n", "text", F.concat_ws(" ", "tags")).alias("_body"))
    parts = []
    for name, df, base in (("fact", f, FACT), ("chunk", c, CHUNK)):
        if name not in kinds or not terms:
            continue
        for scope in scopes:
            rows = df.where(F.col("scope") == scope)
            if name == "chunk" and chunk_hits is not None:
                best = chunk_hits(terms).withColumnRenamed("id", "item").orderBy(F.desc("score"), "item").limit(pool_size)
                hit = rows.join(F.broadcast(best), "item")  # pool_size rows
            else:
                hit = search_scan(rows, terms, "item", "_body", stem)
            pool = hit.orderBy(F.desc("score"), "item").limit(pool_size)
            parts.append(normalised(pool, ["kind", "scope"]).where(~F.col("pinned")).withColumn("score", F.col("score") * base * weight).select(*cols, "score"))
    if include_pinned and "fact" in kinds:
        parts.append(f.where("pinned").withColumn("score", PINNED * weight).select(*cols, "score"))
    if not parts:
        return c.limit(0).withColumn("score", F.lit(0.0)).select(*cols, "score")
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    if vectors is not None:
        v = vectors.where("cosine > 0").groupBy("kind", "scope", "item").agg(F.max("cosine").alias("cosine"))
        every = c.select(*cols).unionByName(f.where("not pinned").select(*cols))
        add = every.join(v, ["kind", "scope", "item"]).withColumn("bonus", SEMANTIC * F.col("cosine") * weight)
        b = add.select("kind", "scope", "item", "bonus")
        lexical = res.join(b, ["kind", "scope", "item"], "left").withColumn("score", F.col("score") + F.when(F.col("pinned"), 0.0).otherwise(F.coalesce("bonus", F.lit(0.0)))).select(*cols, "score")
        only = add.join(res.select("kind", "scope", "item"), ["kind", "scope", "item"], "left_anti").withColumn("score", F.col("bonus")).select(*cols, "score")
        res = lexical.unionByName(only)
    key = F.when(F.col("kind") == "chunk", F.concat_ws("\x01", "path", "start_line")).otherwise(F.concat_ws("\x01", "scope", F.col("item").cast("string")))
    w = Window.partitionBy("kind", key).orderBy(F.desc("score"), "scope", "item")
    return res.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc("score"), "kind", "scope", "item").limit(k)


def common_terms(docs: DataFrame, text_col: str = "text", least: int = 4) -> DataFrame:
    """(term, n_docs) of lower-case words of at least `least` letters: document frequencies to pick common and rare terms from."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from folioscope import model as M
from folioscope.operators import enrich, facts, graph, merge, search, sheets, vectors
from folioscope.operators.agent import GraphAgent, Reply


def node_claims(spark, rows):
    return spark.createDataFrame(rows, M.NODES)


def test_node_merge(spark):
    rows = [("u", "a", "old", "a longer body", {"x": "1", "y": "1"}, "f1", 1), ("u", "b", "new", "short", {"x": "2"}, None, 2), ("", "a", "n", "", {}, None, 3), (None, "a", "n", "", {}, None, 3), ("v", "a", None, None, None, None, 1)]
    got = {r["uid"]: r.asDict() for r in merge.merge_nodes(node_claims(spark, rows)).collect()}
    assert set(got) == {"u", "v"} and got["v"]["props"] == {}
    assert (got["u"]["kind"], got["u"]["name"], got["u"]["body"], got["u"]["owner"], got["u"]["props"]) == ("b", "new", "a longer body", "f1", {"x": "2", "y": "1"})


def test_edge_merge_resolve_and_garbage(spark):
    e = spark.createDataFrame([("a", "b", "k", 1.0, "inferred", {"l": "1"}, "f1", 1), ("a", "b", "k", 0.5, "extracted", {"l": "2"}, "f2", 2), ("a", "a", "k", 1.0, "llm", {}, "f", 3), ("a", "zz", "k", 1.0, "llm", {}, "f", 4)], M.EDGES)
    m = merge.merge_edges(e)
    r = m.where("dst = 'b'").first()
    assert (r["weight"], r["provenance"], r["props"], r["owner"]) == (1.0, "extracted", {"l": "2"}, "f1") and m.count() == 2
    n = merge.merge_nodes(node_claims(spark, [("a", "document", "a", "", {}, "f", 1), ("b", "entity", "b", "", {}, None, 1), ("c", "entity", "c", "", {}, None, 1), ("d", "folder", "d", "", {}, None, 1)]))
    kept, dropped = merge.resolve_edges(m, n)
    assert kept.count() == 1 and [x["dst"] for x in dropped.collect()] == ["zz"]
    assert sorted(x["uid"] for x in merge.collect_garbage(n, kept).collect()) == ["a", "b", "d"]


def random_graph(spark, seed=1234):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)}
    edges = [(a, b) for a, b in edges if a != b]
    n = spark.createDataFrame([(i, "page", f"n{i}") for i in range(40)], "uid long, kind string, name string").cache()
    e = spark.createDataFrame([(a, b, "next", 1.0, "extracted") for a, b in edges], "src long, dst long, kind string, weight double, provenance string").cache()
    return n, e, edges


def bfs(edges, start):
    seen, front, d = {start: 0}, [start], 0
    while front:
        d += 1
        front = list({y for a, b in edges for x, y in ((a, b), (b, a)) if x in set(front) and y not in seen})
        seen.update(dict.fromkeys(front, d))
    return seen


def test_paths_have_the_length_of_a_plain_search(spark):
    n, e, edges = random_graph(spark)
    for a, b in [(0, 1), (3, 30), (5, 17)]:
        want = bfs(edges, a).get(b)
        path = graph.shortest_path(n, e, a, b, 12)
        assert (len(path) - 1 if path else None) == want
        assert all((x, y) in edges or (y, x) in edges for x, y in zip(path, path[1:]))
    assert graph.shortest_path(n, e, 4, 4) == [4] and graph.shortest_path(n, e, 4, 999) == []
    near = {r["uid"]: r["depth"] for r in graph.reach(n, e, 0, 2).collect()}
    assert near == {k: v for k, v in bfs(edges, 0).items() if v <= 2}


def test_hubs_neighbours_counts(spark):
    n = spark.createDataFrame([(0, "entity", "hub")] + [(i, "chunk", f"c{i:03}") for i in range(1, 601)], "uid long, kind string, name string")
    e = spark.createDataFrame([(i, 0, "mentions", 1.0, "extracted") for i in range(1, 601)], "src long, dst long, kind string, weight double, provenance string")
    assert graph.hubs(n, e, limit=1).first()["degree"] == 600
    assert graph.neighbors(n, e, 0, ["mentions"], "in", ["chunk"], 5).count() == 5 and graph.neighbors(n, e, 12345).count() == 0
    assert graph.shortest_path(n, e, 1, 2) == [1, 0, 2]
    c = {r["key"]: r["n"] for r in graph.counts(n, e).collect()}
    assert c == {"node:entity": 1, "node:chunk": 600, "edge:mentions": 600, "nodes": 601, "edges": 600}
    out = json.loads(graph.export_json(n, e, "r", 3))
    assert len(out["nodes"]) == 3 and out["edges"] == []


DOCS = ["the calibration table was checked", "table table table", "harbour survey of the calibration", "", "Die Kalibrierung der Tabelle", "running runs ran with tables", "a b-c snake_case word"]


@pytest.mark.parametrize("query", ["table", "calibration table", "table table harbour", "snake_case", "survey missing"])
def test_bm25_equals_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body, tokenize = 'porter unicode61 remove_diacritics 2')")
    docs = DOCS + [f"filler text number {i} about nothing much" for i in range(20)]
    db.executemany("insert into f(rowid, body) values (?, ?)", list(enumerate(docs)))
    terms = search.parse_query(query)
    want = {i: round(-s, 9) for i, s in db.execute("select rowid, bm25(f) from f where f match ?", [" OR ".join(f'"{t}"' for t in terms)])}
    df = spark.createDataFrame(list(enumerate(docs)), "uid long, body string")
    got = {r["uid"]: round(r["score"], 9) for r in search.search_scan(df, terms, stem=True).collect()}
    ix = {r["uid"]: round(r["score"], 9) for r in search.search_index(search.postings(df), search.doc_stats(df), terms).collect()}
    assert got == ix == pytest.approx(want)


def test_hostile_queries(spark):
    df = spark.createDataFrame([(1, "x")], "uid long, body string")
    for q in ["", '"', "AND OR *", "é", '"  "']:
        assert search.search_scan(df, search.parse_recall(q)).count() == 0
    assert search.parse_recall('"two words" a ./x.y- b2') == ["two words", "x.y", "b2"]


def test_recall(spark):
    c = spark.createDataFrame([("project", 1, "a.md", 1, "calibration table", "calibration table"), ("project", 2, "b.md", 1, "nothing", "nothing")], "scope string, id long, path string, start_line int, text string, search_body string")
    f = spark.createDataFrame([("project", 1, "calibration is done in May", ["t"], False), ("global", 2, "always be kind", [], True)], "scope string, id long, text string, tags array<string>, pinned boolean")
    r = search.recall("calibration", c, f, 5).collect()
    assert [(x["kind"], x["item"]) for x in r] == [("fact", 2), ("fact", 1), ("chunk", 1)] and r[0]["score"] == pytest.approx(8.2)
    assert [(x["kind"], x["item"]) for x in search.recall("", c, f, 5).collect()] == [("fact", 2)]
    v = spark.createDataFrame([("chunk", "project", 2, 0.9)], "kind string, scope string, item long, cosine double")
    assert ("chunk", 2) in {(x["kind"], x["item"]) for x in search.recall("calibration", c, f, 5, vectors=v).collect()}


def test_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "item long, vec array<double>")
    got = [(r["item"], round(r["cosine"], 4)) for r in vectors.search(e, [2.0, 0.0], 3).collect()]
    assert got == [(1, 1.0), (2, 0.7071), (3, 0.0)]
    items = spark.createDataFrame([("chunk", 1, "a b"), ("chunk", 2, " "), ("chunk", 3, None)], "kind string, item long, text string")
    none = spark.createDataFrame([], "kind string, item long, model string, dim int, vec array<float>")
    built = vectors.build(items, none, "m", vectors.hashing_embedder(8))
    assert [(r["item"], r["dim"]) for r in built.collect()] == [(1, 8)] and vectors.missing(items, built, "m").count() == 2


def test_facts(spark):
    f = spark.createDataFrame([], facts.FACTS)
    f, a = facts.remember(f, "Run the tests with pytest before pushing", ["dev"])
    f, b = facts.remember(f, "Tests are run with pytest before pushing", ["ci"], pin=True)
    f, c = facts.remember(f, "Run pytest before pushing docs to the wiki", [])
    assert (a["action"], b["action"], b["id"], c["action"]) == ("created", "updated", a["id"], "created") and c["related"] == [a["id"]]
    row = f.where(F.col("id") == a["id"]).first()
    assert row["tags"] == ["ci", "dev"] and row["pinned"] and "Tests are run" in row["text"]
    assert facts.forget(f, a["id"]).count() == 1 and facts.markdown(f).startswith("## Always\n- Tests are run")
    with pytest.raises(ValueError):
        facts.remember(f, "  ")


def test_similar_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rnd.randrange(0, 7)))) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {i: facts.words_of(t) for i, t in texts}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = {(r["left_id"], r["right_id"]): round(r["similarity"], 9) for r in facts.similar_pairs(df, df, least=0.5).collect()}
    assert got == want


def test_sheets(spark):
    df = spark.createDataFrame([(i, "N/A" if i == 7 else str(i), "2024-01-02", "$1.50", "yes", "") for i in range(30)], "k int, amount string, day string, price string, flag string, none string")
    cols = ["amount", "day", "price", "flag", "none"]
    rows = sheets.cells_of(df, cols, ["k"])
    got = {r["column"]: (r["dtype"], r["non_empty"], r["distinct_values"]) for r in sheets.profile(rows, cols).collect()}
    assert got == {"amount": ("number", 30, 30), "day": ("date", 30, 1), "price": ("currency", 30, 1), "flag": ("boolean", 30, 1), "none": ("empty", 0, 0)}
    assert [r["samples"] for r in sheets.profile(rows, cols).where("column = 'amount'").collect()] == [[str(i) if i != 7 else "N/A" for i in range(8)]]
    heads = spark.createDataFrame([(["a", "b"],), (["a", "A"],), (["1", "2"],), (["a", ""],), ([],)], "c array<string>").select(sheets.is_header(F.col("c")).alias("h"))
    assert [r["h"] for r in heads.collect()] == [True, False, False, False, False]
    assert sheets.row_chunks(sheets.cells_of(df.limit(0), cols, ["k"]), cols).count() == 0


def test_enrichment(spark):
    body = "Acme Corp and the harbour office agreed on the new timetable. " * 3
    chunks = spark.createDataFrame([("c1", "f", body), ("c2", "f", body), ("c3", "f", "short")], "uid string, owner string, body string")
    todo, cache = enrich.passages(chunks), spark.createDataFrame([], "digest string, producer string, version string, payload string, error string")

    def client(batch):
        return {"passages": [{"id": i, "entities": [{"name": "Acme Corp", "type": "org"}, {"name": "harbour office", "type": "nonsense"}], "relations": [{"source": "Acme Corp", "target": "Harbour Office", "label": "agrees with"}, {"source": "Acme Corp", "target": "Elsewhere"}]} for i, _ in batch]}

    got = enrich.run(todo, cache, client, "m")
    assert got.count() == 1  # equal passages are asked about once
    nodes, edges = enrich.claims(todo, got, "m")
    kinds = {(r["kind"], r["provenance"]): r["n"] for r in merge.merge_edges(edges).groupBy("kind", "provenance").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {("mentions", "llm"): 4, ("related_to", "llm"): 1}
    bad = enrich.run(todo, cache, lambda b: "prose", "m").first()
    assert bad["payload"] is None and bad["error"]
    assert enrich.run(todo, got, client, "m").count() == 0
    assert enrich.estimate(chunks, 1.0, 1.0).first()["passages"] == 2


def test_agent(spark):
    n = spark.createDataFrame([("d", "document", "Doc", "about ferries", {"path": "d"}), ("e", "entity", "Ferry", "entity: Ferry", {})], "uid string, kind string, name string, body string, props map<string,string>")
    e = spark.createDataFrame([("d", "e", "mentions", 1.0, "extracted")], "src string, dst string, kind string, weight double, provenance string")
    script = [Reply(calls=[("1", "search", {"query": "ferries"}), ("2", "path", {"start": "d", "goal": "e"}), ("3", "nope", {})]), Reply(text="done")]
    seen = []

    def client(messages, tools):
        seen.append(messages[-1])
        return script[len(seen) - 1]

    assert GraphAgent(n, e, client).ask("?") == "done"
    answers = [json.loads(r["content"]) for r in seen[1]["results"]]
    assert {h["uid"] for h in answers[0]} == {"d", "e"} and answers[1] == ["d", "e"] and "error" in answers[2]
    assert "could not be asked" in GraphAgent(n, e, lambda m, t: 1 / 0).ask("?")
    assert "No answer" in GraphAgent(n, e, lambda m, t: Reply(calls=[("1", "overview", {})])).ask("?")

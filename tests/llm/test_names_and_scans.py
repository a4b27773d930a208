import random

from folioscope.llm import names, scans

FORMS = [("Bob", "Robert", "en"), ("Kate", "Katherine", "en"), ("Kathy", "Katherine", "en"), ("Joerg", "Jörg", "de")]


def links(spark, rows):
    n = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "id long, kind string, name string")
    f = spark.createDataFrame(FORMS, "form string, full_form string, lang string")
    return sorted((r["id_a"], r["id_b"]) for r in names.linked_pairs(n, f).collect())


def groups(rows):
    return sorted((a, b) for a, (x, *_) in enumerate(rows) for b, (y, *_) in enumerate(rows) if a < b and x is not None and x == y)


def test_people(spark):
    rows = [
        (1, "Robert Kudnoukmoumkik"), (1, "Kudnoukmoumkik, Bob"), (1, "KUDNOUKMOUMKIK Robert"), (1, "Robert A. Kudnoumkoumkik"), (1, "robert.kudnoukmoumkik"), (1, "Dr Robert Kudnoukmoumkik, PhD"),
        (2, "Katherine Kudnoukmoumkik"), (2, "K. Kudnoukmoumkik"), (2, "Kathy Kudnoukmoumkik (archive)"), (2, "Kat. Kudnoukmoumkik"), (2, "Kahterine Kudnoukmoumkik"),
        (3, "Jörg Bauklitborfaud"), (3, "Joerg Bauklitborfaud"), (3, "Jörg Bauklitborfuad"), (None, ""), (None, None), (4, "Robert Danmetkourbus"),
    ]
    assert links(spark, [("person", n) for _, n in rows]) == groups(rows)


def test_organisations(spark):
    rows = [
        (1, "Busneir Baukpex Shipping GmbH"), (1, "Busneir-Baukpex Shipping, Ges. mbH"), (1, "Busneirbaukpex Shpg"), (1, "The Busneir Baukpex Shipping Company"), (1, "Shipping Busneir Baukpex"), (1, "Busneir Baikpex Shpg."), (1, "Busneir Baukpex Shipping (HQ)"),
        (2, "Busneir Baukpex Logistics S.A."), (2, "Busneir Baukpex Log. Société Anonyme"), (3, "Foundou Paurkoal Services & Sons"), (3, "Foundou Paurkoal Svcs and Sons"),
    ]
    assert links(spark, [("org", n) for _, n in rows]) == groups(rows)


def test_stem_join_is_exact(spark):
    rnd = random.Random(5)
    stems = {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(6, 11))) for _ in range(250)}
    df = spark.createDataFrame([("p", s) for s in stems], "block string, stem string")
    got = {tuple(sorted((r["a"], r["b"]))) for r in names.stem_links(df).collect()}
    want = {(a, b) for a in stems for b in stems if a < b and names.edit_distance(a, b) <= names.RADIUS}
    assert got == want and want


def test_short_stems_join_within_one_slip(spark):
    rnd = random.Random(6)
    stems = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(200)}
    got = {(r["a"], r["b"]): r["slip"] for r in names.stem_links(spark.createDataFrame([("p", s) for s in stems], "block string, stem string")).collect()}

    def near(a, b):
        least = min(len(a), len(b))
        return names.edit_distance(a, b) <= 2 if least >= names.LONG else least >= names.SHORTEST and names.slipped(a, b) <= 1

    want = {(a, b): names.slipped(a, b) for a in stems for b in stems if a < b and near(a, b)}
    assert got == want and want


def test_keys_are_never_broadcast(spark):
    """Each stem has dozens of keys, which Spark's estimates of sizes leave out."""
    stems = names.stem_links(spark.createDataFrame([("p", s) for s in ("kudnoukmoumkik", "kudnoumkoumkik", "lund", "lunt")], "block string, stem string"))
    assert {(r["a"], r["b"]) for r in stems.collect()} == {("kudnoukmoumkik", "kudnoumkoumkik"), ("lund", "lunt")}
    one = lambda schema, *row: spark.createDataFrame([row], schema)
    lone = names.placed(one("s string, form string, g string", "lund", "short", "rbo"), one("s string, g string, entity string", "lund", "robert", "e"), one("a string, b string, slip int", "lund", "lund", 0), one("g string, f string", "robert", "robert"))
    assert [r["entity"] for r in lone.collect()] == ["e"]
    for df in (stems, lone):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line and "key#" in line]
        assert joins and not any("Broadcast" in line for line in joins), joins


def test_steps_are_planned_once(spark, monkeypatch):
    """What several steps read is written, so that no plan holds dozens of copies of it: those fill the driver's memory whatever the size of the data."""
    scans_in = {}

    def counted(df, name="table"):
        scans_in[name] = max(scans_in.get(name, 0), df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return written(df, name)

    written = names.materialize
    monkeypatch.setattr(names, "materialize", counted)
    rows = [(1, "person", "Robert Kudnoukmoumkik"), (1, "person", "Bob Kudnoumkoumkik"), (2, "org", "Busneir Baukpex Shipping"), (2, "org", "Busneir Baikpex Shpg")]
    assert links(spark, [r[1:] for r in rows]) == groups(rows)
    assert max(scans_in.values()) <= 24, scans_in


def test_large_tables_are_sorted(spark, monkeypatch):
    """Spark sees compressed files: a table that would unpack beyond the limit isn't broadcast."""
    chain = spark.createDataFrame([("p", f"{i:03d}", f"{i + 1:03d}") for i in range(9)], "block string, a string, b string")

    def broadcasts(limit):
        monkeypatch.setattr(names, "BROADCAST_BYTES", limit)
        label = names.components(chain)
        both = label.join(label.withColumnRenamed("cluster", "c"), ["block", "stem"])
        assert {r["cluster"] for r in both.collect()} == {"000"}
        return "BroadcastHashJoin" in both._jdf.queryExecution().executedPlan().toString()

    assert broadcasts(1 << 30) and not broadcasts(100)


def test_short_surnames(spark):
    rows = [(1, "Peter Smith"), (1, "Peter Smiht"), (1, "Smith, Peter"), (2, "Anna Meier"), (2, "Anna Maier"), (3, "Ole Lund"), (4, "Ole Berg"), (5, "Robert Smith"), (5, "Bob Smith"), (6, "Eva Li"), (7, "Eva Lu")]
    assert links(spark, [("person", n) for _, n in rows]) == groups(rows)
    orgs = [(1, "Acme Shipping"), (1, "Acme Shpg"), (1, "Amce Shipping"), (2, "Acme Logistics"), (3, "Orla Shipping"), (4, "Orka Shipping")]
    assert links(spark, [("org", n) for _, n in orgs]) == groups(orgs)


def test_hot_surname(spark):
    """Many people of one surname: initials that fit several stay apart from all, forms are learned although the surname has many given names, and a chain of misspellings ends."""
    rnd = random.Random(9)
    given = sorted({"".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(400)})
    far = []
    for g in given:  # no two within two slips, so that they are different people
        if all(names.slipped(g, h) > 2 for h in far):
            far.append(g)
    rows = [(i, f"{g.title()} Kudnoukmoumkik") for i, g in enumerate(far)] + [(i, f"KUDNOUKMOUMKIK, {g.title()}") for i, g in enumerate(far)]
    rows += [(1000, f"{far[0][:1].upper()}. Kudnoukmoumkik"), (1000, f"{far[0][:1].upper()} Kudnoukmoumkik")]
    for k, s in enumerate(["Bauklitborfaud", "Danmetkourbus", "Rilgotfempaus"]):  # Zy is learned for Zyprian
        rows += [(2000 + k, f"Zyprian {s}"), (2000 + k, f"Zyx {s}")]
    rows += [(3000, "Zyprian Kudnoukmoumkik"), (3000, "Zyx Kudnoukmoumkik")]
    rows += [(4000 + i, f"Wolfhart {a}{b}") for i, (a, b) in enumerate((a, b) for a in ("Grumpel", "Tosvak", "Henlitz") for b in ("bardonik", "wessimaul", "furtequent", "jollisam", "zampodrek"))]
    assert sum(g[0] == far[0][0] for g in far) > 1
    assert links(spark, [("person", n) for _, n in rows]) == groups(rows)
    chain = spark.createDataFrame([("p", f"{i:03d}", f"{i + 1:03d}") for i in range(120)], "block string, a string, b string")
    assert {r["cluster"] for r in names.components(chain).collect()} == {"000"}


def test_no_names(spark):
    assert links(spark, []) == []


LEX = "the warehouse list summarises the measured flow rate because the index was rebuilt and the loading ramp near the northern depot explains the rainfall series of the front-matter block"


def noise(spark, pages):
    texts = [(LEX, False)] * 6 + [(t, True) for _, _, _, t in pages]
    t = spark.createDataFrame(texts, "text string, is_page boolean")
    return scans.ScanNoise(t, spark.createDataFrame(pages, "node_id long, file_id long, page int, text string"))


def test_pages(spark):
    pages = [
        (1, 1, 1, "The warehoiise l1st summarises thc measured fiow rate be-\ncause the index was rebuilt."),
        (2, 1, 2, "the loading ramp near the northern depot\nexplains the rainfall series."),  # plain wrapping
        (3, 2, 1, "Station Map\n\nthe index was rebuilt near the depot."),  # a title
        (4, 3, 1, "TK\t930\t92\nINV\t232\t47\n\nthe index was rebuilt."), (5, 3, 2, "the index was rebuilt.\n— 12 —"), (6, 4, 2, "T H E   L I S T\nthe index was rebuilt."), (7, 4, 3, "the list was re\xad\nbuilt."),
        (8, 5, 1, "the index of the front-\nmatter block was rebuilt."), (9, 6, 1, None), (10, 6, 2, ""),
    ]
    n = noise(spark, pages)
    assert sorted(r["node_id"] for r in n.found().collect()) == [1, 5, 6, 7]
    got = {r["node_id"]: r["text"] for r in n.repaired().collect()}
    assert got == {1: "The warehouse list summarises the measured flow rate because the index was rebuilt.", 5: "the index was rebuilt.", 6: "the index was rebuilt.", 7: "the list was rebuilt."}


def test_forms_that_stand_in_clean_text_and_short_ones(spark):
    """A misread form doesn't become a word because clean text has it, once or now and then; a rare word of its own context stays; short words and long ones are repaired too."""
    clean = [LEX] * 40 + ["somebody typed thc by mistake and rnap too"] * 2 + ["we will rnap out the thc market"] + ["a stern horse pulls the bam door"] * 3
    long = "hyperrefractometricallycounterstandardised" * 2
    clean += [f"the {long} list of the barn near the northern depot"] * 30
    pages = [(1, 1, 1, "the warehouse list summarises thc measured flow rate"), (2, 1, 2, "a stern horse pulls the bam door"), (3, 1, 3, f"the {long.replace('m', 'rn')} list of the barn"), (4, 1, 4, "the loading rarnp near the northem depot"), (5, 1, 5, "the flow ratc because the list")]
    t = spark.createDataFrame([(x, False) for x in clean] + [(x[3], True) for x in pages], "text string, is_page boolean")
    n = scans.ScanNoise(t, spark.createDataFrame(pages, "node_id long, file_id long, page int, text string"))
    assert {r["node_id"]: r["text"] for r in n.repaired().collect()} == {
        1: "the warehouse list summarises the measured flow rate", 3: f"the {long} list of the barn", 4: "the loading ramp near the northern depot", 5: "the flow rate because the list",
    }
    assert {r["node_id"] for r in n.found().collect()} == {1, 3, 4, 5}


def test_distance_and_keys():
    assert scans.distance("comnnent", "comment") < 0.7 and scans.distance("thc", "the") < 0.4 and scans.distance("cat", "dog") > 1
    for seen, word in [("warehoiise", "warehouse"), ("slielf", "shelf"), ("refei-s", "refers"), ("@gainst", "against"), ("l0g", "log")]:
        assert set(scans.keys(seen)) & set(scans.keys(word)), seen


def test_no_pages(spark):
    t = spark.createDataFrame([], "text string, is_page boolean")
    assert scans.ScanNoise(t, spark.createDataFrame([], "node_id long, file_id long, page int, text string")).found().collect() == []

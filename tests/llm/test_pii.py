import pytest

from folioscope.llm import pii

GIVEN = ["Robert", "Bob", "Katherine", "Kate", "Henry", "Olivia", "Susanne", "Victoria", "Isaac", "Gregory"]
SUR = ["Corvash", "Bellwain", "van der Loom", "Haldane-Orr"]
PHONES = ["+44 20 7946 0387", "(415) 555-0187", "0049 30 23125454", "+33 1 99 00 08 61", "+34 900 55 73 70", "+1 212 555 0127", "020 7946 0947", "212.555.0105", "030/23125-124"]


def corpus():
    out = []
    for i, g in enumerate(GIVEN):
        for j, s in enumerate(SUR):
            out += [f"According to {g} {s}, the valve was shut.", f"Call {g} {s} on {PHONES[(i + j) % len(PHONES)]} if the door is locked.", f"Signed: {g} {s}\nThe rota was kept.", f"Ask {g} about the missing drawer."]
    out += [f"Part 555-2{i}21 fits housing 021-8." for i in range(10)] + ["Rose Hill station and Victoria Basin share one meter.", "The robert-style clamp costs less.", "Pin loader@1.36.1 and ping @reviewers.", None, "", "Minutes taken by Varno Harbour."]
    return out


@pytest.fixture(scope="module")
def found(spark):
    texts = corpus() + [
        "Mimi Corvash and Y. Bellwain signed; HALDANE-ORR, Susanne too.",
        "Write to kate.c+x@mail.brumelle.example, or bob (at) tide-lab.test, or isaac at ostkai dot invalid.",
        "Call Kate Corvash on 555-0104 if the door is locked.",
        "Passport no. TG4713992 was copied, and DNI 12687123-W, visto.",
        "He lives at Flat 6, 104 Saltmarsh Close, Brumelle; Frau Kate wohnt Schäferstraße 135, 00499 Port Edrin; Mme habite 159 bis bd des Fougères; vive en Calle Los Álamos, 67.",
    ]
    df = spark.createDataFrame([("chunks", i, t, 1) for i, t in enumerate(texts)], "tbl string, row_id long, text string, kind int")
    forms = spark.createDataFrame([(g, g, "en") for g in GIVEN], "form string, full_form string, lang string")
    return texts, df, forms, [(r["row_id"], r["pii_kind"], r["start_at"]) for r in pii.found(df, forms).collect()]


def items(found, i):
    texts, _, _, rows = found
    i = i % len(texts)
    return sorted((k, texts[i][a : a + 8]) for r, k, a in rows if r == i)


def test_names(found):
    assert items(found, 0) == [("person", "Robert C")] and items(found, 3) == [("person", "Robert a"[:8])]
    assert items(found, -5) == [("person", "HALDANE-"), ("person", "Mimi Cor"), ("person", "Y. Bellw")]


def test_decoys_are_none(found):
    texts, _, _, rows = found
    bad = {i for i, t in enumerate(texts) if t and (t.startswith(("Part", "Rose", "The robert", "Pin", "Minutes")))}
    assert not [r for r in rows if r[0] in bad]


def test_other_kinds(found):
    assert items(found, -4) == [("email", "bob (at)"), ("email", "isaac at"), ("email", "kate.c+x")]
    assert ("phone", "555-0104") in items(found, -3)
    assert items(found, -2) == [("id_number", "12687123"), ("id_number", "TG471399")]
    assert [x for x in items(found, -1) if x[0] == "address"] == [("address", "159 bis "), ("address", "Calle Lo"), ("address", "Flat 6, "), ("address", "Schäfers")]


def test_redaction(found):
    texts, df, forms, _ = found
    got = {r["row_id"]: r["text"] for r in pii.redact(df, forms).collect()}
    assert got[0] == "According to [PERSON], the valve was shut."
    assert got[len(texts) - 2] == "Passport no. [ID_NUMBER] was copied, and DNI [ID_NUMBER], visto."


def test_empty(spark, found):
    _, df, forms, _ = found
    assert pii.found(df.limit(0), forms).collect() == []


def test_learned_names_alone_and_reversed(spark, found):
    """Quentin and Noémie are in no list but stand beside several surnames; Xerxes stands nowhere else."""
    _, df, forms, _ = found
    more = [f"According to {g} {s}, the valve was shut." for g in ("Quentin", "Noémie") for s in SUR]
    more += [f"The log says name={g}" for g in GIVEN] + [f"Present: {s}, {g}; the rota was kept." for g in GIVEN for s in SUR]
    ask = ["Ask Quentin about the missing drawer.", "The log says name=Noémie", "Present: Bellwain, Xerxes; the rota was kept.", "Present: Corvash, Quentin; the rota was kept.", "Ask Support about the missing drawer.", "The log says name=Backup", "Quentin Basin and Harbour, Depot share one meter."]
    texts = more + ask
    rows = df.unionByName(spark.createDataFrame([("nodes", i, t, 1) for i, t in enumerate(texts)], "tbl string, row_id long, text string, kind int"))
    got = {}
    for r in pii.find(rows, forms).where("tbl = 'nodes'").collect():
        got.setdefault(r["row_id"], []).append(texts[r["row_id"]][r["start_at"] : r["stop_at"]])
    assert [got.get(len(more) + i, []) for i in range(len(ask))] == [["Quentin"], ["Noémie"], ["Bellwain, Xerxes"], ["Corvash, Quentin"], [], [], []]


def test_loose_words():
    given = frozenset({"bob"})
    loose = lambda seq: pii.loose_words(seq, pii.parse_names(seq, given), given)
    assert loose("Quentin") == ["quentin"] and loose("Bob") == [] and loose("Bob Corvash") == [] and loose("Quentin Corvash") == ["corvash"]
    assert loose("Corvash, Xerxes") == ["corvash", "corvash,", "xerxes"] and loose("Y. Corvash, Noémie") == ["noémie"]


def test_what_only_the_pattern_can_tell(spark):
    """Shapes that may be anything count where the words around them are those of sure ones, and rejects stay out; many rows without a name don't meet in one task."""
    texts = [f"Write to {n} {w} Street, please." for n, w in enumerate("Oak Mill Churchyard Station Ropewalk Foundry Elm Orchard Abbey Cooper Tanner Glass".split(), 7)] + ["Write to 44 Beacon Hill, please.", "The gauge rose by 44 Beacon Hill units.", "Look at the dot product of both.", "Moved to 43 Beacon Hill Ave., Apt 13, at noon."]
    df = spark.createDataFrame([("chunks", i, t) for i, t in enumerate(texts)], "tbl string, row_id long, text string")
    forms = spark.createDataFrame([("Bob", "Robert", "en")], "form string, full_form string, lang string")
    got = {(r["row_id"], r["pii_kind"], r["start_at"], r["stop_at"]) for r in pii.find(df, forms).collect()}
    assert {g[0] for g in got} == {*range(13), 15} and (15, "address", 9, 9 + len("43 Beacon Hill Ave., Apt 13")) in got
    x = spark.createDataFrame([("", 1), ("a", 2), ("b", 3)], "surname string, i int")
    plan = pii._known(x, spark.createDataFrame([("a", True)], "surname string, known_s boolean"), "surname")
    assert sorted((r["i"], r["known_s"]) for r in plan.collect()) == [(1, None), (2, True), (3, None)]

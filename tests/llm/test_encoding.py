import pytest

from folioscope.llm import encoding

CLEAN = ["La réunion d’été répète l’échéancier arrêté en février, après la relecture.", "Die Prüfstelle bestätigt die früheren Größen für den nördlichen Teil.", "El año pasado la estación confirmó el albarán según lo acordado.", "“Keep the original,” says the note — it’s about £50."]


def rows(spark, texts):
    df = spark.createDataFrame([("chunks", i, 1 + i % 3, t, "clash") for i, t in enumerate(texts)], "tbl string, row_id long, file_id long, text string, source string")
    files = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, source_id int")
    return df.drop("source"), files


@pytest.mark.parametrize("run, want", [("Ã©", "é"), ("â€™", "’"), ("Ã¢â‚¬â„¢", "’"), ("Г©", "é"), ("├⌐", "é"), ("√©", "é"), ("é", "é"), ("«ÉTÉ»"[4:], "»")])
def test_units(run, want):
    got = encoding.units(run)
    assert "".join(c for _, c in got) == want and "".join(s for s, _ in got) == run


def test_round_trips_and_honest_text(spark):
    swaps = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("cp1252", "cp1251"), ("cp1252", "mac_roman")]
    texts, want = CLEAN * 60, {}
    texts += ["Осадки записаны в журнале, итог сошёлся.", "relatório de SÃO Belarim, à exceção de ÂNGULO", "│ depth │ 12 µm ± 3 │ © archive │ § 4 ¿? │", "棚卸しの結果は前回と同じ。", "plain ascii", "", None] * 12
    for true, wrong in swaps:
        for t in CLEAN[:3]:
            try:
                want[len(texts)] = t
                texts.append(t.encode(true).decode(wrong))
            except UnicodeDecodeError:
                del want[len(texts)]
    want[len(texts)] = None
    texts.append("La r�union d’�t�")
    df, files = rows(spark, texts)
    got = {r["row_id"]: r["text"] for r in encoding.restore(df, files).collect()}
    assert set(got) == set(want)
    exact = [i for i, t in want.items() if t and got[i] == t]
    assert len(exact) >= 0.8 * (len(want) - 1), [(got[i], want[i]) for i in want if got[i] != want[i]]
    assert {r["row_id"] for r in encoding.found(df, files).collect()} == set(want)


def test_empty(spark):
    df, files = rows(spark, ["x"])
    assert encoding.found(df.limit(0), files).collect() == [] and encoding.found(df, files.limit(0)).collect() == []


def test_restore_text_uses_positions():
    assert encoding.restore_text("Ã© and é", [(0, 2, "é")]) == "é and é"


def test_a_page_that_is_not_listed_is_learned(spark):
    import codecs

    assert codecs.lookup("cp1253").name not in encoding.PAGES
    french = ["La réunion d’été répète l’échéancier arrêté en février, après la relecture.", "Le café fermé a été rénové après l’arrivée du désherbage.", "Une méthode vérifiée a été présentée à l’équipe."]
    greek = ["Η συνάντηση έγινε στις δέκα και το πρακτικό γράφτηκε αμέσως μετά."] * 6
    bad = [t.encode("cp1252").decode("cp1253") for t in french] * 4
    texts = french * 80 + greek + bad
    df = spark.createDataFrame([("chunks", i, 1 if i < len(texts) - len(bad) else 2, t) for i, t in enumerate(texts)], "tbl string, row_id long, file_id long, text string")
    files = spark.createDataFrame([(1, 1), (2, 2)], "id long, source_id int")
    got = {r["row_id"]: r["text"] for r in encoding.restore(df, files).collect()}
    assert set(got) == set(range(len(texts) - len(bad), len(texts)))
    right = sum(a == b for i, t in got.items() for a, b in zip(t, (french * 4)[i - len(texts) + len(bad)]) if ord(b) > 127)
    assert right >= 0.8 * sum(ord(c) > 127 for t in french * 4 for c in t)


def test_one_source_with_a_third_of_all_rows_is_no_single_task(spark):
    """EM is planned by source, symbol and proposal, and gives the same however the counts are spread."""
    texts = CLEAN * 40 + [t.encode("utf-8").decode("cp1252", "replace") for t in CLEAN] * 5
    df, files = rows(spark, texts)
    counts = encoding.context_counts(encoding.with_source(df, files))
    plan = encoding.decisions(counts)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    few = {tuple(r) for r in encoding.decisions(counts.coalesce(1)).collect()}
    many = {tuple(r) for r in encoding.decisions(counts.repartition(7)).collect()}
    assert few == many and few

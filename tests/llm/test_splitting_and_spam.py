import random

import pytest

from folioscope.llm import spam, splitting


@pytest.mark.parametrize("alphabet", ["ab \n", "a", "\n", "a\n\n# b.", "。あ", "- x\n", "|;1\n"])
def test_pieces_cover_the_text_and_keep_the_rules(alphabet):
    rnd = random.Random(7)
    for _ in range(150):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 900)))
        ps = splitting.split_text(t, 80, 2, 20)
        assert ps[0][0] == 0 and ps[-1][1] == len(t)
        for (a, b, new), before in zip(ps[1:], ps):
            assert 0 < b - a <= 80 and new == before[1] and b > new
            last = "\n".join(t[before[0] : before[1]].split("\n")[-2:])
            assert t[a:b].startswith(last if len(last) <= 40 else t[before[0] : before[1]][-20:])


def test_lines_and_headings():
    text = "intro\n" * 30 + "\n## First part\n" + "sentence one is here. " * 40 + "\n\n## Second part\n" + "- item\n" * 120
    rows = splitting.split_rows(text, "Given", 11, 500, 2, 60)
    assert rows[0][1] == 11 and rows[0][3] == "Given" and rows[-1][3] == "Second part" and "First part" in {r[3] for r in rows}
    for _, a, b, _, t in rows:
        assert b - a == t.count("\n") and len(t) <= 500
    assert rows[-1][2] == 11 + text.count("\n")


def test_boundaries():
    """No piece ends with a heading that something follows, none holds parts of two sections, sentences and items are cut only where they don't fit."""
    rnd = random.Random(11)
    say = lambda n: " ".join(f"Sentence {i} costs 3.14 units, e.g. for the {rnd.choice(NOUNS)}." for i in range(n))
    md = "# Top\n\n" + "".join(f"## Part {i}\n\n{say(rnd.randrange(1, 60))}\n\n### Detail {i}\n\n{say(rnd.randrange(1, 9))}\n\n" for i in range(30))
    heads = splitting.headings(md)
    for a, b, new in splitting.split_text(md):
        assert not any(h[1] == b for h in heads)
        inside = [h[0] for h in heads if new < h[0] < b and h[2] <= 2]
        own = max((h[0] for h in heads if h[0] <= new and h[2] <= 2), default=0)
        assert not inside or own >= new - 1 or own == 0 or md[new:b].lstrip().startswith("#")
        assert b == len(md) or md[:b].rstrip()[-1] in ".:", md[b - 30 : b]
    html = "<h1>Top</h1>\n" + "".join(f"<h2>Part {i}</h2>\n<ul>" + "".join(f"<li>{say(2)}</li>" for _ in range(20)) + "</ul>\n" for i in range(6))
    cut = [b for _, b, _ in splitting.split_text(html)][:-1]
    assert cut and all(html[:b].rstrip().endswith(("</li>", "</ul>", "</h1>")) for b in cut) and [h[3] for h in splitting.headings(html)][1] == "Part 0"
    lists = "".join(f"- item {i}\n" + "".join(f"  - below {i} {k} {say(1)}\n" for k in range(12)) for i in range(8))
    assert all(lists[b:].lstrip("\n ").startswith("- ") for _, b, _ in splitting.split_text(lists)[:-1])
    under = "Title\n=====\n" + say(10) + "\n\nSecond\n------\n" + say(10) + "\n\n```\n# no heading\n```\n\n" + say(40)
    assert [h[2:] for h in splitting.headings(under)] == [(1, "Title"), (2, "Second")]
    data = '{"a":1,' + ",".join(f'"key{i}":{i * 37}' for i in range(900)) + "}"
    assert all(data[b - 1] == "," for _, b, _ in splitting.split_text(data)[:-1])


def test_split_table(spark):
    rows = [(1, "x" * 2000, "h", 1, "clash"), (2, "y" * 2001, None, None, "clash"), (3, None, "h", 1, None), (4, "", "h", 1, None), (5, "word " * 900, "h", 3, None), (5, "word " * 900, "h", 3, None)]
    df = spark.createDataFrame(rows, "id long, text string, heading string, start_line int, piece string")
    assert sorted(r["chunk_id"] for r in splitting.split_found(df).collect()) == [2, 5, 5]
    two = splitting.split_oversized(df).where("chunk_id = 2").orderBy("piece").collect()
    assert [len(r["text"]) for r in two] == [2000, 121] and two[0]["start_line"] is None
    assert splitting.split_oversized(df.limit(0)).collect() == []


PROSE = "The ferry timetable was checked against the log. The harbour office has kept the older copy, because two rows were swapped. In the first week, nobody needed to rename anything. "
HONEST = {
    "prose": PROSE * 8,
    "table": "id;date;amount;note\n" + "\n".join(f"{i};2024-01-{i % 28 + 1:02};{i * 37};the ferry timetable" for i in range(40)),
    "log": "\n".join(f"2024-01-02 10:{i:02} INFO the ferry timetable was checked" for i in range(50)),
    "code": "def fold(items, limit=3):\n    kept = []\n    for item in items:\n        if item.size > limit:\n            continue\n        kept.append(item)\n    return kept\n\n" * 6,
    "links": "\n\n".join(f"Part {i}: The harbour office has kept the older copy of the log. https://docs.norvik.example/{i}" for i in range(12)),
    "tag line": PROSE * 5 + "\n#ferry #harbour #timetable #log",
    "short": "tide clock, desk lamp", "one sign": "…", "none": "",
}
SPAM = {
    "keywords": "tide clock cheap, tide clock sale, buy tide clock, tide clock online, tide clock deal, best tide clock, tide clock review, tide clock near me, " * 6,
    "lines": "garden pump wholesale\ncheap garden pump\ngarden pump coupon\ngarden pump sale\n" * 12,
    "tags": "#DeskLampSale #TideClock #DeskLamp #TideClockCheap #GardenPump #DeskLampDeal " * 10,
    "urls": "\n".join(f"http://shop.x{i}-desk-lamp.example/p{i}" for i in range(40)),
    "markdown links": " ".join(f"[desk lamp {w}](http://a{i}.example/{i})" for i, w in enumerate(["sale", "cheap", "deal"] * 12)),
    "intro": PROSE[:50] + "\n" + "SKU-1 hose clamp ref 22 tide clock size 3 desk lamp colour 44 hose clamp model 5 tide clock " * 12,
}


def test_spam_and_look_alikes(spark):
    rows, want = [], set()
    for i, (name, t) in enumerate([*HONEST.items(), *SPAM.items()]):
        rows.append((i, t, "en"))
        if name in SPAM:
            want.add(i)
    rows += [(100 + i, PROSE * (3 + i % 4), "en") for i in range(40)] + [(200, None, None), (201, SPAM["urls"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in spam.find_spam(df).collect()} == want | {201}
    assert spam.find_spam(df.limit(0)).collect() == []


NOUNS = "ferry harbour timetable depot orchard meter archive valve ledger beacon quarry canal tram mill bridge ticket survey cellar garden clock parcel signal tower lamp rota barge annex inlet wharf crane buoy kiln forge loom press drain sluice weir hinge gauge".split()
WORDS = [a + b for a in "bra cel dor fim gol hul jar kem lop mur".split() for b in "tin vek sol rud nap lim".split()]


def test_each_signal_flags_a_page(spark):
    rnd = random.Random(3)

    def prose(n):
        return " ".join(f"The {rnd.choice(NOUNS)} was kept in the {rnd.choice(NOUNS)} near a {rnd.choice(NOUNS)}, and the {rnd.choice(NOUNS)} will be moved." for _ in range(n))

    block = "\n".join(" ".join(WORDS[i : i + 6]) for i in range(0, 60, 6))
    different = [a + b for a in WORDS[:20] for b in ("ex", "um", "or", "iv", "as", "et")]
    spam_pages = {
        "grams and dup": "\n".join([block] * 20),
        "grams": " ".join(WORDS * 20),
        "dup": "\n".join(w for _ in range(4) for w in rnd.sample(WORDS, 60)),
        "top": " ".join(f"lampex {a} {b}" for a, b in zip(different[::2], different[1::2])),
    }
    honest = {"list": "\n".join(different), "commas": ", ".join(different), "list of pairs": "\n".join(f"{a} {b}" for a, b in zip(different, reversed(different))), "twice": "\n".join(different + different[:12]), "common word": "\n".join(w + " pier" * (i % 8 == 0) for i, w in enumerate(different))}
    assert all(spam.measure(t)["variety"] > 0.67 and spam.measure(t)["rest"] > 0.5 for t in [*spam_pages.values(), *honest.values()])
    pages = [*spam_pages.items(), *honest.items()]
    rows = [(i, t, "en") for i, (_, t) in enumerate(pages)] + [(100 + i, prose(3 + i % 30), "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(pages[r["doc_id"]][0] for r in spam.find_spam(df).collect()) == sorted(spam_pages)


def test_short_pages(spark):
    short_spam = ["buy cheap pills buy cheap pills buy cheap pills", "#sale #shoes #discount", "http://a.example/x\nhttp://b.example\nhttp://c.example", "shoes shoes shoes shoes shoes shoes"]
    honest = ["Notes", "ok ok", "red blue green", "http://a.example/x", "#todo", "See http://a.example/x and http://b.example for the plan.", "The ferry left at noon.", "12 12 12", "", None, "\u2014 \u2014"]
    rnd = random.Random(5)
    small = "the of a in to was were by with from and or that when before under".split()
    plain = [" ".join(f"The {' '.join(x for w in rnd.sample(NOUNS + WORDS, 4) for x in (w, rnd.choice(small)))} {rnd.choice(WORDS)}." for _ in range(1 + i % 20)) for i in range(160)]
    pages = [*short_spam, *honest, *plain]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(pages)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in spam.find_spam(df).collect()) == list(range(len(short_spam)))


def test_variety_is_the_mean_over_all_windows():
    rnd = random.Random(7)
    for n in (0, 5, 8, 50, 51, 400):
        words = [rnd.choice(NOUNS) for _ in range(n)]
        k = [words[i : i + 50] for i in range(max(1, n - 49))]
        want = 1.0 if n < 8 else sum(len(set(w)) / len(w) for w in k) / len(k)
        r = spam.Repeats(words)
        assert abs(r.variety() - want) < 1e-9 and r.repeated() == n - len(set(words))
        assert n < 2 or abs(r.grams() - (1 - len(set(zip(words, words[1:]))) / (n - 1))) < 1e-9

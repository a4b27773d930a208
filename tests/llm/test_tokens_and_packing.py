import random
from collections import Counter

import pytest
import tiktoken

from folioscope.llm import bpe, packing

RANKS = bpe.load_ranks(f"{bpe.VOCAB_DIR}/byte_bpe_50k.tiktoken")
THEIRS = tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "Hello world", "<|endoftext|> is text", "été vs été", "日本語のテキスト。", "a" * 5000, "ab" * 3000, "x\ny\r\n\n  z\t", "🏳️‍🌈 𝒜", "1234567890" * 40, "\x00\x07\x1f", "don't I'VE they'd it’s"]


def test_ids_equal_a_public_implementation():
    rnd = random.Random(1)
    enc = bpe.Encoder(RANKS)
    texts = TEXTS + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 1200), rnd.randrange(0x3040, 0x30ff)])) for _ in range(rnd.randrange(0, 200))) for _ in range(200)]
    for t in texts:
        assert enc.encode(t) == (THEIRS.encode_ordinary(t) if t else []) and enc.count(t) == len(enc.encode(t))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    enc = bpe.Encoder(RANKS)
    t = "one two three four five six one two three " * 5
    assert enc.encode(t) == THEIRS.encode_ordinary(t)


def test_table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_texts(df).collect())
    assert got == sorted((i, THEIRS.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert bpe.encode_texts(df.limit(0)).collect() == []


def test_bulk_packing_equals_item_by_item():
    rnd = random.Random(3)
    for _ in range(100):
        cap = rnd.choice([7, 64, 2048])
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randrange(0, 200))]
        used: Counter = Counter()
        seen: Counter = Counter()
        for size, a, b, c, per in packing.best_fit_plan(Counter(sizes), cap):
            for i in range(a, b):
                used[c + (i - a) // per] += size
                seen[size, i] += 1
        assert set(seen.values()) <= {1} and len(seen) == len(sizes) and all(v <= cap for v in used.values())
        assert len(used) == len(set(packing.best_fit_decreasing(sizes, cap)))


def test_packing_of_a_table(spark):
    sizes = [(i, n) for i, n in enumerate([0, None, 5, 10, 3, 7, 25, 10, 10, 1, 20])] + [(2, 5)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int")
    got = packing.pack_items(df, 10, salts=3).collect()
    per: Counter = Counter()
    for r in got:
        if r["size"]:
            per[r["container"]] += r["size"]
    assert max(per.values()) <= 10 and sum(per.values()) == sum(n or 0 for _, n in sizes)
    assert sorted((r["piece"], r["first"], r["size"]) for r in got if r["doc_id"] == 6) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert all(r["container"] is None for r in got if r["doc_id"] in (0, 1)) and sum(r["doc_id"] == 2 for r in got) == 2
    assert sorted(per) == list(range(len(per))) and len(per) == 10
    assert packing.pack_items(df.limit(0), 10).collect() == []


def test_full_items_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(i, 10) for i in range(40)], "doc_id long, n_tokens int")
    got = [r["container"] for r in packing.pack_items(df, 10, salts=4).collect()]
    assert sorted(got) == list(range(40))


@pytest.mark.parametrize("size, want", [(1, 4), (4, 4), (5, 9), (10, -1)])
def test_tree(size, want):
    t = packing.RoomTree(12)
    t.add(4, 1)
    t.add(9, 2)
    assert t.tightest(size) == want

import hashlib
import random
import re
import weakref

import pytest

from pagewright.llm import decontamination
from pagewright.llm.decontamination import digest, drop_contaminated, find_contamination
from pagewright.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_whole_tables_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_winnowing"](spark, SF).collect()}
    assert got == brute(docs, items)
    assert any(x[4] for x in got.values())


def test_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten), (2, "ONE, two! three four five six seven eight nine ten eleven"), (10, "tiny item"), (3, None), (4, "..."), (None, "alpha beta"), (5, ten)]
    docs = [
        (0, None), (1, ""), (2, "One two three four five six seven eight nine ten eleven"), (3, "a tiny item, tiny ITEM tiny"), (4, "one two three four five six seven eight nine"),
        (5, "x " * 50_000 + ten + " y" * 50_000), (6, "é tiny-item ü"), (7, "alpha beta"), (8, "tiny"), (8, "item"),
    ]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, n_words string")
    found = find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(tuple(r) for r in digest(found).collect())
    want = brute(docs, [x for x in items if x[0] is not None])
    assert {r[0]: r[1:] for r in got if r[0] != 8} == {k: v for k, v in want.items() if k != 8}
    assert [r[1] for r in got if r[0] == 8] == [1, 1]
    small = find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=40)
    assert sorted(map(str, digest(small).collect())) == sorted(map(str, digest(found).collect()))
    clean = drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {0, 1, 4, 7, 8}


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty(spark, empty):
    docs = spark.createDataFrame([] if empty == "docs" else [(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([] if empty == "items" else [(1, "a b")], "item_id long, text string")
    got = digest(find_contamination(docs, items)).collect()
    assert [r.contaminated for r in got] == ([] if empty == "docs" else [False])


def test_clashing_columns_survive(spark):
    frame = spark.createDataFrame([(1, "tiny item", 777, ["x"], 1), (2, "all else", 778, None, 2)], "doc_id long, text string, n_words long, hit_items array<string>, row int")
    clean = drop_contaminated(frame, spark.createDataFrame([(1, "tiny item")], "item_id long, text string"))
    assert clean.schema == frame.schema
    assert [tuple(r) for r in clean.collect()] == [(2, "all else", 778, None, 2)]


def test_one_block_at_a_time(spark, monkeypatch):
    """Fifty blocks, some with the same passages: one alive at a time, and the result of one block."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary[:6] if rng.random() < 0.3 else vocabulary) for _ in range(n))
    shared = text(14)
    items = [(i, f"{shared} {text(5)}" if i % 7 == 0 else text(rng.choice([1, 4, 12, 30]))) for i in range(150)]
    docs = [(d, " ".join(rng.choice([text(9), shared, rng.choice(items)[1]]) for _ in range(rng.randrange(4)))) for d in range(60)]
    alive, most, made = weakref.WeakSet(), [0], [0]

    init = decontamination.Block.__init__

    def watched(self, *args):
        init(self, *args)
        alive.add(self)
        made[0] += 1
        most[0] = max(most[0], len(alive))

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(tuple(r) for r in digest(find_contamination(frame, bench)).collect())
    monkeypatch.setattr(decontamination.Block, "__init__", watched)
    size = sum(len(t) + 16 for _, t in items)
    passes = sorted(tuple(r) for r in digest(find_contamination(frame, bench, block_bytes=size // 50 + 1)).collect())
    assert made[0] == 50
    assert most[0] == 1
    assert passes == once
    assert {r[0]: r[1:] for r in once} == brute(docs, items)

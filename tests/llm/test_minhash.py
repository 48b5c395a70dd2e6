import random
import re

import pytest

from pagewright.llm import minhash
from pagewright.llm.common import connected_components
from pagewright.llm.minhash import drop_near_duplicates, near_duplicates
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, k):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, 2)
    assert result(QUERIES["op5_circulant_minhash"](spark, SF)) == want
    assert not all(x[2] for x in want.values())


def family(rng, n, size, edits):
    base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = f"x{rng.randrange(10_000)}"
        yield " ".join(w)


@pytest.mark.parametrize("cell", [1024, 16])
def test_groups_of_near_copies_however_they_are_dealt(spark, monkeypatch, cell):
    rng = random.Random(cell)
    texts = [t for size in (30, 120, 200) for t in family(rng, 50, size, size // 8)] + ["same text here"] * 30 + ["Same  TEXT\nhere"] * 3
    docs = [*enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(minhash.dealt, "__defaults__", (cell, 2_000_000 if cell > 16 else 3000))
    assert result(near_duplicates(frame, 2)) == brute(docs, 2)


def test_edges(spark):
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "é" * 100_000), (7, "a b " * 60_000), (8, "b a " * 60_000), (9, "a b"), (-1, "one")]
    frame = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, n_shingles int, signature string")
    assert result(near_duplicates(frame, 2)) == brute(docs, 2)
    kept = drop_near_duplicates(frame, 2)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, -1, 5, 6, 7, 9}
    odd = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, "one two")], "doc_id long, text string")
    assert sorted(map(str, [tuple(r) for r in near_duplicates(odd, 2).collect()])) == ["(1, 1, 1, True)", "(1, 1, 1, True)", "(2, 1, 1, False)", "(None, 1, None, None)"]
    assert sorted(map(str, [r.doc_id for r in drop_near_duplicates(odd, 2).collect()])) == ["1", "1", "None"]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2).collect() == []


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1002), (1002, 1001), (7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}

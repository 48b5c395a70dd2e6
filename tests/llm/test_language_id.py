import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import language_id
from pagewright.llm.language_id import DIM, TELLING, Model, buckets, classify, identify, keep_identified, stays, train
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_naive_bayes_language"](spark, SF).collect()
    assert {r.doc_id for r in got} == docs.keys()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred == "und" or any(c.isalpha() for c in docs[r.doc_id].text)
    tested = [r for r in got if r.held_out and docs[r.doc_id].lang and len(docs[r.doc_id].text) >= 20]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) >= 0.97 * len(tested)


def grams(text):
    """Brute force: the buckets of one text's n-grams."""
    chars = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    out = Counter()
    m = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            g = chars[i : i + n]
            if g[:2] in (" ", "  "):
                continue
            x = sum(ord(c) * k for c, k in zip(g, m)) % 2**32
            out[((x ^ x >> 15) * 0x2C1B3C6D % 2**32) >> 17] += 1
    return out


def test_buckets_and_scores_against_brute_force():
    texts = ["Ab, c!", "", "  ", "É😀x 𝔘𝐀", "12 3", "a" * 50, "the cat  sat\non"]
    for k, (index, starts, some) in enumerate(buckets(texts)):
        assert some.tolist() == [any(c.isalpha() for c in t) for t in texts]
    sums = [Counter() for _ in texts]
    for index, starts, _ in buckets(texts):
        for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(index)])):
            sums[i].update(x for x in index[s:e].tolist() if x < DIM)
    assert sums == [grams(t) for t in texts]
    counts = np.random.default_rng(1).integers(0, 9, (3, DIM))
    model = Model(["a", "b", "c"], counts, np.array([1.0, 2, 3]))
    names, scores = model.predict(pa.array([*texts, None]))
    for text, name, score in zip(texts, names, scores):
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        logs = [math.log(p) + sum(n * math.log((counts[j][g] + 0.1) / (counts[j].sum() + 0.1 * DIM)) for g, n in grams(text).items()) for j, p in enumerate((1 / 6, 2 / 6, 3 / 6))]
        assert name == "abc"[int(np.argmax(logs))] and math.isclose(score, 1 / sum(math.exp(x - max(logs)) for x in logs), rel_tol=1e-6)
    assert (names[-1], scores[-1]) == ("und", 0)


def test_edges(spark):
    rows = [(i, "the house and the garden", "en", "s") for i in range(12)] + [(i, "das Haus und der Garten", "de", "s") for i in range(12, 24)]
    rows += [(100, None, "en", None), (101, "", "de", "s"), (102, "12 34 !", "en", "s"), (None, "the garden", None, "s"), (103, "und der " * 50_000, None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(frame).collect()}
    assert got[None].lang_pred == "en" and got[None].held_out is False and got[103].lang_pred == "de"
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    kept = keep_identified(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {None, 103, *range(24)}
    empty = frame.limit(0)
    assert identify(empty).collect() == []
    assert [r.lang_pred for r in classify(frame, train(empty)).collect()] == ["und"] * len(rows)


def test_what_the_stage_keeps(spark):
    unlabelled = [(1, "the house", None), (2, "ok", None), (3, "12 34 !", None), (4, "", None), (5, None, None), (6, "𝔘", None)]
    frame = spark.createDataFrame(unlabelled, "doc_id long, text string, lang string")
    assert {r.doc_id for r in keep_identified(frame).collect()} == {1, 2, 6}
    labelled = [(i, t, x) for i in range(100, 130) for t, x in (("the house and the garden", "en"), ("das Haus und der Garten", "de"), ("la casa y el jardin", "es"))]
    short = [(i, t, None) for i, t in enumerate(("a", "El.", "the", "Haus", "n", "ok x"))]
    kept = keep_identified(spark.createDataFrame([*labelled, *short, (99, "?!", None)], "doc_id long, text string, lang string"))
    assert {r.doc_id for r in kept.collect()} == {*range(6), *range(100, 130)}
    long = "x" * TELLING
    assert [stays(long, "en", s, 0.5, True) for s in (0.49, 0.5)] == [False, True] and stays(long[1:], "en", 0.1, 0.5, True)
    split = Model(["a", "b", "c"], np.ones((3, DIM)), np.ones(3))
    frame = spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string")
    assert [r.doc_id for r in classify(frame, split, least=0.5).collect()] == [2]


FOREIGN = ["В этом доме живёт старая женщина и её кот.", "今天天气很好，我们去公园散步，然后回家吃饭。今天天气很好，我们去公园。", "Trong ngôi nhà này có một bà già sống cùng con mèo của bà, con mèo thích ngủ trên cửa sổ."]
MADE = [(i, t, x) for i in range(100, 400) for t, x in (("the house and the garden of an old woman", "en"), ("das Haus und der Garten einer alten Frau", "de"))]


def test_other_languages_go_and_columns_stay(spark):
    rows = [(i, t, None, "mine") for i, t in enumerate(FOREIGN)] + [(50, "an old house and the garden", None, "mine"), (51, "alte Frau und das Haus", None, "mine")] + [(*r, "mine") for r in MADE]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    kept = keep_identified(frame)
    assert kept.schema == frame.schema
    assert sorted(tuple(r) for r in kept.where("doc_id < 100").collect()) == [(50, "an old house and the garden", None, "mine"), (51, "alte Frau und das Haus", None, "mine")]
    assert kept.count() == 602
    assert {r.doc_id for r in keep_identified(frame, ["de"]).where("doc_id < 100").collect()} == {51}


def test_gain_against_brute_force():
    counts = np.random.default_rng(2).integers(0, 50, (2, DIM))
    model = Model(["a", "b"], counts, np.array([1.0, 2]))
    texts = ["the cat sat", "x", "", "12", "é" * 40]
    names, _, gains = model.judge(pa.array(texts))
    for text, name, gain in zip(texts, names, gains):
        if name == "und":
            assert gain == 0
            continue
        j, found = "ab".index(name), grams(text)
        logs = sum(n * math.log((counts[j][g] + 0.1) / (counts[j].sum() + 0.1 * DIM) * DIM) for g, n in found.items())
        assert math.isclose(gain, logs / sum(found.values()), abs_tol=1e-9)


def test_ties_and_repeated_rows(spark):
    """Equal evidence goes to the language that sorts first; equal rows get equal results."""
    rows = [(i, "same words here", x) for i in range(60) for x in ("b", "a", "c")]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 180 and {(r.lang_pred, round(r.score, 9)) for r in got} == {("a", round(1 / 3, 9))}


def brute(docs):
    """held_out, language and score of each text by counting n-grams of all learned rows in dictionaries."""
    learned = [(t, x) for d, t, x in docs if d is not None and zlib.crc32(str(d).encode()) % 3 != 1 and t is not None and x is not None]
    rows, counts = Counter(x for _, x in learned), {}
    for t, x in learned:
        counts.setdefault(x, Counter()).update(grams(t))
    out = []
    for d, t, _ in docs:
        held = d is not None and zlib.crc32(str(d).encode()) % 3 == 1
        if not any(c.isalpha() for c in t or ""):
            out.append((d, held, "und", 0.0))
            continue
        own = grams(t)
        logs = {x: math.log(rows[x] / len(learned)) + sum(n * math.log((c[g] + 0.1) / (c.total() + 0.1 * DIM)) for g, n in own.items()) for x, c in counts.items()}
        best = min(logs, key=lambda x: (-logs[x], x))
        out.append((d, held, best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_whole_query_against_brute_force(spark, tmp_path):
    """No language has more rows than the sample takes, so training is exact."""
    SMALL = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op6_naive_bayes_language"](spark, SMALL).collect()}
    want = brute(docs)
    assert len(got) == len(want)
    for d, held, name, score in want:
        assert (got[d].held_out, got[d].lang_pred) == (held, name) and math.isclose(got[d].score, score, rel_tol=1e-6)


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    frame = spark.createDataFrame([(i, "text", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        train(frame)

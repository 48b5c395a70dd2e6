import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import fingerprints as fp
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().replace("\x0b", " ").replace("\x0c", " ").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    texts = [t or "" for _, t in docs]
    for i, (d, _) in enumerate(docs):
        text, after = texts[i], texts[(i + 1) % len(docs)]
        q = len(text) // 4
        yield d, text, text[: len(text) - q] + after[:q], after


@pytest.mark.parametrize("bucket", [2000, 7])
def test_whole_table_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op2_bottom_k_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for d, text, edited, after in expected(docs):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        near, nxt = jaccard(shingles(text), shingles(edited)), jaccard(shingles(text), shingles(after))
        slack = 0 if len(shingles(text) | shingles(edited)) <= fp.K else 0.2
        assert abs(r.near_edited - near) <= slack + 1e-9
        assert abs(r.near_next - nxt) <= 0.2
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert len(base64.b64decode(r.fingerprint)) == 8 * min(fp.K, len(shingles(text)))
        assert abs(r.n_shingles - len(shingles(text))) <= 0.4 * len(shingles(text))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 2)
    docs = [(None, "null id é😀ü here"), (1, None), (2, ""), (3, "x"), (4, "é" * 10), (2**62, "w " * 50_000), (2**62 + 1, "last one here now and then")]
    frame = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, sketch string, bucket int")
    got = {r.doc_id: r for r in fp.digest(frame).collect()}
    for d, text, edited, _ in expected(docs):
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), d
    assert got[1].fingerprint == "" and got[1].near_next == 1.0 and got[2].near_next == 0.0
    one = fp.digest(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    assert len(fp.digest(spark.createDataFrame([(1, "same")] * 9, "doc_id long, text string")).collect()) == 9
    assert fp.digest(frame.limit(0)).collect() == []


def test_merging_and_estimates(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    a, b = " ".join(words), " ".join(words[:1500])
    frame = spark.createDataFrame([("a", a, b), ("b", b, a), (None, None, "x"), ("a", b, b)], "key string, text string, other string")
    rows = frame.select("key", "text", fp.sketch(F.col("text")).alias("s"), fp.sketch(F.col("other")).alias("o"))
    r = rows.select(fp.resemblance(F.col("s"), F.col("o")).alias("j"), fp.containment(F.col("s"), F.col("o")).alias("c"), fp.containment(F.col("o"), F.col("s")).alias("d"), fp.distinct_count(F.col("s")).alias("n")).collect()
    assert abs(r[0].j - 0.5) < 0.15 and abs(r[0].c - 0.5) < 0.15 and r[0].d > 0.8 and abs(r[0].n - 2996) < 900
    merged = {x.key: x.s for x in fp.merge_all(rows, "key", "s").collect()}
    whole = {x.key: x.s for x in rows.where("text is not null").collect() if x.key == "b" or len(x.text) == len(a)}
    assert merged["a"] == whole["a"] and merged["b"] == whole["b"] and merged[None] == []

import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm.queries import QUERIES
from pagewright.llm.sharding import Feistel, row_number_at, shard

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation_with_an_inverse(n):
    f = Feistel(n, key=5)
    p = f.place(np.arange(n))
    assert sorted(p) == list(range(n))
    assert (f.number(p) == np.arange(n)).all()
    assert n < 60 or (Feistel(n, key=6).place(np.arange(n)) != p).any()


def check(rows, docs, shards):
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in docs)
    texts = dict(docs)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op3_feistel_shards"](spark, SF).collect()
    check(rows, docs, 40)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_edges(spark):
    big = (1 << 62) + 1
    docs = [(None, "a"), (5, None), (big, "é" * 100_000), (7, ""), (8, "x")]
    frame = spark.createDataFrame([(d, t, 9, "y") for d, t in docs], "doc_id long, text string, row_number int, shard string")
    rows = shard(frame, 3).collect()
    check(rows, docs, 3)
    place = {r.row_number: (r.shard, r.slot) for r in rows}
    assert place == {int(row_number_at([s], [t], 3, len(docs), 20240229)[0]): (s, t) for s, t in place.values()}
    again = shard(frame.repartition(7), 3).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    same = shard(spark.createDataFrame([(1, "t")] * 10, "doc_id long, text string"), 4).collect()
    assert sorted(Counter(r.shard for r in same).values()) == [2, 2, 3, 3]
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []

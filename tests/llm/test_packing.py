import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagewright.llm.packing import WordTokenizer, by_word, fillings, nnls, pack, pieces, plan, sequences
from pagewright.llm.queries import QUERIES, word_bpe_path
from pagewright.llm.wordhash import SPACED, chunks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_bpe_path())


ODD = [
    "a,b x., don.t A. é. É, 3. x.<|ENDOFTEXT|> <|endoftext|>. H̱. ẖ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ. İstanbul é ́x", "a b c\x85d\x1ce don't I'LL 's",
    "😀‍ x", "12345 ³²ﬁ", "", " ", "한글 ㅎㅏㄴ 한", "Å Å", "\x00 a\x00b", "Q. q. q",
]


@pytest.mark.parametrize("bits", [21, 3])
def test_words_give_the_ids_of_whole_texts(tokenizer, monkeypatch, bits):
    monkeypatch.setattr(WordTokenizer, "BITS", bits)
    monkeypatch.setattr(WordTokenizer, "MOST_IDS", 10**6 if bits > 3 else 30)
    own = WordTokenizer(open(word_bpe_path(), encoding="utf-8").read())
    for texts in (ODD, ODD[::-1], *([t] for t in ODD)):
        for i, _, words in chunks(pa.array(texts), SPACED):
            ids, bounds = own.batch(words)
            for text, a, b in zip(texts[i:], bounds, bounds[1:]):
                assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def verify(rows, docs, tokenizer):
    """Every id lies in one piece, sequences are gapless and within 2048."""
    want = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(map(len, want.values())) / (2048 * len(by_sequence))


def test_whole_table(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert verify(QUERIES["op9_nnls_packing"](spark, SF).collect(), docs, tokenizer) > 0.97


def test_edges_and_real_sequences(spark, tokenizer):
    docs = [(0, None), (1, ""), (2, "word " * 5000), (3, "b " * 2047), (4, "b " * 2048), (None, "null id"), (6, ODD[0])]
    frame = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, bin int, start string")
    from pyspark.sql import functions as F

    packed = pack(pieces(frame, word_bpe_path()).withColumn("ids_crc32", F.crc32("ids"))).cache()
    verify(packed.collect(), docs, tokenizer)
    for r in sequences(packed).collect():
        own = sorted((x for x in packed.collect() if x.sequence_id == r.sequence_id), key=lambda x: x.offset)
        assert bytes(r.ids) == b"".join(bytes(x.ids) for x in own).ljust(8192, b"\0")
    twice = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    assert len(pack(pieces(twice, word_bpe_path())).collect()) == 3
    assert pack(pieces(spark.createDataFrame([], "doc_id long, text string"), word_bpe_path())).collect() == []


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(3)
    for low, high, n in ((1, 257, 5000), (1, 20, 3000), (120, 140, 2000), (256, 257, 10), (1, 2, 1)):
        histogram = Counter(rng.integers(low, high, n).tolist())
        windows = plan(histogram)
        used = Counter()
        for w, k in windows:
            assert sum(w) <= 256 and k > 0
            for b in w:
                used[b] += k
        assert used == histogram
    assert plan({}) == []


def test_nnls_and_fillings():
    a = np.array([[1.0, 0, 1], [0, 2, 1], [0, 0, 1]])
    assert np.allclose(nnls(a, a @ np.array([3.0, 0, 2])), [3, 0, 2], atol=1e-4)
    assert (nnls(a, np.array([-1.0, -1, -1])) == 0).all()
    assert fillings(6, 3) == [(6,), (1, 5), (2, 4), (3, 3), (1, 1, 4), (1, 2, 3), (2, 2, 2)]


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    spec = json.loads(open(word_bpe_path(), encoding="utf-8").read())
    assert by_word(json.dumps(spec))
    spec["normalizer"] = {"type": "Lowercase"}
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    assert not by_word(json.dumps(spec))
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    other = Tokenizer.from_file(str(path))
    texts = [*ODD, None, "a  b\n\nc " * 3000]
    cut = pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(path)).collect()
    for i, text in enumerate(texts):
        ids = np.frombuffer(b"".join(r.ids for r in sorted((r for r in cut if r.doc_id == i), key=lambda r: r.start)), "<u4")
        assert ids.tolist() == [*other.encode(text or "", add_special_tokens=False).ids, 1]


def test_clashing_columns_are_carried(spark):
    names = ["row_number", "_part", "_local_number", "_part_start", "position", "bin", "c0", "text"]
    rows = [(i, 0, 5 + i % 7, *(f"{n}{i}" for n in names)) for i in range(50)]
    got = pack(spark.createDataFrame(rows, "doc_id long, start long, length long, " + ", ".join(f"{n} string" for n in names)))
    assert got.columns == ["doc_id", "start", "length", *names, "sequence_id", "offset"]
    assert sorted(tuple(r)[:-2] for r in got.collect()) == rows

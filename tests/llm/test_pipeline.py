import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm.queries import word_bpe_path

from test_decontamination import brute as contaminated
from test_minhash import brute as components
from test_packing import verify

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    kept = components(docs, 5)
    docs = [(d, t) for d, t in docs if kept[d][2]]
    bad = contaminated(docs, items)
    docs = [(d, t) for d, t in docs if not bad[d][4]]
    assert 0 < len(docs) < len(rows)
    out = corpus_pipeline.run(spark, SF).collect()
    assert verify(out, docs, Tokenizer.from_file(word_bpe_path())) > 0.95


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", "a", 13, "x"), (2, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert [r.doc_id for r in docs.collect()] == [1]
    assert len({name for name, _ in corpus_pipeline.STAGES}) == 4
    assert np.isin(["doc_id", "sequence_id"], corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns).all()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, row int"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("i1", "one two three four five six seven eight nine ten eleven")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).collect() == []


def test_edges(spark, tmp_path):
    """Nulls, no letters, copies, repeated rows, a benchmark passage, another script, a very long text; each stage's input is what the one before kept."""
    texts = {
        1: None, 2: "", 3: "12 !", 4: "the house and the garden of an old woman by the sea", 5: "The house and the garden of an old woman by the sea", 6: "well, ONE two three four five six seven eight nine ten",
        7: "В этом доме живёт старая женщина и её кот", 9: "short", 11: " ".join(f"garden house{i} and woman{i % 77}" for i in range(30_000)),
    }
    rows = [(d, t, "en" if t and d != 7 else None, "s", 0, "mine", d) for d, t in texts.items()]
    rows += [(i, f"the old house number {i} and its garden with woman {i * 7} near tree {i * 3}", "en", "s", 0, "mine", i) for i in range(100, 160)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows)).collect()
    kept = {4, 9, 11, *range(100, 160)}
    assert {r.doc_id for r in out} == kept
    assert verify(out, [(d, t) for d, t, *_ in rows if d in kept], Tokenizer.from_file(word_bpe_path())) > 0.9


def test_repeated_rows(spark, tmp_path):
    row = (1, "the house and the garden of an old woman", "en", "s", 0, "mine", 1)
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, [row, row, (2, *row[1:])])).collect()
    assert {r.doc_id for r in out} == {1}

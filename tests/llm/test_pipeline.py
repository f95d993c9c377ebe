"""The pipeline's stages on a small corpus, and its registration."""

import random

import corpus_pipeline
import pytest
from ledgerlight.llm import queries

pytest.importorskip("public_tokenizers")
R = random.Random(5)
COMMON = ["the", "of", "and", "a", "in", "to", "is", "it"]


def sentence(n):
    return " ".join(R.choice(COMMON) if R.random() < 0.5 else "w%d" % R.randint(0, 900) for _ in range(n))


def test_stages(spark, tmp_path):
    base = [sentence(120) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t if i % 2 else t.replace(" the ", " a ", 1), "en", "s", len(t)) for i, t in enumerate(base[:20])]
    rows += [(200 + i, " | ".join(sentence(60).split(" ")), "en", "s", 9) for i in range(60)]
    rows += [(300, "call password=abcdef1 " + sentence(50), "en", "s", 9), (301, None, None, None, None), (302, "", "en", "s", 0)]
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id: r for r in docs.collect()})
    good, unique, clean = kept
    assert not [i for i in good if 200 <= i < 300] and set(range(60)) <= set(good)
    assert set(range(60)) <= set(unique) and not [i for i in unique if 100 <= i < 200]
    assert set(clean) == set(unique)
    assert "abcdef1" not in clean[300].text and clean[300].n_chars == len(clean[300].text)
    assert all(clean[i].text == base[i] for i in range(60))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(clean)
    again = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    place = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert place(packed) == place(again)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, rows, labels, extra=""):
    spark.createDataFrame(rows, SCHEMA + extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_documents_and_labels(spark, tmp_path):
    rows = [(i, sentence(40), "en", "s", 9) for i in range(5)]
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "a", [], [])).count() == 0
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "b", [], [(1, 1, 0)])).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, written(spark, tmp_path / "c", rows, [])).collect()} == set(range(5))


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(i, sentence(40), "en", "s", 9, "mine", 7) for i in range(12)]
    rows += rows[:4] + [(5, sentence(40), "de", "t", 9, "other", 8), (None, sentence(30), None, None, None, None, None), (None, None, None, None, None, None, None)]
    path = written(spark, tmp_path, rows, [], ", row string, node long")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = out
    kept = docs.collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == sorted({(r[0], r[1]) for r in rows if r[0] is not None})
    assert sum(r.doc_id is None for r in kept) == 2 and {(r.row, r.node) for r in kept if r.doc_id == 5} == {("mine", 7), ("other", 8)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == {*range(12), None}


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]

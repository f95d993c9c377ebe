"""Toxicity: held-out accuracy, exact neighbours, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
from ledgerlight.llm import toxicity
from ledgerlight.llm.toxicity import Settings
from pyspark.sql import functions as F

R = random.Random(23)
HARSH = ["idiot", "worthless", "réeuxpa", "réeuxment", "réeuxelle"]


def text(n, harsh):
    words = [f"w{R.randint(0, 80)}" for _ in range(n)]
    for _ in range(harsh):
        words[R.randrange(n)] = R.choice(HARSH).title()
    return " ".join(words) + "."


def tables(spark, n=600):
    docs = [(i, text(R.randint(20, 120), R.randint(2, 5) if i % 6 == 0 else 0), "de", "s", 0.5) for i in range(n)]
    odd = [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "idiot " * 30_000), (None, "idiot worthless"), (3, docs[3][1]), (n + 4, text(60_000, 0)), (n + 5, "x" * 200_000)]
    docs += [(i, t, None, None, None) for i, t in odd]
    labels = [(i, int(i % 5 > 0), int(i % 6 == 0)) for i in range(n) if i % 4] + [(None, 1, 1), (5, 1, None), (99_999, 0, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, evidence string, score double")
    return frame.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_held_out_documents(spark):
    frame, labels, docs = tables(spark)
    rows = toxicity.classify(frame, labels).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    got = {r.doc_id: r for r in rows}
    wrong = [i for i in range(600) if got[i].held_out and got[i].predicted != int(i % 6 == 0)]
    assert sum(got[i].held_out for i in range(600)) > 150 and len(wrong) <= 2
    assert got[600].score == got[601].score == got[602].score < 0.1 and got[603].predicted == 1 and got[604].predicted == 0
    assert got[600].evidence == "" and all(e.endswith(":1") for e in got[603].evidence.split(",")[:1])
    learnt = {int(e.split(":")[0]) for r in rows for e in r.evidence.split(",") if e}
    assert learnt and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in learnt)
    held = [got[i] for i in range(600) if got[i].held_out]
    brier = sum((r.score - (r.doc_id % 6 == 0)) ** 2 for r in held) / len(held)
    assert brier < 0.02


def test_without_labels_or_rows(spark):
    frame, labels, _ = tables(spark, 30)
    assert {r.score for r in toxicity.classify(frame, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(frame.limit(0), labels).count() == 0
    assert {r.held_out for r in toxicity.classify(frame.filter("doc_id IS NULL"), labels).collect()} == {False}


def test_the_sample_is_bounded(spark):
    frame, labels, _ = tables(spark, 200)
    few = toxicity.labelled(frame, labels, "toxic", toxicity.is_held_out, 20)
    assert few.count() == 20 and few.columns == ["doc_id", "label", "text"]
    every = toxicity.labelled(frame.union(frame), labels, "toxic", toxicity.is_held_out, 1000)
    assert every.count() == every.select("doc_id").distinct().count()
    model = toxicity.train(frame, labels, Settings(sample=50, terms=7, least=0.0))
    assert len(model.vocabulary) <= 7 and len(model.examples) <= 50


def test_neighbours_are_exact():
    rng = np.random.default_rng(5)
    examples = []
    for _ in range(500):
        terms = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        weights = rng.choice([1.0, 2.0, 3.0], len(terms))
        examples.append((terms, weights / np.sqrt((weights**2).sum())))
    for size in (1, 16, 128, 1000):
        index = toxicity.Index(examples, 60, size)
        for _ in range(40):
            terms = np.sort(rng.choice(60, rng.integers(1, 12), replace=False))
            weights = rng.random(len(terms))
            weights /= np.sqrt((weights**2).sum())
            dense = np.zeros(60)
            dense[terms] = weights
            every = [(-round(float(dense[t] @ w), 12), i) for i, (t, w) in enumerate(examples)]
            want = sorted(e for e in every if e[0] < 0)[:10]
            found, cosines = index.nearest(terms, weights, 10)
            assert [i for _, i in want] == found.tolist() or np.allclose([-c for c, _ in want], cosines)
            assert np.allclose([-c for c, _ in want], cosines, atol=1e-11)


def test_terms_are_counted_by_how_often_they_come():
    counts = toxicity.Counts(["=idiot*1", "^réeux*2", "^réeux*3", "=idiot*5"], Settings())
    texts = pa.array(["Idiot! idiot", "", "réeuxpa réeuxment x", "réeuxa, réeuxb réeuxc idiot idiot idiot idiot idiot"])
    got = list(zip(*(c.tolist() for c in counts(texts)), strict=True))
    assert got == [(0, 0, 2), (2, 1, 2), (3, 0, 5), (3, 1, 3), (3, 2, 3), (3, 3, 5)]
    assert [len(c) for c in toxicity.Counts([], Settings())(texts)] == [0, 0, 0]


def test_likelihood_ratio_prefers_what_tells_labels_apart(spark):
    rows = [(i, int(i % 2), "common " + ("harsh" if i % 2 else "mild")) for i in range(100)]
    examples = spark.createDataFrame(rows, "doc_id long, label int, text string")
    words = toxicity.vocabulary(examples, Settings())
    assert {"=harsh*1", "=mild*1"} <= set(words) and not any("common" in w for w in words)
    assert toxicity.vocabulary(examples.filter(F.col("label") == 1), Settings()) == []

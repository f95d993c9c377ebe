"""Quality classifier, language model, top-k search and winnowing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from ledgerlight.llm import lm, quality, topk, winnow
from pyspark.sql import functions as F

R = random.Random(11)
COMMON = ["the", "of", "and", "a", "in", "to", "is", "it", "for", "on"]


def sentence(n):
    return " ".join(R.choice(COMMON) if R.random() < 0.6 else "w%d" % R.randint(0, 60) for _ in range(n))


def low(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def test_quality(spark):
    docs, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        docs.append((i, sentence(40) if good else " | ".join(sentence(30).split(" ")), "x", 0.5))
        if i % 2 or i % 4 == 0:
            labels.append((i, int(good), 0))
    docs += [(1000, None, None, None), (None, "a b", None, None), (1001, "", None, None), (1002, sentence(30000), None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string, held_out double").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (7, 1, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(frame, marks).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (i is not None and low(i, 5))
    wrong = [i for i in range(400) if got[i].held_out and got[i].predicted != int(i % 4 != 0)]
    assert sum(got[i].held_out for i in range(400)) > 50 and not wrong
    assert abs(got[1000].score - got[1001].score) < 1e-12
    model = quality.train(frame, marks)
    kept = quality.keep_good(frame, model)
    assert kept.dtypes == frame.dtypes
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    unlabelled = quality.classify(frame.limit(3), marks.limit(0)).collect()
    assert [r.score for r in unlabelled] == [0.5] * 3
    assert quality.classify(frame.limit(0), marks).count() == 0


def test_ftrl_matches_plain_updates():
    s = quality.Settings(bits=4)
    f = quality.Ftrl(s)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(60):
        index = sorted(R.sample(range(16), 3))
        values, label = [R.random() for _ in index], R.randint(0, 1)
        row = [*zip(index, values, strict=True), (16, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in row)))
        for i, v in row:
            w, g = weight(i), (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
        f.learn(np.array(index), np.array(values), label)
    assert np.allclose(f.weights(np.arange(17)), [weight(i) for i in range(17)])


def plain_features(text, bits):
    """Index and weight of hashed words and pairs, with Python numbers."""
    hashes = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text.lower())]
    mask = (1 << bits) - 1
    keys = [(h ^ (h >> 15)) & mask for h in hashes]
    keys += [((a * 0x9E3779B1 + b + 1) * 0x85EBCA6B % (1 << 64) >> 13) & mask for a, b in zip(hashes, hashes[1:], strict=False)]
    weights = {k: math.log1p(n) for k, n in Counter(keys).items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {k: w / norm for k, w in weights.items()}


def plain_quality(docs, labels, s):
    """Scores of all documents by a dictionary for each number of the model, updated row by row."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    texts = dict(docs)
    taught = sorted((zlib.crc32(str(i).encode()), i, y) for i, y in labels.items() if i in texts and not low(i, 5))
    for _ in range(s.epochs):
        for _, i, y in taught:
            row = [*plain_features(texts[i] or "", s.bits).items(), ("intercept", 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in row)))
            for k, v in row:
                w, g = weight(k), (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / s.alpha * w
                n[k] += g * g
    return {i: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in [*plain_features(t or "", s.bits).items(), ("intercept", 1.0)]))) for i, t in docs}


def test_quality_scores_match_a_plain_version(spark):
    docs = [(i, sentence(20) if i % 3 else " | ".join(sentence(15).split(" "))) for i in range(80)] + [(80, None), (81, ""), (82, "é Ünï — ok!!"), (83, sentence(3000))]
    labels = {i: int(i % 3 != 0) for i in range(70)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    for bits in (18, 6):
        settings = quality.Settings(bits=bits)
        want = plain_quality(docs, labels, settings)
        got = {r.doc_id: r.score for r in quality.classify(frame, marks, settings).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], abs_tol=1e-4) for i in want)


def test_quality_of_repeated_rows_and_of_one_id_with_many_texts(spark):
    docs = [(i, sentence(20)) for i in range(40)]
    frame = spark.createDataFrame([*docs, *docs, *((3, sentence(20)) for _ in range(200))], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = quality.classify(frame, marks).collect()
    assert len(rows) == 280
    scores = defaultdict(set)
    for r in rows:
        scores[r.doc_id].add(r.score)
    assert all(len(s) == 1 for i, s in scores.items() if i != 3)


def plain_lm(train, texts):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    words, pairs = Counter(), Counter()
    for t in train:
        w = split(t)
        words.update(w)
        pairs.update(zip(["\t", *w], w, strict=False))
    total, distinct = sum(words.values()), len(words)
    before = Counter(b for _, b in pairs)
    follow = defaultdict(list)
    for (a, _), c in pairs.items():
        follow[a].append(c)
    of = lambda counts: lm.discounts(*[sum(c == k for c in counts) for k in (1, 2, 3, 4)])
    dp, dw = (0, *of(list(pairs.values()))), (0, *of(list(before.values())))
    rest = sum(dw[min(c, 3)] for c in before.values()) / len(pairs) if pairs else 1.0

    def p_word(w):
        return (max(before[w] - dw[min(before[w], 3)], 0) / len(pairs) if pairs else 0) + rest / (distinct + 1)

    out = []
    for t in texts:
        w = split(t)
        base = sum(math.log10((words[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        score = 0.0
        for a, b in zip(["\t", *w], w, strict=False):
            if a in follow:
                c, n = pairs[a, b], sum(follow[a])
                score += math.log10(max(c - dp[min(c, 3)], 0) / n + sum(dp[min(x, 3)] for x in follow[a]) / n * p_word(b))
            else:
                score += math.log10(p_word(b))
        out.append((len(w), sum(words[x] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize(("repeat", "merged"), [(1, lm.MERGED), (40, lm.MERGED), (1, 40)])
def test_language_model(spark, monkeypatch, repeat, merged):
    monkeypatch.setattr(lm, "MERGED", merged)
    texts = [None, "", "Ünï x\x85y", sentence(6000), *(sentence(R.randint(1, 60)) for _ in range(120)), *["the The end of it"] * 8 * repeat]
    docs = spark.createDataFrame([(i, t, 1.5, "n") for i, t in enumerate(texts)], "doc_id long, text string, score double, held_out string").repartition(3)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    want = plain_lm([t for i, t in enumerate(texts) if not low(i, 10)], texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert r.held_out == low(i, 10) and (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(60) if low(i, 10)], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in lm.score_documents(docs).collect())
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_mix_is_undone():
    x = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype="u8")
    assert (lm.unmix(lm.mix(x)) == x).all()


def plain_topk(rows, every=100, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(good):
        if q % every == 0:
            found = sorted((-max(min(sum(x * y for x, y in zip(a, b, strict=False)), topk.MOST), topk.LEAST), i) for n, (i, b) in enumerate(good) if n != at)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], "s") for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, score string").repartition(3)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one very common vector, also a query's own
    rows += [(2000, None), (2001, [None] + [1.0] * 7), (2100, [math.inf] * 8), (2101, [math.nan] * 8), (2102, []), (2103, [1.0, 2.0]), (2200, [1.0] * 11), (None, [1.0] * 8)]
    rows += [(3000, [-1.0] * 8), (300, rows[5][1])]
    rows += [(0, rows[3][1]), (0, rows[3][1]), (100, rows[100][1])]  # repeated ids, with other vectors and the same
    want = plain_topk([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    monkeypatch.setattr(topk, "HELD", 2000)
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "BLOCK", 4)
    for bins in (4096, 64):
        assert sorted(tuple(r) for r in topk.search(vectors(spark, rows), bins=bins).collect()) == want


def test_topk_of_many_equal_vectors(spark):
    rows = spark.range(50_000).selectExpr("id AS vec_id", "array(1.0F, CAST(id < 3 AS float)) AS embedding").filter("vec_id % 100 <> 0 OR vec_id < 200")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(rows).collect()}
    one = 1024 * 1024
    assert got == {**{(0, k): (i, 2 * one if i < 3 else one) for k, i in enumerate(range(1, 11), 1)}, **{(100, k): (i, one) for k, i in enumerate(range(10), 1)}}


def test_topk_of_huge_and_few_vectors(spark):
    rows = [(0, [1e30, -3e20, 2.0]), (1, [1e30, 1.0, 1.0]), (2, [5e4, 1e5, 3.3]), (3, [-1e30, 0.0, 0.0]), (100, [3e3, 7e4, 0.1])]
    want = plain_topk([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted(tuple(r) for r in topk.search(vectors(spark, rows)).collect()) == want
    assert topk.search(vectors(spark, rows[:1])).count() == 0
    assert topk.search(vectors(spark, rows[1:3])).count() == 0
    assert topk.search(vectors(spark, rows).limit(0)).count() == 0


def plain_winnow(text, k=winnow.K, window=winnow.WINDOW):
    if not text:
        return []
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
    hashes = [int(winnow.gram_hashes(winnow.code_points(g), k)[0]) for g in grams]
    kept = set()
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        kept.add(max(j for j, h in enumerate(part, i) if h == min(part)))
    return [(i, hashes[i]) for i in sorted(kept)]


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_winnowing(spark, monkeypatch):
    texts = [None, "", "short", "é🙂x" * 5, "a" * 500, sentence(50), sentence(2000), sentence(30), "x" * 13, "tail " * 9]
    rows = [(i * 7 % 31, t) for i, t in enumerate(texts)] + [(500, sentence(9)), (500, sentence(9)), (500, sentence(9)), (None, "none"), (None, "zero")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1] or ""), r[1] or ""))
    want = []
    for (i, t), (_, other) in zip(order, [*order[1:], order[0]], strict=True):
        t, other = t or "", other or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + other[:n]
        a, b, c = ({h for _, h in plain_winnow(x)} for x in (t, changed, other))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((i or -1, len(t), hashlib.sha256(changed.encode()).hexdigest(), like(a, b), like(a, c)))
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, part string").repartition(3)
    by_id, original = {}, winnow.with_next
    for parts in (1, 3, None):
        with monkeypatch.context() as patch:
            patch.setattr(winnow, "with_next", lambda d, s, m, parts=parts: original(d, s, m, parts))
            got = winnow.fingerprint_documents(docs).collect()
        assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(want)
        by_id = {r.doc_id: r for r in got}
    for i, t in rows[:10]:
        assert winnow.entries(by_id[i].fingerprint) == plain_winnow(t or "")
    one = winnow.fingerprint_documents(docs.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert winnow.fingerprint_documents(docs.limit(0)).count() == 0
    same = winnow.fingerprint_documents(spark.createDataFrame([(1, texts[5]), (2, texts[6]), (3, texts[5])], "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in same}) == 2


def test_winnowing_splits_a_doc_id_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(winnow, "HEAVY_ROWS", 20)
    rows = [(7, sentence(12)) for _ in range(300)] + [(None, sentence(12)) for _ in range(200)] + [(i, sentence(12)) for i in range(20)] + [(3, "same text")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes, chain = [], {}

    def make(ids, texts, following):
        return winnow.pa.record_batch([winnow.pa.array(ids, winnow.pa.int64()), winnow.pa.array(texts), winnow.pa.array(following)], ["doc_id", "text", "next"])

    out = winnow.with_next(docs, "doc_id long, text string, next string", make, 24)
    per_task = {}
    for r in out.select("*", F.spark_partition_id().alias("task")).collect():
        sizes.append((r.doc_id, r.text))
        chain[r.text] = r.next
        per_task[r.task] = per_task.get(r.task, 0) + 1
    assert sorted(sizes, key=str) == sorted(rows, key=str)
    ids = {t: i for i, t in rows}
    # Rows come by falling doc_id, and only one is followed by the start.
    falls = [(-1 if ids[t] is None else ids[t]) for t in chain if chain[t] is not None]
    rises = sum((-1 if ids[chain[t]] is None else ids[chain[t]]) > (-1 if ids[t] is None else ids[t]) for t in chain)
    assert len(falls) == len(chain) and rises <= 1 and max(per_task.values()) < 400


def test_one_order_at_any_number_of_ranges(spark, monkeypatch):
    """Many rows of one doc_id follow each other in the same order whether or not they fill several ranges."""
    monkeypatch.setattr(winnow, "HEAVY_ROWS", 100)
    rows = [(7, f"text {i}") for i in range(6000)] + [(i, f"other {i}") for i in range(1000)] + [(None, f"none {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1]), r[1]))
    want = sorted(((i, t, other) for (i, t), (_, other) in zip(order, [*order[1:], order[0]], strict=True)), key=str)

    def make(ids, texts, following):
        return winnow.pa.record_batch([winnow.pa.array(ids, winnow.pa.int64()), winnow.pa.array(texts), winnow.pa.array(following)], ["doc_id", "text", "next"])

    for parts in (1, 2, 16, 64):
        got = winnow.with_next(docs, "doc_id long, text string, next string", make, parts).collect()
        assert sorted(map(tuple, got), key=str) == want, parts


def test_shared_runs_share_an_entry():
    run = sentence(20)[: winnow.K + winnow.WINDOW - 1]
    for _ in range(20):
        texts = [sentence(9) + run + sentence(9) for _ in range(2)]
        a, b = ({h for _, h in winnow.entries(winnow.fingerprint(t)[0])} for t in texts)
        assert a & b


def test_held_out_rule(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r.h == low(r.doc_id, 5) for r in df.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect())


def test_quality_fits_one_text_of_each_labelled_document(spark):
    docs = [(i, sentence(40) if i % 3 else " | ".join(sentence(30).split(" "))) for i in range(60)]
    labels = [(i, int(i % 3 != 0)) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    marks = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    settings = quality.Settings(sample=60)
    weights, intercept = quality.train(frame(docs), marks(labels), settings)
    taught = next(d for d in docs if not low(d[0], 5))
    again = quality.train(frame([*docs, *[taught] * 50]), marks(labels), settings)
    assert (again[0] == weights).all() and again[1] == intercept
    missing = quality.train(frame(docs), marks([*labels, *((1000 + i, i % 2) for i in range(600))]), settings)
    assert (missing[0] == weights).all() and missing[1] == intercept

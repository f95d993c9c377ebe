"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from ledgerlight.llm import phrases
from ledgerlight.llm.phrases import Settings
from ledgerlight.llm.words import words_of
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, s: Settings):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, s.most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {w: a for w, a in counts.items() if len(w) > 1 and a >= s.least}
        within = Counter()
        for w, a in candidates.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    within[w[i : i + k]] = max(within[w[i : i + k]], a)
        rows = []
        for w, a in candidates.items():
            cuts = [(2000000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not 100 * within[w] >= s.covered * a:
                rows.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[: s.top], 1)]
    return sorted(out)


def check(spark, docs, s: Settings, parts=3):
    frame = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(docs)], "doc_id long, lang string, text string, phrase string, n int")
    got = phrases.mine(frame.repartition(parts), s)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(docs, s)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "日本", "New", "york", "city", "a-b", "$"] + [f"w{i}" for i in range(12)]
    marks = [" ", " ", " ", " ", "\t", ", ", ". ", "\n", " ! ", "  "]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 60))) + rng.choice(["", "new york city hall"] * 3 + ["x\x00y"])
    return [(rng.choice(["en", "en", "fr", None]), text()) for _ in range(n)]


def test_against_all_phrases(spark):
    docs = [*corpus(3, 120), ("en", None), ("en", ""), (None, " \t.,;"), ("de", "word " * 200), ("de", "x" * 100_000), ("en", "same text here " * 40)] + [("fr", "one two three four five")] * 12
    check(spark, docs, Settings(least=6, top=40))
    check(spark, docs[:50], Settings(least=3, most_words=3, covered=60, top=1000), parts=1)
    check(spark, docs[:50], Settings(least=3, most_words=2, top=5))


def test_no_rows_and_rare_words(spark):
    check(spark, [("en", "only once. each of these")], Settings())
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.mine(empty).count() == 0


def test_small_blocks_and_lanes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    monkeypatch.setattr(phrases, "LANE", 100)
    check(spark, corpus(5, 60), Settings(least=4, top=30), parts=2)


def test_repeated_texts_of_many_documents(spark):
    docs = [("en", "a passage that is everywhere")] * 3000 + corpus(9, 20)
    check(spark, docs, Settings(least=30, top=100), parts=7)


@pytest.mark.parametrize("side", [2, 16, 1024])
def test_tiles_count_like_a_counter(side):
    rng = np.random.default_rng(side)
    left, right = (rng.zipf(1.3, 20000) % 5000 for _ in range(2))
    left[:5] = [1 << 40, 3, 1 << 40, 0, 0]
    got = Counter()
    for a, b, n in phrases.tile_counts(left, right, side):
        assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a)
        got.update({(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)})
    assert got == Counter(zip(left.tolist(), right.tolist(), strict=True))


def test_pairs_are_looked_up():
    big = 1 << 61
    left, right = np.array([5, 0, 5, big]), np.array([1, 2, 9, 3])
    a, b = np.array([5, 5, 5, 0, 0, 7, big]), np.array([1, 9, 2, 2, 10, 1, 3])
    assert phrases.lookup(left, right, np.array([10, 11, 12, 13]), a, b).tolist() == [10, 12, -1, 11, -1, -1, 13]
    assert phrases.sorted_sums(np.array([big, 1, big]), np.array([big, 0, big]))[2].tolist() == [1, 2]


def test_words_of_slices():
    import pyarrow as pa
    from ledgerlight.llm.phrases import BLANKS, BREAKS
    from ledgerlight.llm.words import byte_kinds

    texts = pa.array(["zz", "Ab c", "", "d", "é, e.f", " "])[1:]
    found = words_of(texts, byte_kinds(BLANKS, BREAKS))
    words = [found.distinct[i].as_py().decode() for i in found.codes]
    assert words == ["ab", "c", "d", "é", "e", "f"]
    assert found.text.tolist() == [0, 0, 2, 3, 3, 3]
    assert [int(x) for x in np.diff(found.piece) != 0] == [0, 1, 1, 1, 1]
    assert len(words_of(pa.array([], pa.string()), byte_kinds(BLANKS, BREAKS)).codes) == 0


def test_score_of_counts_beyond_64_bits(spark):
    a = (1 << 62) + 7
    row = spark.createDataFrame([("en", 1, a, "x y", [a + 1], [a + 5])], "lang string, id long, n long, phrase string, heads array<long>, tails array<long>")
    assert phrases.scored(row, 2).head().score == 2000000 * a // (2 * a + 6)
    other = spark.createDataFrame([("en", 1, 2, a)], "lang string, left long, right long, n long")
    kept = spark.createDataFrame([("en", 1, a), ("en", 2, a + a // 4), ("en", 3, a)], "lang string, id long, a long")
    assert sorted(r.id for r in phrases.uncovered(kept, other, 80).select(F.col("id")).collect()) == [3]

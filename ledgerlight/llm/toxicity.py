"""Toxicity: the nearest labelled examples by TF-IDF cosine, found exactly in a block-max inverted index, vote on a text.

Terms are words and beginnings of words, and each of them again for having come
several times (a cosine does not see how much of the same a text holds).  The
vocabulary is that of the terms which the labels tell apart most (likelihood
ratio over the examples), so that a few marked words in a long text are not
drowned by the others; idf comes from all documents.  A text's vector holds
(1 + log count) * idf of its terms, of length one.

Postings stand by example, in blocks of neighbouring examples, with the
greatest weight of each term in each block.  The sum of these over a text's
terms bounds every cosine in the block; blocks are scored by falling bound
until none can hold a nearer example than the k found, so the k nearest are
exact, ties by example number.

Votes weigh by a power of the cosine and are drawn towards the share of labels
among the examples without any term; a text without terms has that share as its
score.  ``evidence`` names the nearest examples with cosine and label.

Null text counts as empty; long texts are read whole; rows that repeat are
scored each for itself; other columns do not matter, whatever their names.
Without labels every score is 0.5.  Labels of one document that disagree count
by their majority; rows with a null label or doc_id teach nothing, nor do
labels without a document; of rows that share a doc_id one text is learnt from,
that of least hash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, whole_text
from .words import byte_kinds, words_of

FOLDS, OUT = 3, 1
KINDS = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum()), b"")
#: Words and texts that a worker remembers.
KNOWN = 400_000


@dataclass(frozen=True)
class Settings:
    """``sample``: examples at most, the labelled documents of least hash; ``terms``: of the vocabulary at most; ``least``: likelihood ratio of a term."""

    sample: int = 12_000
    terms: int = 1024
    least: float = 24.0
    shortest: int = 4
    longest: int = 8
    times: tuple[int, ...] = (1, 2, 3, 5)
    neighbours: int = 24
    power: float = 3.0
    prior: float = 0.5
    block: int = 1024
    threshold: float = 0.7


def terms_of(word: str, settings: Settings) -> list[str]:
    """A word in lower case, as a whole (``=``) and by its beginnings (``^``); in the vocabulary they end in ``*`` and the least number of times."""
    word = word.lower()
    return [f"={word}", *(f"^{word[:n]}" for n in range(settings.shortest, settings.longest + 1) if len(word) > n)]


def labelled(docs: DataFrame, labels: DataFrame, label: str, outside, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled documents for which ``outside`` does not hold."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("mark"))
    marked = marked.filter(~outside(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("mark") >= 0.5).cast("int").alias("label"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    present = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return found.groupBy("doc_id", "label").agg(least).select("doc_id", "label", "least.text")


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; rows without a doc_id are not held out, and carry no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == OUT, F.lit(False))


def vocabulary(examples: DataFrame, settings: Settings) -> list[str]:
    """The terms that tell the labels apart most, at most ``settings.terms``."""

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for part in slices(batch):
                found = words_of(part.column("text"), KINDS)
                own = [terms_of(w.decode("utf-8", "replace"), settings) for w in found.distinct.to_pylist()]
                marks = part.column("label").to_pylist()
                ends = np.searchsorted(found.text, np.arange(part.num_rows + 1))
                for i, mark in enumerate(marks):
                    times: Counter = Counter()
                    for c, n in Counter(found.codes[ends[i] : ends[i + 1]].tolist()).items():
                        for t in own[c]:
                            times[t] += n
                    seen[mark].update(f"{t}*{m}" for t, n in times.items() for m in settings.times if n >= m)
        terms = list(seen[0] | seen[1])
        columns = [pa.array(terms, pa.string()), *(pa.array([seen[m][t] for t in terms], pa.int64()) for m in (1, 0))]
        yield pa.record_batch(columns, ["term", "ones", "zeros"])

    sizes = examples.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).head()
    counted = examples.mapInArrow(count, "term string, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    n1, n0 = (float(n) for n in sizes)
    if not n1 or not n0:
        return []
    part = lambda seen, total, share: F.when(seen > 0, seen * F.log(seen / (total * share))).otherwise(0.0)
    share = (F.col("ones") + F.col("zeros")) / (n1 + n0)
    rest1, rest0 = n1 - F.col("ones"), n0 - F.col("zeros")
    ratio = 2 * (part(F.col("ones"), F.lit(n1), share) + part(F.col("zeros"), F.lit(n0), share) + part(rest1, F.lit(n1), 1 - share) + part(rest0, F.lit(n0), 1 - share))
    best = counted.withColumn("ratio", F.round(ratio, 6)).filter(F.col("ratio") >= settings.least)
    return without_echoes(best.orderBy(F.desc("ratio"), "term").limit(8 * settings.terms).collect())[: settings.terms]


def without_echoes(found: list) -> list[str]:
    """Terms in the order given, without beginnings of words that are seen as often as a longer beginning or the whole word."""
    whole: dict[tuple, list[str]] = {}
    for r in found:
        word, times = r["term"][1:].rsplit("*", 1)
        whole.setdefault((times, r["ones"], r["zeros"]), []).append(word)
    kept = []
    for r in found:
        word, times = r["term"][1:].rsplit("*", 1)
        echo = any(w != word and w.startswith(word) for w in whole[times, r["ones"], r["zeros"]])
        if r["term"][0] == "=" or not (echo or f"={word}*{times}" in kept):
            kept.append(r["term"])
    return kept


class Counts:
    """Counts of the vocabulary's terms in texts."""

    def __init__(self, vocabulary: list[str], settings: Settings):
        self.settings = settings
        self.base: dict[str, int] = {}
        places = [(self.base.setdefault(t, len(self.base)), int(n)) for t, n in (t.rsplit("*", 1) for t in vocabulary)]
        #: The number of a term by how often at least it comes, -1 where the vocabulary has none.
        self.levels = {n: np.full(len(self.base), -1) for n in settings.times}
        for i, (base, n) in enumerate(places):
            self.levels[n][base] = i
        self.known: dict[bytes, tuple[int, ...]] = {}

    def terms(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            names = terms_of(word.decode("utf-8", "replace"), self.settings)
            found = tuple(self.base[n] for n in names if n in self.base)
            if len(self.known) < KNOWN:
                self.known[word] = found
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) in order."""
        none = np.zeros(0, "i8")
        found = words_of(texts, KINDS)
        own = list(map(self.terms, found.distinct.to_pylist()))
        flat = np.array([i for t in own for i in t], "i8")
        if not len(flat):
            return none, none, none
        sizes = np.array([len(t) for t in own], "i8")
        starts = np.cumsum(sizes) - sizes
        used = np.flatnonzero(sizes[found.codes] > 0)
        codes = found.codes[used]
        n = sizes[codes]
        bases = flat[np.repeat(starts[codes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        keys, counts = np.unique(np.repeat(found.text[used], n) * len(self.base) + bases, return_counts=True)
        text, base = keys // len(self.base), keys % len(self.base)
        parts = []
        for least, numbers in self.levels.items():
            at = np.flatnonzero((counts >= least) & (numbers[base] >= 0))
            parts.append((text[at], numbers[base[at]], counts[at]))
        text, term, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((term, text))
        return text[order], term[order], counts[order]


def vectors(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of one text's terms, of length one."""
    weights = (1 + np.log(counts)) * idf[terms]
    return weights / np.sqrt((weights**2).sum())


class Index:
    """Examples by term, in blocks of ``size`` neighbouring numbers, with each term's greatest weight in each block."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], terms: int, size: int):
        self.size, self.n = size, len(examples)
        self.blocks = -(-self.n // size)
        term = np.concatenate([t for t, _ in examples]) if examples else np.zeros(0, "i8")
        weight = np.concatenate([w for _, w in examples]) if examples else np.zeros(0)
        number = np.repeat(np.arange(self.n), [len(t) for t, _ in examples])
        order = np.lexsort((number, term))
        self.number, self.weight = number[order], weight[order]
        cell = term[order] * max(1, self.blocks) + self.number // size
        self.ends = np.searchsorted(cell, np.arange(terms * max(1, self.blocks) + 1)).reshape(-1)
        self.most = np.zeros(terms * max(1, self.blocks))
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(terms, max(1, self.blocks))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above zero (ties by number) and their cosines, in order."""
        bound = weights @ self.most[terms]
        best, found = np.zeros(0), np.zeros(0, "i8")
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] + 1e-9 < best[-1]):
                break
            sums = np.zeros(self.size)
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                at = t * self.blocks + b
                own = slice(self.ends[at], self.ends[at + 1])
                sums[self.number[own] - b * self.size] += w * self.weight[own]
            seen = np.flatnonzero(sums)
            best, found = np.concatenate([best, np.round(sums[seen], 12)]), np.concatenate([found, seen + b * self.size])
            order = np.lexsort((found, -best))[:k]
            best, found = best[order], found[order]
        return found, best


@dataclass(frozen=True)
class Model:
    vocabulary: list[str]
    idf: np.ndarray
    examples: list[tuple[np.ndarray, np.ndarray]]
    ids: np.ndarray
    marks: np.ndarray
    base: float


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The vocabulary, idf over all documents, and the examples' vectors (at most ``sample`` of at most ``terms`` entries)."""
    examples = staged(labelled(docs, labels, "toxic", is_held_out, settings.sample), "toxicity-examples")
    words = vocabulary(examples, settings)

    def frequencies(batches):
        counts = Counts(words, settings)
        total, n = np.zeros(len(words) + 1, "i8"), 0
        for batch in batches:
            for part in slices(batch):
                total[: len(words)] += np.bincount(counts(part.column("text"))[1], minlength=len(words))[: len(words)]
                n += part.num_rows
        total[-1] = n
        yield pa.record_batch([pa.array(np.arange(len(total), dtype="i4")), pa.array(total)], ["term", "n"])

    def counted(batches):
        counts = Counts(words, settings)
        for batch in batches:
            for part in slices(batch):
                text, term, n = counts(part.column("text"))
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                rows = [(term[a:b].astype("<i4").tobytes(), n[a:b].astype("<i4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch([part.column("doc_id"), part.column("label"), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], ["doc_id", "label", "terms", "counts"])

    df = np.zeros(len(words) + 1, "i8")
    for r in docs.select(whole_text(docs).alias("text")).mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    rows = examples.mapInArrow(counted, "doc_id long, label int, terms binary, counts binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    found, ids, marks, bare = [], [], [], []
    for r in rows:
        terms = np.frombuffer(r["terms"], "<i4").astype("i8")
        if not len(terms):
            bare.append(r["label"])
            continue
        found.append((terms, vectors(terms, np.frombuffer(r["counts"], "<i4"), idf)))
        ids.append(r["doc_id"])
        marks.append(r["label"])
    share = sum(r["label"] for r in rows) / len(rows) if rows else 0.5
    return Model(words, idf, found, np.array(ids, "i8"), np.array(marks, "i8"), (sum(bare) + share) / (len(bare) + 1))


class Voter:
    """Scores and evidence of texts by their nearest examples."""

    def __init__(self, model: Model, settings: Settings):
        self.model, self.settings = model, settings
        self.counts = Counts(model.vocabulary, settings)
        self.index = Index(model.examples, len(model.vocabulary), settings.block)
        self.known: dict[bytes, tuple[float, str]] = {}

    def vote(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, str]:
        key = terms.tobytes() + counts.tobytes()
        if key not in self.known:
            if len(self.known) >= KNOWN // 10:
                self.known.clear()
            s, m = self.settings, self.model
            found, cosines = self.index.nearest(terms, vectors(terms, counts, m.idf), s.neighbours) if len(terms) else (np.zeros(0, "i8"), np.zeros(0))
            votes = cosines**s.power
            score = (float(votes @ m.marks[found]) + s.prior * m.base) / (float(votes.sum()) + s.prior)
            self.known[key] = score, ",".join(f"{m.ids[i]}:{c:.4f}:{m.marks[i]}" for i, c in list(zip(found.tolist(), cosines.tolist(), strict=True))[:5])
        return self.known[key]

    def __call__(self, texts: pa.Array) -> list[tuple[float, str]]:
        text, term, n = self.counts(texts)
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [self.vote(term[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def score_documents(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and evidence (``doc_id:cosine:label`` of the five nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        voter = Voter(shared.value, settings)
        for batch in batches:
            for part in slices(batch):
                found = voter(part.column("text"))
                keep = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.record_batch([*keep, pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())], [*part.schema.names[:-1], "score", "evidence"])

    texts = docs.select("doc_id", is_held_out(docs["doc_id"]).alias("held_out"), whole_text(docs).alias("text"))
    scored = texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, evidence string")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"), "evidence")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score_documents(docs, train(docs, labels, settings), settings)

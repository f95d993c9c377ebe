"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Null text counts as empty; a text without words is scored by the intercept
alone; long texts are read whole; rows that repeat are scored each for itself;
other columns do not matter, whatever their names.  Without labels every score
is 0.5.  Labels of one document that disagree count by their majority, and
rows with a null label or doc_id teach nothing; nor do labels without a
document.  Of rows that share a doc_id one text is learnt from, that of least
hash.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, fresh_path, slices, whole_text

WORDS = re.compile(r"\w+|[^\w\s]+")
#: Words whose hash a worker remembers.
KNOWN = 400_000


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents at most that the classifier is fitted on, those of least hash."""

    bits: int = 18
    sample: int = 12_000
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0
    threshold: float = 0.3


class Featurizer:
    """Hashed words and pairs of neighbouring words, weighted by log(1 + count) and scaled to length one."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = WORDS.findall(text.lower())
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, "<f4")
        known = self.known
        hashes = list(map(known.get, words))
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = h = zlib.crc32(words[i].encode("utf-8", "surrogatepass"))
                    if len(known) < KNOWN:
                        known[words[i]] = h
        h = np.array(hashes, "u8")
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] + np.uint64(1)) * np.uint64(0x85EBCA6B)
        found, counts = np.unique(np.concatenate([h ^ (h >> np.uint64(15)), pairs >> np.uint64(13)]) & self.mask, return_counts=True)
        values = np.log1p(counts)
        return found.astype("<u4"), (values / np.sqrt((values**2).sum())).astype("<f4")


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Follow-the-regularised-leader with a step size for each coordinate; the last coordinate is the intercept."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)

    def weights(self, index) -> np.ndarray:
        s = self.settings
        z = self.z[index]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[index])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        index = np.append(index.astype("i8"), len(self.z) - 1)
        values = np.append(values, 1.0)
        w = self.weights(index)
        gradient = (logistic(w @ values) - label) * values
        squares = gradient**2
        step = (np.sqrt(self.n[index] + squares) - np.sqrt(self.n[index])) / self.settings.alpha
        self.z[index] += gradient - step * w
        self.n[index] += squares


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training; rows without a doc_id are not held out, and carry no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights (2^bits, float32) and intercept, from the labelled documents outside the held-out fold."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    marked = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    present = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most settings.sample rows of two numbers
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")  # one text of each, however often its doc_id repeats
    rows = found.groupBy("doc_id", "label").agg(least).select("doc_id", "label", "least.text")

    def featurize(batches):
        features = Featurizer(settings.bits)
        for batch in batches:
            for part in slices(batch):
                found = [features(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("label"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                    ["doc_id", "label", "index", "value"],
                )

    url = fresh_path(docs.sparkSession, "features")

    def fit(batches):
        """Goes through the rows several times; their features lie in a file, of which a row's part is mapped when its turn comes."""
        name, at, places = uuid.uuid4().hex, 0, []
        with SharedFiles(url).writer(name) as write:
            for batch in batches:
                for doc_id, label, index, value in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                    places.append((zlib.crc32(str(doc_id).encode()), doc_id, label, at, len(index) // 4))
                    write(index)
                    write(value)
                    at += len(index) + len(value)
        data = SharedFiles(url).map(name)
        places.sort()
        model = Ftrl(settings)
        for _ in range(settings.epochs):
            for _, _, label, at, n in places:
                model.learn(np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<f4", n, at + 4 * n), label)
        weights = model.weights(np.arange(len(model.z))).astype("<f4")
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    featured = rows.mapInArrow(featurize, "doc_id long, label int, index binary, value binary")
    made = featured.repartition(1).mapInArrow(fit, "weights binary").head()
    weights = np.frombuffer(made["weights"], "<f4")
    return weights[:-1], float(weights[-1])


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, intercept = shared.value
        features = Featurizer(settings.bits)
        for batch in batches:
            for part in slices(batch):
                sums = []
                for text in part.column("text").to_pylist():
                    index, values = features(text)
                    sums.append(float(weights[index] @ values) + intercept)
                keep = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.record_batch([*keep, pa.array(logistic(np.array(sums)))], [*part.schema.names[:-1], "score"])

    texts = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), whole_text(docs).alias("text"))
    scored = texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings()) -> DataFrame:
    """The documents that the classifier accepts, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        weights, intercept = shared.value
        features = Featurizer(settings.bits)
        for batch in batches:
            for part in slices(batch):
                sums = []
                for text in part.column(at).cast(pa.string()).to_pylist():
                    index, values = features(text or "")
                    sums.append(float(weights[index] @ values) + intercept)
                yield part.filter(pa.array(logistic(np.array(sums)) >= settings.threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score_documents(docs, train(docs, labels, settings), settings)

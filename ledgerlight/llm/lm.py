"""Interpolated modified Kneser-Ney language model over pairs of words.

Spark counts words and neighbouring pairs; the model lies in the shared folder
as arrays sorted by hash, which workers map into memory:

* ``words-*``: hashes of the words (XXH64), sorted, with their counts; a word's
  number is its place among all of them, from 1 on, and 0 stands for the start;
* ``pairs-*`` and ``counts-*``: pairs of word numbers, mixed by a bijection of
  64 bits and sorted; counts of one byte, and a list of the larger ones;
* ``stats-*``: for each word number what follows and precedes it.

Null text counts as empty (one token, the end); texts are read whole; rows that
repeat count and are scored each for itself; other columns do not matter,
whatever their names; an empty table, or one without training rows, gives a
model that knows no word.  Rows without a doc_id are training rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, fresh_path, slices, whole_text

END = b" end"  # no word holds a space
#: Distinct words, or pairs, that a task gathers before it passes them on.
FLUSH = 1 << 20
#: Entries that a task merges at a time; a shard is merged in as many slots, one after another.
MERGED = 1 << 20
#: Words whose number a worker remembers.
KNOWN = 400_000


def tokens(text: str) -> list[bytes]:
    """Words (A-Z lower-cased, parted by ASCII white space), then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def hash_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def shard_bounds(shards: int) -> np.ndarray:
    """Least hash of each shard but the first."""
    return np.array([(k << 64) // shards for k in range(1, shards)], "u8")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def dealt(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray):
    """(shard, bytes of keys, bytes of counts) for sorted keys."""
    edges = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            yield k, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def by_group(batches, columns: int, group: int = 1):
    """(group, list of the rows' values of each column) from rows sorted by their first ``group`` columns."""
    now, held = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:group] != now:
                if held is not None:
                    yield now, held
                now, held = row[:group], [[] for _ in range(columns)]
            for k in range(columns):
                held[k].append(row[k + group])
    if held is not None:
        yield now, held


def joined(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


@dataclass
class Model:
    """Where the model lies and its numbers: a few for each shard."""

    url: str
    shards: int
    word_bases: list[int]
    n_words: int
    n_tokens: int
    n_pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of one, of two, and of three or more; halves where the corpus is too small to tell."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


class Vocabulary:
    """Numbers of words, from the mapped files, with a memory of words met."""

    def __init__(self, url: str, shards: int, bases: list[int]):
        self.bounds, self.bases = shard_bounds(shards), bases
        files = SharedFiles(url)
        self.hashes, self.counts = [], []
        for k in range(shards):
            n = bases[k + 1] - bases[k]
            data = files.map(f"words-{k}") if n else b""
            self.hashes.append(np.frombuffer(data, "<u8", n))
            self.counts.append(np.frombuffer(data, "<u8", n, 8 * n) if n else np.zeros(0, "<u8"))
        self.known: dict[bytes, int] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words of the given hashes; -1 if unknown."""
        order = np.argsort(hashes)
        asked = hashes[order]
        out = np.full(len(asked), -1, "i8")
        edges = [0, *np.searchsorted(asked, self.bounds).tolist(), len(asked)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            own = self.hashes[k]
            if a < b and len(own):
                at = np.minimum(np.searchsorted(own, asked[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == asked[a:b], 1 + self.bases[k] + at, -1)
        found = np.empty_like(out)
        found[order] = out
        return found

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts after one another, and the number of tokens of each."""
        parts = [tokens(t) for t in texts]
        known = self.known
        flat = [w for p in parts for w in p]
        ids = list(map(known.get, flat))
        missing = list({w for w, i in zip(flat, ids, strict=True) if i is None})
        if missing:
            new = dict(zip(missing, self.find(np.array(list(map(hash_word, missing)), "u8")).tolist(), strict=True))
            ids = [new[w] if i is None else i for w, i in zip(flat, ids, strict=True)]
            for w, i in new.items():
                if len(known) >= KNOWN:
                    break
                known[w] = i
        return np.array(ids, "i8"), np.array([len(p) for p in parts], "i8")


def pair_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mixed pairs of each token with the one before it (0 at the start); unknown words give pairs that no model holds."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = 0
    return mix((before.astype("u4").astype("u8") << np.uint64(32)) | ids.astype("u4").astype("u8"))


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def count_words(texts: DataFrame, url: str, shards: int, slots: int = 16) -> list[tuple[int, int, int]]:
    """Writes the words' files; (shard, distinct words, tokens) of each."""
    bounds = shard_bounds(shards * slots)

    def gather(batches):
        def flush(counts):
            keys, sums = summed(np.array(list(map(hash_word, counts)), "u8"), np.array(list(counts.values()), "i8"))
            rows = [(slot // slots, slot, *parts) for slot, *parts in dealt(keys, sums, bounds)]
            return _batch(rows, ["shard", "slot", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    counts.update(tokens(text))
                if len(counts) >= FLUSH // 2:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    def merge(batches):
        """Words go to the file slot by slot, and then their counts, which are held as they take half the room at most."""
        for shard, found in grouped_slots(batches):
            n, sums = 0, []

            def chunks():
                nonlocal n
                for keys, counts in found:
                    words, own = summed(joined(keys, "<u8"), joined(counts, "<u4").astype("i8"))
                    n += len(words)
                    sums.append(own.astype("<u8"))
                    yield words.tobytes()
                yield from (x.tobytes() for x in sums)

            SharedFiles(url).write(f"words-{shard}", chunks())
            yield pa.record_batch([[shard], [n], [int(sum(x.sum() for x in sums))]], ["shard", "n", "total"])

    gathered = texts.mapInArrow(gather, "shard int, slot int, keys binary, counts binary")
    merged = gathered.repartition(shards, "shard").sortWithinPartitions("shard", "slot").mapInArrow(merge, "shard long, n long, total long")
    return [tuple(r) for r in merged.collect()]


def grouped_slots(batches):
    """(shard, iterator of (keys, counts) slot by slot) from rows (shard, slot, keys, counts) sorted by shard and slot."""
    for shard, slots in groupby(by_group(batches, 2, 2), lambda g: g[0][0]):
        yield shard, (found for _, found in slots)


def count_pairs(texts: DataFrame, url: str, shards: int, bases: list[int], n_tokens: int) -> list[tuple]:
    """Writes the pairs' and the words' statistics files; counts of counts, (kind, shard, n1, n2, n3, n4, n), of each."""
    slots = 1 + n_tokens // (shards * MERGED)
    bounds = shard_bounds(shards * slots)
    n_ids = bases[-1] + 1
    id_edges = [n_ids * k // shards for k in range(shards + 1)]

    def gather(batches):
        words = Vocabulary(url, shards, bases)
        held, size = [], 0

        def flush():
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            rows = [(slot // slots, slot, *parts) for slot, *parts in dealt(keys[first], np.diff(first, append=len(keys)), bounds)]
            return _batch(rows, ["shard", "slot", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

        for batch in batches:
            for part in slices(batch):
                held.append(pair_keys(*words.numbers(part.column("text").to_pylist())))
                size += len(held[-1])
                if size >= 2 * FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def tally(counts: np.ndarray) -> np.ndarray:
        return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]

    kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    names = ["shard", "kind", "a", "b", "c"]

    def followers(pairs: np.ndarray, sums: np.ndarray):
        """What pairs say of their first and second words, by ranges of word numbers."""
        both = unmix(pairs)
        first, second = (both >> np.uint64(32)).astype("i8"), (both & np.uint64(0xFFFFFFFF)).astype("i8")
        order = np.argsort(first, kind="stable")
        of, start = np.unique(first[order], return_index=True)
        c = sums[order]
        totals = np.add.reduceat(c, start)
        levels = np.stack([np.add.reduceat((c == 1).astype("i8"), start), np.add.reduceat((c == 2).astype("i8"), start), np.add.reduceat((c > 2).astype("i8"), start)], 1)
        heads, before = np.unique(second, return_counts=True)
        for k, (lo, hi) in enumerate(zip(id_edges, id_edges[1:], strict=False)):
            a, b = np.searchsorted(of, (lo, hi))
            if a < b:
                yield k, "first", of[a:b].astype("<u4").tobytes(), totals[a:b].astype("<u8").tobytes(), levels[a:b].astype("<u4").tobytes()
            a, b = np.searchsorted(heads, (lo, hi))
            if a < b:
                yield k, "second", heads[a:b].astype("<u4").tobytes(), before[a:b].astype("<u4").tobytes(), b""

    def merge(batches):
        """The pairs of a shard slot by slot into a file of keys and one of counts; goes on with what they say of their words."""
        for shard, found in grouped_slots(batches):
            levels, n, small, large, more = np.zeros(4, "i8"), 0, [], [], []
            rows: list[tuple] = []

            def chunks():
                nonlocal levels, n
                for keys, counts in found:
                    pairs, sums = summed(joined(keys, "<u8"), joined(counts, "<u4").astype("i8"))
                    levels = levels + tally(sums)
                    high = np.flatnonzero(sums > 254)
                    large.append(high + n)
                    more.append(sums[high])
                    small.append(np.where(sums > 254, 255, sums).astype("u1").tobytes())
                    n += len(pairs)
                    rows.extend(followers(pairs, sums))
                    yield pairs.tobytes()

            stream = chunks()
            files = SharedFiles(url)
            # The keys are written as they are merged; rows to pass on are handed over between the slots.
            with files.writer(f"pairs-{shard}") as write:
                for chunk in stream:
                    write(chunk)
                    yield _batch(rows, names, kinds)
                    rows.clear()
            high, sums = np.concatenate(large), np.concatenate(more)
            files.write(f"counts-{shard}", [np.array([n, len(high)], "<u8").tobytes(), high.astype("<u8").tobytes(), sums.astype("<u8").tobytes(), *small])
            yield _batch([(shard, "pairs", np.array([*levels, n], "<i8").tobytes(), b"", b"")], names, kinds)

    def finish(batches):
        """For a range of word numbers: total and numbers of followers by count, and the number of different words before."""
        ranges = ((shard, kind, a, b, c) for batch in batches for shard, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        for shard, rows in groupby(ranges, lambda r: r[0]):
            lo, n = id_edges[shard], id_edges[shard + 1] - id_edges[shard]
            table = np.zeros((n, 5), "<i8")
            for _, what, x, y, z in rows:
                if what == "pairs":
                    own = np.frombuffer(x, "<i8").tolist()
                    yield pa.record_batch([["pairs"], [shard], *([v] for v in own)], ["kind", "shard", "n1", "n2", "n3", "n4", "n"])
                    continue
                at = np.frombuffer(x, "<u4").astype("i8") - lo
                if what == "first":
                    table[at, 0] += np.frombuffer(y, "<i8")
                    table[at, 1:4] += np.frombuffer(z, "<u4").reshape(-1, 3)
                else:
                    table[at, 4] += np.frombuffer(y, "<u4")
            SharedFiles(url).write(f"stats-{shard}", [table.tobytes()])
            seen = table[:, 4]
            yield pa.record_batch([["words"], [shard], *([v] for v in [*tally(seen).tolist(), int((seen > 2).sum())])], ["kind", "shard", "n1", "n2", "n3", "n4", "n"])

    gathered = texts.mapInArrow(gather, "shard int, slot int, keys binary, counts binary")
    merged = gathered.repartition(shards, "shard").sortWithinPartitions("shard", "slot").mapInArrow(merge, "shard int, kind string, a binary, b binary, c binary")
    ended = merged.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(finish, "kind string, shard long, n1 long, n2 long, n3 long, n4 long, n long")
    return [tuple(r) for r in ended.collect()]


def train(texts: DataFrame) -> Model:
    """The model of a table of texts (column ``text``, no nulls), with as many shards as the session has shuffle partitions."""
    spark = texts.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = fresh_path(spark, "lm")
    sizes = np.zeros(shards, "i8")
    n_tokens = 0
    for shard, n, total in count_words(texts, url, shards):
        sizes[shard] = n
        n_tokens += total
    bases = [0, *np.cumsum(sizes).tolist()]
    pairs, words = np.zeros(5, "i8"), np.zeros(5, "i8")
    for kind, _, *numbers in count_pairs(texts, url, shards, bases, n_tokens) if n_tokens else []:
        (pairs if kind == "pairs" else words)[:] += np.array(numbers, "i8")
    n_pairs = int(pairs[4])
    d = discounts(*words[:4].tolist())
    taken = d[0] * words[0] + d[1] * words[1] + d[2] * words[4]
    rest = float(taken / n_pairs) if n_pairs else 1.0
    return Model(url, shards, bases, bases[-1], n_tokens, n_pairs, discounts(*pairs[:4].tolist()), d, rest)


class Scorer:
    """Log10 probabilities from the mapped files."""

    def __init__(self, model: Model):
        self.model = m = model
        self.words = Vocabulary(m.url, m.shards, m.word_bases)
        files = SharedFiles(m.url)
        n_ids = m.n_words + 1
        self.id_edges = np.array([n_ids * k // m.shards for k in range(m.shards + 1)])
        self.files = files
        self.pairs: dict[int, tuple] = {}
        self.stats: dict[int, np.ndarray] = {}

    def _pairs(self, k: int):
        if k not in self.pairs:
            try:
                keys, data = self.files.map(f"pairs-{k}"), self.files.map(f"counts-{k}")
            except FileNotFoundError:
                keys, data = b"", np.zeros(2, "<u8").tobytes()
            n, more = np.frombuffer(data, "<u8", 2).tolist()
            large = np.frombuffer(data, "<u8", more, 16)
            counts = np.frombuffer(data, "<u8", more, 16 + 8 * more)
            self.pairs[k] = np.frombuffer(keys, "<u8", n), large, counts, np.frombuffer(data, "u1", n, 16 + 16 * more) if n else np.zeros(0, "u1")
        return self.pairs[k]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys."""
        out = np.zeros(len(keys), "i8")
        edges = [0, *np.searchsorted(keys, shard_bounds(self.model.shards)).tolist(), len(keys)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a == b:
                continue
            own, large, counts, small = self._pairs(k)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
            found = np.where(own[at] == keys[a:b], small[at], 0).astype("i8")
            for i in np.flatnonzero(found == 255).tolist():
                found[i] = counts[np.searchsorted(large, at[i])]
            out[a:b] = found
        return out

    def word_stats(self, ids: np.ndarray) -> np.ndarray:
        """Statistics of sorted word numbers."""
        out = np.zeros((len(ids), 5), "i8")
        edges = np.searchsorted(ids, self.id_edges).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                if k not in self.stats:
                    try:
                        data = self.files.map(f"stats-{k}")
                    except FileNotFoundError:
                        data = b"\0" * (40 * int(self.id_edges[k + 1] - self.id_edges[k]))
                    self.stats[k] = np.frombuffer(data, "<i8").reshape(-1, 5)
                out[a:b] = self.stats[k][ids[a:b] - self.id_edges[k]]
        return out

    def score(self, texts: list[str]):
        """Number of tokens, known tokens, base score and model score of each text."""
        m = self.model
        ids, lengths = self.words.numbers(texts)
        starts = np.cumsum(lengths) - lengths
        known = ids > 0
        distinct, of = np.unique(ids, return_inverse=True)
        seen = distinct > 0
        counts = np.zeros(len(distinct))
        edges = np.searchsorted(distinct, np.array(m.word_bases) + 1).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                counts[a:b] = self.words.counts[k][distinct[a:b] - 1 - m.word_bases[k]]
        base = np.log10((counts + 0.1) / (m.n_tokens + 0.1 * (m.n_words + 1)))[of]
        own = np.zeros((len(distinct), 5), "i8")
        own[seen] = self.word_stats(distinct[seen])
        d = np.array([0.0, *m.word_discounts])
        before = own[:, 4]
        word_p = m.word_rest / (m.n_words + 1) + np.maximum(before - d[np.minimum(before, 3)], 0) / max(m.n_pairs, 1)
        start = self.word_stats(np.zeros(1, "i8"))
        d = np.array([0.0, *m.pair_discounts])
        context = np.concatenate([own, start])
        total = context[:, 0]
        rest = np.where(total > 0, context[:, 1:4] @ d[1:] / np.maximum(total, 1), 1.0)
        previous = np.empty_like(of)
        previous[1:] = of[:-1]
        previous[starts] = len(distinct)
        keys, at = np.unique(pair_keys(ids, lengths), return_inverse=True)
        c = self.pair_counts(keys)[at]
        c = np.where(known, c, 0)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[previous], 1) + rest[previous] * word_p[of]
        sums = [np.add.reduceat(x, starts) for x in (known.astype("i8"), base, np.log10(p))]
        return lengths, *sums


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """One row per document: its tokens and scores under a model of the documents outside the held-out fold."""
    texts = docs.select("doc_id", held_out(docs["doc_id"], folds).alias("held_out"), whole_text(docs).alias("text"))
    return score_texts(texts, train(texts.filter("NOT held_out").select("text")))


def score_texts(texts: DataFrame, model: Model) -> DataFrame:
    """Scores (doc_id, held_out, text) rows; perplexity is 10 ** (-score / n_tokens)."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                n, known, base, score = scorer.score(part.column("text").to_pylist())
                total = pa.array(np.full(len(n), model.n_tokens))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(known), total, pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
                yield pa.record_batch(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return texts.mapInArrow(run, schema)

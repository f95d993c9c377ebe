"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves through a binary trie.

Equal fingerprints are one node.  Nodes are dealt to buckets such that linked
ones share a bucket; within a bucket the sorted fingerprints are a binary trie,
and pairs of its nodes are followed together from the root.  Each bit in which
the two sides of a pair differ counts against the error budget; a pair over it
is dropped with all that lies below.

A bucket of more than ``lane_rows`` nodes is dealt into lanes, and each pair of
lanes is worked on by itself.  A group of rows gives no more links than it has
nodes (a spanning forest), so copies are never expanded into pairs.

``similar_documents`` judges by the sets of distinct shingles themselves: rows
with the same set are one node, MinHash bands only propose pairs, and a pair is
linked if the Jaccard similarity of its two sets is at the bound or over it.

Null text counts as empty; a text without words has fingerprint zero; one of
fewer words than a shingle is one shingle; long texts are read whole; rows that
repeat share a fingerprint; an empty table gives an empty result; other columns
do not matter, whatever their names.  Null doc_ids link like others and are
never a component's id unless all its ids are null.
"""

from __future__ import annotations

from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, fresh_path, slices, spread_join, staged, whole_text
from .components import components

SEED = 42
#: Rows of a bucket that are worked on together; larger buckets are dealt into lanes.
LANE_ROWS = 1024
#: A pair of trie nodes with so few pairs of leaves is compared leaf by leaf.
LEAF_PAIRS = 256
MASK = (1 << 64) - 1


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of the words of a text (A-Z lower-cased, parted by ASCII white space), repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each, from its first."""
    h = (hashes + np.uint64(k * 0x9E3779B97F4A7C15 & MASK)).astype("<u8")
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int, size: int = 1) -> DataFrame:
    """doc_id, n (shingles) and f0..f{size-1}, signed longs of 64 fingerprint bits each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                counts, columns = [], [[] for _ in range(size)]
                for text in part.column("text").to_pylist():
                    h = shingle_hashes(text, words)
                    counts.append(len(h))
                    for k, column in enumerate(columns):
                        column.append(majority(remixed(h, k) if k else h) if len(h) else 0)
                arrays = [pa.array(np.array(c, "u8").view("i8")) for c in columns]
                yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), *arrays], ["doc_id", "n", *(f"f{k}" for k in range(size))])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, " + ", ".join(f"f{k} long" for k in range(size))
    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, schema)


def block_keys(budget: int, nodes: int, lane_rows: int = LANE_ROWS) -> list[Column]:
    """Keys of which any two nodes within the budget share one, made of as many bits as so many nodes need.

    The fingerprint is cut into runs of bits.  Within the budget all but
    ``budget`` runs agree, so there is a key for each choice of the others.
    With one more run than the budget a key is one run; more runs, with more
    bits to a key, are taken until buckets of evenly spread fingerprints hold
    less than ``lane_rows``.  Keys are hashes; should two choices ever have the
    same one, their nodes are compared in vain and nothing else.
    """
    runs = budget + 1
    while nodes >> (64 * (runs - budget) // runs) > lane_rows:
        runs += 1
    edges = [round(64 * k / runs) for k in range(runs + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, runs - budget)]
    return [F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(chosen)]


def least_values(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value that each random function takes on a set of shingles."""
    least = np.full((factors.size, 1), MASK, "u8")
    for at in range(0, len(shingles), 256):
        values = shingles[None, at : at + 256] * factors.reshape(-1, 1) + shifts.reshape(-1, 1)
        np.minimum(least, values.min(1, keepdims=True), out=least)
    return least.reshape(factors.shape)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band (bands, rows) of least values."""
    return np.fromiter((xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least)), "u8", len(least))


def random_functions(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of as many random functions, the same ones always."""
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 64, (bands, rows), dtype="u8") | np.uint64(1), random.integers(0, 1 << 64, (bands, rows), dtype="u8")


def set_digest(shingles: np.ndarray) -> int:
    """One number for a sorted set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype("i8"))


class Forest:
    """Components of rows as they are linked, in arrays."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.of[a], self.of[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.of, high, low)
            while True:
                on = self.of[self.of]
                if (on == self.of).all():
                    break
                self.of = on


def trie_join(words: np.ndarray, starts: list[tuple[int, int, int, int]], budget: int, forest: Forest) -> None:
    """Links rows of ``words`` (n, size) within the budget.

    ``starts`` are pairs of row ranges (lo, hi, lo2, hi2), equal or apart, each
    range sorted by the first word.
    """
    if not starts:
        return
    first = words[:, 0]
    pairs = np.array(starts, "i8").reshape(-1, 4)
    errors = np.zeros(len(pairs), "i8")
    for bit in range(63, -2, -1):
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (sizes <= LEAF_PAIRS) if bit >= 0 else np.ones(len(pairs), bool)
        compare_leaves(words, pairs[small], budget, forest)
        pairs, errors = pairs[~small], errors[~small]
        if not len(pairs):
            return
        ones = np.concatenate([[0], np.cumsum((first >> np.uint64(bit)) & np.uint64(1))]).astype("i8")
        middle = lambda lo, hi: hi - (ones[hi] - ones[lo])
        lo, hi, lo2, hi2 = pairs.T
        mid, mid2 = middle(lo, hi), middle(lo2, hi2)
        same = (lo == lo2) & (hi == hi2)
        children = [(lo, mid, lo2, mid2, 0, None), (mid, hi, mid2, hi2, 0, None), (lo, mid, mid2, hi2, 1, None), (mid, hi, lo2, mid2, 1, ~same)]
        next_pairs, next_errors = [], []
        for a, b, c, d, more, where in children:
            keep = (a < b) & (c < d) & (errors + more <= budget)
            if where is not None:
                keep &= where
            next_pairs.append(np.stack([a, b, c, d], 1)[keep])
            next_errors.append(errors[keep] + more)
        pairs, errors = np.concatenate(next_pairs), np.concatenate(next_errors)


def compare_leaves(words: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest, most: int = 1 << 20) -> None:
    """Compares all leaves of pairs of row ranges, so many at a time."""
    if not len(pairs):
        return
    widths = pairs[:, 3] - pairs[:, 2]
    sizes = (pairs[:, 1] - pairs[:, 0]) * widths
    ends = np.cumsum(sizes)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        total = int(sizes[at:to].sum())
        of = np.repeat(np.arange(at, to), sizes[at:to])
        k = np.arange(total) - np.repeat(ends[at:to] - sizes[at:to] - (ends[at - 1] if at else 0), sizes[at:to])
        a, b = pairs[of, 0] + k // widths[of], pairs[of, 2] + k % widths[of]
        near = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype="i8") <= budget
        forest.link(a[near], b[near])
        at = to


def in_lanes(rows: DataFrame, columns: list[str], lane_rows: int) -> DataFrame:
    """Rows (key, node, columns) so dealt and sorted that each task has whole groups (key, pair) of at most two lanes.

    A key of more than ``lane_rows`` rows is dealt into lanes, and each pair of
    its lanes is a group.
    """
    large = rows.groupBy("key").count().filter(F.col("count") > lane_rows).select("key", F.ceil(F.col("count") / lane_rows).cast("int").alias("lanes"))
    dealt = spread_join(rows, large, "key", "node").withColumn("lane", F.pmod(F.xxhash64("node", "key"), F.coalesce("lanes", F.lit(1))).cast("int"))
    across = F.when(F.col("lanes").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("lanes") - 1))
    dealt = dealt.select("key", "lane", "node", *columns, F.explode(across).alias("with"))
    pair = F.shiftleft(F.least("lane", "with").cast("long"), 32) + F.greatest("lane", "with")
    dealt = dealt.select("key", pair.alias("pair"), "lane", "node", *columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "lane")


def over_groups(batches, solve):
    """``solve(table, groups)`` for runs of whole groups of ``in_lanes``; groups are (rows from, rows to, end of the first lane)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        whole, held = _whole_groups(table, last=False)
        if whole is not None:
            yield solve(*whole)
    if held is not None:
        whole, _ = _whole_groups(held, last=True)
        if whole is not None:
            yield solve(*whole)


def _whole_groups(table, last: bool):
    """((rows of whole groups, groups), the rows left over)."""
    table = table.combine_chunks()
    n = table.num_rows
    if not n:
        return None, None
    key, pair, lane = (table.column(c).to_numpy() for c in ("key", "pair", "lane"))
    change = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
    bounds = np.concatenate([[0], change, [n]])
    if not last:
        bounds = bounds[:-1]
    to = int(bounds[-1])
    groups = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            low, high = int(pair[a]) >> 32, int(pair[a]) & 0xFFFFFFFF
            groups.append((a, b, b if low == high else a + int(np.searchsorted(lane[a:b], low, side="right"))))
    return ((table.slice(0, to), groups) if to else None), (table.slice(to) if not last else None)


def _forest_links(forest: Forest, node: np.ndarray):
    moved = np.flatnonzero(forest.of != np.arange(len(node)))
    a, b = node[moved], node[forest.of[moved]]
    apart = a != b
    return pa.record_batch([pa.array(a[apart]), pa.array(b[apart])], ["a", "b"])


def links(nodes: DataFrame, keys: list[Column], budget: int, size: int = 1, lane_rows: int = LANE_ROWS) -> DataFrame:
    """(a, b) of linked nodes (``node`` long, f0.., and what the keys use), a spanning forest of each group of rows."""
    prints = [f"f{k}" for k in range(size)]
    rows = nodes.select("node", *prints, F.explode(F.array(*keys)).alias("key"))

    def solve(table, groups):
        node = table.column("node").to_numpy()
        words = np.stack([table.column(p).to_numpy() for p in prints], 1).view("u8")
        order = np.arange(len(node))
        starts = []
        for lo, hi, mid in groups:
            for a, b in ((lo, mid), (mid, hi)):
                order[a:b] = a + np.argsort(words[a:b, 0], kind="stable")
            starts.append((lo, hi, lo, hi) if mid == hi else (lo, mid, mid, hi))
        node, words = node[order], words[order]
        forest = Forest(len(node))
        trie_join(words, starts, budget, forest)
        return _forest_links(forest, node)

    return in_lanes(rows, prints, lane_rows).mapInArrow(lambda batches: over_groups(batches, solve), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, lane_rows: int = LANE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links lead to."""
    prints = staged(fingerprints(docs, words).select("doc_id", F.col("f0").alias("node")), "prints")
    nodes = staged(prints.groupBy("node").agg(F.min("doc_id").alias("first")).withColumn("f0", F.col("node")), "nodes")
    labels = components(links(nodes, block_keys(budget, nodes.count(), lane_rows), budget, 1, lane_rows))
    return _named(prints, nodes, labels).select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _named(prints: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``prints`` (doc_id, node) with component_id, the least ``first`` of the nodes (node, first) of a component (node, root)."""
    linked = staged(labels.join(nodes.select("node", "first").hint("merge"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    found = spread_join(linked.select("node", "root"), least, "root", "node").select("node", "least")
    named = nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    return spread_join(prints, named, "node", "doc_id")


#: Slots of the bitmap of nodes whose sets are read; nodes that share a slot are read in vain and nothing else.
SLOTS = 1 << 25


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (the digest of the set of distinct shingles), n (its size), f0 (its fingerprint) and keys (one for each band, none for an empty set)."""

    def run(batches):
        functions = random_functions(bands, rows)
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(shingle_hashes(t, words)) for t in part.column("text").to_pylist()]
                keys = [band_keys(least_values(s, *functions)).view("i8") if len(s) else [] for s in sets]
                prints = np.array([majority(s) for s in sets], "u8").view("i8")
                arrays = [pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.record_batch([part.column("doc_id"), *arrays], ["doc_id", "node", "n", "f0", "keys"])

    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, node long, n long, f0 long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes asked for: their sorted distinct shingle hashes as bytes.

    The texts are read again and pass a bitmap of the nodes, of a fixed size,
    so that only sets that are asked for (and a few others) are moved.
    """
    slot = F.col("node").bitwiseAND(F.lit(SLOTS - 1))
    found = nodes.select(F.shiftright(slot, 15).alias("at"), slot.bitwiseAND(F.lit(0x7FFF)).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bitmap = np.zeros((SLOTS >> 15, 1 << 12), "u1")
    for r in found:
        bitmap[r["at"]] = np.frombuffer(r["bits"], "u1")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    def run(batches):
        wanted = shared.value
        for batch in batches:
            for part in slices(batch):
                out = {}
                for text in part.column("text").to_pylist():
                    shingles = np.unique(shingle_hashes(text, words))
                    node = set_digest(shingles)
                    at = node & (SLOTS - 1)
                    if wanted[at >> 3] >> (at & 7) & 1:
                        out[node] = shingles.tobytes()
                yield pa.record_batch([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["node", "shingles"])

    return docs.select(whole_text(docs).alias("text")).mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


class SetFiles:
    """Sets of shingles in files of the shared folder, with their band keys and a byte of each least value.

    A file holds the sets of the nodes of one shard one after another, then the
    nodes in order, where their sets begin, the keys, the bytes, and the number
    of nodes.
    """

    def __init__(self, url: str, shards: int, bands: int, rows: int):
        self.url, self.shards, self.bands, self.rows = url, shards, bands, rows

    def write(self, sets: DataFrame) -> None:
        """Writes the files of ``sets`` (node, shingles)."""

        def run(batches):
            functions = random_functions(self.bands, self.rows)
            rows = (r for b in batches for r in zip(b.column("shard").to_pylist(), b.column("node").to_pylist(), b.column("shingles"), strict=True))
            for shard, own in groupby(rows, lambda r: r[0]):
                nodes, starts, keys, marks = [], [0], [], []
                with SharedFiles(self.url).writer(f"part-{shard}") as add:
                    for _, node, shingles in own:
                        data = shingles.as_buffer()
                        least = least_values(np.frombuffer(data, "<u8"), *functions)
                        add(data)
                        nodes.append(node)
                        starts.append(starts[-1] + data.size // 8)
                        keys.append(band_keys(least).tobytes())
                        marks.append(least.astype("u1").tobytes())
                    for numbers in (nodes, starts):
                        add(np.array(numbers, "<i8").tobytes())
                    add(b"".join(keys))
                    add(b"".join(marks))
                    add(np.array([len(nodes), starts[-1]], "<i8").tobytes())
                yield pa.record_batch([[len(nodes)]], ["n"])

        dealt = sets.withColumn("shard", self.shard("node")).repartition(self.shards, "shard")
        dealt.sortWithinPartitions("shard", "node").select("shard", "node", "shingles").mapInArrow(run, "n long").agg(F.sum("n")).collect()

    def shard(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.shards)).cast("int")

    def reader(self):
        """A function from nodes with their shards to (keys, bytes, function from a place to its set).

        Files are mapped, so a worker holds only what it has read of them.
        """
        files, shards = SharedFiles(self.url), {}

        def load(k: int):
            if k not in shards:
                data = files.map(f"part-{k}")
                n, total = np.frombuffer(data, "<i8", 2, len(data) - 16).tolist()
                at = 8 * np.cumsum([0, total, n, n + 1, n * self.bands]).astype("i8")
                parts = [np.frombuffer(data, kind, size, int(x)) for kind, size, x in zip(("<u8", "<i8", "<i8", "<u8", "u1"), (total, n, n + 1, n * self.bands, n * self.bands * self.rows), at, strict=True)]
                shards[k] = *parts[:3], parts[3].reshape(n, -1), parts[4].reshape(n, -1)
            return shards[k]

        def find(nodes: np.ndarray, of: np.ndarray):
            keys, marks = np.zeros((len(nodes), self.bands), "<u8"), np.zeros((len(nodes), self.bands * self.rows), "u1")
            places = np.zeros(len(nodes), "i8")
            for k in np.unique(of).tolist():
                _, known, _, own_keys, own_marks = load(k)
                here = np.flatnonzero(of == k)
                places[here] = at = np.searchsorted(known, nodes[here])
                keys[here], marks[here] = own_keys[at], own_marks[at]

            def members(i: int) -> np.ndarray:
                blob, _, starts, _, _ = load(int(of[i]))
                return blob[starts[places[i]] : starts[places[i] + 1]]

            return keys, marks, members

        return find


def confirmed(pairs: DataFrame, sets: SetFiles, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the Jaccard similarity."""

    def run(batches):
        find = sets.reader()
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, first, of = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]), return_index=True, return_inverse=True)
            shards = np.concatenate([batch.column(c).to_numpy() for c in ("sa", "sb")])[first]
            members = find(nodes, shards)[2]
            keep = []
            for i, j in of.reshape(2, -1).T.tolist():
                x, y = members(i), members(j)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", sets.shard("a").alias("sa"), sets.shard("b").alias("sb")).mapInArrow(run, "a long, b long")


def similar_in_bands(rows: DataFrame, sets: SetFiles, similarity: float, lane_rows: int = LANE_ROWS) -> DataFrame:
    """(a, b) of similar nodes that share the key of a band and are not of one root (key, band, node, n, root); a task links each two roots once.

    All pairs of a group are looked at by the task that has it: a pair belongs
    to the first band that its nodes share, so it is looked at once.  Bytes of
    least values tell most pairs apart (one at the bound is passed over with a
    probability below 1e-6); those that stay are judged by the sets themselves.
    No pair leaves the task unless it is a link.
    """
    functions = sets.bands * sets.rows
    enough = functions * similarity - 5 * (functions * similarity * (1 - similarity)) ** 0.5
    close = lambda x, y: np.minimum(x, y) + 1e-9 >= similarity * np.maximum(x, y)

    def run(batches):
        find = sets.reader()

        def solve(table, groups):
            node, shards, n, root, band = (table.column(c).to_numpy() for c in ("node", "shard", "n", "root", "band"))
            known, first, of = np.unique(node, return_index=True, return_inverse=True)
            keys, marks, members = find(known, shards[first])
            roots = np.unique(root, return_inverse=True)[1]
            joined = Forest(len(node))  # of roots
            found = []
            for a, b in pair_blocks(groups):
                keep = (joined.of[roots[a]] != joined.of[roots[b]]) & close(n[a], n[b])
                a, b = a[keep], b[keep]
                keep = (marks[of[a]] == marks[of[b]]).sum(1) >= enough
                a, b = a[keep], b[keep]
                keep = (keys[of[a]] == keys[of[b]]).argmax(1) == band[a]
                for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                    if joined.of[roots[x]] == joined.of[roots[y]]:
                        continue
                    both = len(np.intersect1d(members(of[x]), members(of[y]), assume_unique=True))
                    if both + 1e-9 >= similarity * (n[x] + n[y] - both):
                        joined.link(roots[[x]], roots[[y]])
                        found.append((int(node[x]), int(node[y])))
            return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        yield from over_groups(batches, solve)

    return in_lanes(rows.withColumn("shard", sets.shard("node")), ["shard", "n", "root", "band"], lane_rows).mapInArrow(run, "a long, b long")


def pair_blocks(groups: list[tuple[int, int, int]], most: int = 1 << 15):
    """Row numbers (a, b) of the pairs of groups of ``in_lanes``, so many at a time."""
    if not groups:
        return
    lo, hi, mid = np.array(groups, "i8").T
    other = np.where(mid == hi, lo, mid)
    width = hi - other
    ends = np.cumsum((mid - lo) * width)
    for at in range(0, int(ends[-1]), most):
        k = np.arange(at, min(at + most, int(ends[-1])))
        g = np.searchsorted(ends, k, side="right")
        k = k - np.where(g > 0, ends[g - 1], 0)
        a, b = lo[g] + k // width[g], other[g] + k % width[g]
        yield a[a < b], b[a < b]


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, budget: int = 4, bands: int = 40, rows: int = 5, lane_rows: int = LANE_ROWS) -> DataFrame:
    """doc_id and component_id of groups of documents, linked where the Jaccard similarity of their sets of shingles is ``similarity`` or more.

    The trie join of the sets' fingerprints proposes pairs within the budget.
    A pair at the bound may differ in many more bits, so bands take in the
    rest: nodes that share the key of a band may be similar, and a pair at
    similarity s shares none with probability (1 - s**rows)**bands, 1.3e-7 at
    0.8.  First each node is compared with its links in the trie and with one
    node of each of its bands, drawn by hash; then, within the tasks that have
    a band's nodes, all pairs that are still in different components.  So what
    is left out are pairs whose ends are linked already, and no group is
    expanded into pairs.
    """
    prints = staged(sketches(docs, words, bands, rows), "prints")
    once = [F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "f0", "keys")]]
    nodes = staged(prints.groupBy("node").agg(*once), "nodes")
    near = links(nodes.filter("n > 0"), block_keys(budget, nodes.count(), lane_rows), budget, 1, lane_rows)
    members = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    drawn = F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("lead"), F.col("n").alias("lead_n"))).alias("drawn")
    leads = members.groupBy("key").agg(drawn, F.count("*").alias("rows")).filter("rows > 1").select("key", "drawn.lead", "drawn.lead_n")
    shared = staged(spread_join(members, leads, "key", "node").filter("lead IS NOT NULL"), "bands")
    close = F.least("n", "lead_n") + 1e-9 >= similarity * F.greatest("n", "lead_n")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    stars = shared.filter((F.col("node") != F.col("lead")) & close).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    stars = staged(stars.union(near).select(*pair).distinct(), "pairs")
    asked = shared.select("node").union(stars.select("a")).union(stars.select("b")).distinct()
    sets = SetFiles(fresh_path(docs.sparkSession, "sets"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bands, rows)
    sets.write(shingle_sets(docs, words, asked))
    linked = staged(confirmed(stars, sets, similarity), "confirmed")
    labels = components(linked)
    rooted = shared.select("key", "band", "node", "n").join(labels.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = staged(rooted, "bands")
    split = rooted.groupBy("key").agg((F.min("root") < F.max("root")).alias("apart")).filter("apart")
    rooted = staged(spread_join(rooted, split, "key", "node").filter("apart").drop("apart"), "bands")
    more = staged(similar_in_bands(rooted, sets, similarity, lane_rows), "confirmed")
    if not more.isEmpty():
        labels = components(linked.union(more))
    return _named(prints.select("doc_id", "node"), nodes, labels).select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those near one of a smaller doc_id.

    A document is a doc_id with a text: rows that repeat both leave one row,
    rows of one doc_id with different texts are judged each for itself (the
    order between them is that of a hash of the text).  Rows without a doc_id
    are not judged and stay.
    """
    text = whole_text(docs)
    keyed = docs.select(F.struct("*").alias("row"), F.struct(docs["doc_id"].alias("id"), F.xxhash64(text).alias("h")).alias("doc_id"), text.alias("text"))
    found = similar_documents(keyed.filter("doc_id.id IS NOT NULL").select("doc_id", "text"), **options)
    judged = staged(found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("near"), F.count("*").alias("rows")), "judged")
    near = judged.filter("near").select("doc_id").hint("merge")  # it grows with the documents, so it is never broadcast
    rest = keyed.join(near, "doc_id", "left_anti")
    repeated = judged.filter("NOT near AND rows > 1").select("doc_id").hint("merge")
    once = rest.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.first("row").alias("row"))
    return rest.join(repeated, "doc_id", "left_anti").select("row.*").unionByName(once.select("row.*"))

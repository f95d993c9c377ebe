"""Phrase collocations: pairs counted by direct address in tiles, frequent pairs ranked and paired again.

Texts become blocks of word numbers.  Within a language the words that are
frequent enough are numbered by falling frequency; a block's pairs of
neighbouring numbers fall into tiles of the square of both numbers, and a
crowded tile is counted in a dense array, the others as sorted coordinates.  A
phrase of m + 1 words is a pair of phrases of m words that overlap in all but
one, and cannot be more frequent than either; so the frequent pairs get numbers
of their own, by falling frequency, take the place of the words, and pairs of
them are counted in the same way.

What a block counted leaves it in packets, one for each lane that a pair's hash
falls to; a lane adds up the packets of all blocks and keeps what is frequent.
A block never looks a pair up in a table of all pairs: the frequent part of its
packets meets the numbered pairs of its lane and comes back to it as its own
small table.  Numbers travel as narrow, compressed differences.  All counts are exact and cover all texts.

Null text counts as empty, a null language as ``und``; a word is never cut,
whatever its length; rows that repeat count each for itself; an empty table
gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, staged, whole_text
from .words import byte_kinds, words_of

#: What ends a piece, and what parts words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: The side of a tile; a tile is dense when its cells are no more than so many times its pairs.
SIDE, SPARSE = 1024, 16
#: Tiles along each side of the square that may be dense; beyond them all are counted as sorted coordinates.
TILES = 1024
#: Text bytes of a block, after which a task writes it.
BLOCK_BYTES = 8 << 20
#: Words of the corpus for each lane at most, which bounds what a lane adds up.
LANE = 1 << 21
CODEC = pa.Codec("zstd", compression_level=1)
WORDS = "lang string, lane int, block long, codes binary, words binary, counts binary"
PAIRS = "lang string, lane int, block long, left binary, right binary, counts binary"


@dataclass(frozen=True)
class Settings:
    """``least``: occurrences of a candidate; ``most_words``: its length; ``covered``: percent of its occurrences that lie in a longer one; ``top``: rows for each language."""

    least: int = 30
    most_words: int = 4
    covered: int = 80
    top: int = 2000


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts of one language: the numbers of their words, -1 between pieces, and the distinct words with their counts."""
    kinds = byte_kinds(BLANKS, BREAKS)
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), whole_text(docs).alias("text"))

    def block(lang: str, held: list) -> pa.RecordBatch:
        whole = pa.concat_arrays([d for d, _ in held]).dictionary_encode()
        place, at, parts = whole.indices.to_numpy(zero_copy_only=False).astype("i8"), 0, []
        for distinct, codes in held:
            parts.append(np.where(codes >= 0, place[np.maximum(codes, 0) + at], -1) if len(distinct) else codes)
            at += len(distinct)
        ids = np.concatenate(parts)
        counts = np.bincount(ids[ids >= 0], minlength=len(whole.dictionary)).astype("i8")
        binary = (squeezed(ids + 1), text_squeezed(b" ".join(whole.dictionary.to_pylist())), squeezed(counts))  # no word holds a blank
        columns = [pa.array([lang]), pa.array([int(counts.sum())]), *(pa.array([v], pa.binary()) for v in binary)]
        return pa.record_batch(columns, ["lang", "n", "ids", "words", "counts"])

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                named = part.column("lang").dictionary_encode()
                of = named.indices.to_numpy(zero_copy_only=False)
                for i, lang in enumerate(named.dictionary.to_pylist()):
                    found = words_of(part.column("text").filter(pa.array(of == i)), kinds)
                    cuts = np.flatnonzero(np.diff(found.piece)) + 1
                    held.setdefault(lang, []).append((found.distinct, np.append(np.insert(found.codes, cuts, -1), np.int32(-1))))
                size += part.column("text").nbytes
                if size >= BLOCK_BYTES:
                    for lang, own in held.items():
                        yield block(lang, own)
                    held, size = {}, 0
        for lang, own in held.items():
            yield block(lang, own)

    made = rows.mapInArrow(run, "lang string, n long, ids binary, words binary, counts binary")
    return staged(made.select(F.monotonically_increasing_id().alias("block"), "*"), "phrase-blocks")


def sorted_sums(left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with the sums of their counts (each counts once, if there are none)."""
    if not len(left):
        return left, right, np.zeros(0, "i8")
    span = int(right.max()) + 1
    if int(left.max()) < (1 << 62) // span:
        keys = left * span + right
        order = np.argsort(keys)
    else:
        order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    sums = np.diff(np.append(first, len(left))) if n is None else np.add.reduceat(n[order], first)
    return left[first], right[first], sums


def tile_counts(left: np.ndarray, right: np.ndarray, side: int = SIDE):
    """Distinct pairs with their counts, tile by tile: dense ones in an array with a cell for each pair, the others in order."""
    rest = np.ones(len(left), bool)
    head = (left < TILES * side) & (right < TILES * side)
    tile = np.where(head, (left // side) * TILES + right // side, TILES * TILES)
    pairs = np.bincount(tile, minlength=TILES * TILES + 1)[:-1]
    for t in np.flatnonzero(pairs * SPARSE >= side * side).tolist():
        own = tile == t
        rest &= ~own
        cells = np.bincount((left[own] % side) * side + right[own] % side, minlength=side * side)
        used = np.flatnonzero(cells)
        yield t // TILES * side + used // side, t % TILES * side + used % side, cells[used]
    yield sorted_sums(left[rest], right[rest])


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a number and the next one both count, and these two numbers."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at], ids[at + 1]


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of at least 0 in as few bytes each as the greatest one needs, their bytes of one rank together, compressed."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view("u1").reshape(-1, width).T)
    return struct.pack("<BQ", width, len(values)) + (CODEC.compress(planes, asbytes=True) if len(values) else b"")


def released(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    if not n:
        return np.zeros(0, "i8")
    planes = np.frombuffer(CODEC.decompress(memoryview(data)[9:], width * n, asbytes=True), "u1").reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype("i8")


def text_squeezed(text: bytes) -> bytes:
    return struct.pack("<Q", len(text)) + CODEC.compress(text, asbytes=True)


def text_released(data: bytes) -> bytes:
    return CODEC.decompress(memoryview(data)[8:], struct.unpack_from("<Q", data)[0], asbytes=True)


def rises(values: np.ndarray) -> np.ndarray:
    """The differences of rising numbers from 0 on."""
    return np.diff(values, prepend=0)


def all_released(column) -> np.ndarray:
    """The numbers of all packets of a column, one after another."""
    parts = [released(v) for v in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, "i8")


def all_risen(column) -> np.ndarray:
    parts = [np.cumsum(released(v)) for v in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, "i8")


def lane_bounds(order: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries in an order by lane: the lanes that have some, and where each begins and ends."""
    ends = np.searchsorted(lane[order], np.arange(lanes + 1))
    return np.flatnonzero(np.diff(ends)), ends


def word_packets(blocks: DataFrame, lanes: int) -> DataFrame:
    """Each block's distinct words with their counts, by lane of a hash."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                joined = text_released(batch.column("words")[i].as_py())
                words = joined.split(b" ") if joined else []
                counts = released(batch.column("counts")[i].as_py())
                lane = np.array([zlib.crc32(w) % lanes for w in words], "i8")
                order = np.argsort(lane, kind="stable")
                used, ends = lane_bounds(order, lane, lanes)
                own = [order[ends[k] : ends[k + 1]] for k in used.tolist()]
                rows = [(squeezed(rises(o)), text_squeezed(b" ".join([words[j] for j in o.tolist()])), squeezed(counts[o])) for o in own]
                head = [pa.repeat(batch.column("lang")[i], len(used)), pa.array(used.astype("i4")), pa.repeat(batch.column("block")[i], len(used))]
                yield pa.record_batch([*head, *(pa.array([r[c] for r in rows], pa.binary()) for c in range(3))], ["lang", "lane", "block", "codes", "words", "counts"])

    return blocks.select("block", "lang", "words", "counts").mapInArrow(run, WORDS)


def pair_packets(blocks: DataFrame, lanes: int) -> DataFrame:
    """Each block's distinct pairs of neighbouring numbers with their counts, by lane of a hash and in order."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, left, right = neighbours(released(batch.column("ids")[i].as_py()) - 1)
                left, right, n = (np.concatenate(c) for c in zip(*tile_counts(left, right), strict=True))
                lane = pair_lane(left, right, lanes)
                order = np.lexsort((right, left, lane))
                used, ends = lane_bounds(order, lane, lanes)
                own = [order[ends[k] : ends[k + 1]] for k in used.tolist()]
                head = [pa.repeat(batch.column("lang")[i], len(used)), pa.array(used.astype("i4")), pa.repeat(batch.column("block")[i], len(used))]
                rows = [(squeezed(rises(left[o])), squeezed(right[o]), squeezed(n[o])) for o in own]
                yield pa.record_batch([*head, *(pa.array([r[c] for r in rows], pa.binary()) for c in range(3))], ["lang", "lane", "block", "left", "right", "counts"])

    return blocks.select("block", "lang", "ids").mapInArrow(run, PAIRS)


def pair_lane(left: np.ndarray, right: np.ndarray, lanes: int) -> np.ndarray:
    mixed = left.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + right.astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype("i8") % lanes


def frequent_words(packets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, lane, word, n) of the words with at least so many occurrences, and the packets without all others."""

    def add(table: pa.Table) -> pa.Table:
        parts = [text_released(p).split(b" ") for p in table.column("words").to_pylist()]
        words = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
        own = words.indices.to_numpy()
        n = np.bincount(own, all_released(table.column("counts")), len(words.dictionary)).astype("i8")
        often = n >= least
        kept = np.flatnonzero(often)
        distinct = words.dictionary.take(pa.array(kept))
        rows, at = [(None, None, text_squeezed(b" ".join(distinct.to_pylist())), squeezed(n[kept]))], 0
        for block, codes, p in zip(table.column("block").to_pylist(), table.column("codes").to_pylist(), parts, strict=True):
            stays = np.flatnonzero(often[own[at : at + len(p)]])
            at += len(p)
            if len(stays):
                rows.append((block, squeezed(rises(np.cumsum(released(codes))[stays])), text_squeezed(b" ".join([p[j] for j in stays.tolist()])), None))
        return parcel(table, rows if len(kept) else [], ("block", "codes", "words", "counts"))

    met = staged(packets.groupBy("lang", "lane").applyInArrow(add, WORDS), "phrase-frequent")

    def listed(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, n = text_released(batch.column("words")[i].as_py()).split(b" "), released(batch.column("counts")[i].as_py())
                yield pa.record_batch([pa.repeat(batch.column("lang")[i], len(n)), pa.repeat(batch.column("lane")[i], len(n)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "lane", "word", "n"])

    return met.filter("block IS NULL").mapInArrow(listed, "lang string, lane int, word string, n long"), met.filter("block IS NOT NULL")


def frequent_pairs(packets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, lane, left, right, n) of the pairs with at least so many occurrences, and the packets without all others."""

    def add(table: pa.Table) -> pa.Table:
        left, right = all_risen(table.column("left")), all_released(table.column("right"))
        a, b, n = sorted_sums(left, right, all_released(table.column("counts")))
        often = n >= least
        a, b, n = a[often], b[often], n[often]
        rows, at = [(None, squeezed(rises(a)), squeezed(b), squeezed(n))], 0
        sizes = [struct.unpack_from("<BQ", v)[1] for v in table.column("right").to_pylist()]
        there = lookup(a, b, n, left, right) > 0
        for block, size in zip(table.column("block").to_pylist(), sizes, strict=True):
            stays = at + np.flatnonzero(there[at : at + size])
            at += size
            if len(stays):
                rows.append((block, squeezed(rises(left[stays])), squeezed(right[stays]), None))
        return parcel(table, rows if len(n) else [], ("block", "left", "right", "counts"))

    met = staged(packets.groupBy("lang", "lane").applyInArrow(add, PAIRS), "phrase-frequent")

    def listed(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right, n = np.cumsum(released(batch.column("left")[i].as_py())), released(batch.column("right")[i].as_py()), released(batch.column("counts")[i].as_py())
                yield pa.record_batch([pa.repeat(batch.column("lang")[i], len(n)), pa.repeat(batch.column("lane")[i], len(n)), pa.array(left), pa.array(right), pa.array(n)], ["lang", "lane", "left", "right", "n"])

    return met.filter("block IS NULL").mapInArrow(listed, "lang string, lane int, left long, right long, n long"), met.filter("block IS NOT NULL")


def parcel(table: pa.Table, rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    """Rows with the language and lane of a group."""
    head = [pa.array([table.column(c)[0].as_py()] * len(rows), k) for c, k in (("lang", pa.string()), ("lane", pa.int32()))]
    kinds = [pa.int64(), *[pa.binary()] * (len(names) - 1)]
    return pa.table([*head, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["lang", "lane", *names])


def ranked(frequent: DataFrame, keys: list[str]) -> DataFrame:
    """Frequent keys of a language with the number ``id`` by falling frequency.

    The order is one of ranges, so no language falls to one task; a row's number
    is its place in its range and what the ranges before hold of its language.
    """
    order = ["lang", F.desc("n"), *keys]
    parted = frequent.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(parted.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "*"), "phrase-ranked")
    ranges = placed.groupBy("part", "lang").agg(F.count("*").alias("size"), F.min("at").alias("first"))  # a row for each range and language
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("part", "lang", (before - F.col("first")).alias("shift"))
    return placed.join(starts, ["part", "lang"]).select("lang", "lane", *keys, "n", (F.col("at") + F.col("shift")).alias("id"))


def word_tables(packets: DataFrame, words: DataFrame) -> DataFrame:
    """For each block the block's own numbers of frequent words with their ranks, a pair of lists for each lane."""

    def meet(own: pa.Table, known: pa.Table) -> pa.Table:
        number = dict(zip(known.column("word").cast(pa.binary()).to_pylist(), known.column("id").to_pylist(), strict=True))
        ids = [squeezed(np.array([number[w] for w in text_released(p).split(b" ")], "i8")) for p in own.column("words").to_pylist()]
        return pa.table([own.column("block"), own.column("codes"), pa.array(ids, pa.binary())], ["block", "codes", "ids"])

    left, right = packets.select("lang", "lane", "block", "codes", "words").groupBy("lang", "lane"), words.select("lang", "lane", "word", "id").groupBy("lang", "lane")
    met = left.cogroup(right).applyInArrow(meet, "block long, codes binary, ids binary")
    return met.groupBy("block").agg(*(F.collect_list(c).alias(f"known_{c}") for c in ("codes", "ids")))  # no more than the block's words


def pair_tables(packets: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each block the block's frequent pairs with their ranks, three lists for each lane."""

    def meet(own: pa.Table, known: pa.Table) -> pa.Table:
        left, right, ids = (known.column(c).to_numpy() for c in ("left", "right", "id"))
        found = [squeezed(lookup(left, right, ids, np.cumsum(released(a)), released(b))) for a, b in zip(own.column("left").to_pylist(), own.column("right").to_pylist(), strict=True)]
        return pa.table([own.column("block"), own.column("left"), own.column("right"), pa.array(found, pa.binary())], ["block", "left", "right", "ids"])

    own, known = packets.select("lang", "lane", "block", "left", "right").groupBy("lang", "lane"), pairs.select("lang", "lane", "left", "right", "id").groupBy("lang", "lane")
    met = own.cogroup(known).applyInArrow(meet, "block long, left binary, right binary, ids binary")
    return met.groupBy("block").agg(*(F.collect_list(c).alias(f"known_{c}") for c in ("left", "right", "ids")))  # no more than the block's pairs


NUMBERED = "block long, lang string, ids binary"


def numbered(batch: pa.RecordBatch, i: int, ids: np.ndarray) -> pa.RecordBatch:
    """A block with new numbers, -1 (stored as 0) where there is none."""
    return pa.record_batch([batch.column("block").slice(i, 1), batch.column("lang").slice(i, 1), pa.array([squeezed(ids + 1)], pa.binary())], ["block", "lang", "ids"])


def renumbered_words(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with the ranks of their words in place of their own numbers; the join has one plan at all sizes."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = released(batch.column("ids")[i].as_py()) - 1
                ranks = np.full(int(ids.max(initial=-1)) + 2, -1, "i8")  # the last one for the -1 between pieces
                ranks[all_risen(batch.column("known_codes")[i].values)] = all_released(batch.column("known_ids")[i].values)
                yield numbered(batch, i, ranks[ids])

    return staged(blocks.select("block", "lang", "ids").join(tables.hint("merge"), "block").mapInArrow(run, NUMBERED), "phrase-ids")


def renumbered_pairs(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with the ranks of their pairs at the place of each pair's first number; blocks without a frequent pair go."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = released(batch.column("ids")[i].as_py()) - 1
                at, left, right = neighbours(ids)
                out = np.full(len(ids), -1, "i8")
                known = [all_risen(batch.column("known_left")[i].values), *(all_released(batch.column(f"known_{c}")[i].values) for c in ("right", "ids"))]
                out[at] = lookup(*known, left, right)
                yield numbered(batch, i, out)

    return staged(blocks.join(tables.hint("merge"), "block").mapInArrow(run, NUMBERED), "phrase-ids")


def lookup(left: np.ndarray, right: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of the pairs (a, b) among the pairs (left, right), -1 for those that are not there."""
    if not len(ids):
        return np.full(len(a), -1, "i8")
    firsts, rows = np.unique(left, return_inverse=True)
    span = int(right.max()) + 1
    keys = rows * span + right
    order = np.argsort(keys)
    row = np.minimum(np.searchsorted(firsts, a), len(firsts) - 1)
    own = row * span + b
    place = order[np.minimum(np.searchsorted(keys, own, sorter=order), len(keys) - 1)]
    return np.where((firsts[row] == a) & (b < span) & (keys[place] == own), ids[place], -1)


def _exact(number: Column | str) -> Column:
    return (F.col(number) if isinstance(number, str) else number).cast("decimal(19,0)")


def longer(phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases of one more word: their text, and the frequencies of what they begin with and of what they end with, by length."""
    side = lambda name, *columns: phrases.select("lang", F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    both = pairs.join(side("left", "phrase", "heads"), ["lang", "left"]).join(side("right", "last", "tails"), ["lang", "right"])
    own = F.array("n")
    return both.select(
        "lang", "id", "left", "right", "n", F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"),
        F.concat("left_heads", own).alias("heads"), F.concat("right_tails", own).alias("tails"),
    )


def scored(phrases: DataFrame, words: int) -> DataFrame:
    """lang, id, phrase, a, l, r and score of phrases of so many words, by the cut of least score."""
    cuts = []
    for k in range(1, words):
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))  # noqa: E741
        exact = F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * _exact("n"), _exact(l) + _exact(r))
        cuts.append(F.struct(exact.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    least = (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")
    return phrases.select("lang", "id", "phrase", F.col("n").alias("a"), least).select("lang", "id", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, longer_ones: DataFrame, percent: int) -> DataFrame:
    """Candidates without those of which so large a share lies in one longer candidate; ones of more than one word more add nothing, as those between are as frequent."""
    parts = longer_ones.select("lang", F.explode(F.array("left", "right")).alias("id"), "n").groupBy("lang", "id").agg(F.max("n").alias("within"))
    known = candidates.join(parts, ["lang", "id"], "left")
    lies = _exact("within") * 100 >= _exact("a") * percent
    return known.filter(~F.coalesce(lies, F.lit(False))).drop("within")


def mine(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    blocks = word_blocks(docs)
    n = blocks.agg(F.sum("n")).head()[0] or 0
    lanes = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LANE))
    packets = word_packets(blocks, lanes)
    frequent, packets = frequent_words(packets, settings.least)
    words = ranked(frequent, ["word"])
    ids = renumbered_words(blocks, word_tables(packets, words))
    phrases = words.select("lang", "id", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    levels = []
    for m in range(2, settings.most_words + 1):
        frequent, packets = frequent_pairs(pair_packets(ids, lanes), settings.least)
        pairs = ranked(frequent, ["left", "right"])
        phrases = staged(longer(phrases, pairs), "phrases")
        levels.append(phrases)
        if m < settings.most_words:
            ids = renumbered_pairs(ids, pair_tables(packets, pairs))
    kept = None
    for m, level in enumerate(levels, 2):
        found = scored(level, m)
        if m < settings.most_words:
            found = uncovered(found, levels[m - 1], settings.covered)
        kept = found if kept is None else kept.unionByName(found)
    return best(kept.drop("id"), settings.top).join(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first of each language, chosen first within lanes, so that only so many for each lane come together."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    lanes = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(lanes)))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    few = dealt.withColumn("rank", place("lang", "lane")).filter(F.col("rank") <= top).drop("rank", "lane")
    return few.withColumn("rank", place("lang")).filter(F.col("rank") <= top)


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents
), grams AS (
    SELECT lang, k, w[i : i + k - 1] AS words
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (
    SELECT lang, k, words, count(*) AS n FROM grams GROUP BY ALL
), candidates AS (
    SELECT * FROM f WHERE k >= 2 AND n >= 30
), cuts AS (
    SELECT c.lang, c.words, c.k, c.n AS a, cut, l.n AS l, r.n AS r, CAST((2000000::HUGEINT * c.n) // (l.n + r.n) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN f l ON l.lang = c.lang AND l.words = c.words[1 : cut]
    JOIN f r ON r.lang = c.lang AND r.words = c.words[cut + 1 : c.k]
), least AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
), inner_parts AS (
    SELECT lang, words[i : i + m - 1] AS words, max(n) AS within
    FROM (SELECT lang, words, n, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
    GROUP BY ALL
), kept AS (
    SELECT x.lang, array_to_string(x.words, ' ') AS phrase, a, l, r, score
    FROM least x LEFT JOIN inner_parts p ON p.lang = x.lang AND p.words = x.words
    WHERE p.within IS NULL OR 100 * p.within < 80 * a
), sizes AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""

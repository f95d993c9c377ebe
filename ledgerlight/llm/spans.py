"""Spans of regular-expression matches as DataFrame expressions, without Python code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are taken within blocks of so many numbers, so that a text with very many matches costs little.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(numbers: Column, start: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """What the numbers so far come to, each without its own number."""
    zero = F.struct(start.cast("long").alias("t"), F.array().cast("array<bigint>").alias("a"))
    return F.aggregate(
        numbers,
        zero,
        lambda s, x: F.struct(plus(s["t"], x).cast("long").alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")),
        lambda s: s["a"],
    )


def before_each(numbers: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For an array of longs of at least 0, what those before each come to by ``plus``, which must be associative with 0 as its neutral number."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), plus)

    def in_blocks(blocks: Column) -> Column:
        starts = _running(F.transform(blocks, total), F.lit(0), plus)
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: _running(b, F.get(at, i), plus))))

    def whole(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(xs) <= _BLOCK, _running(xs, F.lit(0), plus)).otherwise(let(blocks, in_blocks))

    return let(numbers, whole)


def sums_before(numbers: Column) -> Column:
    """For an array of longs, the sum of what stands before each."""
    return before_each(numbers, lambda a, b: a + b)


#: Code points of a piece of a text that is cut once to be read at many places.
PIECE = 256


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points (the last one shorter), so that a place in it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut_out(pieces: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` up to ``end`` (exclusive) of a text in pieces; what lies beyond it is left out."""
    place = lambda at: F.floor(at / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    within = lambda at: (at % PIECE).cast("int")

    def cut(i: Column) -> Column:
        first, last = i["first"], i["last"]
        same = F.substring(piece(first), within(begin) + 1, (end - begin).cast("int"))
        middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, same).otherwise(F.concat(F.substring(piece(first), within(begin) + 1, F.lit(PIECE)), middle, F.substring(piece(last), F.lit(1), within(end))))

    return let(F.struct(place(begin).alias("first"), place(end).alias("last")), cut)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, body>>.

    Positions count code points and the end is exclusive.  The text between the
    matches comes from ``split``, so positions are sums of lengths.  ``pattern``
    must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = let(gaps, lambda g: F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long")))
        own = lambda x: F.length(x).cast("long")
        spans = let(
            lengths,
            lambda ls: F.zip_with(
                F.arrays_zip(sums_before(ls).alias("before"), ls.alias("step")),
                m,
                lambda p, x: F.struct(
                    (p["before"] + p["step"] - own(x)).alias("start"), (p["before"] + p["step"]).alias("end"), x.alias("body")
                ),
            ),
        )
        none = F.array().cast("array<struct<start:bigint,end:bigint,body:string>>")
        return F.when(F.size(m) > 0, spans).otherwise(none)

    return let(found, placed)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as array<struct<start, order, kind, end, body>>, which sort by start and then by the order of kinds."""
    return F.transform(
        spans, lambda s: F.struct(s["start"], F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"], s["body"])
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Secret scans: patterns for known kinds, and windows of high Shannon entropy in candidate strings.

DataFrame functions only.  Null text counts as empty; an empty text, or one
without findings, gives zero counts and the digest of the empty string; rows
that repeat are scanned each for itself; other columns of the input are kept
out of the way, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .spans import before_each, cut_out, joined, let, match_spans, pieces_of, tagged

#: The kinds of the contract, in its order.
KINDS = ("assign", "access", "hex")
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
)
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Of these two a match is a whole run, so the least length can stand in the pattern and short runs are no matches at all.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
MARK = "[SECRET]"


@dataclass(frozen=True)
class EntropyClass:
    """A character class and the entropy, in bits, at which a window of it counts as random."""

    name: str
    alphabet: str
    pattern: str
    threshold: float


DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("entropy_hex", DIGITS + "abcdef", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9+/_=-])", 3.0),
    EntropyClass("entropy_base64", DIGITS + LOWER + LOWER.upper() + "+/_=-", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 3.8),
    EntropyClass("entropy_lower", DIGITS + LOWER, r"(?<![A-Za-z0-9+/_=-])[0-9a-z]{20,}+(?![A-Za-z0-9+/_=-])", 3.3),
    EntropyClass("entropy_upper", DIGITS + LOWER.upper(), r"(?<![A-Za-z0-9+/_=-])[0-9A-Z]{20,}+(?![A-Za-z0-9+/_=-])", 3.3),
    EntropyClass("entropy_mixed", DIGITS + LOWER + LOWER.upper(), r"(?<![A-Za-z0-9+/_=-])[0-9A-Za-z]{20,}+(?![A-Za-z0-9+/_=-])", 3.6),
)

#: Candidates that match one of these are no secrets: words, words run together by capitals, paths and words joined by marks
#: (no letter follows a digit, and no five digits each other), numbers, UUIDs and rules drawn in text.
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[a-z]{0,30}(?:[A-Z][a-z]{1,30}){1,30}[0-9]{0,2}$",
    r"^(?=.*[/_=+-])(?!.*(?:[0-9][A-Za-z]|[0-9]{5}))",
    r"^[0-9_/=+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)


def entropy_extent(candidate: Column, cls: EntropyClass, window: int) -> Column:
    """struct<first, last>: the code points from the first to the last window at or over the threshold; nulls if there is none.

    The window's counts change by one character in and one out at a step.  With
    S = sum of c*log2(c) over the counts c, its entropy is log2(window) - S / window.
    Counts stand side by side in a few longs, so that a step changes few numbers.
    """
    bits = (window + 1).bit_length()
    each = 63 // bits
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most = window * (math.log2(window) - cls.threshold) + 1e-9
    symbols = F.lower(candidate) if cls.alphabet == cls.alphabet.lower() else candidate
    codes = F.transform(F.split(symbols, ""), lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
    words = F.array(*[F.lit(j) for j in range(-(-len(cls.alphabet) // each))])
    #: What one more of a symbol adds to its word, by the symbol's code.
    ones = F.array(*[F.lit(1 << i % each * bits).cast("long") for i in range(len(cls.alphabet))])
    place = F.array(*[F.lit(i // each) for i in range(len(cls.alphabet))])

    def count(counts: Column, code: Column) -> Column:
        behind = F.call_function("shiftright", F.get(counts, F.get(place, code)), code % each * bits)
        return behind.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def scan(at: Column) -> Column:
        begin = F.struct(
            F.transform(words, lambda j: F.lit(0).cast("long")).alias("n"),
            F.lit(0.0).alias("s"),
            F.lit(0).alias("i"),
            F.lit(None).cast("int").alias("first"),
            F.lit(None).cast("int").alias("last"),
        )

        def step(st: Column, code: Column) -> Column:
            out = F.when(st["i"] >= window, F.get(at, st["i"] - window)).otherwise(F.lit(-1))

            def moved(gone: Column) -> Column:
                own = count(st["n"], code)
                left = F.when(gone >= 0, count(st["n"], F.greatest(gone, F.lit(0)))).otherwise(F.lit(0)) + F.when(gone == code, 1).otherwise(0)
                s = (
                    st["s"]
                    + F.get(weights, own + 1)
                    - F.get(weights, own)
                    - F.when(gone >= 0, F.get(weights, left) - F.get(weights, left - 1)).otherwise(0.0)
                )
                more, less = F.get(place, code), F.get(place, gone)
                counts = F.transform(
                    st["n"],
                    lambda c, j: c + F.when(j == more, F.get(ones, code)).otherwise(0) - F.when(j == less, F.get(ones, gone)).otherwise(0),
                )

                def closed(total: Column) -> Column:
                    hit = (st["i"] >= window - 1) & (total <= most)
                    return F.struct(
                        counts.alias("n"),
                        total.alias("s"),
                        (st["i"] + 1).alias("i"),
                        F.when(hit & st["first"].isNull(), st["i"] - window + 1).otherwise(st["first"]).alias("first"),
                        F.when(hit, st["i"] + 1).otherwise(st["last"]).alias("last"),
                    )

                return let(s, closed)

            return let(out, moved)

        return F.aggregate(at, begin, step, lambda st: F.struct(st["first"], st["last"]))

    return let(codes, scan)


def entropy_spans(text: Column, cls: EntropyClass, window: int, allowed: tuple[str, ...]) -> Column:
    """Spans of candidates of the class that hold a window of high entropy, but for those on the allow-list."""
    candidates = F.filter(
        match_spans(text, cls.pattern),
        lambda s: ~s["body"].rlike("|".join(f"(?:{p})" for p in allowed)) if allowed else F.lit(True),
    )
    measured = F.transform(
        candidates,
        lambda s: let(
            entropy_extent(s["body"], cls, window),
            lambda e: F.struct((s["start"] + e["first"]).alias("start"), (s["start"] + e["last"]).alias("end"), s["body"]),
        ),
    )
    return F.filter(measured, lambda s: s["start"].isNotNull())


def base_spans(text: Column) -> Column:
    """The spans of the three fixed kinds by start and kind."""
    value = lambda s: F.length(F.regexp_extract(s["body"], ASSIGN_VALUE, 1))
    return F.array_sort(
        F.concat(
            tagged(F.filter(match_spans(text, ASSIGN), lambda s: value(s) >= 6), "assign", 0),
            tagged(match_spans(text, ACCESS), "access", 1),
            tagged(match_spans(text, HEX), "hex", 2),
        )
    )


def with_spans(docs: DataFrame, window: int = 20, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """Columns ``row`` (the input row as a struct), ``body`` (its text), ``base`` and ``spans`` (arrays of spans by start)."""
    named = docs.select(F.struct("*").alias("row"), whole_text(docs).alias("body"))
    found = named.withColumn("base", base_spans(F.col("body")))
    more = [tagged(entropy_spans(F.col("body"), c, window, allowed), c.name, len(KINDS) + i) for i, c in enumerate(classes)]
    return found.withColumn("spans", F.array_sort(F.concat("base", *more)))


def scan_secrets(docs: DataFrame, window: int = 20, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """One row per document: counts of the fixed kinds, a digest of their spans, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return with_spans(docs, window, classes, allowed).select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, window: int = 20, classes=CLASSES, allowed=ALLOWED, mark: str = MARK) -> DataFrame:
    """The documents with each finding (overlapping ones together) replaced by a mark.

    The columns are those of the input; ``n_chars``, where there is one,
    follows the text.  Documents without findings stay as they are, a null
    text included.
    """
    body, spans = F.col("body"), F.col("spans")

    def clean(found: Column) -> Column:
        """The pieces of text between findings, joined by the mark; a finding that begins within those before it adds none."""
        ends = F.transform(found, lambda s: s["end"])
        reached = F.transform(F.arrays_zip(found.alias("s"), before_each(ends, lambda a, b: F.greatest(a, b)).alias("at")), lambda z: F.struct(z["s"]["start"].alias("start"), z["at"].alias("at")))
        kept = F.concat(F.filter(reached, lambda r: r["start"] >= r["at"]), F.array(F.struct(F.length(body).cast("long").alias("start"), F.array_max(ends).alias("at"))))
        return let(pieces_of(body), lambda p: F.array_join(F.transform(kept, lambda k: cut_out(p, k["at"], k["start"])), mark))

    done = with_spans(docs, window, classes, allowed).select(
        "row", F.when(F.size(spans) > 0, let(spans, clean)).otherwise(F.col("row.text").cast("string")).alias("clean"), (F.size(spans) > 0).alias("hit")
    )
    columns = []
    for name, kind in docs.dtypes:
        own = F.col("row").getField(name)
        if name == "text":
            own = F.col("clean")
        elif name == "n_chars":
            own = F.when(F.col("hit"), F.length("clean").cast(kind)).otherwise(own)
        columns.append(own.alias(name))
    return done.select(*columns)

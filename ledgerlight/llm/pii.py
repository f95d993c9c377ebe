"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

DataFrame functions only.  Null text counts as empty; a text without findings
gives zero counts and the digest of the empty string; rows that repeat are
scanned each for itself; other columns of the input do not matter, whatever
their names.

The patterns are possessive where nothing could be given back, so that long
runs of digits or name characters are read once and need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .spans import cut_out, joined, let, match_spans, pieces_of, tagged

#: The kinds of the contract in its order, then the kind this method adds.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban",)
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The length of an account number (IBAN) by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: A country, two check digits and as many characters as its numbers have, spaces between them left aside.
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:%s)(?![A-Za-z0-9])" % "|".join(
    rf"(?:{'|'.join(c for c, m in IBAN_LENGTHS.items() if m == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values()))
)

#: Words that make a kind likelier when they stand near it, in the languages of the corpus.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "server", "host", "address", "adresse", "client"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
#: The score of a confirmed span without context; a checksum confirms more than a shape.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
BONUS = 0.15
NEAR = 40


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number with country and check digits in front leaves 1 modulo 97."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda s, v: F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97)
    return rest == 1


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0") <= "255")


def base_spans(text: Column) -> Column:
    """Confirmed spans of the four fixed kinds, by kind and then start."""
    parts = lambda s: F.split(s["body"], r"\.")
    n = lambda s: F.length(digits_of(s["body"]))
    return F.concat(
        tagged(match_spans(text, EMAIL), "email", 0),
        tagged(F.filter(match_spans(text, IP), lambda s: F.forall(parts(s), _byte)), "ip", 1),
        tagged(F.filter(match_spans(text, CARD), lambda s: F.when(n(s).between(13, 19), luhn(digits_of(s["body"]))).otherwise(False)), "card", 2),
        tagged(F.filter(match_spans(text, PHONE), lambda s: n(s).between(9, 15)), "phone", 3),
    )


def added_spans(text: Column) -> Column:
    """Account numbers as long as their country's that pass mod-97."""
    return tagged(F.filter(match_spans(text, IBAN), lambda s: mod97(F.regexp_replace(s["body"], r"\x20", ""))), "iban", 4)


def span_score(pieces: Column, span: Column, near: int = NEAR) -> Column:
    """The kind's prior, raised when one of its context words stands within ``near`` code points of the span in a text in pieces."""
    begin = F.greatest(span["start"] - near, F.lit(0))
    around = F.lower(F.concat_ws(" ", cut_out(pieces, begin, span["start"]), cut_out(pieces, span["end"], span["end"] + near)))
    score = F.lit(0.0)
    for kind in (*KINDS, *ADDED):
        words = r"(?<![\p{L}\p{N}])(?:" + "|".join(CONTEXT[kind]) + r")(?![\p{L}\p{N}])"
        score = F.when(span["kind"] == kind, F.lit(PRIOR[kind]) + F.when(around.rlike(words), BONUS).otherwise(0.0)).otherwise(score)
    return F.round(score, 2)


def find_pii(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One row per document: counts of the fixed kinds, a digest of their spans, all spans, and the spans' scores in the same order."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = docs.select("doc_id", whole_text(docs).alias("body")).withColumn("base", base_spans(F.col("body")))
    found = found.withColumn("all", F.concat("base", added_spans(F.col("body"))))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        F.when(F.size("all") > 0, let(pieces_of(F.col("body")), lambda p: F.array_join(F.transform("all", lambda s: span_score(p, s, near).cast("string")), ","))).otherwise("").alias("scores"),
    )

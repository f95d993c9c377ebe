"""Text functions: normal forms, keys for matching, era dates, web addresses.

NFKC and kanji numerals have no built-in function and run as Arrow UDFs, which
hold a slice of a batch as Python strings; all else is built-in expressions.
Null in gives null out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fixed import (
    ABBREVIATED, AREA_MARK, BLOCK_MARK, BLOCK_NUMERAL, CORPORATION_BODY, CORPORATIONS, ERAS, LINE_NUMERAL, MARKERS, NUMBER_MARK,
    PREFECTURES, PRIVATE_USE, PROBED_ENDINGS, PROBED_FOLDERS, SPACE_BEFORE_NUMBER, SPARED_PATH, SPARED_SEGMENT, SPELLINGS,
    UNKNOWN_CHARACTER, UP_TO_HOUSE_NUMBER,
)
from .variants import VARIANTS

KANJI = {"〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
#: Characters that NFKC leaves as they are, whatever stands beside them: ASCII, Latin and Cyrillic letters, kana, ideographs and usual marks.
INERT = r"\x{0}-\x{9F}\x{BF}-\x{131}\x{14A}-\x{17E}\x{400}-\x{482}\x{2018}-\x{2023}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A0}-\x{30FE}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
#: Texts of a batch that are Python strings at a time: so many, and in the mean so many bytes.
SLICE, SLICE_BYTES = 1024, 1 << 20


def _by_slices(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """Each text changed, slice by slice, so that a batch of long texts is never Python strings as a whole."""
    step = max(1, min(SLICE, SLICE_BYTES * len(texts) // (texts.nbytes + 1)))
    made = [pa.array([None if t is None else change(t) for t in texts.slice(i, step).to_pylist()], texts.type) for i in range(0, len(texts), step)]
    return pa.concat_arrays(made) if made else texts


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return _by_slices(texts, lambda t: unicodedata.normalize("NFKC", t))


def kanji_number(text: str) -> int:
    """The value of a kanji numeral below 100."""
    tens, found, ones = text.rpartition("十")
    if not found:
        return KANJI[text[-1]]
    return (KANJI[tens[-1]] if tens and KANJI.get(tens[-1]) else 1) * 10 + (KANJI[ones[-1]] if ones else 0)


@F.arrow_udf(StringType())
def _block_numerals(texts: pa.Array) -> pa.Array:
    return _by_slices(texts, lambda t: re.sub(BLOCK_NUMERAL, lambda m: str(kanji_number(m[1])), t))


@F.arrow_udf(StringType())
def _line_numerals(texts: pa.Array) -> pa.Array:
    return _by_slices(texts, lambda t: re.sub(LINE_NUMERAL, lambda m: str(kanji_number(m[1])), t))


def replace_private_use(text: Column) -> Column:
    """A vendor's private characters as standard ones; those not known as a mark."""
    known = F.translate(text, "".join(map(chr, PRIVATE_USE)), "".join(PRIVATE_USE.values()))
    return F.regexp_replace(known, r"[\x{E000}-\x{F8FF}]", UNKNOWN_CHARACTER)


def normalize_text(text: Column, variants: dict[str, str] | None = None) -> Column:
    """NFKC, then single characters by a map of variants, ``VARIANTS`` if none is given; only texts that NFKC may change go through Python."""
    normal = F.coalesce(nfkc(F.when(~text.rlike(rf"\A[{INERT}]*+\z"), text)), text)
    usual = VARIANTS if variants is None else variants
    return F.translate(normal, "".join(usual), "".join(usual.values())) if usual else normal


def normalize_address(text: Column, variants: dict[str, str] | None = None) -> Column:
    return F.regexp_replace(normalize_text(text, variants), "(?<=[0-9])ー(?=[0-9])", "-")


def normalize_station(text: Column, variants: dict[str, str] | None = None) -> Column:
    return F.translate(F.regexp_replace(normalize_text(text, variants), r"(?U)\s+", ""), "ヶヵ", "ケカ")


def normalize_for_matching(text: Column, variants: dict[str, str] | None = None) -> Column:
    dashed = F.regexp_replace(normalize_address(text, variants), "(?<=[0-9])[‐‑‒–—―−](?=[0-9])", "-")
    return _block_numerals(F.translate(dashed, "ケヵ", "ヶヶ"))


def _without_corporation(name: Column, kinds: str) -> Column:
    """A name after the corporation of one of the kinds that it begins with; names of nothing else stay whole."""
    rest = F.regexp_replace(name, f"^(?:社団|財団)?(?:{kinds})(?:社団|財団)?{CORPORATION_BODY}", "")
    return F.coalesce(F.nullif(rest, F.lit("")), name)


def name_key(name: Column, variants: dict[str, str] | None = None) -> Column:
    """A name without corporation, spaces and punctuation, in one spelling."""
    bare = F.regexp_replace(normalize_for_matching(name, variants), r"(?U)\s+", "")
    bare = _without_corporation(_without_corporation(bare, "|".join(CORPORATIONS)), rf"\((?:{'|'.join(ABBREVIATED)})\)")
    bare = F.translate(bare, "‐－―-・･、，,．.()「」\"'’", "ーーーー")  # dashes as one, marks away
    for spelling, usual in SPELLINGS.items():
        bare = F.replace(bare, F.lit(spelling), F.lit(usual))
    return bare


def address_key(address: Column, variants: dict[str, str] | None = None) -> Column:
    """An address below its prefecture up to the first house number, in one spelling.

    The numbers of a house are those joined by block and house marks, which
    become hyphens; numbers that belong to a name (before 条, 線, 地, 区, 割) are
    no house numbers.
    """
    whole = F.trim(F.regexp_replace(normalize_for_matching(address, variants), r"(?U)\s+", " "))
    local = F.regexp_replace(whole, f"^(?:{'|'.join(PREFECTURES.values())}) *", "")
    local = _line_numerals(F.regexp_replace(local, AREA_MARK, ""))
    hyphened = F.regexp_replace(local, BLOCK_MARK, "$1-")
    tokens = F.regexp_replace(F.regexp_replace(hyphened, NUMBER_MARK, "$1"), SPACE_BEFORE_NUMBER, "")
    upto = F.regexp_extract(tokens, UP_TO_HOUSE_NUMBER, 0)
    return F.coalesce(F.nullif(upto, F.lit("")), tokens)


def house_numbers(rest: Column) -> Column:
    """struct<first, second>: the house numbers at the head of what follows a town; nulls if there are none."""
    bare = F.regexp_replace(F.ltrim(rest), r"^字?\p{IsHan}{1,6}(?=[0-9])", "")
    pattern = "^([0-9]+)(?:番地の?|番|-|の)?([0-9]+)?"
    part = lambda g: F.nullif(F.regexp_replace(F.regexp_extract(bare, pattern, g), "^0+(?=[0-9])", ""), F.lit(""))
    return F.struct(part(1).alias("first"), part(2).alias("second"))


@F.arrow_udf(StringType())
def _quoted(texts: pa.Array) -> pa.Array:
    return _by_slices(texts, lambda t: re.sub(r"[^\x21-\x7E]+", lambda m: quote(m[0], safe=""), t))


def clean_url(text: Column, most: int = 500) -> Column:
    """A web address made whole; null if it is none.

    It is taken apart into scheme, host, port and the rest; a missing colon and
    a missing scheme are added.
    """
    given = F.regexp_replace(nfkc(text), r"^[\s\x00]+|[\s\x00]+$", "")
    scheme = F.lower(F.regexp_extract(given, "^([A-Za-z]+):?//", 1))
    usable = scheme.isin("http", "https") | given.rlike("^[A-Za-z]+://")
    rest = F.when(usable, F.regexp_replace(given, "^[A-Za-z]+:?//", "")).otherwise(given)
    tail = F.regexp_extract(rest, "(?s)[/?#].*$", 0)
    place = F.split(F.substr(rest, F.lit(1), F.length(rest) - F.length(tail)), ":")
    host, port = F.get(place, F.lit(0)), F.get(place, F.lit(1))
    labels = F.split(host, r"\.")
    hosted = (F.size(labels) > 1) & F.forall(labels, lambda x: x.rlike("^[A-Za-z0-9-]+$")) & (F.size(place) <= 2)
    ported = port.isNull() | port.rlike("^[0-9]{1,5}$")
    url = F.concat(F.when(usable, scheme).otherwise("http"), F.lit("://"), F.array_join(place, ":"), _quoted(tail))
    served = F.when(usable, scheme.isin("http", "https")).otherwise(True)
    return F.when(served & hosted & ported & (F.octet_length(url) <= most), url)


def kana_reading(text: Column) -> Column:
    """NFKC without outer white space; null if empty or over 255 characters."""
    reading = F.regexp_replace(nfkc(text), r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")
    return F.when((reading != "") & (F.length(reading) <= 255), reading)


def search_words(query: str, most: int = 5) -> list[str]:
    return re.split(r"\s+", query.strip())[:most] if query.strip() else []


def scanner_path(path: Column) -> Column:
    """Whether a request path is one that scanners try."""
    spared = F.regexp_replace(path, r"\+", "%2B")
    decoded = F.concat(F.lit("/"), F.regexp_replace(F.coalesce(F.try_url_decode(spared), path), "^/+", ""))
    segments = F.split(F.lower(decoded), "/")
    hidden = F.exists(segments, lambda s: F.startswith(s, F.lit(".")) & (F.length(s) > 1) & (s != SPARED_SEGMENT))
    script = F.exists(segments, lambda s: F.endswith(s, F.lit(".php")))
    folder = F.exists(segments, lambda s: s.isin(*PROBED_FOLDERS) | s.rlike("^wp-[a-z]+$"))
    copy = F.lit(False)
    for ending in PROBED_ENDINGS:
        copy = copy | F.endswith(F.element_at(segments, -1), F.lit(ending))
    return (decoded != SPARED_PATH) & (hidden | script | folder | copy)


def _era_date(text: Column, eras: dict[str, int], pattern: str) -> Column:
    part = lambda g: F.regexp_extract(text, pattern, g)
    start = F.lit(None).cast("int")
    for era, year in eras.items():
        start = F.when(part(1) == era, year).otherwise(start)
    years = F.when(part(2) == "元", 1).otherwise(F.expr("1") * part(2).try_cast("int"))
    day = F.concat_ws("-", F.lpad((start + years - 1).cast("string"), 4, "0"), F.lpad(part(3), 2, "0"), F.lpad(part(4), 2, "0"))
    return F.when(text.rlike(pattern), F.try_to_date(day, "yyyy-MM-dd"))


def era_date(text: Column) -> Column:
    """The date of a cell such as 昭47. 3. 1; null if it is none."""
    eras = {name[0]: year for name, year in ERAS.items()}
    return _era_date(F.trim(text), eras, rf"^({'|'.join(eras)})(元|[0-9]+)\.\s*([0-9]+)\.\s*([0-9]+)$")


def page_date(text: Column) -> Column:
    """The first date of a page such as 令和8年9月1日現在, in NFKC digits; null if there is none."""
    found = F.regexp_extract(text, rf"({'|'.join(ERAS)})\s*(元|[0-9]+)\s*年\s*([0-9]+)\s*月\s*([0-9]+)\s*日\s*現在", 0)
    return _era_date(F.regexp_replace(found, r"\s+", ""), ERAS, rf"^({'|'.join(ERAS)})(元|[0-9]+)年([0-9]+)月([0-9]+)日現在$")


def category_of(token: Column, markers: list[tuple[str, int]] = MARKERS) -> Column:
    """The category of the first marker, in their order, that a token holds."""
    return F.coalesce(*[F.when(F.contains(token, F.lit(m)), c) for m, c in markers])

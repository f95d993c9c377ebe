"""Links to published files, read off fetched index pages by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, page_date

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def plain(html: Column) -> Column:
    """Text without tags, white space as single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", ""), r"(?U)(?:\s|&nbsp;)+", " ")
    return F.trim(F.replace(bare, F.lit("&amp;"), F.lit("&")))


def resolve_url(base: Column, href: Column) -> Column:
    """An address relative to a page's, with ``.`` and ``..`` left as they are."""
    host = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([a-z][a-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^([a-z][a-z0-9+.-]*://[^/]*(?:/.*)?/)", 1)
    folder = F.when(F.length(folder) > F.length(host), folder).otherwise(F.concat(host, F.lit("/")))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(host, href))
        .otherwise(F.concat(folder, href))
    )


def anchors(pages: DataFrame, key: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """(key, n, href, text, url) of each link of a page, in order."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("body"))
    rows = pages.select(*key, F.col(url).alias("_base"), F.posexplode(found).alias("n", "a"))
    return rows.select(*key, "n", F.col("a.href").alias("href"), plain(F.col("a.body")).alias("text"), resolve_url(F.col("_base"), F.replace("a.href", F.lit("&amp;"), F.lit("&"))).alias("url"))


def extract_links(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(bureau, category, prefecture, url, filename, published_on) of links that a rule of the page's publisher picks.

    ``pages`` (bureau, url, html); ``rules`` (bureau, category, prefecture,
    href_has, text_has, row_has, unless, first_table): patterns that must be
    found in the address, the link's text and its table row (null: any), one
    that must not be found in any, and whether only the page's first table
    counts.  A page's links share its first date.
    """
    dated = pages.withColumn("published_on", page_date(nfkc(plain(F.col("html")))))
    ruled = dated.join(rules, "bureau")
    scope = F.when(F.col("first_table"), F.regexp_extract("html", "(?is)<table\\b.*?</table>", 0)).otherwise(F.col("html"))
    row = r"(?is)<tr\b.*?</tr>"
    whole = ruled.withColumn("_scope", scope)
    parts = F.when(F.col("row_has").isNotNull(), F.regexp_extract_all("_scope", F.lit(row), F.lit(0))).otherwise(F.array("_scope"))
    rows = whole.withColumn("_row", F.explode(parts)).filter(F.col("row_has").isNull() | F.expr("_row RLIKE row_has"))
    links = anchors(rows.withColumn("_row", F.coalesce("_row", F.lit(""))), ["bureau", "category", "prefecture", "published_on", "href_has", "text_has", "unless"], "url", "_row")
    has = lambda column, pattern: F.expr(f"{pattern} IS NULL OR {column} RLIKE {pattern}")
    picked = links.filter(has("href", "href_has") & has("text", "text_has") & F.expr("unless IS NULL OR NOT concat_ws(' ', href, text) RLIKE unless"))
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1)
    return picked.select("bureau", "category", "prefecture", "url", name.alias("filename"), "published_on").distinct()

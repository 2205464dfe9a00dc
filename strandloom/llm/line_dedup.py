"""Boilerplate lines by their frequency within a site.

Pages are grouped by host; a line that more than RATIO of a host's pages contain
is boilerplate there and goes from all of them. A line must repeat to count, so
LEAST_PAGES is 2: a line on one page of a host with up to three is over the
ratio without being anybody's boilerplate, and such hosts would lose all text.
Built-in functions only. Pages are counted per (host, line) with map-side
partial sums, so neither a large host nor a common line meets in one task. The
boilerplate lines of one host are at most its mean number of lines a page
divided by RATIO, whatever the host's size, so they travel as one small row;
a large host's pages meet them in as many parts as the host has shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import BLANKS, checkpointed

RATIO = 0.3
LEAST_PAGES = 2
#: A host with more than one in so many of all pages is split, and there are at most so many such hosts:
#: as many as parts of PART_PAGES pages, within these limits (names of 50,000 hosts are some megabytes).
SHARES, PART_PAGES = (1000, 50_000), 10_000

_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_BREAKS = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; an empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), _HOST, 1), F.lit("")))


def text_of_html(html: Column) -> Column:
    """The text of a page, a line for each block element."""
    text = F.regexp_replace(html.cast("string"), _HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), r"<[^>]*>", "")
    for name, plain in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def lines_of(text: Column) -> Column:
    """The lines of a text with blanks at their ends cut; lines without content are left out."""
    cut = F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.filter(cut, lambda line: line != "")


def boilerplate(rows: DataFrame, by_host: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """One row per host with its number of pages and the array of its boilerplate lines."""
    each = rows.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    by_line = each.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    common = by_line.join(by_host, "host").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
    return by_host.join(common.groupBy("host").agg(F.collect_list("line").alias("common")), "host", "left")


def cleaned(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", html: bool = True) -> DataFrame:
    """One row per row of pages: id_col, host, host_pages, n_lines, n_kept, text.

    text holds the lines that stay, in order, joined by line feeds. Pages
    without a host in their URL (null ones too) are one site with an empty
    name. A null page has no lines. Repeated rows each count as a page; hosts
    of fewer than `least` pages lose nothing; no rows give no rows. Other
    columns are not read.
    """
    content = text_of_html(F.col(text_col)) if html else F.col(text_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), lines_of(content).alias("lines"))
    by_host = checkpointed(rows.groupBy("host").agg(F.count("*").alias("host_pages")))
    total = by_host.agg(F.sum("host_pages")).first()[0] or 1
    share = F.lit(min(max(SHARES[0], total / PART_PAGES), SHARES[1]) / total) * F.col("host_pages")
    parts = F.broadcast(by_host.where(share > 1).select("host", F.ceil(share).alias("parts")))
    sites = boilerplate(rows, by_host, ratio, least).join(parts, "host", "left")
    sites = sites.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    rows = rows.join(parts, "host", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    stay = F.filter("lines", lambda line: ~F.array_contains(F.col("common"), line))
    out = rows.join(sites, ["host", "part"]).withColumn("stay", F.when(F.col("common").isNull(), F.col("lines")).otherwise(stay))
    return out.select(F.col("id").alias(id_col), "host", "host_pages", F.size("lines").cast("long").alias("n_lines"), F.size("stay").cast("long").alias("n_kept"), F.array_join("stay", "\n").alias("text"))

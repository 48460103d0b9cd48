"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a site if the share of the site's pages that contain it exceeds a ratio, and a few pages
contain it: sites of every size are examined. Lines are
counted by site and 64-bit hash with partial sums before the shuffle, so neither a common line nor a large site
gathers in a task. What exceeds the ratio is at most (mean lines a page) / ratio lines a site: each site gets an
array of them, joined to its pages by site, and pages never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, same, small
from tidemark.session import cut

#: Share of a site's pages above which a line is dropped.
RATIO = 0.1
#: Pages that hold a line, below which it stays: two exact copies on a small site aren't emptied by each other.
MIN_WITH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_pages: int = 0, min_with: int = MIN_WITH) -> DataFrame:
    """(_site, _drop): hashes of each site's boilerplate lines, as a checkpoint. Null is a site like others."""
    base = pages.select(F.col(site).alias("_site"), F.col(text).alias("_text"))
    totals = base.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages)
    each = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: ~_blank(x)), _key))
    counts = base.select("_site", F.explode(each).alias("_line")).groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_n"))
    totals = small(cut(totals)).withColumnRenamed("_site", "_s")
    common = counts.join(totals, same(F.col("_site"), F.col("_s"))).where((F.col("_n") > ratio * F.col("_pages")) & (F.col("_n") >= min_with))
    return cut(common.groupBy("_site").agg(F.collect_list("_line").alias("_drop")))


def drop_lines(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = 0, counts: bool = False, min_with: int = MIN_WITH) -> DataFrame:
    """pages with the boilerplate lines taken out of text; with counts, also n_lines and n_dropped (lines that aren't blank).

    Lines end at newlines and are compared without spaces around them; blank lines stay. Null text stays null
    and counts as a page; a page whose lines all go keeps an empty text; repeated rows are pages of their own.
    A line on fewer than min_with pages stays; sites with fewer than min_pages pages keep all lines.
    """
    found = small(boilerplate(pages, site, text, ratio, min_pages, min_with))
    column = F.col(f"in_{text}")
    lines = _lines(column)
    common = lambda x: ~_blank(x) & F.coalesce(F.array_contains(F.col("_drop"), _key(x)), F.lit(False))
    out = aside(pages).join(found, same(F.col(f"in_{site}"), F.col("_site")), "left")
    size = lambda x: F.when(column.isNull(), 0).otherwise(F.size(x)).cast("long")
    new = [size(F.filter(lines, lambda x: ~_blank(x))).alias("n_lines"), size(F.filter(lines, common)).alias("n_dropped")] if counts else []
    kept = F.when(F.col("_drop").isNull(), column).otherwise(F.array_join(F.filter(lines, lambda x: ~common(x)), "\n"))
    # one select, as the counts are of the text as it was
    columns = [c for c in pages.columns if not (counts and c.lower() in ("n_lines", "n_dropped"))]
    return out.select(*[(kept if c == text else F.col(f"in_{c}")).alias(c) for c in columns], *new)


#: Values of the page format, the same in Java's and RE2's syntax.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"


def host(url: Column) -> Column:
    """Lower-case host of a URL; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def page_text(html: Column) -> Column:
    """What stands between tags, a line each; scripts, styles and comments go."""
    return F.regexp_replace(F.regexp_replace(html, UNSEEN, "\n"), TAG, "\n")

"""Readers of landed pages and lists: HTML rows, reports, probes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 1.5


class _Links(HTMLParser):
    """Links with their text, as (href, text)."""

    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join("".join(self.text).split())))
            self.href = None


def parse_links(html: str | None) -> list[tuple[str, str]]:
    """Links of a page in order, with squeezed texts; none for null. Broken pages give what can be read."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return parser.found


def html_rows(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_title: int = 1) -> DataFrame:
    """(page_id, pos, href, title, position): a row a link with a title, pos from 0 within its page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, h, t, max(0.0, 100 - STEP * i)) for k, x in zip(pdf[page_id], pdf[html]) for i, (h, t) in enumerate((h, t) for h, t in parse_links(x) if len(t) >= least_title)]
            yield pd.DataFrame(rows, columns=[page_id, "pos", "href", "title", "position"])

    return pages.select(page_id, html).mapInPandas(run, f"{page_id} {pages.schema[page_id].dataType.simpleString()}, pos long, href string, title string, position double")


#: Marks of pages that block a reader, the page they lead to, and the bytes at a page's start that are looked at: fixed values.
CHALLENGES = ("Just a moment", "보안 검사", "보안 시스템")
BLOCK_PAGE, REDIRECT = "msg.html", r"""location\.(?:replace|href)\s*\(?\s*=?\s*['"][^'"]*msg\.html"""
HEAD_BYTES, CHARSETS = 60_000, ("utf-8", "cp949")


def block_reason(body: Column, url: Column) -> Column:
    """Why a page (text, or bytes of either charset) is no list but a block: BLOCK_PAGE or the mark that it bears; '' if it's none."""
    head = F.substring(F.coalesce(body.cast("binary"), F.lit(b"")), 1, HEAD_BYTES)
    out = F.when(F.contains(F.coalesce(url, F.lit("")), F.lit(BLOCK_PAGE)) | F.coalesce(F.decode(head, "iso-8859-1").rlike(REDIRECT), F.lit(False)), BLOCK_PAGE)
    for mark in CHALLENGES:
        for form in sorted({mark.encode(c) for c in CHARSETS}):
            out = out.when(F.contains(head, F.lit(bytearray(form))), mark)
    return out.otherwise("")


def is_challenge(html: Column, url: Column | None = None) -> Column:
    return block_reason(html, F.lit("") if url is None else url) != ""


def verdict(status: Column, rows: Column, challenge: Column) -> Column:
    """What a probe's answer means."""
    return (
        F.when(status.isNull(), "error").when(challenge | status.isin(403, 429), "blocked").when(status >= 500, "down").when(status >= 400, "gone")
        .when(F.coalesce(rows, F.lit(0)) == 0, "empty").otherwise("ok")
    )


def verdict_table(probes: DataFrame, group: str = "group") -> DataFrame:
    """Verdicts counted by group, a column each."""
    kinds = ["ok", "empty", "blocked", "gone", "down", "error"]
    return probes.groupBy(group).pivot("verdict", kinds).count().na.fill(0, kinds)


REPORT = (
    "date string, generated_at string, model string, post_count int, summary_md string, analyzed_count int, "
    "posts array<struct<title string, url string, source string, source_label string, source_emoji string, source_color string, "
    "views bigint, likes bigint, comments bigint, date string, rank int>>"
)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Daily reports, one a JSON file, with day (a date) and is_final (written after its day). Files without a real day or a text go."""
    frame = spark.read.schema(REPORT).option("multiLine", True).json(path)
    day = F.col("date").try_cast("date")
    return frame.where(F.col("date").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & day.isNotNull() & (F.trim("summary_md") != "")).withColumn("day", day).withColumn("is_final", F.substring("generated_at", 1, 10) > F.col("date"))


def neighbours(frame: DataFrame) -> DataFrame:
    """Reports with the days before and after, of those there are."""
    from pyspark.sql import Window

    w = Window.orderBy("day")
    return frame.withColumn("previous", F.lag("day").over(w)).withColumn("next", F.lead("day").over(w))


def legacy_summaries(rows: DataFrame, today: Column) -> DataFrame:
    """Rows (date, summary_md, posts_json, post_count, generated_at) of the former table as reports; bad days, future ones and
    texts that aren't JSON go, and a missing time becomes noon of the day."""
    posts = F.from_json("posts_json", REPORT[REPORT.index("array<") :])
    day = F.col("date").try_cast("date")
    return rows.where(day.isNotNull() & (day <= today) & posts.isNotNull()).select("date", F.coalesce(F.nullif(F.trim("generated_at"), F.lit("")), F.concat("date", F.lit("T12:00:00+09:00"))).alias("generated_at"), "summary_md", "post_count", posts.alias("posts")).orderBy("date")

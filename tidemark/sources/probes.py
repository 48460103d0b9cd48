"""What probes of pages say: texts of any charset, counts of links, feed and JSON items, verdicts, and which pages still need a probe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the probes: bytes that are looked at, statuses of a refusal, marks of a check (whatever the case), links of articles that a
# page without a list has at least, and the keys under which a JSON answer may have its list.
SCAN_BYTES, CHECK_CHARS, REDIRECT_CHARS, TITLE_CHARS = 200_000, 50_000, 20_000, 80
REFUSALS, LEAST_LINKS = (401, 403, 429, 430, 451, 503), 5
CHECKS = r"(?i)Just a moment|Attention Required|Checking your browser|cf-chl|_cf_chl|challenge-platform|보안 검사|보안 시스템|captcha"
REDIRECT = r"""(?i)location\.(?:replace|href)\s*\(?\s*=?\s*['"][^'"]*msg\.html"""
TITLE, ARTICLE = r"(?is)<title[^>]*>(.*?)</title>", r"""(?i)href\s*=\s*["']([^"'#]*?[0-9]{5,}[^"'#]*)["']"""
FEED_ITEM, LIST_KEYS = r"<(?:item|entry)[\s>]", ("items", "data", "list", "posts", "result")


@F.pandas_udf(StringType())
def _other_charset(body: pd.Series, declared: pd.Series) -> pd.Series:
    """Bytes in the charset that a header declares, else in the Korean one; null where neither fits."""

    def text(raw: bytes | None, name: str | None) -> str | None:
        for charset in (name, "cp949"):
            try:
                if raw is not None and charset:
                    return bytes(raw).decode(charset)
            except (UnicodeDecodeError, LookupError):
                continue
        return None

    return pd.Series([text(b, d) for b, d in zip(body, declared)], dtype=object)


def decoded(body: Column, declared: Column | None = None) -> Column:
    """The first SCAN_BYTES of a page as text: in the declared charset if it has one and the bytes are such a text, else UTF-8, else CP949, else
    UTF-8 with marks for what isn't. ISO-8859-1 counts as not declared, as readers say so of pages that declare nothing.

    Bytes in UTF-8 that declare it or nothing, the most, stay in Spark; only others go to Python. Null stays null.
    """
    head = F.substring(body, 1, SCAN_BYTES)
    name = F.lower(F.trim(F.coalesce(declared, F.lit("")))) if declared is not None else F.lit("")
    name = F.when(name.isin("", "iso-8859-1", "latin-1"), F.lit(None).cast("string")).otherwise(name)
    utf8 = F.is_valid_utf8(head.cast("string")) & (name.isNull() | name.isin("utf-8", "utf8"))
    other = _other_charset(F.when(~utf8, head), F.when(~name.isin("utf-8", "utf8"), name))
    return F.when(utf8, head.cast("string")).otherwise(F.coalesce(F.when(F.is_valid_utf8(head.cast("string")) & other.isNull(), head.cast("string")), other, F.make_valid_utf8(head.cast("string"))))


def feed_items(body: Column) -> Column:
    """Items or entries of a feed, counted over bytes (whatever the charset)."""
    raw = F.decode(F.substring(F.coalesce(body, F.lit(b"")), 1, 2 * SCAN_BYTES), "ISO-8859-1")
    return F.regexp_count(raw, F.lit(FEED_ITEM)).cast("long")


def json_items(text: Column) -> Column:
    """Entries of a JSON answer: of itself, or of the first of LIST_KEYS that has a list; 0 for others, null for what isn't JSON."""
    found = F.coalesce(F.json_array_length(text), *[F.json_array_length(F.get_json_object(text, f"$.{k}")) for k in LIST_KEYS], F.lit(0))
    is_json = F.try_parse_json(text).isNotNull()
    return F.when(is_json, found).cast("long")


def probed(answers: DataFrame) -> DataFrame:
    """answers (status, body binary, final_url and perhaps charset, mitigated, rows) with text columns title, article_links, challenge,
    msg_redirect, and verdict.

    verdict: error without a status; blocked by status, by the mitigated header, or by a check or redirect on a page without posts (rows 0, or,
    without a count, under LEAST_LINKS links of articles); http-<status> from 400 on; empty for 0 rows; else ok.
    """
    there = lambda c, kind: F.col(c).cast(kind) if c in answers.columns else F.lit(None).cast(kind)
    page = answers.withColumn("_text", F.coalesce(decoded(F.col("body"), there("charset", "string")), F.lit("")))
    title = F.trim(F.regexp_replace(F.regexp_extract("_text", TITLE, 1), r"\s+", " "))
    page = page.withColumns({
        "title": F.nullif(F.substring(title, 1, TITLE_CHARS), F.lit("")),
        "article_links": F.size(F.array_distinct(F.regexp_extract_all("_text", F.lit(ARTICLE), F.lit(1)))).cast("long"),
        "challenge": F.substring("_text", 1, CHECK_CHARS).rlike(CHECKS) | F.substring(title, 1, TITLE_CHARS).rlike(CHECKS),
        "msg_redirect": F.substring("_text", 1, REDIRECT_CHARS).rlike(REDIRECT) | F.contains(F.coalesce("final_url", F.lit("")), F.lit("msg.html")),
    })
    rows, status = there("rows", "long"), F.col("status")
    no_posts = F.coalesce(rows == 0, F.col("article_links") < LEAST_LINKS)
    refused = status.isin(*REFUSALS) | (F.lower(F.coalesce(there("mitigated", "string"), F.lit(""))) == "challenge")
    verdict = (
        F.when(status.isNull(), "error").when(refused, "blocked").when(status >= 400, F.concat(F.lit("http-"), status.cast("string")))
        .when((F.col("challenge") | F.col("msg_redirect")) & no_posts, "blocked").when(F.coalesce(rows == 0, F.lit(False)), "empty").otherwise("ok")
    )
    return page.withColumn("verdict", verdict).drop("_text")


def still_to_probe(candidates: DataFrame, probed_urls: DataFrame) -> DataFrame:
    """Candidates (url, seq, ...) that no probe had, each URL once: the one of least seq."""
    from pyspark.sql import Window

    once = candidates.withColumn("_i", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where("_i = 1").drop("_i")
    return once.join(probed_urls.select("url").distinct(), "url", "left_anti")


def by_group(found: DataFrame) -> DataFrame:
    """(group, verdict, n), counted."""
    return found.groupBy("group", "verdict").agg(F.count(F.lit(1)).alias("n"))

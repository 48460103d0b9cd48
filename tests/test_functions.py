"""Scalar functions on hand-written values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text, urls


def each(spark, values, make, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


NOW = datetime(2026, 1, 1, 0, 5)
DATES = [
    ("2026-01-01T00:01:02+09:00", (datetime(2026, 1, 1, 0, 1, 2), date(2026, 1, 1))), ("2025-12-31T15:00:30.000Z", (datetime(2026, 1, 1, 0, 0, 30), date(2026, 1, 1))),
    ("방금", (NOW, NOW.date())), ("30초 전", (NOW, NOW.date())), ("10분 전", (datetime(2025, 12, 31, 23, 55), date(2025, 12, 31))), ("2시간 전", (datetime(2025, 12, 31, 22, 5), date(2025, 12, 31))),
    ("3일 전", (None, date(2025, 12, 29))), ("어제", (None, date(2025, 12, 31))), ("어제 13:20", (datetime(2025, 12, 31, 13, 20), date(2025, 12, 31))),
    ("00:14", (datetime(2026, 1, 1, 0, 14), date(2026, 1, 1))), ("23:58:01", (datetime(2025, 12, 31, 23, 58, 1), date(2025, 12, 31))), ("25:00", (None, None)),
    ("12.31", (None, date(2025, 12, 31))), ("01/02", (None, date(2026, 1, 2))), ("12-31 10:20", (datetime(2025, 12, 31, 10, 20), date(2025, 12, 31))), ("13.45", (None, None)),
    ("25/12/30 09:08", (datetime(2025, 12, 30, 9, 8), date(2025, 12, 30))), ("25.12.30", (None, date(2025, 12, 30))), ("2025-12-30 11:22:33", (datetime(2025, 12, 30, 11, 22, 33), date(2025, 12, 30))),
    ("2025.2.30", (None, None)), ("2025.2.3.", (None, date(2025, 2, 3))), ("", (None, None)), (None, (None, None)), ("soon", (None, None)), ("12:30 | 조회 55", (datetime(2025, 12, 31, 12, 30), date(2025, 12, 31))),
]


def test_parse_date(spark):
    got = each(spark, [d for d, _ in DATES], lambda v: dates.parse_date(v, F.lit(NOW).cast("timestamp_ntz")))
    assert [(d, tuple(r)) for (d, _), r in zip(DATES, got)] == [(d, w) for d, w in DATES]


def test_other_dates(spark):
    at = F.lit(NOW).cast("timestamp_ntz")
    assert each(spark, ["2026-01-01", "2026-02-30", "2026-01-01\n", "26-01-01", None], dates.is_valid_date) == [True, False, False, False, False]
    written = spark.createDataFrame([(datetime(2026, 1, 1, 15, 0), "x"), (datetime(2026, 1, 1, 15, 0, 1), "x"), (datetime(1969, 12, 31, 15), "2026-01-05"), (None, "bad")], "w timestamp_ntz, t string")
    got = [tuple(r.o) for r in written.select(dates.api_date(F.col("w"), F.col("t")).alias("o")).collect()]
    assert got == [(None, date(2026, 1, 2)), (datetime(2026, 1, 2, 0, 0, 1), date(2026, 1, 2)), (None, date(2026, 1, 5)), (None, None)]
    one = spark.range(1).select(
        dates.date_window(at).alias("w"), dates.hours_to_cover(at).alias("h"), dates.hours_to_cover(F.lit(datetime(2026, 1, 1, 13)).cast("timestamp_ntz")).alias("h2"),
        dates.age_days(F.lit(None).cast("timestamp_ntz"), F.lit(date(2025, 12, 31)), at).alias("a"), dates.age_days(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("date"), at).alias("u"),
    ).first()
    assert one.w == [date(2025, 12, 31), date(2026, 1, 1)] and (one.h, one.h2) == (3, 24) and abs(one.a - (1 + 5 / 1440)) < 1e-9 and one.u == 0


def test_numbers(spark):
    assert each(spark, ["1.2k", "3만", "1,234", "junk", None, "", "2.5M views", "7"], numbers.parse_count) == [1200, 30000, 1234, 0, 0, 0, 2_500_000, 7]
    assert each(spark, ["5", "-3", "x", None, "4.9"], numbers.as_count) == [5, 0, 0, 0, 4]
    assert each(spark, [0.25, 2.675, -0.05, 1.04], numbers.tenths, "v double") == [0.3, 2.7, 0.0, 1.0]


URLS = [
    ("https://www.example.com/view?document_srl=77&page=2", "example.com#77"), ("http://example.com/view?page=3&document_srl=77", "example.com#77"), ("https://a.com/b.php?id=free&no=12", "a.com#free:12"),
    ("https://a.com/x/123/4567?p=1", "a.com#4567"), ("https://a.com/view/some-title-9447051", "a.com#9447051"), ("https://a.com/12345/abc/678", "a.com#12345"), ("https://A.com/Path?q=1#top", "a.com/Path?q=1"), (None, None),
]


def test_url_key(spark):
    assert each(spark, [u for u, _ in URLS], urls.url_key) == [k for _, k in URLS]


def test_clean_url(spark):
    assert each(spark, ["http://M.a.com/x?utm_source=f&id=3&page=2#top", "http://b.com/", "none", None], lambda v: urls.clean_url(v, F.lit("a.com"), (*urls.LIST_FIELDS, *urls.TRACKING))) == ["https://m.a.com/x?id=3", None, None, None]
    assert each(spark, ["https://a.com/x?" + "&".join(f"{f}=1" for f in (*urls.LIST_FIELDS, "no", "b", "utm_source"))], urls.clean_url) == ["https://a.com/x?no=1&b=1&utm_source=1"]
    assert each(spark, ["HTTP://x", "ftp://x", None], urls.is_http) == [True, False, False]


def test_titles(spark):
    assert each(spark, ["  a \n b [12]", "c (3)", "[tag] d", None], text.clean_title) == ["a b", "c", "[tag] d", None]
    assert each(spark, ["안녕 하세요!!", "ab", None, "It's_Long"], lambda v: text.title_key(F.lit("s"), v)) == ["s|안녕하세요", "", "", "s|itslong"]
    assert each(spark, ["[a][b c] d", "none"], text.bracket_tags) == [["a", "b c"], []]
    assert each(spark, ["x" * 131, "x" * 130, " y "], text.ellipsis) == ["x" * 130 + "…", "x" * 130, "y"]
    assert each(spark, ["Ab1", "a", "", None, "aaa"], text.bigrams) == [["ab", "b1"], [], [], [], ["aa"]]
    assert each(spark, ["## One\ntext\n## Two\n### no\n## Three\n## Four"], text.headings) == [["One", "Two", "Three"]]


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0, 1.0]


@pytest.mark.parametrize("value", [" Title  x ", None])
def test_words(spark, value):
    assert each(spark, [value], text.words) == [["title"] if value else []]

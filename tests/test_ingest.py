"""Ingest rules on small tables with nulls, blanks, ties and other columns."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources import pages


def test_filters(spark):
    rows = spark.createDataFrame([(1, " a  b c", "http://x"), (2, "abc", "http://x"), (3, None, "http://x"), (4, "title", None), (5, "title", " HTTPS://x "), (6, "", "")], "i int, t string, u string")
    assert [r.i for r in rows.where(ingest.readable(F.col("t"), F.col("u"))).orderBy("i").collect()] == [1, 5]
    heads = [("[공지] 안내", True), ("【🚨필독🚨】 규칙", True), ("(광고)상품", True), ("AD 상품", True), ("하루특가) 귤", True), ("긴급공지 떴다", False), ("ADHD 이야기", False), (None, False)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(heads)], "i int, t string")
    assert [r.o for r in frame.select("i", ingest.is_notice(F.col("t"), F.lit("http://x")).alias("o")).orderBy("i").collect()] == [w for _, w in heads]
    links = spark.createDataFrame([("some title", "http://x/annonce/1", "/1"), ("some title", "http://x/1", "/1#comment"), ("[1234]", "http://x/1", "/1"), ("some title", "http://x/1", None)], "t string, u string, h string")
    assert [r.o for r in links.select(ingest.is_rejected(F.col("t"), F.col("u"), F.col("h")).alias("o")).collect()] == [True, True, True, False]


def test_sources(spark):
    known = spark.createDataFrame([("AB", "ab_site", "Site", "e", None)], "code string, source string, label string, emoji string, color string")
    rows = spark.createDataFrame([(1, "AB", "x"), (2, "NEW", "New one"), (3, "ZZ", None), (4, "lower", "x"), (5, None, "x")], "i int, code string, name string")
    got = [tuple(r) for r in ingest.with_source(rows, known).orderBy("i").select("i", "source", "label", "emoji", "color").collect()]
    assert got == [(1, "ab_site", "Site", "e", ingest.COLOR), (2, "new", "New one", ingest.EMOJI, ingest.COLOR), (3, "zz", "ZZ", ingest.EMOJI, ingest.COLOR)]


def test_external(spark):
    schema = "source string, arrival int, title string, url string, date string, summary string, views string, likes string, comments string, extra int"
    rows = [("a", 2, "later title", "http://x/2", None, None, "5", "-1", "x", 1), ("a", 1, " first  title", "http://x/1", "2026-01-02T09:00", "s " * 100, "9", "3", "4", 1),
            ("a", 3, "old title", "http://x/3", "2025-12-01", "", "1", "1", "1", 1), ("b", 4, "unwanted", "http://x/4", "", "", "1", "1", "1", 1), (None, 5, "no source", "http://x/5", "", "", "1", "1", "1", 1)]
    window = F.array(F.lit(date(2026, 1, 2)))
    got = ingest.clean_external(spark.createDataFrame(rows, schema), spark.createDataFrame([("a",), ("c",)], "source string"), window, ("c",)).orderBy("arrival").collect()
    assert [(r.arrival, r.title, r.views, r.likes, r.comments, r.position, r.extra) for r in got] == [(1, "first title", 9, 3, 4, 100.0, 1), (2, "later title", 5, 0, 0, 98.5, 1)]
    assert len(got[0].summary) == 131 and got[1].summary == ""


def test_reuse_and_cover(spark):
    posts = spark.createDataFrame([("k", None), ("k2", ""), ("k3", "own"), (None, None)], "url_key string, summary string")
    before = spark.createDataFrame([("k", "b"), ("k", "a"), ("k3", "old"), ("k2", "")], "url_key string, summary string")
    assert sorted((r.url_key or "", r.summary) for r in ingest.with_known_summaries(posts, before).collect()) == [("", ""), ("k", "a"), ("k2", ""), ("k3", "own")]
    previous = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 4, "source string")
    today = spark.createDataFrame([("x",)] * 5 + [("y",)], "source string")
    assert [r.source for r in ingest.covered_sources(previous, today, 2, 5, cap=3).collect()] == ["a"]
    assert ingest.covered_sources(previous, today, 2, 4, cap=3).count() == 0
    assert [r.source for r in ingest.covered_sources(previous, today.limit(0), 1, 1, cap=3).collect()] == ["a"]


def test_places_and_feed(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["b"]), (2, []), (3, None)], "k int, words array<string>")
    assert sorted(tuple(r) for r in ingest.mean_place(rows, "k").collect()) == [(1, "a", 0.0), (1, "b", 0.25)]
    posts = spark.createDataFrame([(1, "a", True), (2, "a", None), (3, "b", True)], "rank int, source string, food boolean")
    ranks = spark.createDataFrame([(1,), (1,), (2,)], "rank int")
    assert [r.rank for r in ingest.feed(posts, F.col("food"), ("a", "b"), ranks).collect()] == [1]
    assert ingest.feed(posts).count() == 3
    issues = spark.createDataFrame([([1, 2],), ([2, 3],), ([],)], "ranks array<int>")
    assert ingest.posts_in_issues(issues).first().in_issues == 3


def test_queues(spark):
    days = spark.createDataFrame([(date(2026, 1, d),) for d in (1, 14, 15, 20)], "day date")
    got = ingest.audio_queue(days, F.lit(date(2026, 1, 20)), F.lit(date(2026, 1, 20))).orderBy("turn").collect()
    assert [r.day.day for r in got] == [15, 14, 20]
    health = spark.createDataFrame([("b", "ok"), ("c", "missing"), ("a", "ok")], "source string, status string")
    assert [r.source for r in ingest.problem_list(health).orderBy("place").collect()] == ["c", "a", "b"]
    now = datetime(2026, 1, 1, 12)
    tried = spark.createDataFrame([("a", datetime(2026, 1, 1, 11, 45)), ("b", datetime(2026, 1, 1, 11, 30))], "source string, ts timestamp_ntz")
    some = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    assert [r.source for r in ingest.refetch_due(some, some.where("source <> 'c'"), tried, F.lit(now).cast("timestamp_ntz")).collect()] == ["b"]


def test_advance(spark):
    posts = spark.createDataFrame([("k", 1.0, None), ("k", 2.0, False), ("old", 3.0, True)], "url_key string, rank_score double, prev_day boolean")
    assert ingest.advance(posts, "s", "s", True, False) == ("same", None)
    assert ingest.advance(posts, "s", "t", False, False) == ("held", None) == ingest.advance(posts, "s", None, True, True)
    state, rows = ingest.advance(posts, "s", None, True, False)
    assert state == "new" and [tuple(r) for r in rows.collect()] == [("k", 2.0)]


def test_block_reason(spark):
    redirect = "<script>location.replace('/msg.html?x=1')</script>"
    cases = [("Just a moment...", ""), ("just a moment", ""), ("보안 검사중", ""), (redirect, ""), ("<a href=x>t</a>", "http://x/msg.html"), (None, None), ("x" * 60_000 + "Just a moment", "")]
    want = ["Just a moment", "", "보안 검사", "msg.html", "msg.html", "", ""]
    frame = spark.createDataFrame([(i, h, u) for i, (h, u) in enumerate(cases)], "i int, h string, u string")
    assert [r.o for r in frame.select("i", pages.block_reason(F.col("h"), F.col("u")).alias("o")).orderBy("i").collect()] == want
    raw = spark.createDataFrame([(bytearray("보안 시스템".encode("cp949")),), (bytearray(b"\xff\xfe"),)], "h binary")
    assert [r.o for r in raw.select(pages.block_reason(F.col("h"), F.lit(None)).alias("o")).collect()] == ["보안 시스템", ""]

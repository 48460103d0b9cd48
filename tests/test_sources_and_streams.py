"""Readers, sinks and streams."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators.health import Alert, next_alert
from tidemark.operators.history import push_round
from tidemark.sources import pages, sinks
from tidemark.streaming import rounds


def test_links_and_html_rows(spark):
    assert pages.parse_links('<a href="/x"> A <b>b</b></a><a>no</a><A HREF="/y">c') == [("/x", "A b")]
    frame = spark.createDataFrame([(1, '<a href="/x">one</a><a href="/z"></a><a href="/y">two</a>'), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in pages.html_rows(frame).collect()] == [(1, 0, "/x", "one", 100.0), (1, 1, "/y", "two", 98.5)]


def test_reports_and_feeds(spark, tmp_path):
    for day, text, made in (("2026-01-01", "## a", "2026-01-02T00:10:00+09:00"), ("2026-01-03", "## b", "2026-01-03T12:00:00+09:00"), ("2026-02-30", "x", ""), ("2026-01-04", " ", "")):
        (tmp_path / f"{day}.json").write_text(json.dumps({"date": day, "generated_at": made, "summary_md": text, "posts": []}, indent=1))
    found = pages.reports(spark, str(tmp_path)).orderBy("day")
    assert [(r.date, r.is_final) for r in found.collect()] == [("2026-01-01", True), ("2026-01-03", False)]
    assert [(r.previous, r.next) for r in pages.neighbours(found).orderBy("day").collect()] == [(None, date(2026, 1, 3)), (date(2026, 1, 1), None)]
    assert "<lastmod>2026-01-02</lastmod>" in sinks.sitemap_urls(found, "https://x").orderBy("day").first().entry
    assert "Sat, 03 Jan 2026" in sinks.rss_items(found, "https://x").first().item
    audio = found.limit(1).select("date", F.substring(F.sha2("summary_md", 256), 1, 16).alias("source_sha"))
    assert [r.date for r in sinks.without_current_audio(found, audio).collect()] == ["2026-01-03"]


def test_save_report_replaces_a_day(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "date string, summary_md string")
    out = str(tmp_path / "r")
    sinks.save_report(rows(("2026-01-01", "a"), ("2026-01-02", "b"), ("2026-13-01", "c"), ("2099-01-01", "d"), ("2026-01-03", "")), out, "2026-01-05")
    sinks.save_report(rows(("2026-01-02", "new")), out, "2026-01-05")
    assert sorted((str(r.date), r.summary_md) for r in spark.read.parquet(out).collect()) == [("2026-01-01", "a"), ("2026-01-02", "new")]


def test_legacy_and_logs(spark):
    rows = spark.createDataFrame([("2026-01-02", "s", '[{"title":"t","views":3}]', 1, None), ("bad", "s", "[]", 0, ""), ("2027-01-01", "s", "[]", 0, "")], "date string, summary_md string, posts_json string, post_count int, generated_at string")
    got = pages.legacy_summaries(rows, F.lit("2026-06-01").cast("date")).collect()
    assert [(r.date, r.generated_at, r.posts[0].views) for r in got] == [("2026-01-02", "2026-01-02T12:00:00+09:00", 3)]
    log = spark.createDataFrame([(i, "x" * 10 if i % 3 else "y" * 10) for i in range(100)], "i int, t string")
    assert sorted(r.i for r in sinks.retained(log, "i", "t", 5, 35).collect()) == [97, 98, 99]
    two = log.withColumn("k", F.lit("a")).unionByName(log.withColumn("k", F.lit("b")))
    assert sorted(sinks.changed(two, "k", "i", "t").groupBy("k").count().collect()) == [("a", 67), ("b", 67)]
    posts = spark.createDataFrame([("s", "t", "http://x", 1), ("s", "t", "js:x", 1)], "source string, title string, url string, secret int")
    assert sinks.public_rows(posts).columns == ["source", "title", "url"] and sinks.public_rows(posts).count() == 1


def test_verdicts(spark):
    rows = spark.createDataFrame([("g", 200, 3, "<a>"), ("g", 200, 0, ""), ("g", 403, 0, ""), ("h", 503, 0, ""), ("h", None, None, None), ("h", 404, 0, ""), ("h", 200, 3, "Just a moment...")], "group string, status int, n int, html string")
    table = pages.verdict_table(rows.withColumn("verdict", pages.verdict(F.col("status"), F.col("n"), pages.is_challenge(F.col("html"))))).orderBy("group").collect()
    assert [tuple(r) for r in table] == [("g", 1, 1, 1, 0, 0, 0), ("h", 0, 0, 1, 1, 1, 1)]


def run_stream(spark, tmp_path, frames, schema, make):
    src = tmp_path / "in"
    query = None
    rows = []
    for i, frame in enumerate(frames):
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        query = make(stream).writeStream.foreachBatch(lambda df, n: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return rows


def test_history_stream_agrees_with_fold(spark, tmp_path):
    minutes = [0, 39, 40, 90, 200, 300]
    frames = [[("f", m * 60, float(m))] for m in minutes[:2]] + [[("f", m * 60, float(m)) for m in minutes[2:]]]
    got = run_stream(spark, tmp_path, frames, "feed string, ts long, score double", rounds.history_stream)
    slots, want = [], []
    for m in minutes:
        slots = push_round(slots, m * 60, float(m))
        want.append(("f", m * 60, len(slots), sum(s[1] for s in slots) / len(slots)))
    assert sorted(got) == sorted(want)


def test_alert_stream_agrees_with_fold(spark, tmp_path):
    runs = [("f", i, 10, p) for i, p in enumerate(["x", "x", "x", "", "", ""])]
    got = run_stream(spark, tmp_path, [runs[:2], runs[2:]], "feed string, ts long, hour int, problem string", rounds.alert_stream)
    was, want = Alert(), []
    for feed, ts, hour, problem in runs:
        was, notify, close = next_alert(was, problem, hour)
        want.append((feed, ts, was.streak, notify, close))
    assert sorted(got) == want


def test_windowed_counts_stream(spark, tmp_path):
    event = lambda h, m: (datetime(2026, 1, 1, h, m), "click", 1.0)
    got = run_stream(spark, tmp_path, [[event(1, 0), event(1, 59), event(2, 0)], [event(9, 0)], [event(1, 5), event(15, 0)]], "ts timestamp_ntz, event_type string, value double", rounds.windowed_counts)
    assert {(r[0].hour, r[2]) for r in got} >= {(1, 2), (2, 1)} and (1, 3) not in {(r[0].hour, r[2]) for r in got}

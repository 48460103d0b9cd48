"""State documents: what is read of good and broken ones, and what comes back after an export."""

import json
from datetime import datetime

import pytest

from tidemark.sources import sinks, state

GOOD = {"source": "a", "title": "t", "url": "https://x/1", "views": 3, "rank": 1, "rank_score": 2.5}
DOCUMENT = {
    "version": 1, "crawl_count": 4, "last_updated": "2026-01-02T03:00:00+09:00", "status": "partial", "snapshot": "s",
    "posts": [GOOD, {**GOOD, "url": "javascript:1"}, {**GOOD, "title": ""}, {**GOOD, "source": None}, None, {**GOOD, "url": "HTTPS://x/2", "views": "many"}],
    "post_score_history": [{f"k{i}": float(i)} for i in range(7)] + [None], "post_score_times": [f"2026-01-02T0{i}:00:00Z" for i in range(3)] + ["never"],
    "source_health": {"a": {"status": "ok", "n": 5, "via": ["issuelink", "main", "other"], "since": "2026-01-01T00:00:00Z", "note": ""}, "b": {"status": "odd", "n": 1}, "c": {"status": "missing", "n": -3, "last_update": "bad", "note": "why"}, "d": None},
    "prev_day": {"date": "2026-01-01", "done": None, "posts": [GOOD, {**GOOD, "url": ""}]},
    "issuelink": {"at": "2026-01-02T03:00:00Z", "sources": ["a"], "cache": {"s-1": "https://o/1", "s-2": None, "s-3": "https://o/3"}},
}


def of(spark, *documents):
    return state.parsed(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "value string"))


def test_tables_of_a_document(spark):
    found = of(spark, DOCUMENT)
    assert [(r.arrival, r.url, r.views) for r in state.posts(found).orderBy("arrival").collect()] == [(0, "https://x/1", 3), (1, "HTTPS://x/2", None)]
    past = state.history(found).orderBy("round_no").collect()
    assert [(r.round_no, r.url_key, r.rank_score) for r in past] == [(i, f"k{i + 1}", i + 1.0) for i in range(6)]
    assert [r.started and r.started.hour for r in past] == [None, None, 0, 1, 2, None]
    known = {r.source: r for r in state.health(found).collect()}
    assert set(known) == {"a", "c"} and known["a"].via == ["main", "issuelink"] and known["a"].note is None and known["a"].since == datetime(2026, 1, 1)
    assert (known["c"].n, known["c"].last_update, known["c"].note) == (0, None, "why")
    day = state.previous_day(found).collect()
    assert [(r.saved_of, r.done, r.url) for r in day] == [("2026-01-01", None, "https://x/1")]
    assert [(r.key, r.url) for r in state.cache(found).orderBy("seq").collect()] == [("s-1", "https://o/1"), ("s-3", "https://o/3")]
    assert [r.key for r in state.cache(found, 1).collect()] == ["s-3"]
    assert tuple(state.status(found).first())[:2] == ("partial", 4)


def test_other_versions_and_broken_documents(spark):
    assert of(spark, {**DOCUMENT, "version": 2}).count() == 0 and of(spark, {"posts": []}).count() == 0 and of(spark).count() == 0 and of(spark, "  ").count() == 0
    with pytest.raises(state.StateUnreadable):
        of(spark, "not json", '{"version": 1')
    assert of(spark, "not json", DOCUMENT).count() == 1
    newer = {**DOCUMENT, "last_updated": "2026-02-01T00:00:00+09:00", "status": "ok"}
    assert state.status(of(spark, DOCUMENT, newer, {**DOCUMENT, "last_updated": None})).first().status == "ok"
    bare = of(spark, {"version": 1})
    assert [t(bare).count() for t in (state.posts, state.history, state.health, state.previous_day, state.cache)] == [0] * 5
    assert state.status(bare).first().status == "idle" and state.status(of(spark, {**DOCUMENT, "status": "??"})).first().status == "ok"


def test_load(spark, tmp_path):
    assert state.load(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps(DOCUMENT, indent=1))
    assert state.load(spark, str(tmp_path / "s.json")).first().crawl_count == 4
    (tmp_path / "s.json").write_text("{")
    with pytest.raises(state.StateUnreadable):
        state.load(spark, str(tmp_path / "s.json"))


def test_export_and_load_again(spark, tmp_path):
    found = of(spark, DOCUMENT)
    tables = state.posts(found), state.history(found), state.health(found), state.cache(found)
    document = state.exported(*tables, {"status": "ok", "crawl_count": 9, "last_updated": "2026-01-02T04:00:00+09:00", "snapshot": None}).collect()
    assert len(document) == 1
    again = of(spark, document[0].value)
    same = lambda f: sorted(map(repr, f(again).collect())) == sorted(map(repr, f(found).collect()))
    assert all(map(same, (state.posts, state.history, state.health))) and tuple(state.status(again).first())[:2] == ("ok", 9)
    assert [(r.key, r.url) for r in state.cache(again).orderBy("seq").collect()] == [("s-1", "https://o/1"), ("s-3", "https://o/3")]
    empty = state.exported(*[t.limit(0) for t in tables], {}).first().value
    assert state.posts(of(spark, empty)).count() == 0 and json.loads(empty)["version"] == 1


def test_upserts_of_batches(spark, tmp_path):
    folder, frame = str(tmp_path / "cache"), lambda *rows: spark.createDataFrame(rows, "key string, url string, seq int")
    write = sinks.upserted(folder, ["key"], ["seq"], most=3)
    assert sinks.current(spark, folder) is None
    read = lambda: sorted(map(tuple, sinks.current(spark, folder).collect()))
    write(frame(("a", "1", 1), ("b", "2", 2), ("a", "3", 3)), 0)
    assert read() == [("a", "3", 3), ("b", "2", 2)]
    write(frame(("c", "4", 4), ("d", "5", 5)), 1)
    second = read()
    assert second == [("a", "3", 3), ("c", "4", 4), ("d", "5", 5)]
    write(frame(("c", "4", 4), ("d", "5", 5)), 1)  # the batch comes again
    assert read() == second
    (tmp_path / "cache" / "batch=2").mkdir()  # a writer died before its mark
    assert read() == second
    write(frame(("b", "6", 6)), 2)
    assert read() == [("b", "6", 6), ("c", "4", 4), ("d", "5", 5)]
    write(frame(), 3)
    assert read() == [("b", "6", 6), ("c", "4", 4), ("d", "5", 5)] and sinks._versions(spark, folder) == [2, 3]


def test_upserts_of_a_stream_that_is_restarted(spark, tmp_path):
    rows = [(f"k{i % 7}", f"u{i}", i) for i in range(40)]
    write = sinks.upserted(str(tmp_path / "t"), ["key"], ["seq"], most=5)
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "key string, url string, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, url string, seq int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    last = {k: (k, u, i) for k, u, i in rows}
    assert sorted(map(tuple, sinks.current(spark, str(tmp_path / "t")).collect())) == sorted(sorted(last.values(), key=lambda r: -r[2])[:5])

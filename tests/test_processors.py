"""Stateful processors: streams that are stopped and go on against one run, batch replays, and plain folds."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.health import source_health
from tidemark.streaming import processors as P

T0 = int(datetime(2026, 3, 1, tzinfo=timezone.utc).timestamp())


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    P.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Stream:
    """Rows fed in parts to a query that is started and stopped for each."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make = spark, folder, schema, make
        (folder / "in").mkdir(parents=True)

    def feed(self, *parts):
        for rows in parts:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
            source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
            self.make(source).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "ck")).trigger(availableNow=True).start().awaitTermination()
        return self

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(str(self.folder / "out")).collect()), key=repr)


# health

ROUND = "source string, at long, slow boolean, gone boolean, blocked boolean, n long, via string, last_update long"


def health_rounds(rounds):
    draw = random.Random(2)
    out = []
    for k in range(rounds):
        at = T0 + k * 4 * 3600
        out.append([(s, at, draw.random() < 0.3, s != "a" and draw.random() < 0.6, draw.random() < 0.5, draw.choice([0, 0, 3]), draw.choice(["main", "direct,main", "", "issuelink"]), at - 600 if draw.random() < 0.3 else None) for s in "abc"])
    return out


def test_health_goes_on_after_a_stop(spark, tmp_path):
    rounds = health_rounds(14)
    prior = spark.createDataFrame([("a", "suspended", -1, T0 - 999, 0, ""), ("z", "ok", T0, T0, 1, "main")], "source string, status string, last_update long, since long, n long, via string")
    several = Stream(spark, tmp_path / "several", ROUND, lambda s: P.health_stream(s, prior)).feed(sum(rounds[:5], []), sum(rounds[5:6], []), sum(rounds[6:], []))
    one = Stream(spark, tmp_path / "one", ROUND, lambda s: P.health_stream(s, prior)).feed(sum(rounds, []))
    want, was = [], {"a": P.Health("suspended", -1, T0 - 999, 0, "")}
    for rows in rounds:
        for s, at, slow, gone, blocked, n, via, last in rows:
            was[s] = P.next_health(was.get(s), at, slow, gone, blocked, n, via, -1 if last is None else last)
            want.append((s, at, was[s].status, was[s].last_update, was[s].since, was[s].n, was[s].via))
    assert several.rows() == one.rows() == sorted(want, key=repr) and {r[2] for r in want} >= {"ok", "missing", "degraded", "blocked"}
    kept = {r.key.source: r.value.status for r in P.read_state(spark, str(tmp_path / "several" / "ck"), "health").collect()}
    assert kept == {s: h.status for s, h in was.items()} | {"z": "ok"}
    # and it goes on from what was read back
    saved = P.read_state(spark, str(tmp_path / "several" / "ck"), "health").select("key.source", "value.*")
    more = health_rounds(16)[14:]
    third = Stream(spark, tmp_path / "third", ROUND, lambda s: P.health_stream(s, saved)).feed(sum(more, []))
    assert set(third.rows()) <= set(several.feed(sum(more, [])).rows()) and len(third.rows()) == 6


def test_health_is_the_batch_rule(spark):
    prior: dict = {}
    for rows in health_rounds(9):
        at = rows[0][1]
        plan = spark.createDataFrame([(s, slow, gone) for s, _, slow, gone, *_ in rows], "source string, is_degraded boolean, is_missing boolean")
        stats = spark.createDataFrame([(s, None if last is None else datetime.fromtimestamp(last, timezone.utc)) for s, *_, last in rows], "source string, last_update timestamp")
        collected = spark.createDataFrame([(s, v) for s, *_, n, via, _ in rows for v in (via or "main").split(",") for _ in range(n)], "source string, via string")
        old = spark.createDataFrame([(s, h.status, None if h.last_update < 0 else datetime.fromtimestamp(h.last_update, timezone.utc), datetime.fromtimestamp(h.since, timezone.utc)) for s, h in prior.items()], "source string, status string, last_update timestamp, since timestamp")
        blocked = spark.createDataFrame([(r[0],) for r in rows if r[4]], "source string")
        got = {r.source: r for r in source_health(plan, stats, collected, old, blocked, F.lit(at).cast("timestamp")).collect()}
        for s, _, slow, gone, is_blocked, n, via, last in rows:
            paths = (via or "main") if n else ""
            n_rows = n * len(paths.split(",")) if n else 0
            prior[s] = P.next_health(prior.get(s), at, slow, gone, is_blocked, n_rows, paths, -1 if last is None else last)
            assert (got[s].status, got[s].n, list(got[s].via)) == (prior[s].status, n_rows, [p for p in prior[s].via.split(",") if p])
            assert int(got[s].since.replace(tzinfo=timezone.utc).timestamp()) == prior[s].since


# the day before

POST = "feed string, ts timestamp, complete boolean, source string, target_date string, url_key string, title string, score double, via string"


def at(day, hour, minute=0):
    return datetime(2026, 3, day, hour, minute)


def post_round(feed, when, day, count, complete=True, sources="ab", via=None, mark=""):
    return [(feed, when, complete, s, f"2026-03-{day:02d}", f"{mark}{day}{s}{i}", f"title {i}", float(i), via) for s in sources for i in range(count)]


ROUNDS = [
    post_round("f", at(1, 0, 10), 28, 3) + post_round("f", at(1, 0, 10), 1, 2),  # February's last day isn't the 28th of March
    post_round("f", at(2, 0, 10), 1, 30) + post_round("f", at(2, 0, 10), 2, 2),
    post_round("f", at(2, 1, 0), 1, 3, complete=False),  # incomplete: replaces nothing
    post_round("f", at(2, 1, 30), 1, 27, mark="x") + post_round("g", at(2, 1, 30), 1, 4, sources="abc"),
    post_round("f", at(2, 3, 0), 2, 20) + post_round("g", at(2, 3, 0), 2, 1, sources="a"),
    post_round("f", at(2, 9, 0), 2, 25, sources="a") + post_round("f", at(2, 9, 0), 2, 24, sources="b", via="direct"),
    post_round("f", at(2, 9, 30), 2, 12, sources="abcd"),  # enough of today: nothing is filled
    post_round("f", at(2, 10, 0), 2, 2, sources="a") + post_round("f", at(2, 10, 0), 1, 1, sources="a", mark="x"),
    post_round("f", at(2, 12, 0), 2, 1),
    post_round("f", at(2, 13, 0), 2, 1),
    post_round("f", at(3, 0, 30), 2, 5, complete=False),  # nothing saved of the day: taken
    post_round("f", at(3, 4, 0), 3, 1, sources="c"),
    post_round("h", at(4, 8, 0), 4, 1),
]


def plain_fill(rounds, done_sources, done_posts):
    saved, out = {}, []
    for rows in sorted((r for rr in rounds for r in [rr]), key=lambda rr: rr[0][1]):
        for feed in sorted({r[0] for r in rows}):
            mine = [r for r in rows if r[0] == feed]
            now = mine[0][1]
            today, before = now.strftime("%Y-%m-%d"), (now - timedelta(days=1)).strftime("%Y-%m-%d")
            if now.hour < 2:
                best = {}
                for r in sorted(mine, key=lambda r: (-r[7], r[5])):
                    if r[4] == before and r[8] is None and len(best.setdefault(r[3], [])) < 25:
                        best[r[3]].append(r)
                if best and (mine[0][2] or saved.get(feed, ("",))[0] != before):
                    saved[feed] = (before, best)
            elif now.hour >= 12:
                saved.pop(feed, None)
            elif saved.get(feed, ("",))[0] == before:
                own = {}
                for r in mine:
                    if r[8] is None and r[4] == today:
                        own[r[3]] = min(25, own.get(r[3], 0) + 1)
                if len(own) >= done_sources and sum(own.values()) >= done_posts:
                    continue
                keys, place = {r[5] for r in mine}, 0
                for s in sorted(saved[feed][1]):
                    room = 25 - sum(r[3] == s for r in mine)
                    for r in saved[feed][1][s]:
                        if room > 0 and r[5] not in keys:
                            out.append((feed, int(now.replace(tzinfo=timezone.utc).timestamp()), place, s, r[5], r[6], r[7]))
                            place, room = place + 1, room - 1
    return sorted(out, key=repr)


def test_day_before_over_two_midnights(spark, tmp_path):
    make = lambda s: P.day_before_stream(s, done_sources=4, done_posts=40)
    each = Stream(spark, tmp_path / "each", POST, make).feed(*ROUNDS)
    few = Stream(spark, tmp_path / "few", POST, make).feed(sum(ROUNDS[:4], []), sum(ROUNDS[4:8], []), sum(ROUNDS[8:], []))
    want = plain_fill(ROUNDS, 4, 40)
    assert each.rows() == few.rows() == want and len({r[1] for r in want}) == 4
    # g and f were saved on the 2nd; nobody came for g after noon, and its posts went all the same
    assert {r.key.feed: r.value.day for r in P.read_state(spark, str(tmp_path / "each" / "ck"), "day").collect()} == {}
    assert P.read_state(spark, str(tmp_path / "each" / "ck"), "posts").count() == 0


# gates

WISH = "feed string, kind string, ts timestamp, outcome string"


def wishes():
    draw = random.Random(6)
    rows, now = [], datetime(2026, 3, 1, 22)
    for _ in range(260):
        now += timedelta(minutes=draw.choice([3, 6, 7, 15, 29, 31, 60]))
        kind = draw.choice([*P.RULES, "audio", "other"])
        rows.append((draw.choice("fg"), kind, now, draw.choice(["ok", "failed", "transient", "quota_day", "publish_failed", "publish_failed", None])))
    return rows


def test_gates_stream_and_replay(spark, tmp_path):
    rows = wishes()
    stream = Stream(spark, tmp_path / "gates", WISH, P.gate_stream).feed(rows[:90], rows[90:91], rows[91:])
    replay = sorted((tuple(r) for r in P.gate_replay(spark.createDataFrame(rows, WISH).repartition(5)).collect()), key=repr)
    assert stream.rows() == replay and len(replay) == len(rows)
    assert {r[5] for r in replay} == {"", "interval", "retry", "quota", "given_up"}
    kept = {(r.key.feed, r.user_map_key.kind) for r in P.read_state(spark, str(tmp_path / "gates" / "ck"), "gates").collect()}
    assert kept == {(r[0], r[1]) for r in rows}
    later = datetime(2026, 4, 1)
    stream.feed([("x", "run", later, "ok")], [("x", "run", later + timedelta(days=1), "ok")])  # f and g fall silent
    assert {r.key.feed for r in P.read_state(spark, str(tmp_path / "gates" / "ck"), "gates").collect()} == {"x"}


def test_gate_rules():
    rule, at0 = P.RULES, T0 + 10 * 3600
    ask = lambda kind, gate, minutes: P.opened(rule[kind], gate, at0 + int(minutes * 60))
    ok = P.Gate(ok_at=at0)
    assert [ask("run", ok, m) for m in (0, 6.9, 7, 8)] == ["interval", "interval", "", ""] and ask("run", ok, -5) == ""
    assert [ask("summary", ok, m) for m in (360, 360.1)] == ["interval", ""]
    failed = lambda error, **more: P.Gate(failed_at=at0, error=error, **more)
    assert [ask("summary", failed("transient"), m) for m in (30, 31)] == ["retry", ""] and [ask("summary", failed("x"), m) for m in (120, 121)] == ["retry", ""]
    assert [ask("audio", failed("quota_day"), m) for m in (179, 180)] == ["retry", ""] and [ask("audio", failed("x"), m) for m in (29, 30)] == ["retry", ""]
    assert [ask("audio", failed("publish_failed", fails=n), 60) for n in (1, 2)] == ["", "given_up"] and ask("audio", failed("publish_failed", fails=2), 14 * 60) == ""
    today = P._local(at0).strftime("%Y-%m-%d")
    assert [ask("audio", P.Gate(day=today, attempts=n), 1) for n in (5, 6)] == ["", "quota"] and ask("audio", P.Gate(day="2026-02-28", attempts=9), 1) == ""
    late = P.Gate(failed_at=T0 - 60, error="x")
    assert P.opened(rule["report"], late, T0 + 60) == "" and P.opened(rule["audio"], late, T0 + 60) == "retry"
    assert P.after_attempt(failed("publish_failed", fails=1), at0, "ok") == P.Gate(ok_at=at0, day=today, attempts=1)

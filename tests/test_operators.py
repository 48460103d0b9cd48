"""Operators on small tables against plain Python."""

import hashlib
import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audio, dedup, health, history, issues, ranking, selection, similarity, stats
from tidemark.functions import text as T

POST = "source string, arrival long, views long, likes long, comments long, age_days double, position double"


def make_posts(spark, n=160, seed=1):
    rnd = random.Random(seed)
    rows = [(f"s{rnd.randrange(5)}", i, rnd.choice([0, 0, rnd.randrange(5000)]), rnd.choice([0, rnd.randrange(90)]), rnd.choice([0, rnd.randrange(60)]), rnd.random() * 100, max(0.0, 100 - 1.5 * rnd.randrange(80))) for i in range(n)]
    rows += [("quiet", 1000 + i, 0, 0, 0, 1.0, 100 - 1.5 * i) for i in range(30)]
    return spark.createDataFrame(rows, POST), rows


def test_rank_invariants(spark):
    posts, rows = make_posts(spark)
    got = ranking.rank_balanced(posts).collect()
    assert sorted(r.rank for r in got) == list(range(1, len(got) + 1)) and all(r.age_days <= 90 for r in got)
    assert max(sum(r.source == s for r in got) for s in {r.source for r in got}) == 25
    assert {(r.arrival, r.rank) for r in got} == {(r.arrival, r.rank) for r in ranking.rank_balanced(posts.repartition(7)).collect()}
    assert ranking.rank_balanced(posts.limit(0)).count() == 0


def test_popularity_rules(spark):
    posts, rows = make_posts(spark)
    young = [r for r in rows if r[5] <= 90]
    raw = {r[1]: r[2] or 100.0 * r[4] or 100.0 * r[3] for r in young}
    known = sorted(v for v in raw.values() if v)
    own = {s: sorted(raw[r[1]] for r in young if r[0] == s and raw[r[1]]) for s in {r[0] for r in young}}
    for r in ranking.estimated_views(posts.where("age_days <= 90")).collect():
        v = own[r.source]
        base = v[len(v) // 2] if v else known[len(known) // 2]
        assert math.isclose(r.estimate, raw[r.arrival] or base * max(0.2, r.position / 100) * 1.5)


def test_dedup(spark):
    rows = [("u1", "t1", "direct", 5, 1), ("u1", "t1", None, 5, 2), ("u2", "t1", "issuelink", 5, 3), ("u3", "t1", None, 5, 4), ("u4", "", "direct", 5, 5), ("u5", "", None, 5, 6)]
    posts = spark.createDataFrame(rows, "url_key string, title_key string, via string, likes int, arrival long").withColumn("priority", dedup.priority(F.col("via"), F.lit(False)))
    got = {r.arrival for r in dedup.dedup(posts).collect()}
    assert got == {2, 4, 5, 6}
    once = dedup.dedup(posts)
    assert {r.arrival for r in dedup.dedup(once).collect()} == got
    stalled = posts.withColumn("priority", dedup.priority(F.col("via"), F.lit(True)))
    assert 1 in {r.arrival for r in dedup.dedup(stalled).collect()}


def test_carry_forward_and_fill(spark):
    schema = "source string, url_key string, title_key string, prev_day boolean, arrival long"
    now = spark.createDataFrame([("a", f"a{i}", "", False, i) for i in range(3)] + [("b", "b1", "a|title", False, 9)], schema)
    before = spark.createDataFrame([("a", "a1", "", None, 20), ("a", "old", "", None, 21), ("c", "c1", "", False, 22), ("c", "c2", "a|title", None, 23), ("c", "c3", "", True, 24), ("c", "c1", "", None, 25)], schema)
    kept = dedup.carry_forward(before, now, complete=True).collect()
    assert [(r.arrival, r.position, r.kept) for r in kept] == [(22, 100.0, True)]
    assert {r.arrival for r in dedup.carry_forward(before, now, complete=False).collect()} == {21, 22}
    filled = dedup.capacity_fill(now, before, cap=4).orderBy("rank").collect()
    assert [(r.arrival, r.rank) for r in filled] == [(21, 5), (22, 6), (23, 7), (24, 8)]
    listed = before.withColumn('listed', F.date_add(F.lit('2026-01-01').cast('date'), (F.col('arrival') - 20).cast('int')))
    days = F.array(F.lit('2026-01-02').cast('date'))
    assert {r.arrival for r in dedup.carry_forward(listed, now, complete=False, window=days).collect()} == {21}
    assert tuple(stats.capped_size(now, 'source', 2).first()) == (2, 3)


def test_signature(spark):
    a = spark.createDataFrame([(i, f"x{i % 3}") for i in range(300)], "i int, t string")
    one = dedup.relation_signature(a, F.concat_ws("|", "i", "t")).first()
    assert one == dedup.relation_signature(a.repartition(9).orderBy(F.desc("i")), F.concat_ws("|", "i", "t")).first()
    assert one != dedup.relation_signature(a.where("i > 0"), F.concat_ws("|", "i", "t")).first()
    assert one != dedup.relation_signature(a.unionByName(a), F.concat_ws("|", "i", "t")).first() and len(dedup.relation_signature(a.limit(0), F.col("t")).first().signature) == 40


def test_signature_digests_sorted_lines(spark):
    lines = [None if i % 50 == 0 else f"{i % 700}|x" for i in range(3000)]
    groups = {}
    for h in sorted(hashlib.sha1(x.encode()).hexdigest() for x in lines if x):
        groups.setdefault(h[:2], []).append(h)
    want = hashlib.sha1("\n".join(hashlib.sha1("\n".join(groups[p]).encode()).hexdigest() for p in sorted(groups)).encode()).hexdigest()
    frame = spark.createDataFrame([(x,) for x in lines], "t string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go over batches
    try:
        assert dedup.relation_signature(frame, F.col("t")).first().signature == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def tried_in_order(posts):
    """Posts kept by trying them one by one."""
    urls, paths, kept = set(), {}, []
    for p in sorted(posts, key=lambda p: (p[4], p[5])):
        url, title, via = p[0], p[1], p[2] or "main"
        if p[3].startswith("http") and url not in urls and not (title and paths.setdefault(title, via) != via):
            urls.add(url)
            kept.append(p[5])
    return sorted(kept)


@pytest.mark.parametrize("seed", range(4))
def test_dedup_tries_later_posts(spark, seed):
    rnd = random.Random(seed)
    vias = [None, "direct", "issuelink"]
    posts = []
    for i in range(150):
        via = rnd.choice(vias)
        posts.append((f"u{rnd.randrange(50)}", rnd.choice(["", *(f"s|t{k}" for k in range(15))]), via, rnd.choice(["http://x", "http://x", "ftp://x"]), vias.index(via), i))
    frame = spark.createDataFrame(posts, "url_key string, title_key string, via string, url string, priority int, arrival long")
    found = dedup.dedup(frame)
    assert found.columns == frame.columns
    assert sorted(r.arrival for r in found.collect()) == tried_in_order(posts)
    assert dedup.dedup(frame.limit(0)).count() == 0


def greedy(posts, base=10, most=20, cap=4, fallback=10):
    pool = [p for p in posts if p["is_candidate"]]
    pool = pool if len(pool) >= fallback else posts
    by_rank, by_score = sorted(pool, key=lambda p: (p["rank"], p["arrival"])), sorted(pool, key=lambda p: (-p["rank_score"], p["rank"], p["arrival"]))
    chosen = []
    for order, limit, per in ((by_rank, base, cap), (by_score, most, cap), (by_score, most, 10**9)):
        for p in order:
            if len(chosen) < limit and p not in chosen and sum(c["source"] == p["source"] for c in chosen) < per:
                chosen.append(p)
    return [p["arrival"] for p in chosen]


@pytest.mark.parametrize("sources, n, share", [(6, 80, 0.5), (2, 40, 0.9), (1, 15, 1.0), (5, 60, 0.05), (3, 0, 0.5), (9, 200, 1.0)])
def test_diversified_topk(spark, sources, n, share):
    rnd = random.Random(n)
    posts = [{"source": f"s{min(rnd.randrange(sources * 2), sources - 1)}", "arrival": i, "rank": i + 1, "rank_score": float(rnd.randrange(30)), "is_candidate": rnd.random() < share} for i in range(n)]
    frame = spark.createDataFrame([tuple(p.values()) for p in posts], "source string, arrival long, rank long, rank_score double, is_candidate boolean")
    got = [r.arrival for r in selection.diversified_topk(frame).orderBy("pick").collect()]
    assert got == greedy(posts)


def test_push_round():
    slots = []
    for minute in (0, 39, 40, 80, 120, 160, 200, 241):
        slots = history.push_round(slots, minute * 60, minute)
    assert [s[1] for s in slots] == [40, 80, 120, 160, 200, 241]
    assert history.push_round([(0, "a")], 241 * 60, "b") == [(241 * 60, "b")]
    assert history.push_round([(0, "a")], 39 * 60, "b") == [(0, "b")]


def test_slot_starts(spark):
    rows = spark.createDataFrame([("k", m * 60) for m in (0, 39, 40, 79, 80, 200)] + [("j", 5)], "key string, ts long")
    got = {(r.key, r.ts // 60): r.slot_start // 60 for r in history.slot_starts(rows, "key", "ts").collect()}
    assert got == {("k", 0): 0, ("k", 39): 0, ("k", 40): 40, ("k", 79): 40, ("k", 80): 80, ("k", 200): 200, ("j", 0): 0}


@pytest.mark.parametrize("keys", [["k"], [], ["k", "j"]])
def test_upper_medians(spark, keys):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(2), rnd.choice([None, 0.0, -1.5, rnd.random() * 1e6, 7.0, 7.25, -rnd.random() * 100])) for _ in range(400)] + [("one", 0, 5.0), ("none", 0, None)]
    rows += [("hot", 1, 3.0)] * 300
    frame = spark.createDataFrame(rows, "k string, j int, v double").repartition(7)
    want = {}
    for k, j, v in rows:
        if v is not None:
            want.setdefault({"": (), "k": (k,), "kj": (k, j)}["".join(keys)], []).append(v)
    got = {tuple(r[:-1]): r.m for r in ranking.upper_median_by_rank(frame, keys, "v", "m").collect()}
    assert got == {k: sorted(x)[len(x) // 2] for k, x in want.items()}
    assert ranking.upper_median_by_rank(frame.limit(0), keys, "v").count() == 0


def test_numbers_over_ranges(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    frame = spark.createDataFrame(rows, "rank long, v long").repartition(6)
    got = {r.v: (r.rank, r.no) for r in ranking.numbered(frame, [F.desc("v")], "no").collect()}
    assert {v: n for v, (_, n) in got.items()} == {v: 1000 - v for v in range(1000)} and ranking.numbered(frame.limit(0), [F.asc("v")]).count() == 0


def test_slot_starts_of_any_stretches(spark):
    rnd = random.Random(12)
    rows, want = [], {}
    for key in ("a", "b", None):
        at = 0
        slots: list = []
        for _ in range(250):
            at += rnd.choice([0, 1, 60, 600, 1500, 2399, 2400, 2401, 9000])
            rows.append((key, at))
            if not slots or not 0 <= at - slots[-1] < 2400:
                slots.append(at)
            if key is not None:
                want[key, at] = slots[-1]
    frame = spark.createDataFrame([*rows, ("c", None)], "key string, ts long")
    got = history.slot_starts(frame.repartition(6), "key", "ts").collect()
    assert {(r.key, r.ts): r.slot_start for r in got} == want and len(got) == sum(k is not None for k, _ in rows)


def test_status_reasons(spark):
    # n, sources, before_n, before_sources, recent, total, since_h, last_h, timed
    cases = [((5, 3, 2, 2, 0, 9, 9.0, 1.0, 4), "최근 3번 갱신 동안 글 2→5개, 커뮤니티 2→3곳"), ((5, 3, None, None, 3, 9, 9.0, 1.0, 4), "최근 3시간에 새 글 3개"), ((2, 2, 2, 2, 0, 9, 20.0, 9.9, 2), "마지막 글 9시간 전"), ((2, 2, 2, 2, 0, 9, 20.0, 9.9, 1), ""), ((2, 2, 2, 2, 0, 9, 2.0, 1.0, 2), "최근 3시간 안에 여러 곳에 올라오기 시작")]
    names = ["n", "c", "bn", "bc", "recent", "total", "since", "last", "timed"]
    frame = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} {'double' if n in ('since', 'last') else 'long'}" for n in names))
    got = frame.select("i", history.status_reason(*map(F.col, names)).alias("w"), history.status(*map(F.col, names)).alias("s")).orderBy("i").collect()
    assert [r.w for r in got] == [w for _, w in cases] and all((r.w == "") == (r.s == "steady") for r in got)


def test_velocity_and_rounds(spark):
    posts = spark.createDataFrame([("a", 5.0), ("b", 7.0)], "url_key string, rank_score double")
    past = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "url_key string, rank_score double")
    assert {r.url_key: r.velocity for r in history.velocity(posts, past).collect()} == {"a": 3.5, "b": 7.0}
    assert {r.velocity for r in history.velocity(posts, past.limit(0)).collect()} == {0.0}
    rounds = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "b")], "round_no int, url_key string")
    assert {r.round_no for r in history.collapse_rounds(rounds).collect()} == {0, 2, 3}


def test_source_health(spark):
    now = datetime(2026, 1, 2, 12)
    at = F.lit(now).cast("timestamp_ntz")
    expected = spark.createDataFrame([(s, 3) for s in "abcdef"] + [("late", 20)], "source string, from_hour int")
    stats_of = spark.createDataFrame([("a", datetime(2026, 1, 2, 11, 30), 9), ("b", datetime(2026, 1, 2, 10), 9), ("e", datetime(2026, 1, 2, 11, 50), 2)], "source string, last_update timestamp_ntz, n int")
    plan = health.fill_plan(expected, stats_of, at)
    flags = {r.source: (r.is_missing, r.is_degraded, r.is_thin) for r in plan.collect()}
    assert flags == {"a": (False, False, False), "b": (False, True, False), "c": (True, False, False), "d": (True, False, False), "e": (False, False, True), "f": (True, False, False), "late": (False, False, False)}
    assert health.round_status(plan).first().status == "partial"
    collected = spark.createDataFrame([("a", None), ("c", "direct"), ("b", None)], "source string, via string")
    prior = spark.createDataFrame([("a", "ok", None, datetime(2026, 1, 1)), ("d", "missing", datetime(2026, 1, 1), datetime(2026, 1, 1)), ("f", "suspended", None, datetime(2025, 12, 1))], "source string, status string, last_update timestamp_ntz, since timestamp_ntz")
    blocked = spark.createDataFrame([("c",), ("d",)], "source string")
    got = {r.source: (r.status, r.since) for r in health.source_health(plan, stats_of, collected, prior, blocked, at).collect()}
    assert got["a"] == ("ok", datetime(2026, 1, 1)) and got["b"] == ("degraded", now) and got["c"] == ("missing", now)
    assert got["d"] == ("suspended", now) and got["f"] == ("suspended", datetime(2025, 12, 1)) and got["late"][0] == "ok"


def test_alerts():
    was, seen = health.Alert(), []
    for hour, problem in [(10, "x"), (11, "x"), (12, "x"), (13, "x"), (14, "y"), (3, ""), (7, ""), (8, ""), (9, ""), (10, "")]:
        was, notify, close = health.next_alert(was, problem, hour)
        seen.append((was.streak, notify, close))
    assert seen == [(1, False, False), (2, False, False), (3, True, False), (4, False, False), (5, True, False), (5, False, False), (0, False, True), (0, False, True), (0, False, True), (0, False, False)]
    assert not health.admitted(0, 5, 0, True) and not health.admitted(10, 5, 30, True) and health.admitted(30, 1, 90, True) and not health.admitted(100, 9, 0, False)


def test_jaccard_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, sorted({rnd.choice("abcdefghijkl") + rnd.choice("ab") for _ in range(rnd.randrange(12))})) for i in range(150)]
    got = {(r.a, r.b): r.jaccard for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s").collect()}
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in rows for j, y in rows if i < j and x and y and len(set(x) & set(y)) >= 0.45 * len(set(x) | set(y))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_jaccard_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)  # elements' lists go over many blocks
    rnd = random.Random(5)
    rows = [(f"k{i}", sorted({"hot", *(f"w{rnd.randrange(25)}" for _ in range(rnd.randrange(9)))})) for i in range(90)] + [("only", ["alone", "apart"])]
    got = similarity.jaccard_pairs(spark.createDataFrame(rows, "id string, s array<string>"), "id", "s", 0.6).collect()
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in rows for j, y in rows if i < j and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}
    assert len(got) == len(want) and {(r.a, r.b): r.jaccard for r in got} == want


def test_candidates_choose_as_all_posts(spark):
    rnd = random.Random(7)
    sets = [[], ["ab", "bc"], ["ab", "bc", "cd"], ["xy", "yz"], ["pq"], ["mn", "no"], ["st", "tu"]]
    rows = [(i % 3, i, f"s{rnd.randrange(12)}", f"t{i}", rnd.choice(sets), i, rnd.random() < 0.4, float(rnd.randrange(6))) for i in range(1500)]
    posts = spark.createDataFrame(rows, "issue long, id long, source string, title string, bi array<string>, rank long, unsafe boolean, why double")
    few = issues.candidates(posts)
    assert few.groupBy("issue").count().agg(F.max("count")).first()[0] <= len(sets) * 2 * issues.REPS
    picked = lambda df: {r["issue"]: (r["head"], list(r["reps"])) for _, g in df.toPandas().groupby("issue") for r in issues._chosen(g).to_dict("records")}
    assert picked(few) == picked(posts)


def test_stats(spark):
    rows = spark.createDataFrame([(1, t) for t in ("price of fame", "stock up", "Game on", None)], "i int, text string")
    flags = stats.category_flags(F.col("text"))
    assert [r[0] for r in rows.select(stats.label(flags)).collect()] == ["general", "money", "game", "general"]


def pcm_of(seconds):
    """PCM of a tone: (seconds, amplitude 0 to 1) in order."""
    return b"".join(np.round(32767 * a * np.sin(np.arange(round(s * audio.RATE)) * 0.2)).astype("<i2").tobytes() for s, a in seconds)


def test_silences_and_sections(spark):
    tone, none = (lambda s: (s, 0.5)), (lambda s: (s, 0.0))
    # 90 ms is no silence; a gap of 120 ms joins, one of 130 ms doesn't
    pcm = pcm_of([tone(1), none(0.09), tone(1), none(0.1), tone(0.12), none(0.2), tone(0.5), none(0.2), tone(0.13), none(0.2), tone(1)])
    clips = spark.createDataFrame([("c", pcm), ("none", None)], "clip string, pcm binary")
    got = sorted((round(r.start, 2), round(r.end, 2)) for r in audio.silences(audio.frames(clips)).collect())
    assert got == [(2.09, 2.51), (3.01, 3.21), (3.34, 3.54)]
    pcm = pcm_of([tone(5), none(0.6), tone(5), none(0.7), tone(5)])
    scripts = spark.createDataFrame([("c", ["x" * 50, "x" * 50, "x" * 50])], "clip string, blocks array<string>")
    r = audio.aligned(audio.frames(spark.createDataFrame([("c", pcm)], "clip string, pcm binary")), scripts).first()
    assert r.boundary == "snap" and r.starts == [5.3, 11.0]
    # a phrase and a silence after the farther of two silences; no silence near; no silence at all; one block
    far = pcm_of([tone(4), none(0.6), tone(2), none(0.6), tone(1), none(0.3), tone(8)])
    clips = spark.createDataFrame([("a", far), ("b", far), ("c", pcm_of([tone(4)])), ("d", far)], "clip string, pcm binary")
    scripts = spark.createDataFrame([("a", ["x" * 5, "x" * 11]), ("b", ["x" * 5, "x" * 5, "x" * 5]), ("c", ["", ""]), ("d", ["x"])], "clip string, blocks array<string>")
    got = {r.clip: (r.starts, r.boundary) for r in audio.aligned(audio.frames(clips), scripts).collect()}
    assert got == {"a": ([6.9], "snap"), "b": ([6.9, 11.0], "partial"), "c": ([0.0], "estimate"), "d": ([], "snap")}


def test_issues(spark):
    now = datetime(2026, 1, 1, 12)
    titles = [
        ("a", "축구 결승 역전 골 장면"), ("b", "축구 결승 역전 골 순간"), ("c", "축구 결승 반응"), ("d", "축구 결승 관중"),
        ("a", "고양이가 문을 여는 방법 공개"), ("b", "고양이가 문을 여는 방법 공개합니다"), ("c", "전혀 다른 이야기 하나"), ("d", "[특가] 축구 결승 티켓"),
    ]
    rows = [(i, s, t, f"k{i}", i + 1, 100.0 - i, 5 * i, datetime(2026, 1, 1, 10 if i < 4 else 1)) for i, (s, t) in enumerate(titles)]
    posts = spark.createDataFrame(rows, "id long, source string, title string, url_key string, rank long, rank_score double, comments long, event_ts timestamp_ntz")
    posts = posts.withColumn("kws", T.words(F.col("title"))).withColumn("bi", T.bigrams(F.col("title")))
    past = spark.createDataFrame([(r, f"k{i}") for r in range(4) for i in range(8)], "round_no int, url_key string")
    found = issues.issues(posts, past, now)
    by = {tuple(r.ranks): r for r in found.collect()}
    assert set(by) == {(1, 2, 3, 4), (5, 6)}
    assert by[(1, 2, 3, 4)].status == "new" and by[(1, 2, 3, 4)].confident and by[(1, 2, 3, 4)].kind == "story" and "축구" in by[(1, 2, 3, 4)].name
    assert by[(5, 6)].kind == "repost" and by[(5, 6)].status == "quiet" and len(by[(1, 2, 3, 4)].reps) >= 2
    assert issues.board(found).count() == 2
    assert [r["rank"] for r in issues.hot_list(posts, found).collect()] == [8, 7]
    assert by[(1, 2, 3, 4)].status_why.startswith("최근 3시간") and by[(5, 6)].status_why == "마지막 글 11시간 전"
    assert by[(1, 2, 3, 4)].first == by[(1, 2, 3, 4)].since == datetime(2026, 1, 1, 10)
    shown = issues.block(posts, found, 4, now).collect()
    assert len(shown) == 1 and (shown[0].as_of, shown[0].posts, shown[0].communities, shown[0].in_issues, shown[0].low_data, shown[0].badges, shown[0].hot) == (now, 8, 4, 6, True, True, [8, 7])
    assert [tuple(i.ranks) for i in shown[0]["items"]] == [tuple(r.ranks) for r in sorted(found.where("confident").collect(), key=lambda r: -r.heat)]
    bare = issues.block(posts, None, 4, now)
    assert bare.schema == issues.block(posts, found, 4, now).schema or [f.name for f in bare.schema] == [f.name for f in issues.block(posts, found, 4, now).schema]
    assert bare.first()["items"] == [] and not bare.first().badges and issues.block(posts.limit(0), None, 0, now).first().posts == 0
    assert json.dumps(sorted(map(str, issues.issues(posts.repartition(3), past, now).drop("by_source").collect()))) == json.dumps(sorted(map(str, found.drop("by_source").collect())))

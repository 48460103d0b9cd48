"""Paged lists by day, and selections under a budget."""

import json
import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.sources import scan

ITEM = "id string, n bigint"


def landed(folder, lists):
    """{day: [page, or a text that is no page]} as files of a page a line."""
    for day, lines in lists.items():
        (folder / f"day={day}").mkdir(parents=True)
        for k, line in enumerate(lines):
            text = line if isinstance(line, str) else json.dumps(line)
            (folder / f"day={day}" / f"{k:03d}.json").write_text(text + "\n")
    return str(folder)


def a_page(k, n=2, more=True, total=10):
    return {"page": k, "total": total, "hasNext": more, "items": [{"id": f"{k}-{i}", "n": i} for i in range(n)]}


def plain_walk(lines, most):
    """Pages a reader gets one after the other, and how it ended."""
    by_number = {x["page"]: x for x in lines if isinstance(x, dict) and x.get("page", 0) >= 1}
    got = []
    for k in range(1, most + 1):
        if k not in by_number:
            break
        got.append(by_number[k])
        if not by_number[k]["hasNext"]:
            return got, False
    return got, True


LISTS = {
    "2026-01-01": [a_page(1), a_page(2), a_page(3, 1, False)],
    "2026-01-02": [a_page(1), a_page(3, 1, False)],
    "2026-01-03": [a_page(2, more=False)],
    "2026-01-04": [a_page(1), '{"page": 2, "items": [{"id"', a_page(3, more=False)],
    "2026-01-05": [a_page(k) for k in range(1, 8)],
    "2026-01-06": [a_page(1, total=10), a_page(2, more=False, total=11), a_page(3, more=False)],
    "2026-01-07": [{"page": 1, "total": 0, "hasNext": False, "items": None}, {"page": 0, "hasNext": False, "items": []}],
    "2026-01-08": ["not json", "[]"],
    "2026-01-09": [a_page(2, more=False), a_page(1)],
    "2026-01-10": [a_page(1, more=False)],
}


def test_walk(spark, tmp_path):
    folder = landed(tmp_path / "lists", LISTS)
    found = scan.pages(spark, folder, "2026-01-01", "2026-01-09", ITEM)
    items, days = scan.walked(found, most_pages=5)
    got = {str(r.day): r for r in days.collect()}
    rows = Counter((str(r.day), r.page, r.place, r.item.id) for r in items.collect())
    for day, lines in LISTS.items():
        read, truncated = plain_walk(lines, 5)
        assert {k: v for k, v in rows.items() if k[0] == day} == ({} if day == "2026-01-10" else {(day, x["page"], i, it["id"]): 1 for x in read for i, it in enumerate(x["items"] or [])})
        if day not in ("2026-01-08", "2026-01-10"):
            assert (got[day].pages, got[day].truncated, got[day].mismatch) == (len(read), truncated, len({x["total"] for x in read}) > 1), day
    assert "2026-01-08" not in got and "2026-01-10" not in got


def test_only_asked_for_days_are_read(spark, tmp_path):
    folder = landed(tmp_path / "lists", LISTS)
    found = scan.pages(spark, folder, "2026-01-02", "2026-01-03", ITEM)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert {r.f.rsplit("/", 2)[1] for r in spark.read.json(folder).where("day between '2026-01-02' and '2026-01-03'").select(F.col("_metadata.file_path").alias("f")).collect()} == {"day=2026-01-02", "day=2026-01-03"}
    # what the scan opened: its files' metric counts those of two days
    found.collect()
    assert found.select("day").distinct().count() == 2


def test_a_page_landed_twice_counts_once(spark, tmp_path):
    later = {**a_page(1, more=False), "items": [{"id": "new", "n": 1}]}
    folder = landed(tmp_path / "lists", {"2026-01-01": [a_page(1), later]})
    items, days = scan.walked(scan.pages(spark, folder, "2026-01-01", "2026-01-01", ITEM))
    assert [r.item.id for r in items.collect()] == ["new"] and days.first().pages == 1 and not days.first().truncated


def test_land_and_scan_again(spark, tmp_path):
    rows = [(f"i{k}", k, date(2026, 1, 1 + k % 3)) for k in range(25)] + [("lost", 99, None)]
    frame = spark.createDataFrame(rows, "id string, n bigint, day date")
    scan.land(frame, str(tmp_path / "x"), "day", ["n"], limit=4)
    items, days = scan.walked(scan.pages(spark, str(tmp_path / "x"), "2026-01-01", "2026-01-31", ITEM))
    for k in range(3):
        mine = [r[0] for r in rows if r[2] == date(2026, 1, 1 + k)]
        got = sorted(items.where(F.col("day") == date(2026, 1, 1 + k)).collect(), key=lambda r: (r.page, r.place))
        assert [r.item.id for r in got] == mine and [(r.page, r.place) for r in got] == [(i // 4 + 1, i % 4) for i in range(len(mine))]
    assert not any(r.truncated or r.mismatch for r in days.collect())


def test_posts(spark, tmp_path):
    base = {"communityId": "AB", "communityName": "Ab!", "postTitle": "  a   title ", "postUrl": "https://x.com/1", "readCount": 5}
    new = {"communityId": "NEW1", "communityName": "", "postTitle": "other title", "postUrl": "https://x.com/2", "postContent": "c" * 200, "postDatetime": "2026-01-01T03:04:05Z", "targetDate": "2026-01-01"}
    items = [base, {**base, "postTitle": "same url again"}, {**base, "postUrl": "https://x.com/3", "readCount": None, "upvoteCount": 2}, new, {**base, "communityId": "no code", "postUrl": "https://x.com/4"}, {**base, "postTitle": "abc", "postUrl": "https://x.com/5"}, {**base, "postUrl": "ftp://x"}, {**base, "communityId": None, "postUrl": "https://x.com/6"}]
    folder = landed(tmp_path / "lists", {"2026-01-01": [{"page": 1, "total": 8, "hasNext": False, "items": items}]})
    found, _ = scan.walked(scan.pages(spark, folder, "2026-01-01", "2026-01-01"))
    sources = spark.createDataFrame([("AB", "ab", "AB label", "e", "c")], "code string, source string, label string, emoji string, color string")
    got = scan.posts(found, sources, ("new1",)).orderBy("arrival").collect()
    assert [(r.source, r.title, r.url, r.views, r.likes, r.position) for r in got] == [("ab", "a title", "https://x.com/1", 5, 0, 100.0), ("ab", "a title", "https://x.com/3", 0, 2, 98.5), ("new1", "other title", "https://x.com/2", 0, 0, 100.0)]
    assert got[2].event_ts == datetime(2026, 1, 1, 12, 4, 5) and len(got[2].summary) == 131 and str(got[2].target_date) == "2026-01-01" and got[0].event_date is None
    limits = spark.createDataFrame([(m,) for m in (0, 9, 10, 25, 59)], "m int").select(scan.page_limit(F.make_timestamp(F.lit(2026), F.lit(1), F.lit(1), F.lit(3), F.col("m"), F.lit(0))).alias("l")).collect()
    assert [r.l for r in limits] == [100, 100, 99, 100, 99]


# budgets


def plain_budget(rows, cached, days, budget, per_source, costs):
    lists: dict = {}
    for source, place, pid, day in sorted(rows, key=lambda r: (r[1], r[2])):
        if day is None or days is None or day in days:
            lists.setdefault(source, []).append(pid)
    used, out = 0.0, {}
    for turn in range(per_source):
        for source in sorted(lists, key=lambda s: (s is not None, s)):
            if turn < len(lists[source]):
                pid = lists[source][turn]
                if cached.get((source, pid)):
                    out[source, pid] = (turn + 1, "cached")
                else:
                    used += costs.get(pid, 1.0)
                    out[source, pid] = (turn + 1, "resolved" if used <= budget else "left")
    return out


@pytest.mark.parametrize("budget, with_days, per_source", [(0, True, 25), (7, True, 25), (30, False, 4), (10**6, True, 3)])
def test_budget(spark, budget, with_days, per_source):
    draw = random.Random(budget)
    rows = [(draw.choice(["a", "b", "c", None, "hot", "hot", "hot"]), draw.randrange(40), f"p{i}", draw.choice([date(2026, 1, 1), date(2026, 1, 2), None])) for i in range(150)]
    cached = {(r[0], r[2]): draw.choice(["u", None]) for r in rows[::5]}
    costs = {r[2]: float(draw.randrange(4)) for r in rows[::2]}
    frame = spark.createDataFrame([(*r, costs.get(r[2])) for r in rows], "source string, place int, pid string, event_date date, cost double")
    known = spark.createDataFrame([(*k, u) for k, u in cached.items()] * 2, "source string, pid string, url string")
    days = {date(2026, 1, 2)} if with_days else None
    found = selection.within_budget(frame, known, None if days is None else spark.createDataFrame([(d,) for d in days] * 2, "day date"), budget, per_source, "cost")
    got = {(r.source, r.pid): (r.turn, r.outcome) for r in found.collect()}
    want = plain_budget(rows, cached, days, budget, per_source, costs)
    assert got == want and found.count() == len(want)
    report = {r.source: (r.tried, r.resolved, r.status) for r in selection.source_report(found).collect()}
    for s in {k[0] for k in want}:
        mine = [o for k, (_, o) in want.items() if k[0] == s]
        done = sum(o != "left" for o in mine)
        assert report[s] == (len(mine), done, "ok" if done else "error")


def test_budget_of_nothing(spark):
    rows = spark.createDataFrame([], "source string, place int, pid string, event_date date")
    cached = spark.createDataFrame([], "source string, pid string, url string")
    assert selection.within_budget(rows, cached, None, 5).count() == 0

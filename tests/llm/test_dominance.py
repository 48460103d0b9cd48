"""Dominance counting against plain loops."""

import random
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import dominance, q_audit

ROWS = "id long, slot long, level long, weight long, n_above string, _n int, _part string, in_slot int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p", 2) for r in rows], ROWS)


def plain(rows):
    out = []
    for i, slot, level, _ in rows:
        if slot is None or level is None:
            out.append((i, None, None))
        else:
            up = [w or 0 for _, s, v, w in rows if s is not None and v is not None and s <= slot and v > level]
            out.append((i, len(up), sum(up)))
    return sorted(out, key=repr)


def counted(found):
    return sorted([(r.id, r.n_above, r.w_above) for r in found.collect()], key=repr)


@pytest.mark.parametrize("slots, levels, per_range", [(1, 300, 40), (300, 1, 40), (12, 9, 7), (200, 200, 30), (10**12, 10**12, 50), (3, 10**9, 10**6)])
def test_counts(spark, slots, levels, per_range):
    draw = random.Random(slots)
    rows = [(i, draw.randrange(slots) - slots // 2, draw.randrange(levels) - levels // 2, draw.randrange(4)) for i in range(400)]
    # a third has one slot and level, some are repeated, some lack values
    rows += [(1000 + i, 0, 0, 2) for i in range(200)] + rows[:20]
    rows += [(2000, None, 5, 1), (2001, 5, None, 1), (2002, None, None, 1), (None, 0, 1, None)]
    found = dominance.above(table_of(spark, rows), per_range=per_range)
    assert found.columns == ["id", "slot", "level", "weight", "_n", "_part", "in_slot", "n_above", "w_above"]
    assert counted(found) == plain(rows)


def test_edges(spark):
    assert dominance.above(table_of(spark, [])).count() == 0
    assert counted(dominance.above(table_of(spark, [(1, None, 3, 1), (2, 4, None, 1)]))) == [(1, None, None), (2, None, None)]
    assert counted(dominance.above(table_of(spark, [(1, 7, 3, 1)]))) == [(1, 0, 0)]


def test_tree_and_batches():
    draw = np.random.default_rng(4)
    for n, wide in ((1, 1), (255, 3), (256, 10**6), (1000, 50), (1500, 10**9)):
        levels, values = draw.integers(-wide, wide, n), draw.integers(0, 9, (n, 2))
        got = dominance.before_and_above(levels, values)
        for i in draw.integers(0, n, 60):
            assert (got[i] == values[:i][levels[:i] > levels[i]].sum(axis=0)).all()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/New_York"])
def test_columns_of_the_query(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    times = [datetime(2024, 1, 1), datetime(2024, 1, 1, 23, 59, 59, 999999), datetime(1969, 12, 31, 23), datetime(2024, 5, 1, 3), None]
    totals = [0.0, 9.994, 9.995, 1.005, -0.006, 35.0, 35.0, None, float("nan"), float("inf"), 1234.56]
    rows = [(i, times[i % 5], t) for i, t in enumerate(totals * 5)] + [(None, times[0], 99999.0)]
    spark.createDataFrame([(i, None if t is None else t.isoformat(" "), x) for i, t, x in rows], "sale_id long, t string, total double").select("sale_id", F.col("t").cast("timestamp_ntz").alias("sold_at"), "total").write.parquet(f"{tmp_path}/sales.parquet")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {(r.sale_id, r.slot, r.level, r.n_sales, r.n_rows) for r in q_audit.op11_dominance(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    slot = lambda t: None if t is None else int((t - datetime(1970, 1, 1)).total_seconds() // 86400)
    level = lambda x: None if x is None or x != x or x == float("inf") else int(np.floor(np.floor(100 * x + 0.5) / 1000))
    plain_rows = [(i, slot(t), level(x), 1 + (zlib.crc32(str(i).encode()) % 3 if i is not None else 0)) for i, t, x in rows]
    want = plain(plain_rows)
    assert got == {(i, *next((s, v) for j, s, v, _ in plain_rows if j == i), a, b) for i, a, b in want}

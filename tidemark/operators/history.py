"""Rounds of scores over time: slots, velocity, trends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds kept, minutes in which a round replaces the last, minutes after which one goes.
SLOTS, MERGE_MIN, MAX_AGE_MIN = 6, 40, 240
RECENT_H, QUIET_H = 3, 8


def push_round(slots: list[tuple], at: float, values, slot_count: int = SLOTS, merge_min: float = MERGE_MIN, max_age_min: float = MAX_AGE_MIN) -> list[tuple]:
    """Slots (start in seconds, values) with one more round: it replaces the last slot's values if that started under merge_min
    ago, and old slots go."""
    slots = list(slots)
    if slots and 0 <= at - slots[-1][0] < merge_min * 60:
        slots[-1] = (slots[-1][0], values)
    else:
        slots.append((at, values))
    return [s for s in slots if at - s[0] <= max_age_min * 60][-slot_count:]


def slot_starts(rounds: DataFrame, key: str, ts: str, merge_min: int = MERGE_MIN) -> DataFrame:
    """Rows of rounds (key, ts seconds) with slot_start: the start of the slot that each round falls in.

    Slots are anchored at their first round, so this is a fold in time order. A round that comes merge_min after the one before it opens a slot
    whatever came earlier, so each stretch between such gaps is folded on its own: a key of any length is dealt out by its
    stretches, and a task streams through sorted times with one start in hand.
    """
    distinct = rounds.select(key, ts).where(F.col(ts).isNotNull()).distinct()
    in_time = Window.partitionBy(key).orderBy(ts)
    gap = F.coalesce(F.col(ts) - F.lag(ts).over(in_time) >= merge_min * 60, F.lit(True))
    marked = distinct.withColumn("_from", F.last(F.when(gap, F.col(ts)), ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, start = None, 0
        for pdf in batches:
            starts = []
            for name, begin, at in zip(pdf[key], pdf["_from"], pdf[ts]):
                if (name, begin) != stretch or not 0 <= at - start < merge_min * 60:
                    stretch, start = (name, begin), at
                starts.append(start)
            yield pdf.assign(slot_start=starts)[[key, ts, "slot_start"]]

    kind = rounds.schema[key].dataType.simpleString()
    slots = marked.where(F.col(key).isNotNull()).repartition(key, "_from").sortWithinPartitions(key, "_from", ts).mapInPandas(fold, f"{key} {kind}, {ts} long, slot_start long")
    return rounds.join(slots, [key, ts])


def velocity(posts: DataFrame, history: DataFrame) -> DataFrame:
    """posts with velocity: rank_score less the mean of the url_key's scores in history (url_key, rank_score); unseen ones count 0,
    and without any history all velocities are 0."""
    mean = history.groupBy("url_key").agg(F.avg("rank_score").alias("_mean"))
    rounds = history.limit(1).agg(F.count(F.lit(1)).alias("_any"))
    out = posts.join(mean, "url_key", "left")
    return out.withColumn("velocity", F.when(rounds.scalar() == 0, 0.0).otherwise(F.col("rank_score") - F.coalesce("_mean", F.lit(0.0)))).drop("_mean")


def status(n: Column, sources: Column, before_n: Column, before_sources: Column, recent: Column, total: Column, since_h: Column, last_h: Column, timed: Column) -> Column:
    """new, rising, quiet or steady: the first rule that holds, in that order.

    n and before_n are the posts in the last round and three rounds earlier (null without so many rounds), recent those
    of the last three hours; since_h and last_h hours since the second and the last post.
    """
    grown = n - before_n
    rising = (grown >= 3) | ((grown >= 2) & (before_n > 0) & (n / before_n >= 1.5)) | (sources - before_sources >= 2)
    return (
        F.when(since_h <= RECENT_H, "new")
        .when(F.coalesce(rising, F.lit(False)), "rising")
        .when((recent >= 2) & (recent / total >= 0.25), "rising")
        .when((last_h > QUIET_H) & (timed >= 2), "quiet")
        .otherwise("steady")
    )


def status_reason(n: Column, sources: Column, before_n: Column, before_sources: Column, recent: Column, total: Column, since_h: Column, last_h: Column, timed: Column) -> Column:
    """Why a status is what it is, as a sentence; '' for steady. Arguments are those of status(), and so is the order of the rules."""
    grown = n - before_n
    rising = (grown >= 3) | ((grown >= 2) & (before_n > 0) & (n / before_n >= 1.5)) | (sources - before_sources >= 2)
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    # fixed values: the sentences
    return (
        F.when(since_h <= RECENT_H, text(f"최근 {RECENT_H}시간 안에 여러 곳에 올라오기 시작"))
        .when(F.coalesce(rising, F.lit(False)), text("최근 3번 갱신 동안 글 ", before_n, "→", n, "개, 커뮤니티 ", before_sources, "→", sources, "곳"))
        .when((recent >= 2) & (recent / total >= 0.25), text(f"최근 {RECENT_H}시간에 새 글 ", recent, "개"))
        .when((last_h > QUIET_H) & (timed >= 2), text("마지막 글 ", F.floor(last_h).cast("int"), "시간 전"))
        .otherwise("")
    )


def collapse_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds (round_no, url_key) without those whose set of keys is that of the round before."""
    sets = rounds.groupBy("round_no").agg(F.count_distinct("url_key").alias("_n"), F.bit_xor(F.xxhash64("url_key")).alias("_h"), F.sum(F.xxhash64("url_key", F.lit(7)).cast("decimal(38,0)")).alias("_s"))
    sign = F.struct("_n", "_h", "_s")
    kept = sets.withColumn("_before", F.lag(sign).over(Window.orderBy("round_no"))).where(F.col("_before").isNull() | (F.col("_before") != sign))
    return rounds.join(kept.select("round_no"), "round_no", "left_semi")


def rising_keys(events: DataFrame, key: str, part: str, ts: str, hours: int = 1) -> DataFrame:
    """Rows (key, round, n, parts, before_n, before_parts, trend) for hourly rounds: posts and parts of a round against those
    three rows of the key earlier."""
    rounds = events.groupBy(key, F.date_trunc("HOUR", ts).alias("round")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(part).alias("parts"))
    by = Window.partitionBy(key).orderBy("round")
    out = rounds.withColumn("before_n", F.lag("n", 3).over(by)).withColumn("before_parts", F.lag("parts", 3).over(by))
    grown = F.col("n") - F.col("before_n")
    rising = (grown >= 3) | ((grown >= 2) & (F.col("before_n") > 0) & (F.col("n") / F.col("before_n") >= 1.5)) | (F.col("parts") - F.col("before_parts") >= 2)
    return out.withColumn("trend", F.when(F.coalesce(rising, F.lit(False)), "rising").otherwise("steady"))


def fold_history(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    """push_round() over frames of (ts seconds, url_key, rank_score), one round a frame."""
    slots: list[tuple] = []
    for pdf in batches:
        slots = push_round(slots, float(pdf["ts"].iloc[0]), dict(zip(pdf["url_key"], pdf["rank_score"])))
    return slots

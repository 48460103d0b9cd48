"""Diversified selections. Limits here are the feature: reports of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE, MOST, A_SOURCE, FALLBACK = 10, 20, 4, 10


def first_per_source(posts: DataFrame, most: int = MOST, order: str = "rank") -> DataFrame:
    """Best post of each source, the first most of them."""
    best = F.row_number().over(Window.partitionBy("source").orderBy(order, "arrival"))
    return posts.withColumn("_i", best).where("_i = 1").drop("_i").orderBy(order, "arrival").limit(most)


def diversified_topk(posts: DataFrame, base: int = BASE, most: int = MOST, a_source: int = A_SOURCE, fallback: int = FALLBACK) -> DataFrame:
    """Greedy selection, exactly: base posts by rank and then up to most by score, a_source of a source at most, then up to
    most without that limit; column pick counts from 1.

    Candidates are those with is_candidate; all posts if under fallback are. Each step needs only the first few posts
    of each source, so windows by source and two small global orders do.
    """
    some = posts.where("is_candidate").limit(fallback).agg(F.count(F.lit(1)).alias("_some"))
    pool = posts.where(F.col("is_candidate") | (some.scalar() < fallback))
    by = Window.partitionBy("source")
    rank, score = [F.asc("rank"), F.asc("arrival")], [F.desc("rank_score"), F.asc("rank"), F.asc("arrival")]
    places = pool.withColumn("_by_rank", F.row_number().over(by.orderBy(*rank)))
    # the step by rank takes a prefix of its order; who is in it follows from the global place among those allowed
    allowed = places.withColumn("_one", F.col("_by_rank") <= a_source)
    one = allowed.where("_one").orderBy(*rank).limit(base).withColumn("_step", F.lit(1))
    taken = one.select("arrival").withColumnRenamed("arrival", "_taken")
    per = one.groupBy("source").agg(F.count(F.lit(1)).alias("_had")).withColumnRenamed("source", "_s")
    rest = pool.join(F.broadcast(taken), F.col("arrival") == F.col("_taken"), "left_anti").join(F.broadcast(per), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    two = rest.withColumn("_by_score", F.row_number().over(by.orderBy(*score))).where(F.col("_by_score") + F.coalesce("_had", F.lit(0)) <= a_source)
    two = two.orderBy(*score).limit(most).withColumn("_step", F.lit(2))
    three = rest.orderBy(*score).limit(2 * most).withColumn("_step", F.lit(3))
    columns = [*posts.columns, "_step"]
    every = one.select(*columns).unionByName(two.select(*columns)).unionByName(three.select(*columns))
    once = every.withColumn("_i", F.row_number().over(Window.partitionBy("arrival").orderBy("_step"))).where("_i = 1")
    order = Window.orderBy("_step", F.when(F.col("_step") == 1, F.col("rank")), F.desc("rank_score"), "rank", "arrival")
    return once.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= most).drop("_i", "_step")


def interleaved(posts: DataFrame) -> DataFrame:
    """posts with turn: all sources' first posts, then all second ones, and so on."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("arrival"))
    return posts.withColumn("turn", place)


#: Rows of a source that may be resolved.
PER_SOURCE = 25


def within_budget(rows: DataFrame, cached: DataFrame, days: DataFrame | None, budget: float, per_source: int = PER_SOURCE, cost: str | None = None) -> DataFrame:
    """Rows of the sources' lists that may be resolved, with turn and outcome: cached, resolved or left.

    rows are (source, place, pid, event_date, ...), cached (source, pid, url), days (day). Only rows of those days, and those without
    a date, count; of them the per_source first of a source, in turns: all sources' first rows, then all second ones. Cached rows cost
    nothing (url is theirs); the others are resolved while their costs (column cost, or 1 each; null 1) so far fit the budget, so that each
    source keeps its head. The days filter stands below the join with cached. Null sources are one source; ties of place go by pid.

    The prefix over all turns is a sum over earlier turns (a row a turn) and a running one within each, so no task gets all rows.
    """
    kept = rows if days is None else rows.join(days.select(F.col("day").alias("_day")).distinct(), F.col("event_date") == F.col("_day"), "left").where(F.col("event_date").isNull() | F.col("_day").isNotNull()).drop("_day")
    turns = kept.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("place", "pid"))).where(F.col("turn") <= per_source)
    known = cached.where("url IS NOT NULL").select(F.col("source").alias("_s"), F.col("pid").alias("_p"), "url").dropDuplicates(["_s", "_p"])
    priced = turns.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pid") == F.col("_p")), "left").drop("_s", "_p")
    priced = priced.withColumn("_cost", F.when(F.col("url").isNotNull(), 0.0).otherwise(F.lit(1.0) if cost is None else F.coalesce(F.col(cost).cast("double"), F.lit(1.0))))
    so_far = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = priced.groupBy("turn").agg(F.sum("_cost").alias("_all")).select("turn", F.coalesce(F.sum("_all").over(so_far), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy("turn").orderBy("source", "place", "pid").rowsBetween(Window.unboundedPreceding, 0)
    summed = priced.withColumn("_within", F.sum("_cost").over(inside)).join(before, "turn")
    outcome = F.when(F.col("url").isNotNull(), "cached").when(F.col("_before") + F.col("_within") <= budget, "resolved").otherwise("left")
    return summed.withColumn("outcome", outcome).drop("_cost", "_before", "_within")


def source_report(chosen: DataFrame) -> DataFrame:
    """(source, tried, resolved, newest, status) of within_budget()'s rows: ok if any row of the source has its URL or may be resolved."""
    got = F.col("outcome") != "left"
    found = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("tried"), F.count_if(got).alias("resolved"), F.max("event_date").alias("newest"))
    return found.withColumn("status", F.when(F.col("resolved") > 0, "ok").otherwise("error"))

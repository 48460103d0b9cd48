"""Scores and ranks within and across sources.

Posts have source, arrival (a number that breaks every tie, as tables have no order), views, likes, comments,
age_days and position (position score). All windows are by source; the cap leaves at most cap rows a source
for the one global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import tenths
from tidemark.session import cut

#: Fixed values of the scoring rules.
STEP, CAP, PENALTY, HALF_LIFE_H, DECAY_DAYS, MAX_AGE_DAYS = 1.5, 25, 0.6, 24.0, 90.0, 90.0
VIEWS_A_COMMENT = VIEWS_A_LIKE = 100.0
UNKNOWN_VIEWS = 1000.0


def position_score(source: str = "source", arrival: str = "arrival") -> Column:
    """100 for the first post of a source, less STEP for each place, 0 at least."""
    place = F.row_number().over(Window.partitionBy(source).orderBy(arrival)) - 1
    return F.greatest(F.lit(0.0), F.lit(100.0) - STEP * place)


#: Buckets of values: so many for each factor of e.
BUCKETS = 64


def upper_median_by_rank(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Upper medians (element n // 2 of the sorted values) of each key: counts by value, then by bucket, then the one bucket that has it.

    Equal values are counted before the shuffle; of a key a task sorts its buckets, some thousands whatever the rows, and the different
    values of one bucket. Null values don't count, null keys are keys. No keys: one row over all, none without values.
    """
    v, own = F.col("_v"), [f"_k{i}" for i in range(len(keys))] or ["_k"]
    named = [F.col(k).alias(o) for k, o in zip(keys, own)] or [F.lit(1).alias("_k")]
    counts = df.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("_v")).groupBy(*own, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_b", F.floor(F.signum(v) * F.log1p(F.abs(v)) * BUCKETS))
    buckets = counts.groupBy(*own, "_b").agg(F.sum("_c").alias("_c"))
    by = Window.partitionBy(*own)
    upto = F.sum("_c").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    found = buckets.select(*own, "_b", (upto - F.col("_c")).alias("_before"), upto.alias("_upto"), F.floor(F.sum("_c").over(by) / 2).alias("_at")).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_upto")))
    hit = found.select(*[F.col(o).alias(f"{o}_") for o in own], F.col("_b").alias("_b_"), (F.col("_at") - F.col("_before")).alias("_rest"))
    same = F.col("_b") == F.col("_b_")
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}_"))
    inside = counts.join(hit, same).select(*own, "_v", "_rest", F.sum("_c").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    median = inside.where(F.col("_upto") > F.col("_rest")).groupBy(*own).agg(F.min("_v").alias(name))
    return median.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], name)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rows' numbers from 1 in an order of all rows, which should have no ties.

    Rows are range-partitioned by the order and numbered within each range after those of the ranges before, so no task sorts more than a
    range; the rows go to a checkpoint, as their ranges must not change between counting and numbering.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_i", inside).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_range", "_i", "_before")


def _log_share(value: Column, most: Column) -> Column:
    return F.when(value > 0, F.log1p(value) / F.log1p(most) * 100).otherwise(0.0)


def scored(posts: DataFrame) -> DataFrame:
    """posts up to MAX_AGE_DAYS old with rank_score, to one decimal; the best of each source has a tenth more."""
    by = Window.partitionBy("source")
    most = {c: F.greatest(F.lit(1), F.max(c).over(by)) for c in ("views", "likes", "comments")}
    viewed = F.coalesce(F.max("views").over(by) > 0, F.lit(False))
    engagement = _log_share(F.col("views"), most["views"]) * 0.60 + _log_share(F.col("likes"), F.when(viewed, most["likes"])) * 0.25 + _log_share(F.col("comments"), most["comments"]) * 0.15
    base = F.when(viewed, F.col("position") * 0.35 + engagement * 0.65).otherwise(F.col("position"))
    first = tenths(base * F.exp(-F.col("age_days") / DECAY_DAYS))
    best = F.row_number().over(by.orderBy(F.desc("rank_score"), "arrival")) == 1
    return (
        posts.where(F.col("age_days") <= MAX_AGE_DAYS).withColumn("rank_score", first)
        .withColumn("rank_score", F.when(best, tenths(F.col("rank_score") * 1.10)).otherwise(F.col("rank_score")))
    )


def estimated_views(posts: DataFrame) -> DataFrame:
    """posts with estimate: views, or 100 a comment, or 100 a like, or the source's upper median (that of all, 1000) by position."""
    raw = F.when(F.col("views") > 0, F.col("views").cast("double")).when(F.col("comments") > 0, VIEWS_A_COMMENT * F.col("comments")).when(F.col("likes") > 0, VIEWS_A_LIKE * F.col("likes"))
    known = posts.withColumn("_raw", raw)
    own = upper_median_by_rank(known, ["source"], "_raw", "_own").withColumnRenamed("source", "_source")
    overall = upper_median_by_rank(known, [], "_raw", "_overall")
    base = F.coalesce(F.col("_own"), overall.scalar(), F.lit(UNKNOWN_VIEWS))
    out = known.join(own, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.withColumn("estimate", F.coalesce("_raw", base * F.greatest(F.lit(0.2), F.col("position") / 100) * 1.5)).drop("_raw", "_own", "_source")


def popularity(estimate: Column, age_days: Column) -> Column:
    """log10 of one more than the estimated views, halved each day."""
    return F.log10(1 + estimate * F.pow(F.lit(0.5), age_days * 24 / HALF_LIFE_H))


def rank_balanced(posts: DataFrame, cap: int = CAP, penalty: float = PENALTY) -> DataFrame:
    """scored() posts with popularity, and rank from 1: by popularity less penalty for each better post of the source, of which cap stay."""
    pop = estimated_views(scored(posts)).withColumn("popularity", popularity(F.col("estimate"), F.col("age_days")))
    order = [F.desc("popularity"), F.desc("rank_score"), F.asc("arrival")]
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    top = pop.withColumn("_k", place).where(F.col("_k") <= cap).withColumn("balanced", F.col("popularity") - penalty * (F.col("_k") - 1))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("balanced"), *order))).drop("_k", "estimate")


def community_context(posts: DataFrame) -> DataFrame:
    """posts with place (by rank_score within the source) and comment_share (share of the source's posts with no more comments)."""
    by = Window.partitionBy("source")
    return posts.withColumn("place", F.row_number().over(by.orderBy(F.desc("rank_score"), "arrival"))).withColumn("comment_share", F.cume_dist().over(by.orderBy("comments")))

"""Counts by flag, caps and orderly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Category -> words that mark it; author's own lists, in priority order.
CATEGORIES = {
    "food": ("cook", "recipe", "맛집", "요리"),
    "game": ("game", "steam", "게임", "배그"),
    "sport": ("goal", "league", "축구", "야구"),
    "money": ("stock", "price", "주식", "코인"),
    "tech": ("phone", "laptop", "폰", "노트북"),
    "film": ("movie", "drama", "영화", "드라마"),
    "trip": ("travel", "hotel", "여행", "항공"),
    "car": ("engine", "suv", "자동차", "운전"),
}
#: Compounds that hold a category's word without meaning it.
FALSE_HITS = ("price of fame", "게임 오버", "영화로움")


def category_flags(text: Column, categories: dict[str, tuple[str, ...]] = CATEGORIES, false_hits: tuple[str, ...] = FALSE_HITS) -> dict[str, Column]:
    """Flag of each category: whether the lower-case text, without the false compounds, holds one of its words."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for x in false_hits:
        plain = F.replace(plain, F.lit(x), F.lit(" "))
    return {name: plain.rlike("|".join(words)) for name, words in categories.items()}


def label(flags: dict[str, Column]) -> Column:
    """First category whose flag is set, else general."""
    out = F.lit("general")
    for name, flag in reversed(flags.items()):
        out = F.when(flag, name).otherwise(out)
    return out


def capped_size(df: DataFrame, group: str, cap: int = 25) -> DataFrame:
    """One row: groups, and rows counted up to cap a group."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.least("_n", F.lit(cap))).alias("capped"))


def spread_heat(df: DataFrame, group: str, source: str, score: str) -> DataFrame:
    """(group, n, sources, spread): best scores of the sources / 100, and half the log of each source's further posts."""
    per = df.groupBy(group, source).agg(F.max(score).alias("_best"), F.count(F.lit(1)).alias("_n"))
    spread = F.sum(F.greatest(F.col("_best"), F.lit(0.0))) / 100 + F.sum(0.5 * F.log1p(F.col("_n") - 1))
    return per.groupBy(group).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("sources"), spread.alias("spread"))


def heat(spread: Column, fresh: Column, kind: Column, is_quiet: Column) -> Column:
    """Spread by freshness (unknown: one half), less for reposts (which have none), topics and quiet ones."""
    live = spread * (0.7 + 0.6 * F.coalesce(fresh, F.lit(0.5)))
    return F.when(kind == "repost", spread * 0.8).when(kind == "topic", live * 0.75).otherwise(live) * F.when(is_quiet, 0.8).otherwise(1.0)


def second_earliest(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, n, first, since, last): since is the second earliest time, null with one row. Null times go.

    Two rows a key are left before the shuffle of the second one, so no key fills an array with its times.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    known = df.where(F.col(ts).isNotNull())
    two = known.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), place.alias("_i")).where("_i <= 2")
    second = two.groupBy("_k").agg(F.max(F.when(F.col("_i") == 2, F.col("_t"))).alias("since"))
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return counts.join(second, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "n", "first", "since", "last")

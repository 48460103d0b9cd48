"""Mixing sources to target weights, with DataFrame functions only.

Each source has a target number of words: a share of the budget by weight, never above max_repeat times
the source's own words, with what a source can't use reshared by weight. Its rate is target / own words; a
document is emitted floor(rate) times, and once more when a hash of its id and a seed, as a number in
[0, 1), lies below the fraction. So the choice needs no state, and reruns and retried tasks agree. Of SEEDS seeds each source
uses the one whose draw comes nearest its target, since a single draw misses by much where a source has few documents.

The text is scanned twice (sizes, then copies) and never shuffled: ids and sizes go to a checkpoint, one row a source is
aggregated from it after partial sums, so a source with a third of all rows costs no more than any other, and the
rates are broadcast if a count shows that they're few. The targets' window runs over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import aside, back, same, small
from tidemark.session import cut

#: Draws of which each source takes the nearest.
SEEDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, source: str = "source", size: str = "size",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, max_repeat: float = 2.0,
) -> DataFrame:
    """(source, source_size, target, rate) for each source.

    Sources in code point order, null last, have the weights in turn. The targets are min(max_repeat * own,
    level * weight) for the level at which they add up to budget * all words: sources by own / weight are
    capped from the lowest up, and the first that its share doesn't fill fixes the level of all after it.
    No sources give no rows; a source without words has target and rate 0.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    fill = Window.orderBy("_ratio", F.col(source).asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(max_repeat))
    return (
        sized.groupBy(source).agg(F.sum(size).alias("source_size"))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("_ratio", cap / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("_weight").over(after))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col(source).isNull(), source, "_level"))).over(everything)["_level"])
        .withColumn("target", F.least(cap, F.coalesce(F.col("_level") * F.col("_weight"), cap)))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select(source, "source_size", "target", "rate")
    )


def chance(key: Column, seed: int | Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of key and seed."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digest = F.md5(F.concat_ws(":", seed, F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _seeds(sized: DataFrame, rates: DataFrame, seed: int, seeds: int) -> DataFrame:
    """rates with each source's seed: of seeds ones from seed on the first whose extra copies come nearest the fraction of its size."""
    fraction = F.col("rate") - F.floor("rate")
    drawn = [F.sum(F.when(chance(F.col("_id"), seed + i) < fraction, F.col("_size")).otherwise(0)).alias(f"_d{i}") for i in range(seeds)]
    sums = sized.join(small(rates.select(F.col("source").alias("_s"), "rate")), same(F.col("_source"), F.col("_s"))).groupBy("_source").agg(*drawn)
    off = [F.struct(F.abs(F.col(f"_d{i}") - fraction * F.col("source_size")).alias("off"), F.lit(seed + i).alias("seed")) for i in range(seeds)]
    return rates.join(small(cut(sums)), same(F.col("source"), F.col("_source"))).withColumn("seed", F.array_min(F.array(*off))["seed"]).select(*rates.columns, "seed")


def copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, seeds: int = SEEDS, **mix) -> DataFrame:
    """docs with size, source_size, target and copies, the times that the mix takes the document.

    Columns of docs of these names are replaced. Null text has size 0; null sources are one source; rows with
    equal ids decide alike within a source; without any words all copies are 0; an empty table gives no rows.
    """
    sized = aside(docs).withColumn("_size", words(F.col(f"in_{text}")))
    small_rows = cut(sized.select(F.col(f"in_{doc_id}").cast("string").alias("_id"), F.col(f"in_{source}").alias("_source"), "_size"))
    rates = cut(source_targets(small_rows.select(F.col("_source").alias("source"), F.col("_size").alias("size")), **mix))
    rates = small(cut(_seeds(small_rows, rates, seed, seeds)))
    whole = F.floor("rate")
    taken = (whole + (chance(F.col(f"in_{doc_id}"), F.col("seed")) < F.col("rate") - whole).cast("long")).cast("long")
    joined = sized.join(rates, same(F.col(f"in_{source}"), F.col("source")), "left")
    return back(joined, docs.columns, F.col("_size").alias("size"), F.col("source_size"), F.col("target"), taken.alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document copies times, with a copy number from 1 in the column copy_no."""
    found = copies(aside(docs), **{k: f"in_{how.get(k, k)}" for k in ("doc_id", "source", "text")}, **{k: v for k, v in how.items() if k not in ("doc_id", "source", "text")})
    each = found.where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return back(each, docs.columns, F.col("copy_no"))

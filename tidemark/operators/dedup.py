"""Dedup by priority, carry-forward, filling, and the fingerprint of a relation."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import is_http
from tidemark.session import cut

#: Priority of a post's path; a stalled main source comes last. Fixed values.
VIA_ORDER = {"direct": 1, "issuelink": 2}
STALLED = 3


def priority(via: Column, stalled: Column) -> Column:
    out = F.when(F.coalesce(stalled, F.lit(False)), STALLED).otherwise(0)
    known = F.lit(2)
    for name, value in VIA_ORDER.items():
        known = F.when(via == name, value).otherwise(known)
    return F.when(via.isNull(), out).otherwise(known)


def dedup(posts: DataFrame) -> DataFrame:
    """Posts kept when all are tried by (priority, arrival): one goes if a kept post has its url_key, or if the first kept post of
    its title_key came by another path.

    posts have url_key, title_key ('' never matches), via (null: the main source), priority and arrival, and url if links that
    aren't http shall go. A later post of a url is tried where an earlier one went by its title. Each round settles the first
    open post of every url and all posts of titles whose path is known; most tables take one or two rounds.
    """
    order = ["priority", "arrival"]
    by_url, by_title = Window.partitionBy("url_key"), Window.partitionBy("_t")
    start = posts.where(is_http(F.col("url"))) if "url" in posts.columns else posts
    # texts are compared by digests; a post without a title_key has a title of its own, so they don't gather in one task
    title = F.when(F.col("title_key") != "", F.md5("title_key")).otherwise(F.concat_ws("#", F.lit(""), F.col("arrival").cast("string"), "url_key"))
    path = F.coalesce("via", F.lit("main"))
    left = start.withColumns({"_t": title, "_via": path, "_path": F.lit(None).cast("string")})
    kept = None
    while True:
        first = F.row_number().over(by_url.orderBy(*order)) == 1
        named = left.withColumn("_first", first)
        # the first open post of a title that is also the first of its url settles the title's path
        head = F.row_number().over(by_title.orderBy(*order)) == 1
        named = named.withColumn("_head", head & F.col("_first") & F.col("_path").isNull())
        named = named.withColumn("_path", F.coalesce("_path", F.max(F.when(F.col("_head"), F.col("_via"))).over(by_title)))
        named = named.withColumn("_keep", F.col("_first") & F.coalesce(F.col("_path") == F.col("_via"), F.lit(False)))
        settled = cut(named.withColumn("_taken", F.max("_keep").over(by_url)))
        chosen = settled.where("_keep").select(*posts.columns)
        kept = chosen if kept is None else kept.unionByName(chosen)
        left = settled.where(~F.col("_taken") & F.coalesce(F.col("_path") == F.col("_via"), F.lit(True))).select(*posts.columns, "_t", "_via", "_path")
        if left.isEmpty():
            return kept


def carry_forward(previous: DataFrame, current: DataFrame, complete: bool, cap: int = 25, window: Column | None = None) -> DataFrame:
    """Previous posts of sources that came short: none now, or under cap if the round is incomplete; marked kept.

    Posts whose url_key, or title_key unless '', is among the current ones are left out, as are previous-day posts
    (prev_day) and, where window (an array of days) is given, those listed on no day of it. Their position scores start
    anew, in order of arrival.
    """
    if window is not None:
        previous = previous.where(F.coalesce(F.array_contains(window, F.col("listed")), F.lit(False)))
    counts = current.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    short = previous.select("source").distinct().join(counts, "source", "left").where(F.coalesce("_n", F.lit(0)) < (1 if complete else cap))
    titles = current.where("title_key <> ''").select("title_key").distinct()
    left = (
        previous.where("NOT coalesce(prev_day, false)").join(short.select("source"), "source", "left_semi")
        .join(current.select("url_key").distinct(), "url_key", "left_anti").join(titles, "title_key", "left_anti")
    )
    once = left.withColumn("_i", F.row_number().over(Window.partitionBy("url_key").orderBy("arrival"))).where("_i = 1")
    place = F.row_number().over(Window.partitionBy("source").orderBy("arrival")) - 1
    return once.drop("_i").withColumn("kept", F.lit(True)).withColumn("position", F.greatest(F.lit(0.0), 100 - 1.5 * place))


def capacity_fill(ranked: DataFrame, previous: DataFrame, cap: int = 25) -> DataFrame:
    """Previous-day posts for the places that sources have left under cap, by arrival, ranked after all of ranked."""
    counts = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    fresh = previous.join(ranked.select("url_key").distinct(), "url_key", "left_anti")
    once = fresh.withColumn("_i", F.row_number().over(Window.partitionBy("url_key").orderBy("arrival"))).where("_i = 1").drop("_i")
    place = F.row_number().over(Window.partitionBy("source").orderBy("arrival"))
    fits = once.withColumn("_p", place).join(counts, "source", "left").where(F.col("_p") <= cap - F.coalesce("_n", F.lit(0)))
    base = ranked.agg(F.count(F.lit(1)).alias("_base"))
    return fits.withColumn("rank", base.scalar() + F.row_number().over(Window.orderBy("arrival"))).drop("_p", "_n")


def _run_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (prefix, digest), whole prefixes -> (prefix, digest of its digests, one a line). Holds a batch at most."""
    at, made = None, None
    done: list[tuple[str, str]] = []
    for batch in batches:
        prefixes, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        begin = 0
        while begin < len(prefixes):
            end = bisect_right(prefixes, prefixes[begin], begin)
            if prefixes[begin] != at:
                if made is not None:
                    done.append((at, made.hexdigest()))
                at, made = prefixes[begin], hashlib.sha1()
            else:
                made.update(b"\n")
            made.update("\n".join(digests[begin:end]).encode())
            begin = end
    if made is not None:
        done.append((at, made.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["_p", "_d"])


def relation_signature(df: DataFrame, line: Column) -> DataFrame:
    """One row, signature: a digest of all lines that doesn't depend on their order, but on how often each is there; of no rows that of none.

    Digests of lines are sorted and digested by their first two hexadecimal digits, then the digests of those 256 groups in order. A
    group's digests are sorted by Spark and digested as they stream by, so no task, array or the driver holds them. Null lines are as no lines.
    """
    lines = df.select(F.sha1(line).alias("_h")).where("_h IS NOT NULL").select(F.substring("_h", 1, 2).alias("_p"), "_h")
    parts = lines.repartition("_p").sortWithinPartitions("_p", "_h").mapInArrow(_run_digests, "_p string, _d string")
    return parts.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), "\n")).alias("signature"))

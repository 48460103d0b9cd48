"""State documents of a feed: JSON of one version, read by types, checked, and taken apart into tables; and written again.

A document that isn't JSON, or has another type where a value belongs, loses that value and no other; rows that can't be used go. A document
of another version is as none. That nothing could be read where something is there is an error: going on from nothing would
delete what the last run knew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.urls import is_http
from tidemark.operators.health import PATHS
from tidemark.operators.history import SLOTS
from tidemark.session import cut

# Fixed values of the format.
VERSION, CACHE_ROWS = 1, 1000
STATUSES, HEALTH = ("ok", "partial", "stale", "stale-source"), ("ok", "degraded", "missing", "blocked", "suspended")
POST = "source string, title string, url string, summary string, views bigint, likes bigint, comments bigint, rank int, rank_score double, date string, target_date string, via string, kept boolean, prev_day boolean"
POSTS = f"array<struct<{POST.replace(' ', ':').replace(',:', ',')}>>"
STATE = (
    f"version int, post_score_history array<map<string,double>>, post_score_times array<string>, posts {POSTS}, crawl_count int, "
    "last_updated string, status string, snapshot string, source_health map<string,struct<status:string,last_update:string,last_new:string,n:bigint,since:string,via:array<string>,note:string>>, "
    f"prev_day struct<date:string,done:string,posts:{POSTS}>, issuelink struct<at:string,sources:array<string>,cache:map<string,string>>"
)


class StateUnreadable(ValueError):
    """There are state documents, but none is JSON."""


def load(spark: SparkSession, path: str) -> DataFrame:
    """The state document of path as one row, or none: if path doesn't exist, or the document has another version.

    Of several documents the one with the latest last_updated counts (documents without it first, then by text). Raises StateUnreadable if
    path has text but no JSON object.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], STATE)
    return parsed(spark.read.text(path, wholetext=True))


def parsed(texts: DataFrame) -> DataFrame:
    """As load(), of a table of documents (value)."""
    spark = texts.sparkSession
    read = texts.where(F.trim("value") != "").select("value", F.from_json("value", f"{STATE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("s"), F.get_json_object("value", "$.version").alias("_version"))
    read = cut(read)
    whole = read.where(F.col("_version").isNotNull() | F.col("s._bad").isNull())
    if read.limit(1).count() and not whole.limit(1).count():
        raise StateUnreadable("no state document is JSON")
    current = whole.where(F.col("_version") == str(VERSION)).orderBy(F.col("s.last_updated").desc_nulls_last(), "value").limit(1)
    fields = [f.name for f in spark.createDataFrame([], STATE).schema]
    return current.select(*[F.col(f"s.{f}").alias(f) for f in fields])


def _usable(p: Column) -> Column:
    return is_http(p["url"]) & (F.coalesce(p["title"], F.lit("")) != "") & (F.coalesce(p["source"], F.lit("")) != "")


def posts(state: DataFrame) -> DataFrame:
    """Posts with source, title and an http URL, in order (arrival from 0)."""
    return state.select(F.posexplode(F.filter(F.coalesce("posts", F.array().cast(POSTS)), lambda p: F.coalesce(_usable(p), F.lit(False)))).alias("arrival", "p")).select("arrival", "p.*")


def history(state: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(round_no, started, url_key, rank_score): the last slots rounds, from 0. Times belong to the last rounds; rounds before and
    times that are none are unknown (null)."""
    rounds = F.filter("post_score_history", lambda m: m.isNotNull())
    last = lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - slots + 1), slots)
    framed = state.select(F.when(F.size(rounds) > 0, last(rounds)).alias("r"), F.coalesce("post_score_times", F.array().cast("array<string>")).alias("t")).where("r IS NOT NULL")
    each = framed.select(F.posexplode("r").alias("round_no", "m"), F.size("r").alias("_n"), "t")
    at = F.try_element_at("t", F.col("round_no") - F.col("_n") + F.size("t") + 1)
    started = F.when(F.col("round_no") - F.col("_n") + F.size("t") + 1 >= 1, at.try_cast("timestamp"))
    return each.select("round_no", started.alias("started"), F.explode("m").alias("url_key", "rank_score")).where("rank_score IS NOT NULL")


def health(state: DataFrame) -> DataFrame:
    """(source, status, last_update, last_new, n, since, via, note): entries of a known status; n is 0 at least, times that are none are
    null, via has the known paths in their order."""
    e = state.select(F.explode("source_health").alias("source", "e")).where(F.col("e.status").isin(*HEALTH))
    via = F.filter(F.array(*map(F.lit, PATHS)), lambda p: F.array_contains(F.coalesce("e.via", F.array().cast("array<string>")), p))
    time = lambda c: F.col(f"e.{c}").try_cast("timestamp").alias(c)
    return e.select("source", "e.status", time("last_update"), time("last_new"), F.greatest(F.lit(0).cast("long"), F.coalesce("e.n", F.lit(0).cast("long"))).alias("n"), time("since"), via.alias("via"), F.nullif(F.col("e.note"), F.lit("")).alias("note"))


def previous_day(state: DataFrame) -> DataFrame:
    """(date, done, arrival, and a post's columns) of the day before; none if its date is missing."""
    day = state.where("prev_day.date IS NOT NULL").select("prev_day.date", "prev_day.done", F.coalesce("prev_day.posts", F.array().cast(POSTS)).alias("posts"))
    kept = day.select(F.col("date").alias("_date"), "done", F.posexplode(F.filter("posts", lambda p: F.coalesce(_usable(p), F.lit(False)))).alias("arrival", "p"))
    return kept.select(F.col("_date").alias("saved_of"), "done", "arrival", "p.*")


def cache(state: DataFrame, most: int = CACHE_ROWS) -> DataFrame:
    """(seq, key, url) of the resolved URLs, the most last ones; entries without a URL go."""
    entries = F.filter(F.map_entries("issuelink.cache"), lambda e: e["value"].isNotNull())
    return state.select(F.posexplode(F.slice(entries, F.greatest(F.lit(1), F.size(entries) - most + 1), most)).alias("seq", "e")).select("seq", F.col("e.key").alias("key"), F.col("e.value").alias("url"))


def status(state: DataFrame) -> DataFrame:
    """One row (status, crawl_count, last_updated): a status that isn't known is ok where there are posts, else idle."""
    has = F.exists(F.coalesce("posts", F.array().cast(POSTS)), lambda p: F.coalesce(_usable(p), F.lit(False)))
    return state.select(F.when(F.col("status").isin(*STATUSES), F.col("status")).when(has, "ok").otherwise("idle").alias("status"), F.coalesce("crawl_count", F.lit(0)).alias("crawl_count"), F.col("last_updated").try_cast("timestamp").alias("last_updated"))


def exported(posts: DataFrame, rounds: DataFrame, health: DataFrame, cache: DataFrame, meta: dict[str, str | int | None]) -> DataFrame:
    """One row (value): the state document of these tables, which load() reads back.

    posts (arrival, columns of POST), rounds (round_no, started, url_key, rank_score), health as health() gives it, cache (seq, key, url), of which the
    CACHE_ROWS last go; meta has status, crawl_count, last_updated, snapshot. What a document holds is a site's own posts and sources, so it has one row.
    """
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    fields = [f.split()[0] for f in POST.split(", ")]
    listed = posts.agg(F.transform(F.array_sort(F.collect_list(F.struct("arrival", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("posts"))
    each = rounds.groupBy("round_no").agg(F.first(iso("started")).alias("t"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("url_key", "rank_score")))).alias("m"))
    folded = each.agg(F.array_sort(F.collect_list(F.struct("round_no", "t"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("round_no", "m"))).alias("b")).select(
        F.transform("a", lambda x: F.element_at("b", x["round_no"])).alias("post_score_history"), F.transform("a", lambda x: x["t"]).alias("post_score_times"))
    known = health.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.struct("status", iso("last_update").alias("last_update"), iso("last_new").alias("last_new"), "n", iso("since").alias("since"), "via", "note").alias("e"))))).alias("source_health"))
    newest = cache.orderBy(F.desc("seq")).limit(CACHE_ROWS).agg(F.array_sort(F.collect_list(F.struct("seq", "key", "url"))).alias("c")).select(F.map_from_entries(F.transform("c", lambda x: F.struct(x["key"], x["url"]))).alias("cache"))
    one = listed.join(folded).join(known).join(newest)
    extra = [F.lit(meta.get(c)).alias(c) for c in ("status", "crawl_count", "last_updated", "snapshot")]
    return one.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), "post_score_history", "post_score_times", "posts", *extra, "source_health", F.struct("cache").alias("issuelink"))).alias("value"))

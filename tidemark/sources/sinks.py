"""What goes out: public rows, reports, feeds, logs with limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import is_http

POST_FIELDS = ("source", "title", "url", "views", "likes", "comments", "rank", "rank_score")
LOG_ROWS, LOG_BYTES, REPORT_POSTS, FEED_ITEMS = 72, 30_000, 50, 30


def public_rows(posts: DataFrame, fields: tuple[str, ...] = POST_FIELDS) -> DataFrame:
    """Only the public columns that there are, and only rows with http links."""
    return posts.where(is_http(F.col("url"))).select(*[c for c in fields if c in posts.columns])


def save_report(report: DataFrame, folder: str, today: str) -> None:
    """Write reports by day, replacing those days alone. Days that aren't real, lie ahead, or have no text are left out."""
    good = report.where(F.col("date").try_cast("date").isNotNull() & (F.col("date") <= today) & (F.trim(F.coalesce("summary_md", F.lit(""))) != ""))
    good.write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def retained(log: DataFrame, order: str, text: str, rows: int = LOG_ROWS, size: int = LOG_BYTES) -> DataFrame:
    """The newest entries of a log, at most so many and so many bytes. Only the newest rows are ever sorted together."""
    newest = log.orderBy(F.desc(order)).limit(rows)
    run = F.sum(F.octet_length(text)).over(Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("_bytes", run).where(F.col("_bytes") <= size).drop("_bytes")


def changed(log: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Entries that differ from the one before of their key (a site, a feed)."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    return log.withColumn("_before", before).where(~F.col(text).eqNullSafe(F.col("_before"))).drop("_before")


def _xml(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rss_items(reports: DataFrame, site: str, most: int = FEED_ITEMS) -> DataFrame:
    """(day, item): RSS items of the newest reports."""
    newest = reports.orderBy(F.desc("day")).limit(most)
    link = F.concat(F.lit(site), F.lit("/daily/"), F.col("date"), F.lit("/"))
    item = F.concat(F.lit("<item><title>"), _xml(F.col("date")), F.lit("</title><link>"), _xml(link), F.lit("</link><pubDate>"), F.date_format("day", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 +0900</pubDate></item>"))
    return newest.select("day", item.alias("item"))


def sitemap_urls(reports: DataFrame, site: str) -> DataFrame:
    """(day, entry): sitemap entries of all reports."""
    entry = F.concat(F.lit("<url><loc>"), F.lit(site), F.lit("/daily/"), F.col("date"), F.lit("/</loc><lastmod>"), F.substring("generated_at", 1, 10), F.lit("</lastmod></url>"))
    return reports.select("day", entry.alias("entry"))


def without_current_audio(reports: DataFrame, audio: DataFrame, most_chars: int = 3000) -> DataFrame:
    """Reports that need audio: none of their day has the digest of their text, and the text isn't too long."""
    named = reports.where(F.char_length("summary_md") <= most_chars).withColumn("source_sha", F.substring(F.sha2("summary_md", 256), 1, 16))
    return named.join(audio.select("date", "source_sha"), ["date", "source_sha"], "left_anti")


def prompt_lines(posts: DataFrame, most: int = 400) -> DataFrame:
    """(rank, line): posts as lines of a prompt, bodies cut."""
    body = F.substring(F.coalesce("summary", F.lit("")), 1, most)
    line = F.concat_ws(" | ", F.concat(F.lit("#"), F.col("rank").cast("string")), "source", "title", F.concat(F.lit("views "), F.format_number("views", 0)), F.when(body != "", body))
    return posts.select("rank", line.alias("line"))


#: Fixed value: entries of a cache that are kept.
CACHE_ROWS = 1000


def _versions(spark, folder: str) -> list[int]:
    """Batch numbers whose version is whole, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    named = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in named if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def upserted(folder: str, key: list[str], order: list[str], most: int = CACHE_ROWS, keep: int = 2):
    """A writer for foreachBatch: a table of the last row of each key, the most newest ones, as versions folder/batch=N.

    A batch is laid over the version before its number and written as its own, so a batch that comes again (after a death, or from a replay)
    writes what it wrote before: nothing doubles. Rows of equal key count by order, the largest last; retention is by order too. A version
    is there once its success mark is; of the whole ones the keep newest stay.
    """
    newest = [F.col(c).desc_nulls_last() for c in order]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = [n for n in _versions(spark, folder) if n < number]
        rows = batch.unionByName(spark.read.parquet(f"{folder}/batch={there[-1]}")) if there else batch
        last = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("_i = 1").drop("_i")
        last.orderBy(*newest, *key).limit(most).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in there[: max(0, len(there) + 1 - keep)]:
            gone = fs_path(f"{folder}/batch={old}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return write


def current(spark, folder: str) -> DataFrame | None:
    """The newest whole version of upserted()'s table; None before the first."""
    there = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/batch={there[-1]}") if there else None

"""Paged lists of a JSON interface, landed by day: only days asked for are read, pages count up to the end of their list.

A file of the folder day=YYYY-MM-DD has a page a line: {"page", "total", "hasNext", "items"}. Days are partitions, so a range of days
is pruned before a file is opened. Pages are walked as narrow rows (day, number, more to come); items move in no shuffle but
that of their own page's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import api_date
from tidemark.functions.text import ellipsis, squeeze
from tidemark.operators.ingest import first_of_url, positions, readable, real_views, with_source
from tidemark.session import cut

# Fixed values of the interface: items of a page by the ten minutes of the clock (so that answers kept for ten minutes aren't met
# again), pages of a list at most, and an item's fields.
PAGE_LIMITS, MOST_PAGES = (100, 99), 30
ITEM = (
    "id string, communityId string, communityName string, postTitle string, postUrl string, postDesc string, postContent string, postWriterName string, "
    "postDatetime timestamp, targetDate string, readCount bigint, upvoteCount bigint, commentCount bigint, updateDatetime timestamp, creationDatetime timestamp"
)


def page_limit(as_of: Column) -> Column:
    """Items of a page to ask for at a time."""
    return F.element_at(F.array(*map(F.lit, PAGE_LIMITS)), (F.floor(F.minute(as_of) / 10) % len(PAGE_LIMITS) + 1).cast("int"))


def land(items: DataFrame, folder: str, day: str, order: list[str], limit: int = PAGE_LIMITS[0]) -> None:
    """Write items as pages of their days: what a crawler of the interface leaves, for tests and for lists made of other tables.

    Days are replaced one by one; rows without a day go. Items of a page are limit at most.
    """
    fields = [c for c in items.columns if c != day]
    numbered = items.where(F.col(day).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(day).orderBy(*order)) - 1).withColumn("page", F.floor(F.col("_i") / limit).cast("int") + 1)
    totals = items.groupBy(day).agg(F.count(F.lit(1)).alias("total"))
    pages = numbered.groupBy(day, "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", *fields))), lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("items"))
    full = pages.join(totals, day).withColumn("hasNext", F.col("page") * limit < F.col("total"))
    full.select(F.col(day).alias("day"), F.to_json(F.struct("page", "total", "hasNext", "items")).alias("value")).repartition("day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(folder)


def pages(spark: SparkSession, folder: str, first: str, last: str, item: str = ITEM) -> DataFrame:
    """(day, page, total, more, items) of the days from first to last; lines that aren't such a page go.

    The filter on days is one on partitions; of a page that was landed twice the line of the later file counts.
    """
    schema = f"page int, total bigint, hasNext boolean, items array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in item.split(','))}>>, _bad string, day date"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(folder).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    good = raw.where(F.col("_bad").isNull() & (F.col("page") >= 1)).select("day", "page", "total", F.coalesce("hasNext", F.lit(False)).alias("more"), "items", F.col("_metadata.file_path").alias("_file"))
    latest = F.row_number().over(Window.partitionBy("day", "page").orderBy(F.desc("_file")))
    return good.withColumn("_n", latest).where("_n = 1").drop("_n", "_file")


def walked(found: DataFrame, most_pages: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """Items of the pages that a reader from page 1 on would get, and a row a day with how far it came.

    A reader stops after the page that says that it's the last, before a page that isn't there, and after most_pages. Items are (day,
    page, place, item), place from 0 on the page. Days are (day, pages, items, truncated, mismatch): truncated if no page read was
    the last, mismatch if pages differ in their totals. Without a first page a day has none, and is truncated. Null lists have no items.
    """
    heads = cut(found.select("day", "page", "total", "more", F.coalesce(F.size("items"), F.lit(0)).alias("n")))
    by_day = Window.partitionBy("day")
    marked = heads.withColumn("_i", F.row_number().over(by_day.orderBy("page"))).withColumn("_last", F.min(F.when(~F.col("more"), F.col("page"))).over(by_day))
    got = (F.col("page") == F.col("_i")) & (F.col("page") <= F.least(F.coalesce("_last", F.lit(most_pages)), F.lit(most_pages)))
    marked = marked.withColumn("_got", got)
    days = marked.groupBy("day").agg(
        F.count_if("_got").alias("pages"), F.sum(F.when(F.col("_got"), F.col("n")).otherwise(0)).alias("items"),
        (~F.coalesce(F.bool_or(F.col("_got") & ~F.col("more")), F.lit(False))).alias("truncated"),
        (F.count_distinct(F.when(F.col("_got"), F.col("total"))) > 1).alias("mismatch"),
    )
    read = found.join(marked.where("_got").select("day", "page"), ["day", "page"], "left_semi")
    return read.select("day", "page", F.posexplode("items").alias("place", "item")).where("item IS NOT NULL"), days


def posts(items: DataFrame, sources: DataFrame, synthetic: tuple[str, ...] = ()) -> DataFrame:
    """Items as posts, in the order of day, page and place: what can't be read and unknown codes go, the first of a URL stays.

    sources has (code, source, label, emoji, color). Views of synthetic sources are 0, missing counts too; the summary is the start of the
    content, the board the description; position counts within the source over what stays.
    """
    flat = items.select(F.struct("day", "page", "place").alias("arrival"), "item.*").withColumns({"title": squeeze(F.coalesce("postTitle", F.lit(""))), "url": F.trim("postUrl")})
    coded = flat.where(readable(F.col("title"), F.col("url"))).withColumnsRenamed({"communityId": "code", "communityName": "name"})
    known = with_source(coded, sources)
    once = positions(first_of_url(known))
    date = api_date(F.col("postDatetime").cast("timestamp_ntz"), F.col("targetDate"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return once.withColumn("_d", date).select(
        "arrival", "source", "label", "emoji", "color", "title", "url", ellipsis(squeeze(F.coalesce("postContent", F.lit("")))).alias("summary"), F.trim(F.coalesce("postDesc", F.lit(""))).alias("board"),
        F.coalesce("postWriterName", F.lit("")).alias("author"), "_d.event_ts", "_d.event_date", real_views(F.col("source"), count("readCount"), synthetic).alias("views"),
        count("upvoteCount").alias("likes"), count("commentCount").alias("comments"), "position", F.col("targetDate").try_cast("date").alias("target_date"),
    )

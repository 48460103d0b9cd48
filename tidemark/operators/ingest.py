"""What becomes a post: filters of titles and links, sources' names, rows of other paths, and what the feed shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_count
from tidemark.functions.text import TITLE_CHARS, ellipsis, squeeze
from tidemark.functions.urls import is_http

#: Fixed values of the sites: marks of notices and ads in titles and URLs, links that are a count of comments, codes of sources.
NOTICE_TITLE = r"^\s*[\[【(<][^\p{L}\p{N}_]{0,3}(?:공지|필독|이벤트|광고|홍보|AD)"
NOTICE_URL = r"/event/|/annonce/|/rule/|[?&]b=notice|event_notice|[?&]id=sponsor"
AD_TITLE = r"^\s*(?:AD\s|하루특가\))"
COUNT_LINK = r"^[\[(]?[0-9]+[\])]?$"
COMMENT_MARK = "#comment"
SOURCE_CODE = r"^[A-Z0-9]{2,5}$"
#: What a source without an entry shows: fixed values.
EMOJI, COLOR = "📝", "#7c6cff"
CAP, STEP = 25, 1.5


def readable(title: Column, url: Column) -> Column:
    """Whether a row has a title of TITLE_CHARS characters or more, once squeezed, and an http link. Null is neither."""
    return F.coalesce((F.char_length(squeeze(title)) >= TITLE_CHARS) & is_http(F.trim(url)), F.lit(False))


def first_of_url(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first row of each url."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy("url").orderBy(arrival))).where("_i = 1").drop("_i")


def is_notice(title: Column, url: Column) -> Column:
    """Whether a row is a notice or an ad by its title's head or its URL."""
    return F.coalesce(title.rlike(NOTICE_TITLE) | title.rlike(AD_TITLE), F.lit(False)) | F.coalesce(url.rlike(NOTICE_URL), F.lit(False))


def is_rejected(title: Column, url: Column, href: Column) -> Column:
    """Whether a scraped row is no post: unreadable, a count of comments, a link into comments, or a notice."""
    return ~readable(title, url) | F.coalesce(title.rlike(COUNT_LINK), F.lit(False)) | F.contains(F.coalesce(href, F.lit("")), F.lit(COMMENT_MARK)) | is_notice(title, url)


def real_views(source: Column, views: Column, synthetic: tuple[str, ...]) -> Column:
    """A count of views; 0 for sources whose views aren't counted by the site."""
    return F.when(source.isin(*synthetic), F.lit(0).cast("long")).otherwise(as_count(views))


def with_source(rows: DataFrame, sources: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """rows with source, label, emoji and color by their code; codes without an entry in sources (code, source, label, emoji,
    color; a row a code) get their own in lower case, name as the label and the defaults. Rows whose code isn't one go.

    sources is a table of sites. It isn't forced to be broadcast: Spark does so by its size.
    """
    known = sources.select(F.col(code).alias("_code"), *[F.col(c).alias(f"_{c}") for c in ("source", "label", "emoji", "color")])
    found = rows.join(known, F.col(code) == F.col("_code"), "left").where(F.col("_code").isNotNull() | F.col(code).rlike(SOURCE_CODE))
    label = F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(code))
    return found.withColumns(
        {"source": F.coalesce("_source", F.lower(code)), "label": F.coalesce(F.col("_label"), label), "emoji": F.coalesce("_emoji", F.lit(EMOJI)), "color": F.coalesce("_color", F.lit(COLOR))}
    ).drop("_code", "_source", "_label", "_emoji", "_color")


def positions(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """rows with position: 100 for the first of a source, less STEP a place."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(arrival)) - 1
    return rows.withColumn("position", F.greatest(F.lit(0.0), 100 - STEP * place))


def clean_external(items: DataFrame, wanted: DataFrame, window: Column, synthetic: tuple[str, ...] = ()) -> DataFrame:
    """Rows of another path (source, arrival, title, url, date, summary, views, likes, comments) as posts of the wanted sources.

    Titles are squeezed and summaries cut; rows without a readable title and link go, as do those whose date (a text that begins
    with its day) is outside window, an array of days; without a date a row stays. Positions start anew.
    """
    dated = F.coalesce(F.col("date"), F.lit(""))
    inside = (dated == "") | F.coalesce(F.array_contains(window, F.substring(dated, 1, 10).try_cast("date")), F.lit(False))
    kept = items.where(readable(F.col("title"), F.col("url")) & inside).join(wanted.select("source").distinct(), "source", "left_semi")
    counts = {c: as_count(F.col(c)) for c in ("likes", "comments")}
    return positions(
        kept.withColumns({"title": squeeze(F.col("title")), "url": F.trim("url"), "summary": ellipsis(F.coalesce("summary", F.lit(""))), "date": dated, "views": real_views(F.col("source"), F.col("views"), synthetic), **counts})
    )


def with_known_summaries(posts: DataFrame, before: DataFrame) -> DataFrame:
    """posts whose empty summary is that of the same url_key before, where there was one; '' otherwise.

    Of several earlier summaries of a key the least counts.
    """
    known = before.where(F.coalesce("summary", F.lit("")) != "").groupBy("url_key").agg(F.min("summary").alias("_known"))
    found = posts.join(known, "url_key", "left")
    return found.withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), "_known", F.lit(""))).drop("_known")


def covered_sources(previous: DataFrame, today: DataFrame, done_sources: int, done_posts: int, cap: int = CAP) -> DataFrame:
    """Sources of which the day before has cap posts or more, so that they fill every place; none once today's posts, cap a
    source at most, come to done_posts from done_sources sources."""
    sizes = today.groupBy("source").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("_n"))
    done = sizes.agg(((F.count(F.lit(1)) >= done_sources) & (F.coalesce(F.sum("_n"), F.lit(0)) >= done_posts)).alias("_done"))
    full = previous.where(F.coalesce(F.col("source").cast("string"), F.lit("")) != "").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap)
    return full.where(~done.scalar()).select("source", "n")


def mean_place(tokens: DataFrame, key: str, words: str = "words") -> DataFrame:
    """(key, word, place): where a word first stands in a text's words, from 0 to 1, on average over the key's texts that have it."""
    spread = tokens.select(key, words, F.explode(F.array_distinct(words)).alias("word"))
    at = (F.array_position(words, F.col("word")) - 1) / F.greatest(F.lit(1), F.size(words) - 1)
    return spread.groupBy(key, "word").agg(F.avg(at).alias("place"))


def posts_in_issues(issues: DataFrame, ranks: str = "ranks") -> DataFrame:
    """One row, in_issues: how many different posts the issues have."""
    return issues.select(F.explode(ranks).alias("rank")).agg(F.count_distinct("rank").alias("in_issues"))


def feed(posts: DataFrame, tab: Column | None = None, sources: tuple[str, ...] = (), ranks: DataFrame | None = None) -> DataFrame:
    """Posts that pass every filter given: a category's flag, chosen sources, an issue's posts (rank)."""
    out = posts if tab is None else posts.where(F.coalesce(tab, F.lit(False)))
    out = out.where(F.col("source").isin(*sources)) if sources else out
    return out if ranks is None else out.join(ranks.select("rank").distinct(), "rank", "left_semi")


def audio_queue(reports: DataFrame, today: Column, failed: Column, days: int = 14) -> DataFrame:
    """Reports of the last days with turn: the newest first, but the day that failed last after all others."""
    recent = reports.where(F.col("day") > F.date_sub(today, days))
    # at most a row a day is left
    order = Window.orderBy(F.coalesce(F.col("day") == failed, F.lit(False)), F.desc("day"))
    return recent.withColumn("turn", F.row_number().over(order))


def problem_list(health: DataFrame) -> DataFrame:
    """States of sources with place: those with problems first, then by source."""
    return health.withColumn("place", F.row_number().over(Window.orderBy(F.col("status") == "ok", "source")))


def refetch_due(problems: DataFrame, scrapable: DataFrame, tried: DataFrame, as_of: Column, gap_min: int = 30) -> DataFrame:
    """Sources with a problem that a direct path can read and that weren't tried (source, ts) in the last gap_min minutes."""
    lately = tried.where(F.timestamp_diff("SECOND", F.col("ts"), as_of) < gap_min * 60).select("source")
    return problems.select("source").distinct().join(scrapable.select("source"), "source", "left_semi").join(lately, "source", "left_anti")


def advance(posts: DataFrame, signature: str, before: str | None, complete: bool, stalled: bool) -> tuple[str, DataFrame | None]:
    """What a round does to the history: ('same', None) if its signature is that before; ('held', None) if it's incomplete or the
    main source stalls; else ('new', (url_key, rank_score) of its posts that aren't of the day before)."""
    if before is not None and signature == before:
        return "same", None
    if stalled or not complete:
        return "held", None
    today = posts.where("NOT coalesce(prev_day, false)")
    return "new", today.groupBy("url_key").agg(F.max("rank_score").alias("rank_score"))


"""Lists of posts on landed pages: rows by a table of selectors, places that go on over a source's pages.

Pages go through a Python table function in a lateral join, which yields a page's rows as they stand there. All else is columns: what
is no post goes, dates and counts are parsed, and places are numbered. A source is read to its first page without a post:
its status then says why.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date
from tidemark.functions.numbers import parse_count
from tidemark.functions.text import clean_title, ellipsis, squeeze
from tidemark.functions.urls import is_http
from tidemark.operators.ingest import is_rejected
from tidemark.session import cut
from tidemark.sources import selectors
from tidemark.sources.pages import STEP, block_reason

FIELDS = ("row", "title", "text", "strip", "views", "likes", "date", "date_attr", "summary")
SPEC = "source string, " + ", ".join(f"{f} string" for f in FIELDS)

# Fixed values of the sites: their lists' pages, and by source the selectors of a row, of the link to the post within it (none: the row is the
# link), of the title within that, of what isn't title in it, of views, likes, date (and the attribute that has it) and summary.
LISTS = {
    "todayhumor": ("https://www.todayhumor.co.kr/board/list.php?table=bestofbest&page=1", "https://www.todayhumor.co.kr/board/list.php?table=bestofbest&page=2"),
    "ruliweb": ("https://bbs.ruliweb.com/best/humor_only", "https://bbs.ruliweb.com/best/humor_only?page=2"),
    "clien": ("https://www.clien.net/service/board/park?od=T33&po=0", "https://www.clien.net/service/board/park?od=T33&po=1"),
    "theqoo": ("https://theqoo.net/hot", "https://theqoo.net/hot?page=2"),
    "mlbpark": ("https://mlbpark.donga.com/mp/best.php?b=bullpen&m=view",),
    "bobaedream": ("https://www.bobaedream.co.kr/list?code=best", "https://www.bobaedream.co.kr/list?code=best&page=2"),
    "natekorea": ("https://pann.nate.com/talk/ranking",),
    "humoruniv": ("https://web.humoruniv.com/board/humor/list.html?table=pds&pg=0", "https://web.humoruniv.com/board/humor/list.html?table=pds&pg=1"),
    "arcalive": ("https://arca.live/b/live?sort=recommend", "https://arca.live/b/live?sort=recommend&p=2"),
    "ddanzi": ("https://www.ddanzi.com/index.php?mid=free&statusList=BEST%2CHOTBEST%2CBESTAC%2CHOTBESTAC", "https://www.ddanzi.com/index.php?mid=free&statusList=BEST%2CHOTBEST%2CBESTAC%2CHOTBESTAC&page=2"),
    "dcinside": ("https://gall.dcinside.com/board/lists/?id=dcbest", "https://gall.dcinside.com/board/lists/?id=dcbest&page=2"),
    "ppomppu": ("https://www.ppomppu.co.kr/hot.php",),
    "inven": ("https://www.inven.co.kr/board/webzine/2097?my=chuchu",),
    "cook82": ("https://www.82cook.com/entiz/enti.php?bn=15",),
    "etoland": ("https://www.etoland.co.kr/hit/list",),
    "ygosu": ("https://ygosu.com/board/real_article",),
    "dogdrip": ("https://www.dogdrip.net/dogdrip?sort_index=popular",),
}
SPECS = (
    ("todayhumor", "table.table_list tr.view", "td.subject > a", None, None, "td.hits", "td.oknok", "td.date", None, None),
    ("ruliweb", "table.board_list_table tr.table_body", 'a.subject_link[href*="/best/board/"]', ".text_over", None, "td.hit", "td.recomd", "td.time", None, None),
    ("clien", "div.list_item:not(.notice)", "a.list_subject", "span.subject_fixed", None, ".list_hit .hit", ".list_symph span", ".list_time span.timestamp", None, None),
    ("theqoo", "table tbody tr:not(.notice):not(.notice_expand)", "td.title > a:not(.replyNum)", None, None, "td.m_no", None, "td.time", None, None),
    ("mlbpark", "table.tbl_type01 tbody tr", "td.t_left a.txt", None, None, None, None, "span.date", None, None),
    ("bobaedream", "table tbody tr", "a.bsubject", None, None, "td.count", "td.recomm", "td.date", None, None),
    ("natekorea", "div.cntList ul li", 'dt h2 a[href^="/talk/"]', None, None, "dd.info span.count", "dd.info span.rcm", None, None, "dd.txt"),
    ("humoruniv", 'tr[id^="li_chk_"]', 'td.li_sbj a[href*="read.html"]', 'span[id^="title_chk_"]', None, "td.li_und", "td.li_und span.o", "td.li_date", None, None),
    ("arcalive", "div.vrow.hybrid:not(.notice)", "a.title.hybrid-title", None, ".info, .media-icon", ".col-view", ".col-rate", "time[datetime]", "datetime", None),
    ("ddanzi", "table.fz_change tr:not(.notice)", "td.title > a:first-of-type", None, None, "td.readNum", "td.voteNum", "td.time", None, None),
    ("dcinside", "table.gall_list tbody tr.ub-content.us-post", "td.gall_tit > a:not(.reply_numbox)", None, None, "td.gall_count", "td.gall_recommend", "td.gall_date", "title", None),
    ("ppomppu", "tr.baseList", "a.baseList-title", None, ".list_comment2", "td.board_date + td.board_date + td.board_date", "td.board_date + td.board_date", "td.board_date", None, None),
    ("inven", "table.thumbnail tbody tr", "a.subject-link", None, "span.category", "td.view", "td.reco", "td.date", None, None),
    ("cook82", "div.Best ul.most li", 'a[href*="read.php"]', None, None, None, None, None, None, None),
    ("etoland", 'a[class*="grid-cols-[21px"]', None, "span.subject", None, None, None, None, None, None),
    ("ygosu", "table.yg-board-table tbody tr:not(:has(td.bdname)), table.bd_list tbody tr:not(:has(td.bdname))", "td.tit a", None, "span.category, span.reply_cnt", "td.read", "td.vote", "td.date", None, None),
    ("dogdrip", "li.webzine", "a.title-link", None, None, None, "div.list-meta span.margin-right-xsmall > span.text-primary:last-child", "div.list-meta span.text-muted", None, None),
)


def specs(spark: SparkSession, rows: tuple = SPECS) -> DataFrame:
    """The table of selectors, a row a source."""
    return spark.createDataFrame(list(rows), SPEC)


def rows_of_page(html: str | None, url: str | None, spec: dict[str, str | None]) -> Iterator[tuple]:
    """(href, title, views, likes, date, summary) of each row with a link, as texts; null where a spec has no selector or a row no element."""
    if not html:
        return
    for row in selectors.select(selectors.page(html), spec["row"]):
        link = selectors.first(row, spec["title"]) if spec["title"] else row
        if link is None or not link.attrs.get("href"):
            continue
        junk = frozenset(selectors.select(link, spec["strip"])) if spec["strip"] else frozenset()
        titled = (selectors.first(link, spec["text"]) if spec["text"] else None) or link
        read = {f: selectors.first(row, spec[f]) if spec[f] else None for f in ("views", "likes", "date", "summary")}
        texts = {f: None if e is None else e.text() for f, e in read.items()}
        if read["date"] is not None and spec["date_attr"]:
            texts["date"] = read["date"].attrs.get(spec["date_attr"])
        try:
            href = urljoin(url or "", link.attrs["href"].strip())
        except ValueError:
            continue
        yield href, titled.text(junk), texts["views"], texts["likes"], texts["date"], texts["summary"]


class _ListRows:
    """Table function: a page's rows with their place on it, from 0."""

    def eval(self, html: str, url: str, spec: str) -> Iterator[tuple]:
        for i, row in enumerate(rows_of_page(html, url, json.loads(spec))):
            yield (i, *row)


_RAW = "seq int, href string, raw_title string, raw_views string, raw_likes string, raw_date string, raw_summary string"


def raw_rows(pages: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of all pages whose source is in table, as they stand there: pages' source, page_no, url with the columns of _RAW."""
    lists = F.udtf(_ListRows, returnType=_RAW)
    known = pages.join(F.broadcast(table), "source").select("source", "page_no", "url", "html", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("spec"))
    return known.lateralJoin(lists(F.col("html").outer(), F.col("url").outer(), F.col("spec").outer())).drop("html", "spec")


def page_outcome(status: Column, body: Column, url: Column) -> Column:
    """Why a fetched page can't be read, '' if it can: an error (no answer, or 500 and up), or a refusal by status or by a page of marks."""
    return (
        F.when(status.isNull(), "error: no answer").when(status >= 500, F.concat(F.lit("error: HTTP "), status.cast("string")))
        .when(status >= 400, F.concat(F.lit("blocked: HTTP "), status.cast("string"))).when(F.contains(F.coalesce(url, F.lit("")), F.lit("msg.html")), "blocked: msg.html").otherwise("")
    )


def listed(pages: DataFrame, table: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Posts of all sources' lists, and a row a source with how its reading went.

    pages are (source, page_no, url, html) and perhaps status (HTTP, null without an answer). Posts have source, page_no, place (from
    0 over all its pages), title, url, views, likes (0 if none), event_ts, event_date, summary and position. Titles under
    four characters, notices, links to comments and to other than http go, and don't count as places. A source's pages count up to
    the first that can't be read or has no post; the status table (source, status, why, n) is ok if any was read, with the reason of
    the end, else blocked or error. Pages of unknown sources, null html and empty tables give no posts.
    """
    pages = pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))
    fetched = pages.withColumn("_bad", page_outcome(F.col("status"), F.col("html"), F.col("url")))
    raw = raw_rows(fetched.where("_bad = ''").select("source", "page_no", "url", "html"), table)
    title, date = clean_title(F.col("raw_title")), parse_date(F.col("raw_date"), as_of)
    posts = raw.select("source", "page_no", "seq", title.alias("title"), F.col("href").alias("url"), F.coalesce(parse_count(F.col("raw_views")), F.lit(0)).alias("views"), F.coalesce(parse_count(F.col("raw_likes")), F.lit(0)).alias("likes"), date.alias("_date"), ellipsis(squeeze(F.coalesce("raw_summary", F.lit("")))).alias("summary"))
    posts = cut(posts.where((F.char_length("title") >= 4) & is_http(F.col("url")) & ~is_rejected(F.col("title"), F.col("url"), F.col("url"))))
    # places: pages are numbered on by how many posts those before have, a row a page
    counts = posts.groupBy("source", "page_no").agg(F.count(F.lit(1)).alias("n"))
    known = fetched.join(F.broadcast(table.select("source")), "source").select("source", "page_no", "_bad", block_reason(F.col("html"), F.col("url")).alias("_mark"))
    by_page = Window.partitionBy("source").orderBy("page_no")
    walked = known.join(counts, ["source", "page_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    why = F.when(F.col("_bad") != "", F.col("_bad")).when(F.col("_mark") != "", F.concat(F.lit("blocked: "), F.col("_mark"))).otherwise("blocked: no rows")
    walked = walked.withColumn("_end", F.min(F.when(F.col("n") == 0, F.struct("page_no", why.alias("why")))).over(Window.partitionBy("source")))
    walked = cut(walked.withColumn("_start", F.coalesce(F.sum("n").over(by_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    read = F.col("_end").isNull() | (F.col("page_no") < F.col("_end.page_no"))
    inside = F.row_number().over(Window.partitionBy("source", "page_no").orderBy("seq")) - 1
    out = posts.withColumn("_i", inside).join(walked.where(read).select("source", "page_no", "_start"), ["source", "page_no"]).withColumn("place", (F.col("_start") + F.col("_i")).cast("long"))
    out = out.select("source", "page_no", "place", "title", "url", "views", "likes", "_date.event_ts", "_date.event_date", "summary", F.greatest(F.lit(0.0), 100 - STEP * F.col("place")).alias("position"))
    ended = walked.groupBy("source").agg(F.sum(F.when(read, F.col("n")).otherwise(0)).alias("n"), F.first("_end.why").alias("_why"))
    status = F.when(F.col("n") > 0, "ok").otherwise(F.element_at(F.split("_why", ":"), 1))
    return out, ended.select("source", status.alias("status"), F.coalesce("_why", F.lit("")).alias("why"), F.col("n").cast("long").alias("n"))

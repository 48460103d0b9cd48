"""Queries of titles, reports, feeds and dates over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as T
from tidemark.functions import titles as W
from tidemark.operators import history as Y
from tidemark.operators import issues as Q
from tidemark.plans.core import query
from tidemark.session import table
from tidemark.sources import sinks as K


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# titles

#: Heads of titles as sites write them; each document's title has one by its id, and the start of its text.
HEADS = ("[속보] 결승.jpg ㅋㅋ ", "(후기) 자전거 ", "잡담) 이야기 ", "【단독】 뉴스 ", "특가 30,000원 + 쿠폰 ", "약혐 사진.gif ", "ㄷㄷ 尹 美 ", "[공지][필독] ", "")
_TITLES = f"SELECT doc_id, [{', '.join(map(_sql, HEADS))}][doc_id % {len(HEADS)} + 1] || substr(coalesce(text, ''), 1, 30) AS title FROM documents"


def _titles(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.substring(F.coalesce("text", F.lit("")), 1, 30)).alias("title"))


@query(f"""WITH t AS ({_TITLES}),
r AS (SELECT doc_id, list_transform(regexp_extract_all(title, {_sql(W.TAG)}, 1), lambda x: trim(x)) AS inside, regexp_replace(title, {_sql(W.TAG)}, ' ', 'g') AS rest FROM t),
h AS (SELECT *, regexp_extract(rest, {_sql(W.HEAD_TAG)}, 1) AS head, regexp_replace(regexp_replace(regexp_replace(rest, {_sql(W.HEAD_TAG)}, '', 'g'), {_sql(W.FILE_MARK)}, ' ', 'g'), {_sql(W.JAMO)}, ' ', 'g') AS body FROM r)
SELECT doc_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS body, array_to_string(CASE WHEN head <> '' THEN list_append(inside, head) ELSE inside END, '|') AS tags FROM h""")
def title_parts(spark, sf_dir):
    parts = _titles(spark, sf_dir).select("doc_id", W.split_title(F.col("title")).alias("p"))
    return parts.select("doc_id", "p.body", F.array_join("p.tags", "|").alias("tags"))


@query(f"""WITH t AS ({_TITLES}) SELECT doc_id, regexp_matches(title, {_sql(Q.DEAL)}) AS is_deal, NOT regexp_matches(title, {_sql(Q.UNSAFE)}) AS is_safe FROM t""")
def title_flags(spark, sf_dir):
    t = F.col("title")
    return _titles(spark, sf_dir).select("doc_id", F.coalesce(t.rlike(Q.DEAL), F.lit(False)).alias("is_deal"), (~F.coalesce(t.rlike(Q.UNSAFE), F.lit(False))).alias("is_safe"))


# reports and feeds

_REPORT = "regexp_replace(coalesce(text, ''), '(?m)^E', '## E', 'g')"


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all({_REPORT}, '(?m)^##[ \t]+([^\n]+)$', 1)[1:3], ' / ') AS headings FROM documents")
def report_headings(spark, sf_dir):
    report = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^E", "## E")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.headings(report), " / ").alias("headings"))


@query("""WITH r AS (SELECT doc_id::VARCHAR AS date, coalesce(text, '') AS md FROM documents),
a AS (SELECT l.doc_id::VARCHAR AS date, substr(sha256(CASE WHEN l.toxic = 1 THEN 'another text' ELSE coalesce(d.text, '') END), 1, 16) AS sha FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT date FROM r WHERE length(md) <= 3000 AND NOT EXISTS (SELECT 1 FROM a WHERE a.date = r.date AND a.sha = substr(sha256(r.md), 1, 16))""")
def reports_without_audio(spark, sf_dir):
    """Documents as reports that no audio reads: labelled ones have some, of another text where they're toxic."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("date"), F.coalesce("text", F.lit("")).alias("summary_md"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("date"), "toxic")
    read = F.when(F.col("toxic") == 1, "another text").otherwise(F.col("summary_md"))
    audio = docs.join(labels, "date").select("date", F.substring(F.sha2(read, 256), 1, 16).alias("source_sha"))
    return K.without_current_audio(docs, audio).select("date")


@query("""SELECT p_partkey AS rank, '#' || p_partkey || ' | ' || p_brand || ' | ' || p_name || ' | views ' || format('{:,}', p_size * 1000) || CASE WHEN p_type <> '' THEN ' | ' || substr(p_type, 1, 400) ELSE '' END AS line FROM part""")
def prompt_lines(spark, sf_dir):
    posts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rank"), F.col("p_brand").alias("source"), F.col("p_name").alias("title"), (F.col("p_size") * 1000).alias("views"), F.col("p_type").alias("summary"))
    return K.prompt_lines(posts)


@query("SELECT page_id::VARCHAR AS title, url FROM pages WHERE regexp_matches(lower(coalesce(url, '')), '^https?://')")
def public_rows(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("title"), "url", "html")
    return K.public_rows(pages)


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), n AS (SELECT day FROM d ORDER BY day DESC LIMIT 30)
SELECT day::VARCHAR AS day, '<item><title>' || day || '</title><link>https://s/daily/' || day || '/</link><pubDate>' || strftime(day, '%a, %d %b %Y') || ' 00:00:00 +0900</pubDate></item>' AS item FROM n""")
def rss_items(spark, sf_dir):
    """The newest days of orders as items of a feed."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().withColumn("date", F.col("day").cast("string"))
    return K.rss_items(days, "https://s").select(F.col("day").cast("string").alias("day"), "item")


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day::VARCHAR AS day, '<url><loc>https://s/daily/' || day || '/</loc><lastmod>' || day || '</lastmod></url>' AS entry FROM d""")
def sitemap_urls(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().withColumn("date", F.col("day").cast("string")).withColumn("generated_at", F.concat("date", F.lit("T12:00:00+09:00")))
    return K.sitemap_urls(days, "https://s").select(F.col("day").cast("string").alias("day"), "entry")


# rounds


@query("""WITH r AS (SELECT DISTINCT month(o_orderdate) * 100 + day(o_orderdate) AS round_no, o_orderstatus || o_orderpriority AS url_key FROM orders),
s AS (SELECT round_no, string_agg(url_key, '|' ORDER BY url_key) AS keys FROM r GROUP BY round_no),
k AS (SELECT round_no, keys <> lag(keys) OVER (ORDER BY round_no) AS differs FROM s)
SELECT round_no, url_key FROM r WHERE round_no IN (SELECT round_no FROM k WHERE coalesce(differs, true))""")
def distinct_rounds(spark, sf_dir):
    """Days of the year as rounds of kinds of orders, without those whose kinds are those of the day before."""
    d = F.col("o_orderdate")
    rounds = table(spark, sf_dir, "orders").select((F.month(d) * 100 + F.dayofmonth(d)).cast("long").alias("round_no"), F.concat("o_orderstatus", "o_orderpriority").alias("url_key")).distinct()
    return Y.collapse_rounds(rounds)


# dates without a year or a day

_CLOCK = "o_orderdate::TIMESTAMP + to_seconds((o_orderkey * 7919) % 86400)"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, {_CLOCK} AS t FROM orders),
m AS (SELECT *, date_trunc('minute', TIMESTAMP '2001-03-02 12:00:00'::DATE + (t - date_trunc('day', t))) AS clk, try_cast(strftime(t, '2001-%m-%d') AS DATE) AS this, try_cast(strftime(t, '2000-%m-%d') AS DATE) AS last FROM o),
y AS (SELECT *, CASE WHEN this IS NOT NULL AND this::TIMESTAMP > TIMESTAMP '2001-03-03 12:00:00' THEN last ELSE this END AS day FROM m),
e AS (SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN clk > TIMESTAMP '2001-03-02 12:10:00' THEN clk - INTERVAL 1 DAY ELSE clk END
    WHEN 1 THEN clk - INTERVAL 1 DAY WHEN 3 THEN day + (date_trunc('minute', t) - date_trunc('day', t)) END AS event_ts, day, k FROM y)
SELECT o_orderkey, event_ts, (CASE WHEN k < 2 THEN event_ts::DATE ELSE day END)::VARCHAR AS event_date FROM e""")
def clock_dates(spark, sf_dir):
    """Orders' times written as a time of day, yesterday's, and days without a year, read as of noon of March 2nd."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 7919) % 86400)).alias("t"))
    form = lambda f: F.date_format(F.col("t"), f)
    text = F.when(k % 4 == 0, form("HH:mm")).when(k % 4 == 1, F.concat(F.lit("어제 "), form("HH:mm"))).when(k % 4 == 2, form("MM.dd")).otherwise(form("MM.dd HH:mm"))
    found = rows.select("o_orderkey", D.parse_date(text, F.lit("2001-03-02 12:00:00").cast("timestamp_ntz")).alias("d"))
    return found.select("o_orderkey", "d.event_ts", F.col("d.event_date").cast("string").alias("event_date"))

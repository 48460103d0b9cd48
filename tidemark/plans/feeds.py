"""Queries of ingest, dates, counts, titles and health over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions import speech as SP
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import health as H
from tidemark.operators import history as Y
from tidemark.operators import ingest as I
from tidemark.operators import stats as A
from tidemark.operators import selection as E
from tidemark.plans.core import query, r6
from tidemark.session import ensure_checkpoint_dir, table
from tidemark.sources import listing as L
from tidemark.sources import probes as PR
from tidemark.sources import scan as S
from tidemark.streaming import processors as G


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ingest

_TITLE = "regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1)"
_SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_HTTP = "coalesce(regexp_matches(lower(trim(url)), '^https?://'), false)"


@query(f"""WITH r AS (SELECT page_id, url, {_TITLE} AS title FROM pages WHERE length({_SQUEEZED.format(_TITLE)}) >= 4 AND {_HTTP}),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS i FROM r)
SELECT page_id, {_SQUEEZED.format('title')} AS title FROM f WHERE i = 1""")
def ingest_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1).alias("title"))
    return I.first_of_url(rows.where(I.readable(F.col("title"), F.col("url"))), "page_id").select("page_id", T.squeeze(F.col("title")).alias("title"))


#: Heads of titles and tails of links that the rules are about, by an id's remainder.
HEADS = ("", "[공지] ", "AD ", "(광고)", "[19]", "하루특가)", "【 필독】")
TAILS = ("view/1", "event/2", "x?b=notice", "view#comment", "rule/3", "x?id=sponsor", "x?id=9", "y", "annonce/")


def _pick(values: tuple[str, ...], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({i} % {len(values)}) + 1]"


@query(f"""WITH r AS (SELECT doc_id, {_pick(HEADS, 'doc_id')} || coalesce(CASE WHEN doc_id % 7 = 4 THEN '' ELSE text END, '') AS title, 'https://a.com/' || {_pick(TAILS, 'doc_id')} AS url FROM documents),
n AS (SELECT *, regexp_matches(title, '{I.NOTICE_TITLE}') OR regexp_matches(title, '{I.AD_TITLE}') OR regexp_matches(url, '{I.NOTICE_URL}') AS is_notice FROM r)
SELECT doc_id, is_notice, is_notice OR length({_SQUEEZED.format('title')}) < 4 OR regexp_matches(title, '{I.COUNT_LINK}') OR contains(url, '#comment') AS is_rejected FROM n""")
def notice_rows(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    title = F.concat(pick(HEADS), F.when(F.col("doc_id") % 7 == 4, "").otherwise(F.coalesce("text", F.lit(""))))
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.concat(F.lit("https://a.com/"), pick(TAILS)).alias("url"))
    t, u = F.col("title"), F.col("url")
    return rows.select("doc_id", I.is_notice(t, u).alias("is_notice"), I.is_rejected(t, u, u).alias("is_rejected"))


_SOURCES = "k AS (SELECT 'SRC' || n_nationkey AS code, lower(n_name) AS source, n_name AS label, 'x' AS emoji, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE '#000000' END AS color FROM nation WHERE n_nationkey < 8)"


def _sources(spark, sf_dir):
    i = F.col("n_nationkey")
    code = F.concat(F.lit("SRC"), i.cast("string"))
    return table(spark, sf_dir, "nation").where(i < 8).select(code.alias("code"), F.lower("n_name").alias("source"), F.col("n_name").alias("label"), F.lit("x").alias("emoji"), F.when(i % 2 != 0, "#000000").alias("color"))


@query(f"""WITH {_SOURCES}, d AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN lower(source) ELSE upper(source) END AS code, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS name FROM documents)
SELECT doc_id, coalesce(k.source, lower(d.code)) AS source, coalesce(k.label, nullif(d.name, ''), d.code) AS label, coalesce(k.emoji, '{I.EMOJI}') AS emoji, coalesce(k.color, '{I.COLOR}') AS color
FROM d LEFT JOIN k ON d.code = k.code WHERE k.code IS NOT NULL OR regexp_full_match(d.code, '[A-Z0-9]{{2,5}}')""")
def source_names(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 13 == 0, F.lower("source")).otherwise(F.upper("source")).alias("code"), F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("name"))
    return I.with_source(rows, _sources(spark, sf_dir)).select("doc_id", "source", "label", "emoji", "color")


@query(f"""WITH w AS (SELECT source FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) WHERE n % 2 = 0),
r AS (SELECT doc_id, source, {_SQUEEZED.format('text')} AS title, n_chars, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '2024-01-02T10:00' WHEN 2 THEN '2024-01-03' ELSE 'soon' END AS date, text FROM documents WHERE source IN (SELECT source FROM w)),
f AS (SELECT * FROM r WHERE length(title) >= 4 AND (date = '' OR date[1:10] IN ('2024-01-02', '2024-01-01')) AND doc_id % 9 <> 0)
SELECT doc_id, source, CASE WHEN length(title) > 130 THEN substr(title, 1, 130) || '…' ELSE title END AS summary, CASE WHEN source = 'src1' THEN 0 ELSE greatest(n_chars, 0) END::BIGINT AS views,
  greatest(0.0, 100 - 1.5 * (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1))::DOUBLE AS position FROM f""")
def external_rows(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    wanted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")
    date = F.when(i % 4 == 0, "").when(i % 4 == 1, "2024-01-02T10:00").when(i % 4 == 2, "2024-01-03").otherwise("soon")
    link = F.concat(F.when(i % 9 == 0, "ftp").otherwise("https"), F.lit("://a.com/"), i.cast("string"))
    items = docs.select("doc_id", "source", i.alias("arrival"), F.col("text").alias("title"), link.alias("url"), date.alias("date"), F.col("text").alias("summary"), F.col("n_chars").alias("views"), F.lit(None).cast("string").alias("likes"), F.lit("3").alias("comments"))
    days = F.array(*(F.lit(d).cast("date") for d in ("2024-01-01", "2024-01-02")))
    return I.clean_external(items, wanted, days, ("src1",)).select("doc_id", "source", "summary", "views", "position")


@query("""WITH p AS (SELECT doc_id // 3 AS k, min(text) AS s FROM documents WHERE doc_id % 2 = 0 AND coalesce(text, '') <> '' GROUP BY 1)
SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 5 = 0 THEN lang END, p.s, '')) AS digest FROM documents LEFT JOIN p ON doc_id // 3 = p.k WHERE doc_id % 2 = 1""")
def known_summaries(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = docs.withColumn("url_key", F.floor(i / 3))
    posts = rows.where(i % 2 == 1).select("doc_id", "url_key", F.when(i % 5 == 0, F.col("lang")).alias("summary"))
    before = rows.where(i % 2 == 0).select("url_key", F.col("text").alias("summary"))
    return I.with_known_summaries(posts, before).select("doc_id", F.md5("summary").alias("digest"))


@query("""WITH p AS (SELECT user_id AS source, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1 HAVING count(*) >= 25),
t AS (SELECT count(*) AS s, sum(least(n, 25)) AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1))
SELECT source, n FROM p WHERE NOT (SELECT s >= 1000 AND n >= 100000 FROM t)""")
def covered_sources(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "source")
    return I.covered_sources(events.where(F.col("ts") < ntz("2024-01-15")), events.where(F.col("ts") >= ntz("2024-01-29")), 1000, 100_000)


@query("""WITH t AS (SELECT p_partkey, p_brand, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS ws FROM part),
u AS (SELECT p_partkey, p_brand, len(ws) AS n, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM t),
f AS (SELECT p_partkey, p_brand, word, min(i)::DOUBLE / greatest(1, min(n) - 1) AS p FROM u GROUP BY 1, 2, 3)
SELECT p_brand, word, round(avg(p), 6) AS place FROM f GROUP BY 1, 2""")
def mean_place(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ").alias("words"))
    return I.mean_place(rows, "p_brand").withColumn("place", r6(F.col("place")))


@query("SELECT count(DISTINCT l_partkey) AS in_issues FROM lineitem")
def posts_in_issues(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ranks"))
    return I.posts_in_issues(found)


@query("SELECT source, count(*) AS n FROM documents WHERE coalesce(contains(text, 'tionsh'), false) AND source IN ('src1', 'src2', 'src3') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source")
def feed_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("rank", F.col("doc_id"))
    inside = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("rank"))
    return I.feed(docs, F.contains("text", F.lit("tionsh")), ("src1", "src2", "src3"), inside).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE > DATE '1998-01-20' - 14 AND o_orderdate::DATE <= DATE '1998-01-20')
SELECT day::VARCHAR AS day, row_number() OVER (ORDER BY day = DATE '1998-01-19', day DESC) AS turn FROM r""")
def audio_queue(spark, sf_dir):
    today = F.lit("1998-01-20").cast("date")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).where(F.col("day") <= today).distinct()
    return I.audio_queue(days, today, F.lit("1998-01-19").cast("date")).select(F.col("day").cast("string").alias("day"), F.col("turn").cast("long").alias("turn"))


@query("""WITH h AS (SELECT user_id AS source, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 20 THEN 'missing' ELSE 'ok' END AS status FROM events GROUP BY 1)
SELECT source, status, row_number() OVER (ORDER BY status = 'ok', source) AS place FROM h""")
def problem_list(spark, sf_dir):
    bad = F.count_if(F.col("event_type") == "error") > 20
    health = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(F.when(bad, "missing").otherwise("ok").alias("status"))
    return I.problem_list(health).select("source", "status", F.col("place").cast("long").alias("place"))


@query("""SELECT DISTINCT user_id AS source FROM events WHERE event_type = 'error' AND user_id % 3 <> 0
AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-29 23:30:00')""")
def refetch_due(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "source")
    tried = events.where("event_type = 'click'").select("source", "ts")
    return I.refetch_due(events.where("event_type = 'error'"), events.where("source % 3 <> 0").select("source").distinct(), tried, ntz("2024-01-30"))


# dates, counts, titles

_AT = "o_orderdate::TIMESTAMP + to_seconds((o_orderkey * 7919) % 86400)"
_SPELL = {
    0: ("strftime(t, '%Y-%m-%d %H:%M:%S')", "t", "t::DATE"), 1: ("strftime(t, '%Y.%m.%d')", "NULL", "t::DATE"), 2: ("strftime(t, '%y/%m/%d %H:%M')", "date_trunc('minute', t) + CASE WHEN year(t) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END", "(t + CASE WHEN year(t) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END)::DATE"),
    3: ("strftime(t, '%Y-%m-%dT%H:%M:%SZ')", "t + INTERVAL 9 HOUR", "(t + INTERVAL 9 HOUR)::DATE"), 4: ("(o_orderkey % 50) || '분 전'", "TIMESTAMP '2001-01-01 12:00:00' - to_minutes(o_orderkey % 50)", "DATE '2001-01-01'"),
    5: ("(o_orderkey % 9) || '일 전'", "NULL", "DATE '2001-01-01' - (o_orderkey % 9)::INT"), 6: ("'어제'", "NULL", "DATE '2000-12-31'"), 7: ("'never'", "NULL", "NULL"),
}


def _case(at: int, kind: str) -> str:
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {v[at]}" for k, v in _SPELL.items()) + f" END::{kind}"


@query(f"""WITH o AS (SELECT o_orderkey, {_AT} AS t FROM orders) SELECT o_orderkey, {_case(1, 'TIMESTAMP')} AS event_ts, {_case(2, 'DATE')}::VARCHAR AS event_date FROM o""")
def spelled_dates(spark, sf_dir):
    """Orders' times written in eight ways and read again as of noon of a day."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 7919) % 86400)).alias("t"))
    form = lambda f: F.date_format(F.col("t"), f)
    spelled = {0: form("yyyy-MM-dd HH:mm:ss"), 1: form("yyyy.MM.dd"), 2: form("yy/MM/dd HH:mm"), 3: form("yyyy-MM-dd'T'HH:mm:ss'Z'"), 4: F.concat((k % 50).cast("string"), F.lit("분 전")), 5: F.concat((k % 9).cast("string"), F.lit("일 전")), 6: F.lit("어제"), 7: F.lit("never")}
    text = F.lit(None).cast("string")
    for at, form_of in spelled.items():
        text = F.when(k % 8 == at, form_of).otherwise(text)
    found = rows.select("o_orderkey", D.parse_date(text, ntz("2001-01-01 12:00:00")).alias("d"))
    return found.select("o_orderkey", "d.event_ts", F.col("d.event_date").cast("string").alias("event_date"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 AND date_trunc('hour', ts) + INTERVAL 9 HOUR = date_trunc('day', date_trunc('hour', ts) + INTERVAL 9 HOUR) THEN NULL
  WHEN event_id % 4 = 1 THEN date_trunc('hour', ts) + INTERVAL 9 HOUR ELSE ts + INTERVAL 9 HOUR END AS event_ts,
  CASE WHEN event_id % 4 = 0 THEN DATE '2024-02-01' ELSE (ts + INTERVAL 9 HOUR)::DATE END::VARCHAR AS event_date FROM events""")
def api_dates(spark, sf_dir):
    i, ts = F.col("event_id"), F.col("ts")
    written = F.when(i % 4 == 1, F.date_trunc("HOUR", ts).cast("timestamp_ntz")).when(i % 4 != 0, ts.cast("timestamp_ntz"))
    found = table(spark, sf_dir, "events").select("event_id", D.api_date(written, F.lit("2024-02-01")).alias("d"))
    return found.select("event_id", "d.event_ts", F.col("d.event_date").cast("string").alias("event_date"))


@query("""WITH e AS (SELECT event_id, ts, hour(ts) + minute(ts) / 60 + second(ts) / 3600 AS h FROM events)
SELECT event_id, CASE WHEN hour(ts) < 2 THEN 2 ELSE 1 END AS days, CASE WHEN h <= 3 THEN 3 WHEN h <= 6 THEN 6 WHEN h <= 12 THEN 12 ELSE 24 END AS hours,
  round(greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 86400000000.0), 6) AS age FROM e""")
def date_rules(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", F.size(D.date_window(ts)).alias("days"), D.hours_to_cover(ts).alias("hours"), r6(D.age_days(ts, F.lit(None).cast("date"), ntz("2024-01-20"))).alias("age"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN (o_orderkey % 1000) * 1000 + 500 WHEN 2 THEN (o_orderkey % 100) * 10000 WHEN 3 THEN 0 ELSE o_orderkey + 1000000 END::BIGINT AS n FROM orders""")
def spelled_counts(spark, sf_dir):
    """Counts written in five ways and read again."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("조회 "), k.cast("string"))).when(k % 5 == 1, F.concat((k % 1000).cast("string"), F.lit(".5k"))).when(k % 5 == 2, F.concat((k % 100).cast("string"), F.lit("만")))
    text = text.when(k % 5 == 3, "none").otherwise(F.concat(F.format_number(k + 1_000_000, 0), F.lit(" views")))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.parse_count(text).alias("n"))


_COUNTED = r"\s*[\[(]\s*[0-9,]+\s*[\])]\s*$"


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' [' || doc_id || ']' WHEN doc_id % 3 = 1 THEN '[tag]' || text ELSE text END AS title FROM documents),
s AS (SELECT doc_id, title, {_SQUEEZED.format('title')} AS flat FROM t)
SELECT doc_id, md5(trim(regexp_replace(flat, '{_COUNTED}', ''))) AS cleaned, CASE WHEN length(flat) > 130 THEN substr(flat, 1, 130) || '…' ELSE flat END AS short,
  len(regexp_extract_all(title, '\\[([^\\[\\]]+)\\]', 1)) AS tags FROM s""")
def title_forms(spark, sf_dir):
    i, text = F.col("doc_id"), F.col("text")
    title = F.when(i % 3 == 0, F.concat(text, F.lit(" ["), i.cast("string"), F.lit("]"))).when(i % 3 == 1, F.concat(F.lit("[tag]"), text)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_title(title)).alias("cleaned"), T.ellipsis(title).alias("short"), F.when(title.isNotNull(), F.size(T.bracket_tags(title))).alias("tags"))


# health and status

_STATS = """s AS (SELECT user_id AS source, max(ts) AS last_update, count(*) AS n FROM events WHERE user_id % 7 <> 0 GROUP BY 1),
e AS (SELECT DISTINCT user_id AS source, user_id % 24 AS from_hour FROM events WHERE user_id % 5 <> 0),
b AS (SELECT source, coalesce(12 >= from_hour, false) AS due, coalesce(n, 0) AS n, last_update FROM e FULL JOIN s USING (source)),
p AS (SELECT source, n, due AS is_expected, due AND n = 0 AS is_missing, n > 0 AND coalesce(epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_update) >= 5401000000, false) AS is_degraded, last_update FROM b),
plan AS (SELECT source, is_expected, is_missing, is_degraded, n > 0 AND NOT is_degraded AND n < 5 AS is_thin, n FROM p)"""
NOW = "2024-01-30 12:00:00"


def _plan(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "source")
    stats = H.source_stats(events.where("source % 7 <> 0"), "source", "event_id", "ts", "ts")
    expected = events.where("source % 5 <> 0").select("source", (F.col("source") % 24).alias("from_hour")).distinct()
    return events, stats, H.fill_plan(expected, stats, ntz(NOW))


@query(f"WITH {_STATS} SELECT * FROM plan")
def fill_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[2]


@query(f"WITH {_STATS} SELECT CASE WHEN count(*) >= 3 THEN 'partial' ELSE 'ok' END AS status FROM plan WHERE (is_missing OR is_degraded) AND source % 2 = 0")
def round_status(spark, sf_dir):
    events, _, plan = _plan(spark, sf_dir)
    return H.round_status(plan, suspended=events.where("source % 2 <> 0").select("source").distinct())


@query(f"""WITH {_STATS},
c AS (SELECT user_id AS source, count(*) AS n, bool_or(event_id % 3 = 0) AS m, bool_or(event_id % 3 = 1) AS d, bool_or(event_id % 3 = 2) AS i FROM events WHERE user_id % 11 <> 0 AND ts >= TIMESTAMP '2024-01-28' GROUP BY 1),
was AS (SELECT DISTINCT user_id AS source, CASE user_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' ELSE 'suspended' END AS was, CASE WHEN user_id % 3 < 2 THEN TIMESTAMP '2024-01-20' END AS upd, TIMESTAMP '2024-01-10' AS since FROM events WHERE user_id % 4 <> 0),
a AS (SELECT k.source, coalesce(plan.is_degraded, false) AS deg, coalesce(plan.is_missing, false) AS mis, coalesce(s.last_update, was.upd) AS last_update, coalesce(c.n, 0) AS n, coalesce(c.m, false) AS m, coalesce(c.d, false) AS d, coalesce(c.i, false) AS i, was.was, was.since
  FROM (SELECT source FROM plan UNION SELECT source FROM s UNION SELECT source FROM c) k LEFT JOIN plan USING (source) LEFT JOIN s USING (source) LEFT JOIN c USING (source) LEFT JOIN was USING (source)),
x AS (SELECT *, CASE WHEN deg THEN 'degraded' WHEN mis THEN 'missing' ELSE 'ok' END AS s0 FROM a),
y AS (SELECT *, CASE WHEN s0 <> 'ok' AND source % 6 = 1 AND NOT (d OR i) THEN 'blocked' ELSE s0 END AS s1 FROM x),
z AS (SELECT *, CASE WHEN s1 <> 'ok' AND n = 0 AND (coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_update) >= 108001000000, false) OR (last_update IS NULL AND coalesce(was = 'suspended', false))) THEN 'suspended' ELSE s1 END AS status FROM y)
SELECT source, status, last_update, n, concat_ws('+', CASE WHEN m THEN 'main' END, CASE WHEN d THEN 'direct' END, CASE WHEN i THEN 'issuelink' END) AS via, CASE WHEN was = status THEN since ELSE TIMESTAMP '{NOW}' END AS since FROM z""")
def source_health(spark, sf_dir):
    events, stats, plan = _plan(spark, sf_dir)
    i, s = F.col("event_id"), F.col("source")
    collected = events.where((s % 11 != 0) & (F.col("ts") >= ntz("2024-01-28"))).select("source", F.when(i % 3 == 1, "direct").when(i % 3 == 2, "issuelink").alias("via"))
    prior = events.where(s % 4 != 0).select("source").distinct().select("source", F.when(s % 3 == 0, "ok").when(s % 3 == 1, "degraded").otherwise("suspended").alias("status"), F.when(s % 3 < 2, ntz("2024-01-20")).alias("last_update"), ntz("2024-01-10").alias("since"))
    blocked = events.where(s % 6 == 1).select("source")
    return H.source_health(plan, stats, collected, prior, blocked, ntz(NOW)).select("source", "status", "last_update", "n", F.array_join("via", "+").alias("via"), "since")


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS s, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-29') AS bn, count(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-29') AS bs,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 09:00:00') AS recent, list_sort(list(ts))[2] AS second, max(ts) AS last FROM events GROUP BY 1),
h AS (SELECT *, (epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(second)) / 3600 AS since_h, (epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(last)) / 3600 AS last_h FROM g)
SELECT user_id, CASE WHEN since_h <= 3 THEN 'new' WHEN coalesce(n - bn >= 3 OR (n - bn >= 2 AND bn > 0 AND n / bn >= 1.5) OR s - bs >= 2, false) THEN 'rising' WHEN recent >= 2 AND recent / n >= 0.25 THEN 'rising'
  WHEN last_h > 8 AND n >= 2 THEN 'quiet' ELSE 'steady' END AS status FROM h""")
def issue_status(spark, sf_dir):
    ts, early = F.col("ts"), F.col("ts") < ntz("2024-01-29")
    events = table(spark, sf_dir, "events")
    two = A.second_earliest(events, "user_id", "ts").select("user_id", "since", "last")
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("s"), F.count_if(early).alias("bn"), F.count_distinct(F.when(early, F.col("event_type"))).alias("bs"), F.count_if(ts >= ntz("2024-01-30 09:00:00")).alias("recent"))
    hours = lambda c: F.timestamp_diff("MICROSECOND", F.col(c), ntz(NOW)) / 3_600_000_000
    state = Y.status(F.col("n"), F.col("s"), F.col("bn"), F.col("bs"), F.col("recent"), F.col("n"), hours("since"), hours("last"), F.col("n"))
    return counts.join(two, "user_id").select("user_id", state.alias("status"))


# lists by selectors

#: The generator's pages have their links in a list of the navigation.
NAV = ("nav", "nav ul li", "a", None, None, None, None, None, None, None)


@query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '{U.PARTS}', 1)) AS source, html FROM pages),
l AS (SELECT page_id, source, unnest(regexp_extract_all(coalesce(html, ''), '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS title, generate_subscripts(regexp_extract_all(coalesce(html, ''), '<li><a href="([^"]*)">([^<]*)</a></li>', 2), 1) AS seq FROM p),
t AS (SELECT page_id, source, seq, regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '\s*[\[(][0-9]+[\])]$', '') AS title FROM l),
k AS (SELECT * FROM t WHERE length(title) >= 4 AND NOT regexp_matches(title, '{I.NOTICE_TITLE}') AND NOT regexp_matches(title, '{I.AD_TITLE}')),
n AS (SELECT p.page_id, p.source, count(k.page_id) AS n FROM p LEFT JOIN k ON p.page_id = k.page_id GROUP BY p.page_id, p.source),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, min(CASE WHEN n = 0 THEN page_id END) OVER (PARTITION BY source) AS stop FROM n)
SELECT k.source, k.page_id, (w.start + row_number() OVER (PARTITION BY k.page_id ORDER BY k.seq) - 1)::BIGINT AS place, k.title
FROM k JOIN w ON k.page_id = w.page_id WHERE w.stop IS NULL OR w.page_id < w.stop""")
def listed_rows(spark, sf_dir):
    """Links of pages' navigation as lists of their hosts, with places over all pages of a host."""
    pages = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", U.PARTS, 1)).alias("source"), F.col("page_id").alias("page_no"), "url", "html")
    sources = pages.select("source").distinct().select("source", *[F.lit(x).cast("string").alias(f) for f, x in zip(L.FIELDS, NAV[1:])])
    posts, _ = L.listed(pages, sources, ntz("2026-01-01 00:00:00"))
    return posts.select("source", F.col("page_no").alias("page_id"), "place", "title")


# paged lists and budgets

CLICK_ITEM = "click_id bigint, kind string, value double"
CLICK_PAGE = 50


@query(f"""WITH c AS (SELECT click_id, kind, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY click_id, kind NULLS FIRST, value NULLS FIRST) - 1 AS i FROM clicks WHERE ts IS NOT NULL),
d AS (SELECT *, (i // {CLICK_PAGE} + 1)::INT AS page, (i % {CLICK_PAGE})::INT AS place, count(*) OVER (PARTITION BY day) > {CLICK_PAGE * S.MOST_PAGES} AS truncated FROM c)
SELECT click_id, kind, day::VARCHAR AS day, page, place, truncated FROM d WHERE page <= {S.MOST_PAGES}""")
def paged_scan(spark, sf_dir):
    """All clicks landed as paged lists of their days, and what a scan of those days reads."""
    folder = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    clicks = table(spark, sf_dir, "clicks").select("click_id", "kind", "value", F.col("ts").cast("date").alias("day"))
    S.land(clicks, folder, "day", ["click_id", "kind", "value"], CLICK_PAGE)
    items, days = S.walked(S.pages(spark, folder, "2024-01-01", "2024-12-31", CLICK_ITEM))
    return items.join(days.select("day", "truncated"), "day").select("item.click_id", "item.kind", F.col("day").cast("string").alias("day"), "page", "place", "truncated")


@query("""WITH k AS (SELECT client_id AS source, click_id AS pid, ts::DATE AS event_date, kind,
    row_number() OVER (PARTITION BY client_id ORDER BY click_id, kind NULLS FIRST) AS turn FROM (SELECT DISTINCT client_id, click_id, ts, kind FROM clicks) WHERE ts IS NULL OR ts::DATE >= '2024-03-01'),
p AS (SELECT *, CASE WHEN kind = 'purchase' THEN 0.0 ELSE 1.0 END AS cost FROM k WHERE turn <= 25),
c AS (SELECT *, sum(cost) OVER (ORDER BY turn, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM p)
SELECT source, pid, turn::INT AS turn, CASE WHEN kind = 'purchase' THEN 'cached' WHEN used <= 2000 THEN 'resolved' ELSE 'left' END AS outcome FROM c""")
def budgeted_rows(spark, sf_dir):
    """Clients' lists of clicks since March: their first 25 in turns, purchases cached, 2,000 others within the budget."""
    clicks = table(spark, sf_dir, "clicks").select(F.col("client_id").alias("source"), F.col("click_id").alias("pid"), F.col("ts").cast("date").alias("event_date"), "kind", "ts").distinct()
    place = F.struct("pid", "kind")
    cached = clicks.where("kind = 'purchase'").select("source", F.struct("pid", "kind").alias("pid"), F.lit("u").alias("url"))
    days = clicks.where("event_date >= '2024-03-01'").select(F.col("event_date").alias("day")).distinct()
    rows = clicks.select("source", place.alias("place"), place.alias("pid"), "event_date")
    return E.within_budget(rows, cached, days, 2000).select("source", F.col("pid.pid").alias("pid"), "turn", "outcome")


# scripts and probes


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    for pattern, to in ((SP.MARKS, ""), (SP.UNSAID, ""), (SP.DOTS, ", "), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_LINE = f"CASE WHEN level = 2 THEN rest ELSE regexp_replace(regexp_replace(CASE WHEN level > 0 THEN rest ELSE line END, '{SP.QUOTE}', ''), '{SP.LIST}', '') END"


@query(f"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '(?m)^E', '## E', 'g'), '{SP.BREAKS}') AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
g AS (SELECT doc_id, i, line, length(regexp_extract(line, '{SP.HEADING}', 1)) AS level, regexp_extract(line, '{SP.HEADING}', 2) AS rest FROM l),
p AS (SELECT doc_id, i, level = 2 AS head, {_plain(_LINE)} AS said FROM g),
e AS (SELECT doc_id, i, head, said, CASE WHEN said = '' OR regexp_matches(said, '{SP.ENDS}') THEN said ELSE said || '.' END AS ended, (sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS part FROM p),
b AS (SELECT doc_id, part, coalesce(max(ended) FILTER (WHERE head), '') AS title, coalesce(string_agg(ended, ' ' ORDER BY i) FILTER (WHERE NOT head AND regexp_matches(said, '[\\p{{L}}\\p{{N}}]')), '') AS body FROM e GROUP BY doc_id, part),
n AS (SELECT doc_id, max(part) AS n FROM b GROUP BY doc_id),
k AS (SELECT n.doc_id, 0 AS part, trim('1월 2일 커뮤니티 데일리 리포트입니다. 모두 ' || coalesce({_LISTED(SP.COUNTS)}[nullif(n, 0)], n::VARCHAR) || ' 가지 이야기를 전해 드립니다. ' || coalesce(b.body, '')) AS block FROM n LEFT JOIN b ON n.doc_id = b.doc_id AND b.part = 0
  UNION ALL SELECT doc_id, part, trim(coalesce({_LISTED(SP.ORDINALS)}[part], part::VARCHAR) || ' 번째 이야기. ' || title || ' ' || body) FROM b WHERE part > 0)
SELECT doc_id, (count(*) - 1)::BIGINT AS sections, sha256(string_agg(block, chr(10) || '{SP.PAUSE}' || chr(10) ORDER BY part)) AS script_sha256 FROM k GROUP BY doc_id""")
def report_scripts(spark, sf_dir):
    """Documents as reports, whose lines that begin with E are headings, read aloud: sections, and the script's digest."""
    report = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^E", "## E")
    made = table(spark, sf_dir, "documents").select("doc_id", SP.script(report, F.lit("2026-01-02").cast("date")).alias("s"))
    return made.select("doc_id", F.size("s.titles").cast("long").alias("sections"), F.sha2("s.text", 256).alias("script_sha256"))



@query(rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, coalesce(url, '') AS url, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status FROM pages),
v AS (SELECT page_id, status, trim(regexp_replace(regexp_extract(t, '{PR.TITLE}', 1), '\s+', ' ', 'g')) AS title, t, url,
  len(list_distinct(regexp_extract_all(t, '{PR.ARTICLE.replace("'", "''")}', 1))) AS article_links, len(regexp_extract_all(t, '{PR.FEED_ITEM}')) AS feed_items FROM p)
SELECT page_id, nullif(substr(title, 1, {PR.TITLE_CHARS}), '') AS title, article_links::BIGINT AS article_links, feed_items::BIGINT AS feed_items,
  CASE WHEN status >= 400 THEN 'http-404' WHEN (regexp_matches(substr(t, 1, {PR.CHECK_CHARS}), '{PR.CHECKS}') OR regexp_matches(title, '{PR.CHECKS}') OR regexp_matches(substr(t, 1, {PR.REDIRECT_CHARS}), '{PR.REDIRECT.replace("'", "''")}') OR contains(url, 'msg.html')) AND article_links < {PR.LEAST_LINKS} THEN 'blocked' ELSE 'ok' END AS verdict FROM v""")
def probe_records(spark, sf_dir):
    """Every page as a probe's answer, each fifth of them as not found."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("final_url"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    return PR.probed(pages).select("page_id", "title", "article_links", PR.feed_items(F.col("body")).alias("feed_items"), "verdict")


# gates


@query("""WITH RECURSIVE s AS (SELECT user_id AS feed, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT feed, sec, i, true AS allowed, sec AS prev FROM s WHERE i = 1
  UNION ALL SELECT s.feed, s.sec, s.i, s.sec - r.prev >= 420, CASE WHEN s.sec - r.prev >= 420 THEN s.sec ELSE r.prev END FROM r JOIN s ON s.feed = r.feed AND s.i = r.i + 1)
SELECT feed, count(*) AS wishes, count(*) FILTER (WHERE allowed) AS runs FROM r GROUP BY feed""")
def run_guard(spark, sf_dir):
    """Events as wishes to run of their users: how many the guard of the interval lets through."""
    wishes = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").alias("feed"), F.lit("run").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.lit("ok").alias("outcome"))
    decisions = G.gate_replay(wishes.withColumn("feed", F.col("feed").cast("string")))
    return decisions.groupBy(F.col("feed").cast("long").alias("feed")).agg(F.count(F.lit(1)).alias("wishes"), F.count_if("allowed").alias("runs"))

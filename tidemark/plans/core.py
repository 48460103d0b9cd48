"""Queries of the library's operators over the driver's tables, each with its DuckDB counterpart.

Roles: documents.source is a source, n_chars views, doc_id arrival; events are timed posts of users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import dedup as D
from tidemark.operators import health as H
from tidemark.operators import history as Y
from tidemark.operators import ranking as R
from tidemark.operators import selection as S
from tidemark.operators import similarity as M
from tidemark.operators import stats as A
from tidemark.operators.graph import components as connected
from tidemark.session import table
from tidemark.sources import pages as P

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column) -> Column:
    return F.round(x, 6)


# ranking

_POSTS = """posts AS (SELECT source, doc_id AS arrival, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS views, doc_id % 53 AS likes,
  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 41 END AS comments, (doc_id % 100)::DOUBLE AS age_days,
  greatest(0.0, 100.0 - 1.5 * (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1))::DOUBLE AS position FROM documents)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts; reactions and ages are given by the id, as the table has none."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "source", i.alias("arrival"), F.when(i % 11 == 0, 0).otherwise(F.col("n_chars")).alias("views"), (i % 53).alias("likes"),
        F.when(i % 7 == 0, 0).otherwise(i % 41).alias("comments"), (i % 100).cast("double").alias("age_days"), R.position_score("source", "doc_id").alias("position"),
    )


@query("SELECT source, doc_id, greatest(0.0, 100.0 - 1.5 * (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1))::DOUBLE AS position_score FROM documents")
def position_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "doc_id", R.position_score("source", "doc_id").alias("position_score"))


_SCORED = f"""{_POSTS},
young AS (SELECT *, greatest(1, max(views) OVER w) AS mv, greatest(1, max(likes) OVER w) AS ml, greatest(1, max(comments) OVER w) AS mc,
  max(views) OVER w > 0 AS viewed FROM posts WHERE age_days <= 90 WINDOW w AS (PARTITION BY source)),
s0 AS (SELECT *, floor((CASE WHEN viewed THEN position * 0.35 + (
    CASE WHEN views > 0 THEN ln(1 + views) / ln(1 + mv) * 100 ELSE 0 END * 0.60 + CASE WHEN likes > 0 THEN ln(1 + likes) / ln(1 + ml) * 100 ELSE 0 END * 0.25
    + CASE WHEN comments > 0 THEN ln(1 + comments) / ln(1 + mc) * 100 ELSE 0 END * 0.15) * 0.65 ELSE position END) * exp(-age_days / 90.0) * 10 + 0.5) / 10.0 AS score0 FROM young),
scored AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY score0 DESC, arrival) = 1 THEN floor(score0 * 1.10 * 10 + 0.5) / 10.0 ELSE score0 END AS rank_score FROM s0)"""
_POPULAR = f"""{_SCORED},
raws AS (SELECT *, CASE WHEN views > 0 THEN views::DOUBLE WHEN comments > 0 THEN 100.0 * comments WHEN likes > 0 THEN 100.0 * likes END AS raw FROM scored),
own AS (SELECT source, list_sort(list(raw) FILTER (WHERE raw IS NOT NULL))[(count(raw) // 2 + 1)::INT] AS own FROM raws GROUP BY source),
overall AS (SELECT list_sort(list(raw) FILTER (WHERE raw IS NOT NULL))[(count(raw) // 2 + 1)::INT] AS overall FROM raws),
pop AS (SELECT r.*, log10(1 + coalesce(raw, coalesce(own, overall, 1000.0) * greatest(0.2, position / 100) * 1.5) * pow(0.5, age_days * 24 / 24.0)) AS popularity
  FROM raws r JOIN own ON r.source IS NOT DISTINCT FROM own.source, overall)"""


@query(f"""WITH {_POPULAR},
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY popularity DESC, rank_score DESC, arrival) AS k FROM pop),
b AS (SELECT *, popularity - 0.6 * (k - 1) AS balanced FROM k WHERE k <= 25)
SELECT source, arrival, rank_score, round(popularity, 6) AS popularity, row_number() OVER (ORDER BY balanced DESC, popularity DESC, rank_score DESC, arrival) AS rank FROM b""")
def rank_balanced(spark, sf_dir):
    return R.rank_balanced(posts(spark, sf_dir)).select("source", "arrival", "rank_score", r6(F.col("popularity")).alias("popularity"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT event_id, round(log10(1 + value * pow(0.5, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0 * 24 / 24.0)), 6) AS popularity FROM events""")
def popularity_score(spark, sf_dir):
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit("2024-02-01").cast("timestamp_ntz")) / F.lit(86_400_000_000.0)
    return table(spark, sf_dir, "events").select("event_id", r6(R.popularity(F.col("value"), age)).alias("popularity"))


@query("""SELECT c_mktsegment, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::INT] AS median FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def upper_median(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.upper_median_by_rank(joined, ["c_mktsegment"], "o_totalprice")


@query(f"""WITH {_SCORED}
SELECT source, arrival, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC, arrival) AS place, round(cume_dist() OVER (PARTITION BY source ORDER BY comments), 6) AS comment_share FROM scored""")
def comment_percentile(spark, sf_dir):
    found = R.community_context(R.scored(posts(spark, sf_dir)))
    return found.select("source", "arrival", F.col("place").cast("long").alias("place"), r6(F.col("comment_share")).alias("comment_share"))


@query(f"""WITH {_SCORED}, f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC, arrival) AS i FROM scored)
SELECT source, arrival, rank_score FROM f WHERE i = 1 ORDER BY rank_score DESC, arrival LIMIT 20""")
def first_per_source(spark, sf_dir):
    scored = R.scored(posts(spark, sf_dir)).withColumn("rank", -F.col("rank_score"))
    return S.first_per_source(scored).select("source", "arrival", "rank_score")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def interleave(spark, sf_dir):
    found = S.interleaved(table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").alias("arrival")))
    return found.select("source", "doc_id", F.col("turn").cast("long").alias("turn"))


_TOPK = """p AS (SELECT o_orderkey AS arrival, c_mktsegment AS source, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank,
  o_totalprice / (1 + o_orderkey % 97) AS rank_score, o_orderdate >= TIMESTAMP '2001-07-25' OR o_orderdate < TIMESTAMP '1995-01-05' AS cand FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT * FROM p WHERE cand OR (SELECT count(*) FROM p WHERE cand) < 10),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, arrival) AS i FROM c) WHERE i <= 4 ORDER BY rank, arrival LIMIT 10),
rest AS (SELECT c.*, coalesce(h.had, 0) AS had FROM c LEFT JOIN (SELECT source, count(*) AS had FROM one GROUP BY source) h ON c.source IS NOT DISTINCT FROM h.source WHERE arrival NOT IN (SELECT arrival FROM one)),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC, rank, arrival) AS i FROM rest) WHERE i + had <= 4),
o AS (SELECT arrival, source, rank, rank_score, 1 AS step FROM one UNION ALL SELECT arrival, source, rank, rank_score, 2 FROM two
  UNION ALL SELECT arrival, source, rank, rank_score, 3 FROM rest WHERE arrival NOT IN (SELECT arrival FROM two)),
n AS (SELECT *, row_number() OVER (ORDER BY step, CASE WHEN step = 1 THEN rank END, rank_score DESC, rank, arrival) AS pick FROM o)"""


@query(f"WITH {_TOPK} SELECT arrival, source, rank, pick FROM n WHERE pick <= 20")
def diversified_topk(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ranked = R.numbered(joined, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select(
        F.col("o_orderkey").alias("arrival"), F.col("c_mktsegment").alias("source"), "rank",
        (F.col("o_totalprice") / (1 + F.col("o_orderkey") % 97)).alias("rank_score"),
        ((F.col("o_orderdate") >= F.lit("2001-07-25").cast("timestamp_ntz")) | (F.col("o_orderdate") < F.lit("1995-01-05").cast("timestamp_ntz"))).alias("is_candidate"),
    )
    return S.diversified_topk(ranked).select("arrival", "source", "rank", F.col("pick").cast("long").alias("pick"))


# keys and dedup

_URL_KEY = f"""CASE WHEN regexp_extract(query, '{U.POST_NUMBER}', 1) <> '' THEN host || '#' || CASE WHEN regexp_extract(query, '{U.BOARD_NAME}', 1) <> '' THEN regexp_extract(query, '{U.BOARD_NAME}', 1) || ':' ELSE '' END || regexp_extract(query, '{U.POST_NUMBER}', 1)
  WHEN len(nums) > 0 THEN host || '#' || nums[-1] ELSE host || path || '?' || query END"""
_URLS = f"""u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '{U.PARTS}', 1)), '^www\\.', '') AS host, regexp_extract(url, '{U.PARTS}', 2) AS path, regexp_extract(url, '{U.PARTS}', 3) AS query FROM pages),
n AS (SELECT *, list_filter(list_transform(string_split(path, '/'), lambda p: regexp_extract('-' || p, '-([0-9]{{4,}})$', 1)), lambda x: x <> '') AS nums FROM u),
keyed AS (SELECT page_id, url, {_URL_KEY} AS url_key FROM n)"""


@query(f"""WITH {_URLS}, r AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS i, count(*) OVER (PARTITION BY url_key) AS copies FROM keyed)
SELECT page_id, url_key, copies FROM r WHERE i = 1""")
def url_key_dedup(spark, sf_dir):
    from pyspark.sql import Window

    keyed = table(spark, sf_dir, "pages").select("page_id", U.url_key(F.col("url")).alias("url_key"))
    copies = keyed.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("url_key")))
    found = D.dedup(copies.select("*", F.lit("").alias("title_key"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("priority"), F.col("page_id").alias("arrival")))
    return found.select("page_id", "url_key", "copies")


_TITLE_KEY = rf"""CASE WHEN length(lower(regexp_replace(coalesce(text, ''), '{T.NOT_WORD}', '', 'g'))) >= 5 THEN coalesce(source, 'None') || '|' || lower(regexp_replace(coalesce(text, ''), '{T.NOT_WORD}', '', 'g')) ELSE '' END"""


@query(f"""WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'main' WHEN doc_id % 3 = 1 THEN 'direct' ELSE 'issuelink' END AS via, doc_id % 3 AS prio, {_TITLE_KEY} AS title_key FROM documents),
f AS (SELECT *, first_value(via) OVER (PARTITION BY title_key ORDER BY prio, doc_id) AS claim FROM t)
SELECT doc_id, md5(title_key) AS title_digest FROM f WHERE title_key = '' OR claim = via""")
def title_key_dedup(spark, sf_dir):
    i = F.col("doc_id")
    via = F.when(i % 3 == 1, "direct").when(i % 3 == 2, "issuelink")
    docs = table(spark, sf_dir, "documents").select("doc_id", via.alias("via"), i.alias("arrival"), i.cast("string").alias("url_key"), T.title_key(F.col("source"), F.col("text")).alias("title_key"))
    found = D.dedup(docs.withColumn("priority", D.priority(F.col("via"), F.lit(False))))
    return found.select("doc_id", F.md5("title_key").alias("title_digest"))


_WAYS = """k AS (SELECT event_id AS arrival, user_id AS source, user_id || '#' || event_type || '#' || json_extract_string(props, '$.k') AS url_key, ts FROM events),
cur AS (SELECT * FROM k WHERE ts >= TIMESTAMP '2024-01-21'), prev AS (SELECT * FROM k WHERE ts < TIMESTAMP '2024-01-21'),
counts AS (SELECT source, count(*) AS n FROM cur GROUP BY source)"""


def _ways(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival"), F.col("user_id").alias("source"), F.concat_ws("#", F.col("user_id").cast("string"), "event_type", k).alias("url_key"),
        F.lit("").alias("title_key"), F.lit(False).alias("prev_day"), "ts",
    )
    day = F.lit("2024-01-21").cast("timestamp_ntz")
    return rows.where(F.col("ts") >= day), rows.where(F.col("ts") < day)


@query(f"""WITH {_WAYS},
l AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY arrival) AS i FROM prev WHERE source NOT IN (SELECT source FROM counts WHERE n >= 25) AND url_key NOT IN (SELECT url_key FROM cur))
SELECT arrival, source, url_key, greatest(0.0, 100 - 1.5 * (row_number() OVER (PARTITION BY source ORDER BY arrival) - 1))::DOUBLE AS position FROM l WHERE i = 1""")
def carry_forward(spark, sf_dir):
    current, previous = _ways(spark, sf_dir)
    return D.carry_forward(previous, current, complete=False).select("arrival", "source", "url_key", "position")


@query(f"""WITH {_WAYS},
l AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY arrival) AS i FROM prev WHERE url_key NOT IN (SELECT url_key FROM cur)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY arrival) AS p FROM l WHERE i = 1),
f AS (SELECT p.* FROM p LEFT JOIN counts USING (source) WHERE p.p <= 25 - coalesce(counts.n, 0))
SELECT arrival, source, (SELECT count(*) FROM cur) + row_number() OVER (ORDER BY arrival) AS rank FROM f""")
def capacity_fill(spark, sf_dir):
    current, previous = _ways(spark, sf_dir)
    return D.capacity_fill(current, previous).select("arrival", "source", F.col("rank").cast("long").alias("rank"))


@query("""WITH l AS (SELECT sha1(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || l_returnflag || l_linestatus) AS h FROM lineitem),
p AS (SELECT substr(h, 1, 2) AS p, sha1(string_agg(h, chr(10) ORDER BY h)) AS d FROM l GROUP BY 1)
SELECT sha1(string_agg(d, chr(10) ORDER BY p)) AS signature FROM p""")
def relation_signature(spark, sf_dir):
    bar = F.lit("|")
    line = F.concat("l_orderkey", bar, "l_linenumber", bar, "l_partkey", bar, "l_suppkey", bar, "l_returnflag", "l_linestatus")
    none = F.sha1(F.lit(""))  # SQL has null for a table without lines
    return D.relation_signature(table(spark, sf_dir, "lineitem"), line).select(F.nullif("signature", none).alias("signature"))


# flags, counts, tokens


def _sql_flag(words: tuple[str, ...]) -> str:
    plain = "lower(coalesce(text, ''))"
    for x in A.FALSE_HITS:
        plain = f"replace({plain}, '{x}', ' ')"
    return f"regexp_matches({plain}, '{'|'.join(words)}')"


#: Word parts of the test tables' invented languages.
PARTS = {"food": ("tionsh", "keit"), "game": ("ndle", "elle"), "sport": ("wherh", "mente"), "money": ("blesh", "pfst"), "tech": ("###", "ciónez"), "film": ("oldh", "eaux"), "trip": ("license", "über"), "car": ("ouwhea", "ñar")}


@query("SELECT doc_id, " + ", ".join(f"{_sql_flag(w)} AS is_{k}" for k, w in PARTS.items()) + ", CASE " + " ".join(f"WHEN {_sql_flag(w)} THEN '{k}'" for k, w in PARTS.items()) + " ELSE 'general' END AS label FROM documents")
def classify_flags(spark, sf_dir):
    flags = A.category_flags(F.col("text"), PARTS)
    return table(spark, sf_dir, "documents").select("doc_id", *[f.alias(f"is_{k}") for k, f in flags.items()], A.label(flags).alias("label"))


@query("SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {_sql_flag(w)}) AS {k}" for k, w in PARTS.items() if k not in ("trip", "car")) + f", count(*) FILTER (WHERE {_sql_flag(PARTS['trip'])} OR {_sql_flag(PARTS['car'])}) AS travel FROM documents GROUP BY source")
def category_counts(spark, sf_dir):
    flags = A.category_flags(F.col("text"), PARTS)
    counts = [F.count_if(f).alias(k) for k, f in flags.items() if k not in ("trip", "car")]
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *counts, F.count_if(flags["trip"] | flags["car"]).alias("travel"))


@query("SELECT count(*) AS groups, sum(least(n, 25))::BIGINT AS capped FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def capped_size(spark, sf_dir):
    return A.capped_size(table(spark, sf_dir, "documents"), "source")


_WORDS = rf"list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '{T.NOT_WORD}'), lambda w: length(w) >= 2))"


@query(f"""WITH t AS (SELECT unnest({_WORDS}) AS token FROM documents), d AS (SELECT token, count(*) AS df FROM t GROUP BY token)
SELECT token, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 0.5)), 6) AS idf FROM d""")
def token_idf(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("ws"))
    return M.token_idf(rows, "doc_id", "ws").withColumn("idf", r6(F.col("idf")))


@query(f"""WITH r AS (SELECT p_partkey, unnest({_WORDS.replace('text', "p_name || ' ' || p_type || ' ' || p_brand")}) AS w FROM part)
SELECT a.w AS a, b.w AS b, count(*) AS n FROM r a JOIN r b ON a.p_partkey = b.p_partkey AND a.w < b.w GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(T.words(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("ws"))
    return M.cooccurrence(rows, "ws")


_PAIRS = """t AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_type AS title FROM part GROUP BY 2),
g AS (SELECT id, regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g') AS s FROM t),
b AS (SELECT id, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i::INT, 2))) AS bi FROM g WHERE length(s) >= 2),
pairs AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.bi, y.bi))::DOUBLE / (len(x.bi) + len(y.bi) - len(list_intersect(x.bi, y.bi))) AS j FROM b x JOIN b y ON x.id < y.id)"""


def _titles(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("title")).agg(F.min("p_partkey").alias("id"))
    return part.select("id", T.bigrams(F.col("title")).alias("bi"))


@query(f"WITH {_PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM pairs WHERE j >= 0.45")
def bigram_jaccard(spark, sf_dir):
    return M.jaccard_pairs(_titles(spark, sf_dir), "id", "bi").withColumn("jaccard", r6(F.col("jaccard")))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE j >= 0.75 UNION SELECT b, a FROM pairs WHERE j >= 0.75),
w(node, seen) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a)
SELECT node, min(seen) AS component FROM w GROUP BY node""")
def components(spark, sf_dir):
    return connected(M.jaccard_pairs(_titles(spark, sf_dir), "id", "bi", 0.75), "a", "b")


# time


@query("""WITH h AS (SELECT user_id AS url_key, ts::DATE AS d, sum(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2), m AS (SELECT url_key, avg(s) AS m FROM h GROUP BY 1),
c AS (SELECT user_id AS url_key, sum(value) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT c.url_key, round(c.s - coalesce(m.m, 0), 6) AS velocity FROM c LEFT JOIN m USING (url_key)""")
def velocity(spark, sf_dir):
    events, day = table(spark, sf_dir, "events").withColumnRenamed("user_id", "url_key"), F.lit("2024-01-29").cast("timestamp_ntz")
    history = events.where(F.col("ts") < day).groupBy("url_key", F.col("ts").cast("date")).agg(F.sum("value").alias("rank_score"))
    now = events.where(F.col("ts") >= day).groupBy("url_key").agg(F.sum("value").alias("rank_score"))
    return Y.velocity(now, history).select("url_key", r6(F.col("velocity")).alias("velocity"))


@query("""WITH r AS (SELECT event_type, date_trunc('hour', ts) AS round, count(*) AS n, count(DISTINCT user_id) AS parts FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(n, 3) OVER w AS before_n, lag(parts, 3) OVER w AS before_parts FROM r WINDOW w AS (PARTITION BY event_type ORDER BY round))
SELECT event_type, round, n, parts, before_n, before_parts, CASE WHEN coalesce(n - before_n >= 3 OR (n - before_n >= 2 AND before_n > 0 AND n / before_n >= 1.5) OR parts - before_parts >= 2, false) THEN 'rising' ELSE 'steady' END AS trend FROM l""")
def rising_status(spark, sf_dir):
    return Y.rising_keys(table(spark, sf_dir, "events"), "event_type", "user_id", "ts")


@query("SELECT event_type AS source, max(ts) AS last_update, min_by(ts, -event_id) AS last_new, count(*) AS n FROM events GROUP BY 1")
def source_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "source")
    return H.source_stats(events, "source", "event_id", "ts", "ts")


@query("""WITH p AS (SELECT user_id, event_type, max(value) AS best, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, sum(n)::BIGINT AS n, count(*) AS sources, round(sum(greatest(best, 0.0)) / 100 + sum(0.5 * ln(n)), 6) AS spread FROM p GROUP BY 1""")
def spread_heat(spark, sf_dir):
    return A.spread_heat(table(spark, sf_dir, "events"), "user_id", "event_type", "value").withColumn("spread", r6(F.col("spread")))


@query("""SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first, list_sort(list(o_orderdate))[2] AS since, max(o_orderdate) AS last FROM orders GROUP BY 1""")
def second_earliest(spark, sf_dir):
    return A.second_earliest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("""WITH f AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT user_id, event_id, (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id))::BIGINT AS streak FROM f""")
def streaks(spark, sf_dir):
    return H.streaks(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "streak")


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS most FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(spark, sf_dir):
    from tidemark.streaming.rounds import windowed_counts as windowed

    found = windowed(table(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def neighbours(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


# pages


@query(f"SELECT page_id, 'https://' || lower(regexp_extract(url, '{U.PARTS}', 1)) || regexp_extract(url, '{U.PARTS}', 2) || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM (SELECT *, list_aggregate(list_filter(string_split(regexp_extract(url, '{U.PARTS}', 3), '&'), lambda f: f <> '' AND string_split(f, '=')[1] NOT IN ({', '.join(repr(x) for x in U.LIST_FIELDS)})), 'string_agg', '&') AS q0, coalesce(q0, '') AS q FROM pages)")
def clean_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.clean_url(F.col("url")).alias("url"))


#: What the generator escapes in texts and attributes.
_ESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&"))
_LINK = '<a href="([^"]*)">([^<]*)</a>'


def _unescaped(x: str) -> str:
    for one, other in _ESCAPES:
        x = f"replace({x}, '{one}', '{other}')"
    return x


@query(f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS title, generate_subscripts(regexp_extract_all(html, '{_LINK}', 2), 1) AS i FROM pages),
t AS (SELECT page_id, i, {_unescaped('href')} AS href, trim(regexp_replace({_unescaped('title')}, '\\s+', ' ', 'g')) AS title FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM t WHERE length(title) >= 1)
SELECT page_id, pos, href, title, greatest(0.0, 100 - 1.5 * pos)::DOUBLE AS position FROM n""")
def html_rows(spark, sf_dir):
    from tidemark.sources.pages import html_rows as rows

    return rows(table(spark, sf_dir, "pages"))


@query(f"""WITH v AS (SELECT regexp_extract(url, '{U.PARTS}', 1) AS host, CASE WHEN regexp_matches(substr(coalesce(html, ''), 1, 60000), '{'|'.join(P.CHALLENGES)}') OR contains(coalesce(url, ''), '{P.BLOCK_PAGE}') OR regexp_matches(substr(coalesce(html, ''), 1, 60000), '{P.REDIRECT.replace("'", "''")}') THEN 'blocked' WHEN len(regexp_extract_all(html, '<a ')) = 0 THEN 'empty' ELSE 'ok' END AS v FROM pages)
SELECT host, {', '.join(f"count(*) FILTER (WHERE v = '{k}') AS {k}" for k in ('ok', 'empty', 'blocked', 'gone', 'down', 'error'))} FROM v GROUP BY host""")
def probe_verdicts(spark, sf_dir):
    rows = F.size(F.regexp_extract_all("html", F.lit("(<a )"), F.lit(1)))
    probes = table(spark, sf_dir, "pages").select(F.regexp_extract("url", U.PARTS, 1).alias("host"), P.verdict(F.lit(200), rows, P.is_challenge(F.col("html"), F.col("url"))).alias("verdict"))
    return P.verdict_table(probes, "host")


@query("""WITH l AS (SELECT event_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, user_id FROM events) SELECT event_id FROM l WHERE b IS NULL OR b <> event_type""")
def change_log(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("_b", before).where(~F.col("event_type").eqNullSafe(F.col("_b"))).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT event_type, epoch_us(ts) // 1000000 AS t FROM events),
slot(event_type, slot_start) AS (SELECT event_type, min(t) FROM e GROUP BY 1
  UNION ALL SELECT s.event_type, min(e.t) FROM slot s JOIN e ON e.event_type = s.event_type AND e.t >= s.slot_start + 2400 GROUP BY s.event_type, s.slot_start)
SELECT event_type, slot_start, (SELECT count(*) FROM events x WHERE x.event_type = s.event_type AND epoch_us(x.ts) // 1000000 >= s.slot_start AND epoch_us(x.ts) // 1000000 < s.slot_start + 2400) AS n FROM slot s""")
def history_slots(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return Y.slot_starts(events, "event_type", "ts").groupBy("event_type", "slot_start").agg(F.count(F.lit(1)).alias("n"))


@query()
def issue_board(spark, sf_dir):
    """Issues among parts as posts: brands are sources, names and types the titles."""
    from datetime import datetime

    from tidemark.operators import issues as I

    i = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("no"), F.col("p_size").cast("string")))
    rows = R.numbered(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")]).select(
        i.alias("id"), F.col("p_brand").alias("source"), title.alias("title"), i.cast("string").alias("url_key"), "rank",
        (F.col("p_retailprice") / 20).alias("rank_score"), F.col("p_size").cast("long").alias("comments"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), i.cast("int") % 24)).alias("event_ts"),
    )
    history = rows.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("round_no"), "url_key", "id").where(F.col("id") % 5 <= F.col("round_no")).select("round_no", "url_key")
    return I.board(I.issues(rows, history, datetime(2024, 1, 2))).select("issue", "key", "name", "kind", "status", "n", "sources", "heat")

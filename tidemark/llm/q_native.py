"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import licenses, line_dedup, mixing, sharding
from tidemark.session import ensure_checkpoint_dir, table


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken from each, repeats counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             1.5 * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, 2.0 * source_size / weight AS ratio,
        (budget - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, ratio) FILTER (WHERE level <= ratio) AS level FROM l),
t AS (SELECT l.source, l.source_size, least(2.0 * l.source_size, coalesce(f.level * l.weight, 2.0 * l.source_size))::DOUBLE AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
e AS (SELECT d.doc_id, d.size, r.source, r.source_size, r.target, r.rate, x.seed,
        CASE WHEN ('0x' || substr(md5(x.seed || ':' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS more
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range(7, 23) x(seed)),
g AS (SELECT source, seed, abs(sum(size * more) - (any_value(rate) - floor(any_value(rate))) * any_value(source_size)) AS off FROM e GROUP BY source, seed),
b AS (SELECT source, first(seed ORDER BY off, seed) AS seed FROM g GROUP BY source)
SELECT e.doc_id, e.size, e.source_size, e.target, (e.size * (floor(e.rate) + e.more))::BIGINT AS taken
FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.seed = b.seed
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document, and the licence that its entire text is, if any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "canonical_sha256", "license_id")


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.COPYRIGHT_LINE}', '', 'g')"
    out = f"trim(regexp_replace({out}, '{licenses.NOT_WORD}', ' ', 'g'))"
    for one, other in licenses.EQUIVALENT:
        out = f"replace({out}, '{one}', '{other}')"
    return out


def _sql_known() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in {**licenses.TEXTS, **licenses.NOTICES}.items())


OP4_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(id) AS license_id FROM (VALUES {_sql_known()}) v(id, t) GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, k.license_id FROM d LEFT JOIN k ON d.canonical_sha256 = k.digest
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without its host's boilerplate lines."""
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.page_text(F.col("html")).alias("text"))
    return line_dedup.drop_lines(pages, "host", "text", counts=True).select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{line_dedup.HOST}', 1)), '') AS host,
    regexp_replace(regexp_replace(html, '{line_dedup.UNSEEN}', chr(10), 'g'), '{line_dedup.TAG}', chr(10), 'g') AS text FROM pages),
r AS (SELECT *, row_number() OVER () AS rid FROM p),
l AS (SELECT rid, page_id, host, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM r),
t AS (SELECT host, count(*) AS pages FROM r GROUP BY host),
c AS (SELECT host, trim(line) AS line, count(DISTINCT rid) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
b AS (SELECT c.host, c.line FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE c.n > {line_dedup.RATIO} * t.pages AND c.n >= {line_dedup.MIN_WITH}),
k AS (SELECT l.*, b.line IS NOT NULL AS dropped FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND trim(l.line) = b.line),
o AS (SELECT rid, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text FROM k GROUP BY rid)
SELECT r.page_id, r.host, coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_dropped, 0)::BIGINT AS n_dropped, sha256(o.text) AS text_sha256
FROM r LEFT JOIN o USING (rid)
"""

ARRIVALS = 16


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as arrivals, compacted, and read back by the manifest, with the merges left to do."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.Store(spark, f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes=32 << 20, base_bytes=1 << 20)
    store.append(docs.withColumn("_arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).cast("int")), "_arrival")
    store.compact(keep_old=False)
    found = store.read().select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    return found.withColumn("pending_merges", F.lit(store.pending()).cast("long"))


#: Every row comes back as it was, and no merge is left to do.
OP9_SQL = "SELECT doc_id, source, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256, 0::BIGINT AS pending_merges FROM documents"

QUERIES = {"op4_license_scan": op4_license_scan, "op5_mixing": op5_mixing, "op8_line_dedup": op8_line_dedup, "op9_sharding": op9_sharding}
ORACLES = {"op4_license_scan": OP4_SQL, "op5_mixing": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_sharding": OP9_SQL}

"""Queries of dominance counting, document fingerprints and the filter audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dominance, filter_audit, fingerprints
from tidemark.session import cut, table


def slot_of(sold_at: Column, kind: str) -> Column:
    """Days since 1970 of a time, as UTC; of a time without a zone whatever the session's zone is."""
    if kind == "timestamp_ntz":
        return F.datediff(sold_at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.floor(F.unix_seconds(sold_at) / 86400).cast("long")


def level_of(total: Column) -> Column:
    """Tens of units of a total rounded to hundredths; null for null, NaN and infinite totals."""
    number = F.when(~F.isnan(total) & (F.abs(total) < float("inf")), total)
    return F.floor(F.floor(F.lit(100.0) * number + 0.5).cast("double") / 1000).cast("long")


def op11_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sale the sales above it, and the rows that those stand for. A sale without an id stands for one row."""
    sales = table(spark, sf_dir, "sales")
    weight = 1 + F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 3, F.lit(0))
    rows = sales.select("sale_id", slot_of(F.col("sold_at"), dict(sales.dtypes)["sold_at"]).alias("slot"), level_of(F.col("total")).alias("level"), weight.alias("weight"))
    return dominance.above(rows).select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))


#: crc32 in SQL: each byte is followed by eight marks -1, one for each of its bits.
OP11_SQL = """
WITH s AS (SELECT sale_id, CAST(floor(epoch(sold_at) / 86400) AS BIGINT) AS slot,
    CAST(floor(floor(100.0::DOUBLE * total + 0.5) / 1000) AS BIGINT) AS level,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(sale_id::VARCHAR, ''),
        lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc FROM sales),
r AS (SELECT sale_id, slot, level, 1 + coalesce(xor(crc, 4294967295) % 3, 0) AS w FROM s),
c AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM r WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
a AS (SELECT q.slot, q.level, sum(o.n) AS n, sum(o.w) AS w FROM c q JOIN c o ON o.slot <= q.slot AND o.level > q.level GROUP BY q.slot, q.level)
SELECT r.sale_id, r.slot, r.level,
  CASE WHEN r.slot IS NOT NULL AND r.level IS NOT NULL THEN coalesce(a.n, 0)::BIGINT END AS n_sales,
  CASE WHEN r.slot IS NOT NULL AND r.level IS NOT NULL THEN coalesce(a.w, 0)::BIGINT END AS n_rows
FROM r LEFT JOIN a ON r.slot = a.slot AND r.level = a.level
"""

#: Searches are the documents whose id this divides.
EVERY = 50


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; n_near, for every fiftieth id, is the number of documents near it."""
    found = cut(fingerprints.compared(table(spark, sf_dir, "documents").select("doc_id", "text")))
    near = fingerprints.near_counts(found, found.where(F.col("doc_id") % EVERY == 0))
    asked = found.where(F.col("doc_id") % EVERY == 0).join(near, ["f1", "f2"])
    rest = found.where(F.coalesce(F.col("doc_id") % EVERY != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long"))
    return asked.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("f1"), F.col("f2")).alias("fingerprint"),
        fingerprints.as_text(F.col("e1"), F.col("e2")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, in all their orders."""
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = rf"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT t.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
d AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
f(i, letter) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
o AS (SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.i, b.i, x.i, y.i, z.i] AS places
  FROM f a JOIN f b ON b.i <> a.i JOIN f x ON x.i NOT IN (a.i, b.i) JOIN f y ON y.i NOT IN (a.i, b.i, x.i) JOIN f z ON z.i NOT IN (a.i, b.i, x.i, y.i)),
s AS (SELECT filter_order, step, 1 << places[step] AS own, coalesce(list_sum([1 << p for p in places[1:step - 1]]), 0)::BIGINT AS before
  FROM o, range(1, 6) r(step)),
e AS (SELECT c.part, s.filter_order, s.step, s.own,
    sum(CASE WHEN (c.mask & (s.before | s.own)) = 0 THEN c.n ELSE 0 END) AS kept,
    sum(CASE WHEN (c.mask & s.own) <> 0 AND (c.mask & s.before) = 0 THEN c.n ELSE 0 END) AS removed,
    sum(CASE WHEN (c.mask & s.own) <> 0 AND (c.mask & s.before) <> 0 THEN c.n ELSE 0 END) AS redundant,
    sum(CASE WHEN c.mask = s.own THEN c.n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (c.mask & s.own) <> 0 AND (c.mask & s.before) = 0 THEN c.good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (c.mask & s.own) <> 0 AND (c.mask & s.before) = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY c.part, s.filter_order, s.step, s.own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM e
"""

QUERIES = {"op11_dominance": op11_dominance, "op12_fingerprints": op12_fingerprints, "op13_filter_audit": op13_filter_audit}
ORACLES = {"op11_dominance": OP11_SQL, "op13_filter_audit": OP13_SQL}

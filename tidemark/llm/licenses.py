"""Licence scans by canonical digest, with DataFrame functions only.

A text is brought to a canonical form (lower-case A-Z, without copyright lines, one spelling, words parted by
single spaces) and its SHA-256 looked up among the digests of known licence texts by a hash join on the entire
text. The known texts are a parameter with a checked size, so the join broadcasts them and documents don't move.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, aside, back
from tidemark.llm.license_texts import NOTICES, TEXTS

#: What follows "copyright" at the start of a wrapped line of prose, not of one that names a holder.
PROSE = (
    "a act all also an and any applies are as at because but can cannot claim claims convention date disclaimer doctrines does file files "
    "for from has have header headers holder holders if in including information infringement interest interests is issues it its "
    "law laws licence licences license licensed licenses material may not notice notices of on or owner owners ownership patent patents "
    "permission permissions protection resulting rights shall statement statements status term terms than that these this those to "
    "treaties treaty under violation was were which will with work works year"
).split() + ["the library", "the program", "the software", "the work"]


def _unlike(phrases: list[str], seen: str = "") -> str:
    """A pattern, without lookahead, of the start of a line's rest that is none of the phrases."""
    after = sorted({p[len(seen)] for p in phrases if p.startswith(seen) and p != seen})
    letters = "".join(c for c in after if c != " ")
    free = "".join(c for c in LOWER if c not in letters)
    if seen in phrases:
        here = f"[{free}]"
    elif not seen:
        here = f"[{free}]|[^\\x00-\\x7f]"
    elif " " in after:
        here = rf"[^{letters} \t\r\n]"
    elif seen.endswith(" "):
        here = f"[{free}0-9]"
    else:
        here = rf"[^{letters}\n]|$"
    return "(?:" + "|".join([here, *[("[ \\t]+" if c == " " else c) + _unlike(phrases, seen + c) for c in after]]) + ")"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name a copyright holder, in Java's and RE2's syntax.
COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*(?:portions )?(?:(?:copyright *)?©|copyright *\(c\)|\(c\)[ \t]*[0-9<\[{])[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
    rf"|^[^a-z0-9\n]*(?:portions )?copyright(?:[ \t]*[:,][ \t]*|[ \t]+)(?:[0-9<\[{{]|{_unlike(PROSE)})[^\n]*$"
)
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Spellings that licence matching treats as equal, as stems: first becomes second.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("analys", "analyz"), ("artefact", "artifact"), ("authoris", "authoriz"), ("cancelled", "canceled"), ("capitalis", "capitaliz"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasis", "emphasiz"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"),
    ("maximis", "maximiz"), ("modelled", "modeled"), ("non commercial", "noncommercial"), ("offence", "offense"), ("optimis", "optimiz"),
    ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"),
    ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
)


def canonical(text: Column) -> Column:
    """The canonical form; null gives null."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, license_sha256) of known texts; of texts with one canonical form the first id counts."""
    texts = {**TEXTS, **NOTICES} if texts is None else texts
    if len(texts) > BROADCAST_ROWS:
        raise ValueError("this many known texts belong in a table; join its digests without a broadcast")
    if not texts:
        return spark.sql("SELECT '' license_id, '' license_sha256 WHERE false")
    rows = F.explode(F.from_json(F.lit(json.dumps(texts)), "map<string,string>")).alias("license_id", "text")
    found = spark.range(1).select(rows).select("license_id", F.sha2(canonical(F.col("text")), 256).alias("license_sha256"))
    return found.groupBy("license_sha256").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """docs with canonical_sha256 and license_id, null where the entire text is no known licence.

    Columns of these names are replaced. Null text has no digest; texts without words share the digest of the
    empty form, which no licence has.
    """
    out = aside(docs).withColumn("canonical_sha256", F.sha2(canonical(F.col(f"in_{text}")), 256))
    table = known(docs.sparkSession, texts).where(F.col("license_sha256") != F.sha2(F.lit(""), 256))
    found = out.join(F.broadcast(table), F.col("canonical_sha256") == F.col("license_sha256"), "left")
    return back(found, docs.columns, F.col("canonical_sha256"), F.col("license_id"))

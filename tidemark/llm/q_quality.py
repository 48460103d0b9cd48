"""Queries of the quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import classifier
from tidemark.llm import quality_rules as rules
from tidemark.session import cut, table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = cut(rules.with_counts(docs).drop("text"))
    return rules.judged(rows, rules.fit(rows)).select("doc_id", *[f"_c.{c}" for c in rules.COUNTS], "base_failed", "kept", "distance2")


THRESHOLD = 0.3


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of a fifth, by checksum of the id, are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fifth = lambda x: F.crc32(F.col(x).cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fifth("doc_id") != 0)
    model = classifier.fit(docs, labels)
    scored = docs.select("doc_id", F.coalesce(fifth("doc_id") == 0, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier, "op6_quality_rules": op6_quality_rules}
ORACLES: dict = {}

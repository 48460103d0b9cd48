"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard_join
from tidemark.session import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES = {"op1_jaccard_join": op1_jaccard_join}
ORACLES: dict = {}

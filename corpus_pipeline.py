"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, byte-level BPE.

Each stage takes all that the stage before kept and returns the columns of documents, but for the last, which
returns what the encoding gives. Columns beside those of documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, mixing, quality_rules
from tidemark.llm.common import remove
from tidemark.llm.q_tokens import bpe_columns
from tidemark.session import ensure_checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    Null and empty texts have no words and go; a null language or source is a group like others; repeated rows are judged
    alike; an empty table stays empty.
    """
    return quality_rules.accepted(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that over a tenth of a source's documents have (three at least) are cut from texts; n_chars follows.

    No row goes: null text stays null with null n_chars, a text whose lines all go is empty; repeated rows count as
    documents of their own; an empty table stays empty.
    """
    cut = line_dedup.drop_lines(docs, "source", "text")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the document of least id stays.

    Null, empty and blank texts link with nothing and stay, as do rows without an id; rows of the least id stay however
    often they're repeated; an empty table stays empty.
    """
    return jaccard_join.without_near_copies(docs, k=5, percent=80).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks.

    Null and empty texts have size 0 and are taken at their source's rate; null sources are one source; rows of one
    id and source decide alike; a table without words, or without rows, gives none.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to, as digests.

    Null and empty texts have no ids; a row for each row, repeated ones too; an empty table gives none.
    """
    import public_tokenizers as P

    return bpe_columns(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [("quality rules", rules), ("line dedup", lines), ("near copies", near_copies), ("mixing", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what the last reads stays there."""
    import uuid

    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
        if at:
            remove(spark, f"{folder}/{at - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

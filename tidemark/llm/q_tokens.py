"""Queries of the token operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, token_files
from tidemark.llm.common import remove
from tidemark.session import ensure_checkpoint_dir, table


def bpe_columns(docs: DataFrame, rank_file: str, pattern: str, **memory: int) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of whole texts, encoded and decoded."""
    return docs.select("doc_id", bpe.digests(F.col("text"), rank_file, pattern, **memory).alias("d")).select("doc_id", "d.*")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text, there and back."""
    import public_tokenizers as P

    return bpe_columns(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_bytes=96 << 20, slice_bytes=6 << 20)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to range-coded files and read back."""
    import public_tokenizers as P

    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder, P.path("byte_bpe_50k.json"))
    found = token_files.documents(token_files.checksums(spark, folder))
    remove(spark, folder)  # the checksums are a checkpoint by now
    return found


QUERIES = {"op7_token_files": op7_token_files, "op10_bpe": op10_bpe}
ORACLES: dict = {}

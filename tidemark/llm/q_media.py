"""Query of the media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import media
from tidemark.session import table


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a PNG image and back."""
    stored = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.png(F.col("text")).alias("media"))
    back = stored.withColumn("back", media.read_png(F.col("media"))).withColumn("payload", F.col("back.payload"))
    return back.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("back.feature").alias("feature"),
    )


QUERIES = {"op3_media": op3_media}
ORACLES: dict = {}

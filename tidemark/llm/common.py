"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a checkpointed side of a join is broadcast; beyond it Spark joins by shuffling.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has few rows. df should be a checkpoint: it's read for this."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def aside(df: DataFrame) -> DataFrame:
    """df with all columns renamed to in_<name>, out of the way of an operator's own names."""
    return df.toDF(*[f"in_{c}" for c in df.columns])


def back(df: DataFrame, columns: list[str], *new: Column) -> DataFrame:
    """Columns put aside under their names again, then new ones, which replace those of their names whatever the case."""
    made = df.select(*new).columns if new else []
    taken = {c.lower() for c in made}
    return df.select(*[F.col(f"in_{c}").alias(c) for c in columns if c.lower() not in taken], *new)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory of a Python worker to the machine; for the end of a task, as the worker waits for others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc has its own ways
        pass

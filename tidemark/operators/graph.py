"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of a task -> (node, component), by union-find with the least node as root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, find(x)) for x in list(root)], columns=["node", "component"], dtype="int64")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60, one_task_rows: int = 0) -> DataFrame:
    """(node, component) of every node of an edge, component being the least node that it's connected with.

    Rounds of large-star and small-star: each hangs a node's larger neighbours, then its smaller ones, on its least
    neighbour. Edges never grow in number, and a chain halves in each round. Edges with a null are left out; loops
    give a component of one node. Up to one_task_rows distinct edges, a single task does without rounds; for tables that
    are small by nature, with nodes of type long.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if one_task_rows and now.limit(one_task_rows + 1).count() <= one_task_rows:
        return now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInPandas(_in_one_task, "node long, component long")
    nodes = now
    mark = None
    for _ in range(most_rounds):
        links = now.where("u <> v")
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components don't settle in {most_rounds} rounds")
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(now.select(F.col("u").alias("node"), F.col("v").alias("_c")), "node", "left").select("node", F.coalesce("_c", "node").alias("component"))

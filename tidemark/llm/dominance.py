"""Dominance counting: for each row how many rows stand above it, that is have no larger slot and a strictly larger level.

1. Cells. Rows of one slot and level are one cell with its number of rows and its weight, summed before anything is shuffled,
   so a hot slot, level or cell goes on as few rows.
2. Ranges. Cells are range-partitioned by slot and, within a slot, from the highest level down. In that order all cells above
   one come before it, so tied slots are one batch that may begin in one partition and end in another. A task sweeps its
   partition with a Fenwick tree over its compressed levels (_swept).
3. Scan. What earlier partitions hold above a level comes from their histograms by level: those are range-partitioned by level
   into bands, and a task walks all partitions' histograms of one band in order, with a Fenwick tree over the band's
   levels; for each (partition, level) it gives the suffix within the band, and for each partition the band's whole sum so far.
   A running sum of the latter over higher bands, a window for each partition, gives the rest.
4. Each cell's count is the sum of the three, and goes back to its rows by a join.

No task gets more than a range of cells, a band of histograms or a row for each band; nothing but two numbers (cells and
partitions) comes to the driver, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import aside, back
from tidemark.session import cut

#: Cells of a range; a task holds its range in columns of 8 bytes.
CELLS = 1_000_000
#: Cells that are compared with each other directly, between two uses of the tree.
BATCH = 256


class Fenwick:
    """Sums over places 1 to size, of several values at once."""

    def __init__(self, size: int, width: int) -> None:
        self.tree = np.zeros((size + 1, width), np.int64)

    def add(self, places: np.ndarray, values: np.ndarray) -> None:
        while len(places):
            np.add.at(self.tree, places, values)
            places = places + (places & -places)
            inside = places < len(self.tree)
            places, values = places[inside], values[inside]

    def upto(self, places: np.ndarray) -> np.ndarray:
        """Sums over the places from 1 to each of places."""
        out, places = np.zeros((len(places), self.tree.shape[1]), np.int64), places.copy()
        while (left := places > 0).any():
            out[left] += self.tree[places[left]]
            places &= places - 1
        return out


def before_and_above(levels: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the sums of values over the rows before it that have a strictly larger level."""
    distinct, rank = np.unique(levels, return_inverse=True)
    place = len(distinct) - rank  # the highest level has place 1
    tree, out = Fenwick(len(distinct), values.shape[1]), np.zeros_like(values)
    for at in range(0, len(levels), BATCH):
        p, v = place[at : at + BATCH], values[at : at + BATCH]
        out[at : at + BATCH] = tree.upto(p - 1) + np.tril(p[None, :] < p[:, None], -1).astype(np.int64) @ v
        tree.add(p, v)
    return out


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """Columns of all batches of a task as whole numbers; None if it has no rows."""
    found = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c).astype(np.int64) for c in zip(*found)] if found else None


def _batch(names: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names.split())


_SWEPT = "_part long, _slot long, _level long, _n long, _w long, _own_n long, _own_w long"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_part, _slot, _level, _n, _w) by slot, level falling -> the same with what the partition has above each."""
    if found := _columns(batches):
        part, slot, level, n, w = found
        own = before_and_above(level, np.stack([n, w], axis=1))
        yield _batch("_part _slot _level _n _w _own_n _own_w", part, slot, level, n, w, own[:, 0], own[:, 1])


_SCANNED = "_part long, _level long, _band long, _n long, _w long"


def _scanned(parts: int):
    """Rows (_band, _part, _level, _n, _w) of one band by part, level rising -> what earlier parts have above each level in
    the band, and in rows without a level what they have in the whole band, for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _columns(batches):
            band, part, level, n, w = found
            values = np.stack([n, w], axis=1)
            early = before_and_above(level, values)  # within a part levels rise, so none before is larger
            yield _batch("_part _level _band _n _w", part, level, band, early[:, 0], early[:, 1])
            sums = np.zeros((parts + 1, 2), np.int64)
            np.add.at(sums, part + 1, values)
            sums = np.cumsum(sums, axis=0)[:parts]
            for at in range(0, parts, 10_000):
                some = sums[at : at + 10_000]
                yield _batch("_part _level _band _n _w", np.arange(at, at + len(some)), pa.nulls(len(some), pa.int64()), np.full(len(some), band[0]), some[:, 0], some[:, 1])

    return run


def _cell_counts(cells: DataFrame, per_range: int) -> DataFrame:
    """(_slot, _level, _n, _w) of different cells -> (_slot, _level, _above_n, _above_w)."""
    ranges = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // per_range))
    order = [F.col("_slot").asc(), F.col("_level").desc()]
    ranged = cells.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id().cast("long"))
    swept = cut(ranged.sortWithinPartitions(*order).select("_part", "_slot", "_level", "_n", "_w").mapInArrow(_swept, _SWEPT))
    parts = (swept.agg(F.max("_part")).first()[0] or 0) + 1
    histograms = swept.groupBy("_part", "_level").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"))
    bands = histograms.repartitionByRange(ranges, "_level").withColumn("_band", F.spark_partition_id().cast("long"))
    scanned = cut(bands.sortWithinPartitions("_part", "_level").select("_band", "_part", "_level", "_n", "_w").mapInArrow(_scanned(parts), _SCANNED))
    higher = Window.partitionBy("_part").orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = scanned.where("_level IS NULL").select("_part", "_band", F.sum("_n").over(higher).alias("_more_n"), F.sum("_w").over(higher).alias("_more_w"))
    more = lambda x: F.col(f"_{x}") + F.coalesce(F.col(f"_more_{x}"), F.lit(0))
    early = scanned.where("_level IS NOT NULL").join(sums, ["_part", "_band"]).select("_part", "_level", more("n").alias("_early_n"), more("w").alias("_early_w"))
    return swept.join(early, ["_part", "_level"]).select("_slot", "_level", (F.col("_own_n") + F.col("_early_n")).alias("_above_n"), (F.col("_own_w") + F.col("_early_w")).alias("_above_w"))


def above(rows: DataFrame, slot: str = "slot", level: str = "level", weight: str = "weight", per_range: int = CELLS) -> DataFrame:
    """rows with n_above and w_above: number and weight of the rows of smaller or equal slot and strictly larger level.

    Slots, levels and weights are whole numbers (cast to long). Rows without a slot or level are above none, and their own
    counts are null; a null weight is 0; rows that nothing is above have 0. Repeated rows each count; equal slots see each other,
    equal levels don't. Columns of rows named n_above or w_above are replaced, all others stay. An empty table gives no rows.
    """
    base = aside(rows).withColumns({"_slot": F.col(f"in_{slot}").cast("long"), "_level": F.col(f"in_{level}").cast("long"), "_weight": F.coalesce(F.col(f"in_{weight}").cast("long"), F.lit(0))})
    whole = F.col("_slot").isNotNull() & F.col("_level").isNotNull()
    cells = cut(base.where(whole).groupBy("_slot", "_level").agg(F.count(F.lit(1)).alias("_n"), F.sum("_weight").alias("_w")))
    counts = cut(_cell_counts(cells, per_range))
    out: list[Column] = [F.col("_above_n").alias("n_above"), F.col("_above_w").alias("w_above")]
    none = [F.lit(None).cast("long").alias(x) for x in ("n_above", "w_above")]
    known = base.where(whole).join(counts, ["_slot", "_level"])
    return back(known, rows.columns, *out).unionByName(back(base.where(~whole), rows.columns, *none))

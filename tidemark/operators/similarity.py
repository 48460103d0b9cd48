"""Token statistics and set similarity for titles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import numbered
from tidemark.session import cut

DUPLICATE, NUMBER_HOME = 0.45, 0.2
#: Sets of a block, elements that one product of blocks takes at once, and pairs that are handed on together.
BLOCK, SLICE, OUT_ROWS = 1000, 4096, 50_000


def token_idf(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 0.5)); tokens is an array of distinct strings."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    df = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", "df", F.log((n.scalar() + 1) / (F.col("df") + 0.5)).alias("idf"))


def cooccurrence(rows: DataFrame, tokens: str, least: int = 2) -> DataFrame:
    """(a, b, n) for token pairs a < b that least rows hold together; pairs are made within a row's tokens only."""
    ordered = F.array_sort(tokens)
    pairs = F.flatten(F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _shared(left: tuple, right: tuple, columns: int) -> np.ndarray:
    """Numbers of common elements of each row of left and of right, as (row, column) places of their elements; columns go in slices."""
    out = np.zeros((left[2], right[2]), np.float32)
    for begin in range(0, columns, SLICE):
        sides = []
        for rows, places, n in (left, right):
            here = (places >= begin) & (places < begin + SLICE)
            side = np.zeros((n, min(SLICE, columns - begin)), np.float32)
            side[rows[here], places[here] - begin] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _met(group: pa.RecordBatch, least: float) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(a, b, jaccard) of the pairs of a group (_e, _i, _j, _c, _k, _n, _o) whose first common element is _e: of blocks _i and _j."""
    e, i, j = (group.column(c)[0].as_py() for c in range(3))
    block, sizes, keys, sets = group.column(3).to_numpy(), group.column(5).to_numpy().astype(np.float64), group.column(4), group.column(6)
    names, values = keys.to_numpy(zero_copy_only=False), sets.flatten().to_numpy()
    row = np.repeat(np.arange(len(block)), sets.value_lengths().to_numpy())
    different, place, often = np.unique(values, return_inverse=True, return_counts=True)

    def side(of: np.ndarray, elements: np.ndarray) -> tuple[tuple, int]:
        """The rows of a side, by their elements among some that more than one row has."""
        at, to = np.full(len(block), -1), np.full(len(different), -1)
        at[of], to[elements] = np.arange(len(of)), np.arange(len(elements))
        mine = (at[row] >= 0) & (to[place] >= 0)
        return (at[row[mine]], to[place[mine]], len(of)), len(elements)

    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    counts = []
    for some in (different < e, different >= e):
        elements = np.flatnonzero(some & (often > 1))
        counts.append(_shared(side(a, elements)[0], side(b, elements)[0], len(elements)))
    both = counts[1].astype(np.float64)
    jaccard = both / (sizes[a][:, None] + sizes[b][None, :] - both)
    fits = (counts[0] == 0) & (jaccard >= least)
    if i == j:
        fits &= names[a][:, None] < names[b][None, :]
    x, y = np.nonzero(fits)
    first, second = a[x], b[y]
    turned = names[first] > names[second]
    return keys.take(pa.array(np.where(turned, second, first))), keys.take(pa.array(np.where(turned, first, second))), jaccard[x, y]


def _pairs(least: float):
    """Rows of groups, sorted by group -> their pairs. Holds a group, which is two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, out, n = None, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in out]), pa.concat_arrays([x[1] for x in out]), pa.array(np.concatenate([x[2] for x in out]))], ["a", "b", "jaccard"])

        def closed() -> int:
            found = _met(pa.concat_batches(held), least)
            held.clear()
            if len(found[0]):
                out.append(found)
            return len(found[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = (np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0)) + 1).tolist()
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                here = tuple(groups[:, begin].tolist())
                if held and here != at:
                    n += closed()
                    if n >= OUT_ROWS:
                        yield made()
                        out, n = [], 0
                at = here
                held.append(batch.slice(begin, end - begin))
        if held:
            closed()
        if out:
            yield made()

    return run


def jaccard_pairs(rows: DataFrame, key: str, sets: str, least: float = DUPLICATE) -> DataFrame:
    """(a, b, jaccard) for keys a < b whose sets have at least that Jaccard similarity; exact, by prefixes in order of rarity.

    Two such sets share an element among the first size - ceil(least * size) + 1 of each under any common order; the rarest
    elements first keeps lists short. An element's list is dealt to blocks, and a task counts the common elements of two blocks by one
    product of matrices. A pair is made at its first common element alone, so no pair is made twice.
    """
    kind = rows.schema[key].dataType.simpleString()
    base = rows.select(F.col(key).alias("_k"), F.col(sets).alias("_s")).where(F.size("_s") > 0)
    each = base.select("_k", F.size("_s").alias("_n"), F.explode(F.array_distinct("_s")).alias("_v"))
    order = numbered(each.groupBy("_v").agg(F.count(F.lit(1)).alias("_df")), [F.asc("_df"), F.asc("_v")], "_e")
    ranked = each.join(order.where("_df > 1").select("_v", "_e"), "_v", "left").groupBy("_k", "_n").agg(F.array_sort(F.collect_list("_e")).alias("_o"), F.count_if(F.col("_e").isNull()).alias("_alone"))
    # elements of one set alone come first in the order and are in no pair
    first = F.greatest(F.lit(0), F.col("_n") - F.ceil(F.lit(least) * F.col("_n")) + 1 - F.col("_alone")).cast("int")
    prefix = cut(ranked.select("_k", "_n", "_o", F.explode(F.slice("_o", F.lit(1), first)).alias("_e")))
    lists = prefix.groupBy("_e").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_e", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    dealt = prefix.join(lists, "_e").withColumn("_c", F.pmod(F.xxhash64("_k"), F.col("_blocks").cast("long")).cast("int"))
    sent = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = sent.select("_e", F.least("_x", "_c").alias("_i"), F.greatest("_x", "_c").alias("_j"), "_c", "_k", "_n", "_o")
    return sent.repartition("_e", "_i", "_j").sortWithinPartitions("_e", "_i", "_j").mapInArrow(_pairs(least), f"a {kind}, b {kind}, jaccard double")

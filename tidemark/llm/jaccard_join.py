"""N-gram Jaccard join: an exact metric-space join of documents' shingle sets, given as links' components.

Jaccard distance is a metric, so pivots prune: with radius r, documents x and y can only be within r if their
distances to any pivot differ by r at most. But shingle sets of unrelated documents all lie at distance 1 from
each other and from almost any pivot, where no window excludes anything. So the join first cuts the space
into blocks that no link crosses, and the metric recursion works within blocks.

1. Equal sets become one class (its least id stands for it); only classes go on.
2. Cover. Under one order of all shingles, two sets within r share one of the first n - ceil((1 - r) n) + 1 of
   each: the prefix. Rare shingles come first, by counts of all shingles in a table of fixed size; any counts
   give right results. Classes that share a prefix shingle and may match in size may link, and the components of
   those that may are the blocks. The more data, the less the table tells a shingle of few documents from one of
   its own, and passages of few would chain most sets into one block; so the pairs of a short list hang together only if
   their sketches allow a link. A long list, which copies and very common passages make, adds a star, not pairs, so
   copies don't square.
3. Recursion. A block too large for a task is dealt to Voronoi regions of pivots drawn from it by hash; a
   document also goes to each region whose pivot is at most 2 r farther than its nearest (the hyperplane
   window), and within a region to the ring of width r around the pivot that it lies in and the one before
   (the ball window). Every link has a region and ring with both its ends. Regions recur until they fit. Where the
   windows exclude too little to be worth the copies, a block goes to a grid of chunk pairs, which is exact as well.
4. What fits a task, a whole block or a region of a larger one, is dealt to regions and rings there in the same way, and each of
   these is joined by the product of its incidence matrix, in column tiles of bounded size. A task
   returns a spanning star of each local component and the number of links of each class; a link counts in
   the one region where its end of lesser id is at home.

Nothing but the table of counts (fixed size) and block sizes over the limit come to the driver. Text moves
only for classes in blocks, and only if too many for a broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, back, small
from tidemark.llm.shingles import forget, shingles, signature
from tidemark.operators.graph import components
from tidemark.session import cut

#: log2 of the counters that order shingles, and the counters of one row on their way.
COUNTER_BITS, CHUNK_BITS = 22, 16
#: Blocks and regions above either are dealt to regions: classes and shingles.
LEAF_DOCS, LEAF_SHINGLES = 64, 1_000_000
#: A task of the grid, for blocks whose windows exclude too little, joins so many times as much.
GRID = 8
PIVOTS, LEVELS = 8, 3
#: Sets of a region within a task that one pivot's rings do for; larger ones may have more pivots, and are cut again.
REGION_SETS = 32
#: A block is dealt to regions if their squared sizes come to less than this share of its own.
WORTH = 0.9
#: Shingles of this place in the order and after, which many sets may have, spread their sets over so many tasks.
HOT_RANK, SALTS = 200, 64
#: Sets that share a token are paired, and pairs checked, up to so many; more hang together unchecked.
RUN_SETS = 16
#: A sketch has a bucket for so many shingles of its set, and so many buckets at least (both powers of two).
SKETCH_LOAD, SKETCH_BUCKETS = 4, 32
#: Incidence columns of a tile.
TILE = 4096
#: Rows of block membership (two numbers each) up to which it's broadcast instead of moving text.
MEMBER_ROWS = 500_000


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64))


# 1 and 2: sets, counts, prefixes


def sketch(hashes: np.ndarray) -> bytes:
    """Numbers of a set's hashes by their first bits, modulo 16, two to a byte."""
    bits = max(len(hashes) // SKETCH_LOAD, SKETCH_BUCKETS).bit_length() - 1
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 15
    return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def may_link(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether sets of n and m hashes with these sketches may link: their buckets differ by no more than the sets do."""
    a, b = (np.stack([c & 15, c >> 4], axis=1).ravel() for c in (np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)))
    while len(a) != len(b):
        a, b = (c.reshape(-1, 2).sum(axis=1, dtype=np.uint8) if len(c) > min(len(a), len(b)) else c for c in (a, b))
    apart = (a - b) & 15
    differ = int(np.minimum(apart, 16 - apart).sum())
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def _described(k: int):
    """Rows (doc_id, n, s1, s2, sketch), then rows (chunk, counts) of the task's shingle counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, some = np.zeros(1 << COUNTER_BITS, np.uint32), False
        names = ["doc_id", "n", "s1", "s2", "sketch", "chunk", "counts"]
        for batch in batches:
            made = [shingles(x, k) for x in batch.column(1).to_pylist()]
            signs = np.array([signature(x) for x in made], np.int64).reshape(-1, 2)
            size, sketches = len(made), pa.array([sketch(x) for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), _long([len(x) for x in made]), _long(signs[:, 0]), _long(signs[:, 1]), sketches, pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
            for at in range(0, size, 1000):
                if len(flat := np.concatenate(made[at : at + 1000])):
                    np.add.at(counters, (flat & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64), 1)
                    some = True
        forget()
        if some:
            rows = np.minimum(counters, 255).astype(np.uint8).reshape(-1, 1 << CHUNK_BITS)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(rows), pa.binary()), pa.array(range(len(rows)), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in rows], pa.binary())], names)

    return run


def _summed(packed: bool):
    """Rows (chunk, counts) -> one of each chunk that a task has; packed: as a task of the first scan gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zlib.decompress(data.as_py()), np.uint8) if packed else np.frombuffer(data.as_py(), np.uint32)
                total[chunk] = total[chunk] + counts if chunk in total else counts.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    return run


def _rarity(described: DataFrame) -> np.ndarray:
    """Place of each counter in the order, later for larger counts; 2^COUNTER_BITS bytes, whatever the input.

    Tasks' tables are added in two levels, so that none gets more than about the root of their number.
    Counts are told apart in twelfths of the deviation that chance gives them, so that even a shingle of a few more
    documents than its counter's other ones comes after nearly all that are alone.
    """
    kind, groups = "chunk int, counts binary", max(1, round(described.rdd.getNumPartitions() ** 0.5))
    parts = described.where("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("_g"))
    parts = parts.repartition("chunk", "_g").select("chunk", "counts").mapInArrow(_summed(True), kind)
    parts = parts.repartition("chunk").mapInArrow(_summed(False), kind).collect()
    counts = np.zeros((1 << COUNTER_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.float64)
    for chunk, data in parts:
        counts[chunk] = np.frombuffer(data, np.uint32)
    counts = counts.ravel()
    load = counts.mean()
    z = (counts - load) / max(load, 0.05) ** 0.5
    return np.clip(np.where(z < 11, 64 + 12 * z, 196 + 3 * np.log2(np.maximum(z - 10, 1))), 0, 255).astype(np.uint8)


def _prefixes(k: int, percent: int, rarity, hot_rank: int):
    """Rows (token, salt, n, s1, s2) of each set's prefix, once a task for equal sets; salt is 0 but for hot tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen, mask = rarity.value, set(), np.uint64((1 << COUNTER_BITS) - 1)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 500):
                parts, rows = [], []
                for text in texts[at : at + 500]:
                    h = shingles(text, k)
                    if not len(h) or (sign := signature(h)) in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(sign)
                    n = len(h)
                    order = np.argsort((rank[h & mask].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)), kind="stable")
                    parts.append(h[order[: n - -(-percent * n // 100) + 1]])
                    rows.append((n, *sign))
                if parts:
                    lengths = [len(x) for x in parts]
                    columns, token = np.repeat(np.array(rows, np.int64), lengths, axis=0).T, np.concatenate(parts)
                    salt = np.where(rank[token & mask] >= hot_rank, 1 + columns[1] % SALTS, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *map(_long, (salt, *columns))], ["token", "salt", "n", "s1", "s2"])
        forget()

    return run


_STARS = "a1 long, a2 long, b1 long, b2 long, pair boolean, token long, low long, high long"


def _stars(percent: int, paired: bool):
    """Rows (a1, a2, b1, b2, pair) of sets that share a token: all pairs of a short run that match in size, or of a long one all sets
    to its first; and of each run of a hot token, which has runs in other tasks, a row (a1, a2, token, low, high) with its
    first set and its sizes. Runs of hot tokens, and all where not paired, count as long.

    Input sorted by token, salt, low, high, s1, s2: sets have one size, runs of a task before two. A run ends where the
    next set is too large to match the largest before, so no match spans two runs.
    """
    names = [x.split()[0] for x in _STARS.split(", ")]

    def edges(found: np.ndarray, pair: bool) -> pa.RecordBatch:
        found = np.unique(found, axis=1)
        none = pa.nulls(found.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([*map(_long, found), pa.array(np.full(found.shape[1], pair)), none, none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the run that goes on: of a long one its first set and the largest size so far, else all its sets
        carry, carried_long = np.empty((6, 0), np.int64), False
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows = carry if batch is None else np.hstack([carry, np.array([c.to_numpy() for c in batch.columns])])
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]  # equal sets of several tasks
            token, salt, low, high, s1, s2 = rows
            same_key = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            # the largest size so far within a token and salt: sizes are in order of low, so only high needs it
            group = np.cumsum(np.concatenate(([True], ~same_key)))
            step = np.int64(high.max()) + 1
            reach = np.maximum.accumulate(high + group * step) - group * step
            fresh = np.ones(len(token), bool)
            fresh[1:] = ~same_key | (100 * reach[:-1] < percent * low[1:])
            start = np.flatnonzero(fresh)
            number, size = np.cumsum(fresh) - 1, np.diff(np.append(start, len(token)))
            long = (size > RUN_SETS) | (salt[start] > 0) | (not paired)
            long[0] |= carried_long
            head = start[number]
            goes_on = batch is not None  # the last run
            short = ~long[number]
            if goes_on:
                short[start[-1] :] = False
            pairs = []
            for apart in range(1, RUN_SETS):
                i = np.flatnonzero(short[apart:] & (number[apart:] == number[:-apart]))
                if not len(i):
                    break
                i = i[100 * low[i] >= percent * low[i + apart]]
                pairs.append(np.stack([s1[i], s2[i], s1[i + apart], s2[i + apart]]))
            if pairs and (found := np.hstack(pairs)).shape[1]:
                yield edges(found, True)
            at = np.flatnonzero(long[number] & ~fresh & ((s1 != s1[head]) | (s2 != s2[head])))
            if len(at):
                yield edges(np.stack([s1[head[at]], s2[head[at]], s1[at], s2[at]]), False)
            last = np.append(start[1:] - 1, len(token) - 1)[: len(start) - goes_on]  # the ends of runs that are over
            over = np.array([token, salt, low[head], reach, s1[head], s2[head]])[:, last[salt[last] > 0]]
            if over.shape[1]:
                none, no = pa.nulls(over.shape[1], pa.int64()), pa.array(np.full(over.shape[1], False))
                yield pa.RecordBatch.from_arrays([_long(over[4]), _long(over[5]), none, none, no, _long(over[0]), _long(over[2]), _long(over[3])], names)
            if goes_on:
                first, carried_long = start[-1], bool(long[-1])
                carry = rows[:, first:] if not carried_long else np.array([[token[-1]], [salt[-1]], [low[first]], [reach[-1]], [s1[first]], [s2[first]]])

    return run


def _candidates(tokens: DataFrame, percent: int) -> DataFrame:
    """(a1, a2, b1, b2, pair) of sets that share a token; hot tokens in two rounds, the second over runs instead of sets."""
    key = ["token", "salt", "low", "high", "s1", "s2"]
    first = tokens.select("token", "salt", F.col("n").alias("low"), F.col("n").alias("high"), "s1", "s2")
    joined = lambda rows, paired: rows.select(*key).repartition("token", "salt").sortWithinPartitions(*key).mapInArrow(_stars(percent, paired), _STARS)
    stars = cut(joined(first, True).distinct())
    runs = stars.where("token IS NOT NULL").select("token", F.lit(0).cast("long").alias("salt"), "low", "high", F.col("a1").alias("s1"), F.col("a2").alias("s2"))
    ends = ["a1", "a2", "b1", "b2", "pair"]
    return stars.where("token IS NULL").select(*ends).unionByName(joined(runs, False).select(*ends)).distinct()


def _checked(percent: int):
    """Rows (a, b, pair, a_n, b_n, a_sketch, b_sketch) -> (a, b) without the pairs that can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *what = batch.columns
            may = [not pair or may_link(n, m, x, y, percent) for pair, n, m, x, y in zip(*(c.to_pylist() for c in what))]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(may, pa.bool_()))

    return run


# 3 and 4: regions

_MEMBER = "block string, doc_id long, copies long, hashes binary, home boolean, low int, chunk int"
_NAMES = [x.split()[0] for x in _MEMBER.split(", ")]


def _sets(k: int):
    """Rows (block, doc_id, copies, text) -> members with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            for at in range(0, size, 1000):
                block, doc_id, copies, text = batch.slice(at, 1000).columns
                data = pa.array([shingles(x, k).tobytes() for x in text.to_pylist()], pa.binary())
                m = len(data)
                yield pa.RecordBatch.from_arrays([block, doc_id, copies, data, pa.array([True] * m), pa.array([0] * m, pa.int32()), pa.array([0] * m, pa.int32())], _NAMES)
        forget()

    return run


def _dealt(radius: float, level: int, names_only: bool = False):
    """Members with their block's pivots -> members of regions and rings, home and low added up; or only (block, parent)."""

    def distance(x: np.ndarray, p: np.ndarray) -> float:
        both = np.count_nonzero(p[np.minimum(np.searchsorted(p, x), len(p) - 1)] == x)
        return 1 - both / (len(x) + len(p) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["hashes"], np.uint64)
                far = [distance(x, np.frombuffer(p, np.uint64)) for p in r["pivots"]]
                near = min(range(len(far)), key=far.__getitem__)
                for i, d in enumerate(far):
                    if d <= far[near] + 2 * radius + 1e-9:
                        ring = int(d / radius + 1e-9)
                        for at in {ring, max(ring - 1, 0)}:
                            rows.append((f"{r['block']}/{i}.{at}", r["doc_id"], r["copies"], r["hashes"], r["home"] and i == near, r["low"] | (at == ring) << level, 0))
            if names_only:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[0].rpartition("/")[0] for x in rows], pa.string())], ["block", "parent"])
                continue
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x)) for x in rows[at : at + 2000]], schema=_arrow_schema())

    return run


def _arrow_schema() -> pa.Schema:
    return pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("hashes", pa.binary()), ("home", pa.bool_()), ("low", pa.int32()), ("chunk", pa.int32())])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by tiles of the incidence matrix."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # others meet nothing
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), np.float32)
    wide = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, wide, TILE):
        a, b = np.searchsorted(column, (at, at + TILE))
        tile = np.zeros((m, min(TILE, wide - at)), np.float32)
        tile[owner[a:b], column[a:b] - at] = 1
        out += tile @ tile.T
    return out


def local_regions(sets: list[np.ndarray], radius: float, level: int = 0) -> list[np.ndarray]:
    """Places of sets by region: the Voronoi regions of pivots among them, each cut to rings; every pair within radius shares one.

    Pivots are drawn farthest first, over 2 radius from each other, so copies of one text have one pivot. A set is in each region whose
    pivot is at most 2 radius farther than its nearest, and there in the ring of width radius that it lies in and in the one before. Where several
    pivots' regions are more work than one's rings, the first pivot does. Regions above REGION_SETS are cut again where that makes them smaller.
    """
    m = len(sets)
    if m < 2:
        return []
    far = [1 - _shared(sets, sets[level % m])]
    while len(far) < PIVOTS and m > REGION_SETS and (least := np.min(far, axis=0)).max() > 2 * radius:
        far.append(1 - _shared(sets, sets[int(least.argmax())]))
    one, all_of = _rings(np.stack(far[:1], axis=1), radius), _rings(np.stack(far, axis=1), radius)
    out = []
    for at in min(one, all_of, key=_work):
        again = REGION_SETS < len(at) < 0.9 * m and level + 1 < LEVELS
        out += [at[x] for x in local_regions([sets[i] for i in at], radius, level + 1)] if again else [at]
    return out


def _work(regions: list[np.ndarray]) -> int:
    return sum(len(x) ** 2 for x in regions)


def _rings(far: np.ndarray, radius: float) -> list[np.ndarray]:
    """Places by region and ring, from distances to pivots (a column each); those of fewer than two sets go."""
    inside = far <= far.min(axis=1, keepdims=True) + 2 * radius + 1e-9
    ring = (far / radius + 1e-9).astype(int)
    out = []
    for j in range(far.shape[1]):
        for k in np.unique(ring[inside[:, j], j]):
            # those at k radii, with those of the next ring that may link to them
            at = np.flatnonzero(inside[:, j] & ((ring[:, j] == k) | (ring[:, j] == k + 1)))
            if len(at) > 1:
                out.append(at)
    return out


def _shared(sets: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each set with p."""
    flat, size = np.concatenate(sets), np.array([len(x) for x in sets])
    hit = p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size)[:-1])))
    return both / (size + len(p) - both)


def _local_components(linked: np.ndarray) -> np.ndarray:
    """Label of each row of a symmetric matrix."""
    label = np.full(len(linked), -1)
    for i in np.flatnonzero(linked.any(axis=1)):
        if label[i] < 0:
            front = np.array([i])
            label[i] = i
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
                label[front] = i
    return label


def _joined_group(rows: list[tuple], percent: int) -> tuple[list, list]:
    """Spanning stars (a, b) and (id, links) of one region that fits."""
    seen, kept = set(), []
    for r in rows:  # repeated rows of one document
        if (key := (r[1], r[3])) not in seen:
            seen.add(key)
            kept.append(r)
    ids = np.array([r[1] for r in kept])
    if len(ids) < 2:
        return [], []
    order = np.argsort(ids, kind="stable")
    kept, ids = [kept[i] for i in order], ids[order]
    sets = [np.frombuffer(r[3], np.uint64) for r in kept]
    copies, home, low, chunk = (np.array([r[c] for r in kept]) for c in (2, 4, 5, 6))
    size = np.array([len(x) for x in sets])
    linked = np.zeros((len(ids), len(ids)), bool)
    for at in local_regions(sets, 1 - percent / 100):
        both = overlaps([sets[i] for i in at])
        linked[np.ix_(at, at)] |= 100 * both >= percent * (size[at][:, None] + size[at][None, :] - both)
    np.fill_diagonal(linked, False)
    label = _local_components(linked)
    stars = [(int(ids[label[i]]), int(ids[i])) for i in np.flatnonzero((label >= 0) & (label != np.arange(len(ids))))]
    levels = rows[0][0].count("/")
    mine = linked & ((low[:, None] | low[None, :]) == (1 << levels) - 1) if levels else linked
    pair = rows[0][0].rpartition("#")[2].split("-")
    if "#" in rows[0][0] and pair[0] != pair[1]:
        mine = mine & (chunk[:, None] != chunk[None, :])
    mine = np.triu(mine & home[:, None], 1)
    links = mine @ copies + mine.T @ copies
    return stars, [(int(ids[i]), int(links[i])) for i in np.flatnonzero(links)]


def _joined(percent: int):
    """Members sorted by block -> rows (src, dst, links): a star's edge, or a class's links."""

    def out(found: tuple[list, list]) -> pa.RecordBatch:
        stars, links = found
        src = [a for a, _ in stars] + [a for a, _ in links]
        dst = [b for _, b in stars] + [None] * len(links)
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array([0] * len(stars) + [n for _, n in links], pa.int64())], ["src", "dst", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][0] != r[0]:
                    if len(rows) > 1:
                        yield out(_joined_group(rows, percent))
                    rows = []
                rows.append(r)
        if len(rows) > 1:
            yield out(_joined_group(rows, percent))
        rows.clear()
        forget()

    return run


def _leaves(members: DataFrame, percent: int) -> DataFrame:
    return members.repartition("block").sortWithinPartitions("block").mapInArrow(_joined(percent), "src long, dst long, links long")


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("block").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("hashes") / 8).alias("shingles"))


def _region_joins(members: DataFrame, percent: int, leaf_docs: int, leaf_shingles: int, big: DataFrame | None) -> list[DataFrame]:
    """Joins of all members' blocks; big has the sizes of those over the limits, None: no block is."""
    if big is None:
        return [_leaves(members, percent)]
    radius = 1 - percent / 100
    parts = [_leaves(members.join(small(big).select("block"), "block", "left_anti"), percent)]
    now = cut(members.join(small(big).select("block"), "block", "left_semi"))
    sizes = big.select("block", "docs")
    for level in range(LEVELS):
        drawn = now.join(small(sizes), "block").where(F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(1 << 30)) < 4 * PIVOTS * (1 << 30) / F.col("docs"))
        few = drawn.groupBy("block").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("doc_id", F.lit(level)).alias("h"), "hashes"))), 1, PIVOTS).alias("p"))
        pivots = cut(few.select("block", F.transform("p", lambda x: x["hashes"]).alias("pivots")))
        near = now.join(small(pivots, 500), "block")
        sized = near.mapInArrow(_dealt(radius, level, True), "block string, parent string").groupBy("block", "parent").agg(F.count(F.lit(1)).alias("m"))
        work = sized.groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("work"))
        worth = work.join(sizes.withColumnRenamed("block", "parent"), "parent").where(F.col("work") < WORTH * F.col("docs").cast("double") * F.col("docs"))
        worth = small(cut(worth.select(F.col("parent").alias("block"))))
        # a block that drew no pivot, or whose windows exclude too little, goes to the grid as it is
        dealt = cut(near.join(worth, "block", "left_semi").mapInArrow(_dealt(radius, level), _MEMBER))
        rest = now.join(worth, "block", "left_anti")
        found = cut(_sizes(dealt))
        over = found.where((F.col("docs") > leaf_docs) | (F.col("shingles") > leaf_shingles)).withColumn("parent", F.regexp_replace("block", "/[^/]*$", ""))
        was = sizes.select(F.col("block").alias("parent"), F.col("docs").alias("before"))
        over = cut(over.join(was, "parent").withColumn("again", (F.col("docs") < 0.9 * F.col("before")) & F.lit(level + 1 < LEVELS)))
        fits = dealt.join(small(over).select("block"), "block", "left_anti")
        parts.append(_leaves(fits, percent))
        stuck = dealt.join(small(over.where("NOT again").select("block", "docs")), "block").unionByName(rest.join(small(sizes), "block"))
        parts.append(_grid(stuck, percent, GRID * leaf_docs, GRID * leaf_shingles))
        sizes = cut(over.where("again").select("block", "docs"))
        if not sizes.limit(1).count():
            break
        now = cut(dealt.join(small(sizes).select("block"), "block", "left_semi"))
    return parts


def _grid(members: DataFrame, percent: int, leaf_docs: int, leaf_shingles: int) -> DataFrame:
    """Exact join of blocks of any size (column docs): chunks by hash, a task for each pair of chunks.

    The chunks of a block are so many that a pair of them has about leaf_docs members and leaf_shingles shingles; a
    member goes to as many tasks as its block has chunks.
    """
    weights = members.groupBy("block").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.octet_length("hashes") / 8).alias("_w"))
    chunks = weights.select("block", F.greatest(F.lit(1), F.ceil(2 * F.col("_m") / leaf_docs), F.ceil(2 * F.col("_w") / leaf_shingles)).cast("int").alias("_g"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("_g")).cast("int")
    pair = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    spread = members.join(small(cut(chunks)), "block").withColumn("chunk", own).withColumn("_j", pair)
    key = F.concat_ws("-", F.least("chunk", "_j"), F.greatest("chunk", "_j"))
    # pairs of two chunks count there; pairs of one chunk where it stands alone
    spread = spread.withColumn("block", F.concat_ws("#", "block", key))
    return _leaves(spread.select(*_NAMES), percent)


def linked_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, leaf_docs: int = LEAF_DOCS, leaf_shingles: int = LEAF_SHINGLES, hot_rank: int = HOT_RANK) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs.

    Documents link if 100 * intersection >= percent * union of their sets. component_id is the least id that links
    reach, n_links the number of other documents that a document links with, copies included. Null, empty and blank
    texts have no shingles and no links. Rows of one id and text are one document for others' components, each
    counted as a link; rows without an id join no component (null). Ids are whole numbers.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    described = cut(base.mapInArrow(_described(k), "doc_id long, n long, s1 long, s2 long, sketch binary, chunk int, counts binary"))
    rarity = spark.sparkContext.broadcast(_rarity(described))
    rows = described.where("chunk IS NULL").select("doc_id", "n", "s1", "s2")
    sets = described.where("chunk IS NULL AND n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2")
    classes = cut(sets.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    tokens = base.where("doc_id IS NOT NULL").select("text").mapInArrow(_prefixes(k, percent, rarity, hot_rank), "token long, salt long, n long, s1 long, s2 long")
    stars = _candidates(tokens, percent)
    of = lambda x: classes.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("rep").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    both = stars.join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"]).select("a", "b", "pair", "a_n", "b_n", "a_sketch", "b_sketch")
    candidates = both.mapInArrow(_checked(percent), "a long, b long").distinct()
    blocks = components(candidates, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").cast("string").alias("block"))
    sized = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n"), F.sum("copies").alias("copies"))
    blocks = cut(blocks.join(sized, "doc_id"))
    big = cut(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).where((F.col("docs") > leaf_docs) | (F.col("shingles") > leaf_shingles)))
    has_big = bool(big.limit(1).count())
    members = base.join(small(blocks.select("doc_id", "block", "copies"), MEMBER_ROWS), "doc_id").select("block", "doc_id", "copies", "text").mapInArrow(_sets(k), _MEMBER)
    parts = _region_joins(members, percent, leaf_docs, leaf_shingles, big if has_big else None)
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    joined = cut(joined)
    reached = components(joined.where("dst IS NOT NULL"))
    counts = joined.where("dst IS NULL").groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    known = (
        classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
        .select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    out = rows.join(known, (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs without those that link, over any number of steps, with a document of lesser id.

    Of each component the document of the least id stays, once for each of its rows; rows without an id stay.
    """
    found = linked_components(docs, doc_id, text, **how).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = aside(docs).join(small(cut(found), MEMBER_ROWS), F.col(f"in_{doc_id}").cast("long") == F.col("_gone"), "left_anti")
    return back(left, docs.columns)

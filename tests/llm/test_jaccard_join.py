"""The Jaccard join against brute force, with regions of all sizes."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard_join as join
from tidemark.llm.shingles import shingles


def by_brute_force(docs, k, percent):
    sets = []
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets.append((i, {tuple(words[a : a + k]) for a in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i), links[i] if i is not None else 0) for i, s in sets), key=repr)


def group(rnd, size, words, share):
    """Copies of one text, each with up to a share of its words changed."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rnd.randrange(int(words * share) + 1)):
            copy[rnd.randrange(words)] = f"w{rnd.randrange(10**6)}"
        yield " ".join(copy)


def made(seed):
    rnd = random.Random(seed)
    texts = [x for args in ((60, 80, 0.06), (25, 200, 0.1), (8, 30, 0.05), (3, 500, 0.02)) for x in group(rnd, *args)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"x{rnd.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(40)]
    texts += ["one", "one", "ONE", "one two", "", None, " \n", "é à", "a b c", "a b c d"]
    docs = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("leaf_docs, leaf_shingles", [(1200, 8_000_000), (10, 8_000_000), (1200, 2000), (3, 300)])
def test_join(spark, leaf_docs, leaf_shingles):
    docs = made(leaf_docs)
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n int, block string").repartition(5)
    got = join.linked_components(frame, k=4, percent=85, leaf_docs=leaf_docs, leaf_shingles=leaf_shingles).collect()
    assert sorted(map(tuple, got), key=repr) == by_brute_force(docs, 4, 85)


@pytest.mark.parametrize("hot_rank", [0, 70])
def test_hot_tokens(spark, hot_rank):
    """Sets of hot tokens meet in two rounds."""
    docs = made(hot_rank + 1)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, join.linked_components(frame, k=4, percent=85, hot_rank=hot_rank).collect()), key=repr) == by_brute_force(docs, 4, 85)


@pytest.mark.parametrize("leaf_docs", [join.LEAF_DOCS, 2])
def test_driver_table(spark, monkeypatch, leaf_docs):
    """All documents of sf0.01, by blocks that fit and through pivots' regions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    regions, leaves = [], join._leaves
    monkeypatch.setattr(join, "_leaves", lambda members, percent: regions.append(members) or leaves(members, percent))
    got = sorted(map(tuple, join.linked_components(docs, k=4, percent=85, leaf_docs=leaf_docs).collect()), key=repr)
    assert got == by_brute_force(sorted(map(tuple, docs.collect())), 4, 85)
    paths = [r.block for frame in regions for r in frame.select("block").collect()]
    assert any("/" in x or "#" in x for x in paths) == (leaf_docs == 2)  # regions, or the grid where windows exclude nothing
    assert len(paths) < 4 * len(got)  # members of all blocks, regions and grids


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert join.linked_components(frame([])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None), (9, None)]
    got = sorted(map(tuple, join.linked_components(frame(rows)).collect()), key=repr)
    assert got == sorted([(None, 2, None, 0), (4, 2, 2, 1), (2, 2, 2, 1), (9, 0, 9, 0), (9, 0, 9, 0)], key=repr)
    kept = Counter(r.doc_id for r in join.without_near_copies(frame(rows)).collect())
    assert kept == {None: 1, 2: 1, 9: 2}


def test_local_regions():
    """Every pair within the radius shares a region, and far ones are kept apart."""
    rnd = random.Random(11)
    for radius, changed in ((0.15, 0.02), (0.2, 0.1), (0.15, 0.16)):
        sets = []
        for n in (150, 60, 3, 1, 1):
            base = [rnd.randrange(1 << 60) for _ in range(200)]
            sets += [np.array(sorted({rnd.randrange(1 << 60) if rnd.random() < changed * rnd.random() else x for x in base}), np.uint64) for _ in range(n)]
        regions = join.local_regions(sets, radius)
        together = np.zeros((len(sets), len(sets)), bool)
        for at in regions:
            together[np.ix_(at, at)] = True
        near = [(i, j) for i in range(len(sets)) for j in range(i) if 1 - len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) <= radius]
        assert all(together[i, j] for i, j in near) and near
        assert not any(150 <= i < 210 and j >= 210 for at in regions if len(at) > 40 for i in at for j in at if radius == 0.15 and changed == 0.02)


def test_links_come_from_regions(spark, monkeypatch):
    """On sf0.1 all links come out of regions; members of the grid are a minority."""
    base = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    calls, leaves = [], join._leaves
    monkeypatch.setattr(join, "_leaves", lambda members, percent: calls.append(members) or leaves(members, percent))
    got = join.linked_components(base, k=4, percent=85).where("n_links > 0").count()
    paths = [r.block for frame in calls for r in frame.select("block").collect()]
    in_grid = sum("#" in x for x in paths)
    sets = [np.frombuffer(r.hashes, np.uint64) for r in sorted(calls[0].collect(), key=lambda r: r.block)]
    blocks = [r.block for r in sorted(calls[0].collect(), key=lambda r: r.block)]
    members = 0
    for block in set(blocks):
        members += sum(map(len, join.local_regions([s for s, b in zip(sets, blocks) if b == block], 0.15)))
    assert got > 0 and members > 0 and in_grid < members / 2


def chain(rnd, size):
    """Texts of two passages each, of which the text before has one and the text after the other; no two link."""
    passages = [" ".join(f"q{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(size + 1)]
    return [f"{a} {b}" for a, b in zip(passages, passages[1:])]


@pytest.mark.parametrize("k, percent", [(5, 80), (4, 85)])
def test_passages_chain_no_blocks(spark, monkeypatch, k, percent):
    """Sets that share rare shingles without being alike are in no block; near copies among them are."""
    rnd = random.Random(percent)
    texts = chain(rnd, 300) + list(group(rnd, 5, 200, 0.01))
    docs = list(enumerate(texts))
    rnd.shuffle(docs)
    members, leaves = [], join._leaves
    monkeypatch.setattr(join, "_leaves", lambda rows, percent: members.append(rows.count()) or leaves(rows, percent))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, join.linked_components(frame, k=k, percent=percent).collect()), key=repr)
    assert got == by_brute_force(docs, k, percent)
    assert sum(members) == len(set(texts[300:])) > 1


def test_sketches():
    """No pair that links is told apart; unrelated sets and those that share half are."""
    rnd = np.random.default_rng(5)
    drawn = lambda n: np.unique(rnd.integers(0, 1 << 64, n, np.uint64, endpoint=False))
    for n in (1, 2, 7, 31, 33, 127, 128, 500, 3000, 20_000):
        for percent in (80, 85):
            for share in (1.0, 0.99, 0.95, 0.9, 0.85, 0.82, 0.5, 0.0):
                x = drawn(n)
                kept = rnd.permutation(x)[: round(share * n)]
                for y in (np.sort(kept), np.union1d(kept, drawn(n - len(kept))), np.union1d(x, drawn(n - len(kept)))):
                    if not len(y):
                        continue
                    both = len(np.intersect1d(x, y))
                    links = 100 * both >= percent * (len(x) + len(y) - both)
                    may = [join.may_link(len(a), len(b), join.sketch(a), join.sketch(b), percent) for a, b in ((x, y), (y, x))]
                    assert may[0] == may[1] and (may[0] or not links), (n, share)
                    assert not may[0] or n < 100 or both > 0.6 * n, (n, share)


@pytest.mark.parametrize("batch", [1, 3, 16, 17, 1000])
def test_runs(batch):
    """Sets that share a token are paired, or hang together in long runs, however batches cut them; copies count once."""
    rnd = random.Random(batch)
    rows, sets = [], {}
    for token in range(60):
        for _ in range(rnd.choice((1, 2, 3, 15, 16, 17, 40))):
            i = rnd.randrange(400)
            n = sets.setdefault(i, rnd.choice((10, 11, 12, 13, 20, 22, 50)))
            rows += [(token, 0, n, n, i, -i)] * rnd.choice((1, 1, 3))
    rows.sort()
    names = ["token", "salt", "low", "high", "s1", "s2"]
    cut = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + batch])], names) for i in range(0, len(rows), batch)]
    found = [tuple(r[c] for c in ("a1", "b1", "pair")) for x in join._stars(85, True)(iter(cut)) for r in x.to_pylist()]
    pairs = {frozenset(x[:2]) for x in found if x[2]}
    starred = {frozenset(x[:2]) for x in found if not x[2]}
    sharing, long = set(), set()
    for token in range(60):
        run = []
        for n, i in [*sorted({(r[2], r[4]) for r in rows if r[0] == token}), (10**9, -1)]:
            if run and 100 * run[-1][0] < 85 * n:
                alike = {frozenset((i, j)) for m, i in run for o, j in run if i != j and 100 * min(m, o) >= 85 * max(m, o)}
                if len(run) > join.RUN_SETS:
                    assert all(frozenset((run[0][1], j)) in starred for _, j in run[1:])
                    long |= {frozenset((run[0][1], j)) for _, j in run[1:]}
                else:
                    sharing |= alike
                run = []
            run.append((n, i))
    assert pairs == sharing and starred == long and pairs and starred


def test_very_long_texts(spark):
    words = [f"w{i % 9973}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3])), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (5, "a b " * 250_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, join.linked_components(frame, k=4, percent=85).collect()), key=repr) == by_brute_force(rows, 4, 85)


def test_overlaps():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 6000, n).astype(np.uint64)) for n in (1, 5, 4000, 5000, 300)]
    assert join.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets] or all(
        join.overlaps(sets)[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j
    )


def test_shingles():
    assert len(shingles("a b", 4)) == 1 and shingles("A b", 4) == shingles("a B", 4) != shingles("a b c", 4)
    assert len(shingles("a b c d a b c d", 4)) == 4 and len(shingles(" ", 4)) == 0
    assert shingles("É x", 4) != shingles("é x", 4)  # A-Z only

"""The filter audit against chains that are really applied."""

import random
from fractions import Fraction
from itertools import permutations

import pytest

from tidemark.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, _mask int, n string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


def failing(rows):
    """For each row the letters that it fails."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = text.encode().split()
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            f.add("C")
        if set(text) & set("#$%&*|"):
            f.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            f.add("E")
        out.append(f)
    return out


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails, out, total = failing(rows), [], {}
    for part in {s or "" for *_, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                all_failing = sum(x in f for _, f in mine)
                out.append([part, "".join(order), step, len(left), len(gone), all_failing - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
                total[part, x] = total.get((part, x), 0) + len(gone)
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def texts(draw):
    long = lambda n, kinds: " ".join(f"w{draw.randrange(kinds)}" for _ in range(n))
    made = [long(250, 1000), long(250, 20), long(199, 400), long(200, 400), long(300, 900) + " A B | C", "ABC def", "", None, "a\n\x0b b", "x#y", "*" * 300, long(220, 110).title()]
    return made


def test_audit(spark):
    draw = random.Random(5)
    pool = texts(draw)
    rows = [(i, draw.choice(pool), draw.choice(["a", "b", "", None])) for i in range(120)]
    rows += [(500 + i, pool[0], "a") for i in range(60)]  # one text is a third of all rows
    rows += [(7, rows[7][1], "a"), (None, pool[0], "b"), (None, "only here", "c"), (3, rows[3][1], rows[3][2])]
    labels = [(i, draw.randrange(2), draw.choice([0, 0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(filter_audit.mask_counts(docs(spark, rows), frame)).collect())
    assert got == plain(rows, labels) and len(got) == 4 * 600
    alone = sorted(tuple(r) for r in filter_audit.audit(filter_audit.mask_counts(docs(spark, rows).repartition(7), None)).collect())
    assert alone == plain(rows, [])


def test_edges(spark):
    assert filter_audit.audit(filter_audit.mask_counts(docs(spark, []), None)).count() == 0
    rows = [(1, " ".join(f"w{i}" for i in range(100_000)) + " x", "long")]
    got = sorted(tuple(r) for r in filter_audit.audit(filter_audit.mask_counts(docs(spark, rows), None)).collect())
    assert got == plain(rows, []) and all(r[3] == 1 and r[-1] == 0 for r in got)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shapley_is_the_mean_over_orders(size):
    draw = random.Random(size)
    counts = {m: draw.randrange(50) for m in range(1 << size)}
    p = filter_audit.Removal(counts, size)
    orders = list(permutations(range(size)))
    for i in range(size):
        gain = 0
        for order in orders:
            before = sum(1 << j for j in order[: order.index(i)])
            gain += sum(c for m, c in counts.items() if m >> i & 1 and not m & before)
        assert p.shapley(i) == Fraction(gain, len(orders))
    assert sum(p.shapley(i) for i in range(size)) == p.at((1 << size) - 1) == p.total - counts[0]

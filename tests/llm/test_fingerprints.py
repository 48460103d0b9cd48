"""SimHash fingerprints and their search against plain Python."""

import hashlib
import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, q_audit
from tidemark.session import table

SIGNED = lambda x: x - (1 << 64) if x >> 63 else x
DOCS = "doc_id long, text string, f1 string, _at int, _body string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


def plain_fingerprint(text):
    words = (text or "").encode().split() or [b""]
    votes = [0] * 128
    for i in range(max(1, len(words) - 1)):
        pair = words[i : i + 2]
        h = 42
        for w in pair:
            h = xxhash.xxh64_intdigest(w, h)
        h2 = xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<Q", h), 42))
        weight = min(15, sum(len(w.decode()) for w in pair))
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
            votes[64 + b] += weight if h2 >> b & 1 else -weight
    return sum(1 << b for b in range(64) if votes[b] > 0), sum(1 << b for b in range(64) if votes[64 + b] > 0)


def cosine(a, b):
    return max(0.0, math.cos(math.pi * sum((x ^ y).bit_count() for x, y in zip(a, b)) / 128))


def plain(rows):
    """Rows (doc_id, text) by falling id, null last -> (doc_id, n_chars, edited text's digest, fingerprints, likenesses)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        f, e, g = map(plain_fingerprint, (text, new, following))
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), *map(SIGNED, f + e), round(cosine(f, e), 9), round(cosine(f, g), 9)))
    return sorted(out, key=repr)


def got(found):
    return sorted([(*r[:7], round(r[7], 9), round(r[8], 9)) for r in found.collect()], key=repr)


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = q_audit.op12_fingerprints(spark, sf_dir).collect()
    hexed = lambda a, b: f"{a % (1 << 64):016x}{b % (1 << 64):016x}"
    want = {i: (n, s, hexed(a, b), hexed(c, d), e, x) for i, n, s, a, b, c, d, e, x in plain(rows)}
    assert len(found) == len(rows) and {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found} == want
    own = {i: plain_fingerprint(t) for i, t in rows}
    near = {i: sum(sum((x ^ y).bit_count() for x, y in zip(own[i], f)) <= fingerprints.RADIUS for f in own.values()) for i in own if i % q_audit.EVERY == 0}
    assert {r.doc_id: r.n_near for r in found if r.n_near is not None} == near
    assert sum(r.near_edited > r.near_next for r in found) > 0.95 * len(found)


@pytest.mark.parametrize("range_docs", [1, 2, 5, 1000])
def test_order_over_ranges(spark, range_docs):
    draw = random.Random(range_docs)
    text = lambda: " ".join(draw.choice(["ab", "c", "Dé\t", "한국", "x" * 40]) for _ in range(draw.randrange(12)))
    ids = draw.sample(range(-10**15, 10**15), 30) + list(range(40)) + [2**62, -(2**63)]
    rows = [(i, text()) for i in ids] + [(None, "no id at all"), (50, None), (51, ""), (52, " \t\n"), (53, "same"), (54, "same")]
    found = fingerprints.compared(docs(spark, rows).repartition(3), range_docs=range_docs)
    assert got(found) == plain(rows)


def test_edges(spark):
    assert fingerprints.compared(docs(spark, [])).count() == 0
    assert got(fingerprints.compared(docs(spark, [(1, "one two three")]))) == plain([(1, "one two three")])
    assert fingerprints.compared(docs(spark, [(None, "a b"), (None, "a b"), (None, None)])).count() == 3
    repeated = fingerprints.compared(docs(spark, [(4, "a b c d")] * 5 + [(3, "e f")]), range_docs=2)
    assert sorted(r.near_next for r in repeated.where("doc_id = 4").collect())[1:] == [1.0] * 4 and repeated.count() == 6


def test_very_long_text(spark):
    long = " ".join(f"word{i % 5000}" for i in range(300_000))
    rows = [(2, long), (1, "short one"), (3, "x" * 1_000_000)]
    assert got(fingerprints.compared(docs(spark, rows))) == plain(rows)


@pytest.mark.parametrize("radius, blocks", [(0, 2), (1, 2), (3, 4), (2, 4), (5, 8)])
def test_search(spark, radius, blocks):
    draw = random.Random(radius)
    base = [(draw.getrandbits(64), draw.getrandbits(64)) for _ in range(30)] + [(0, 0)]
    flips = lambda n: [sum(1 << b for b in x) for x in [draw.sample(range(128), n)]][0]
    rows = list(base) + [base[0]] * 50
    for f in base:
        for n in range(8):
            m = flips(n)
            rows.append((f[0] ^ (m >> 64), f[1] ^ (m & (1 << 64) - 1)))
    frame = spark.createDataFrame([(SIGNED(a), SIGNED(b)) for a, b in rows] + [(None, None)], "f1 long, f2 long")
    found = {(r.f1, r.f2): r.n_near for r in fingerprints.near_counts(frame, frame.limit(60), radius, blocks).collect()}
    want = {tuple(map(SIGNED, f)): sum(sum((x ^ y).bit_count() for x, y in zip(f, g)) <= radius for g in rows) for f in set(rows[:60])}
    assert found == want


def test_search_refuses_too_few_blocks(spark):
    frame = spark.createDataFrame([], "f1 long, f2 long")
    assert fingerprints.near_counts(frame, frame).count() == 0
    with pytest.raises(ValueError):
        fingerprints.near_counts(frame, frame, radius=4, blocks=4)


def test_text_form(spark):
    row = spark.range(1).select(fingerprints.as_text(F.lit(-1).cast("long"), F.lit(10).cast("long"))).first()
    assert row[0] == "f" * 16 + "0" * 15 + "a"

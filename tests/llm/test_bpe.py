"""BPE against the public library, over real and odd texts."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidemark.llm import bpe, q_tokens

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  ", "   a", "a   b", "a\t \tb", "\n \n", "it's we'll 'S", "x" * 5000, "ab" * 3000, "a  \n  b ", "naïve café 12²³ ½", "日本語 テスト", "🙂🙂 🙂", "   x", "a\x1c b\x85 c", "###%%% !!", " lead", "trail ", "a \r\n b", "<|endoftext|> x", "é ́"]


def same(text):
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(text).tolist() == THEIRS.encode_ordinary(text)


def test_odd_texts():
    assert [x for x in ODD if not same(x)] == []


def test_other_vocabulary_and_pattern(tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"  ": 256, b"\n ": 257, b"a ": 258, b"a a": 259}
    (tmp_path / "r").write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()))
    for pattern in (P.PATTERN, r"[\s\S]+"):
        theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        ours = bpe.Codec(str(tmp_path / "r"), pattern)
        assert [x for x in ["a  ", "a\n ", "  ", " ", "a ", "a a a", "b  a \n ", *ODD[:8]] if ours.encode(x).tolist() != theirs.encode_ordinary(x)] == []


def test_random_texts():
    rnd = random.Random(5)
    marks = " \n\t'ab1é#漢 .,s  "
    assert [x for x in ("".join(rnd.choice(marks) for _ in range(rnd.randrange(60))) for _ in range(3000)) if not same(x)] == []


def test_ties_and_long_pre_tokens():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 300, b"ab": 290, b"aaaa": 301, b"ba": 290 + 256 * 40}
    by_rule = lambda p: by_rule_of(p, ranks)
    rnd = random.Random(1)
    pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 40))) for _ in range(500)]
    assert [p for p in pieces if bpe.merge(p, ranks) != by_rule(p)] == []
    assert len(bpe.merge(b"a" * 400_000, ranks)) == 100_000


def test_lower_ranks_of_grown_tokens():
    """A vocabulary that no training gives: tokens with a lower rank than their parts go first once they can."""
    ranks = {bytes([i]): i + 1000 for i in range(256)} | {b"ab": 500, b"abc": 3, b"cd": 400, b"ca": 450, b"abcab": 2, b"dab": 1}
    rnd = random.Random(3)
    pieces = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    table = bpe.Ranks(ranks)
    for some in (pieces, pieces[:1]):
        got = [[int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] for ids in bpe.merged(some, table)]
        assert got == [by_rule_of(p, ranks) for p in some]


def test_many_slices_agree(monkeypatch):
    from tidemark.llm import pretoken

    monkeypatch.setattr(pretoken, "SLICE_BYTES", 40)
    docs = [*ODD, None, "one two. two\nThree  four", "x" * 300, "a b" * 100, ""]
    import pyarrow as pa

    small = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_bytes=2000)
    texts, at = pa.array(["not this", *docs])[1:], 0
    for first, ids, ends in small.parts.slices(texts):
        assert first == at
        for a, b in zip([0, *ends], ends):
            assert ids[a:b].tolist() == THEIRS.encode_ordinary(docs[at] or "")
            at += 1
    assert at == len(docs)


def by_rule_of(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 20_000)]])
def test_columns(spark, rows):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, q_tokens.bpe_columns(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(k := THEIRS.encode_ordinary(t or "")), sha(" ".join(map(str, k)).encode()), sha((t or "").encode())) for i, t in rows]
    assert got == sorted(want, key=repr)


def test_whole_table(spark):
    got = {r.doc_id: r for r in q_tokens.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = THEIRS.encode_ordinary(d.text)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()

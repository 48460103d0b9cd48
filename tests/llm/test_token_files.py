"""Coded segments and files: exact round trips; damage is found."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import q_tokens, token_files
from tidemark.llm.range_coder import decode_segment, encode_segment

FILE = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 511, 512, 2047, 2048, 2049, 9000])
def test_round_trip(n):
    rnd = np.random.default_rng(n)
    for ids in (rnd.integers(0, 65536, n), rnd.zipf(1.2, n) % 50257, np.zeros(n, int), np.resize([7, 9, 40000], n)):
        data = encode_segment(ids.astype(np.uint32))
        assert decode_segment(data).tolist() == ids.tolist()
        small = encode_segment(ids.astype(np.uint32), block=max(1, n // 5))
        assert decode_segment(small).tolist() == ids.tolist()
    if n > 2000:
        assert len(data) < n // 8  # a loop of three ids


def test_fewer_bits_than_plain_models():
    """Ids of the driver's documents take fewer bits than a static order-0 table without its own size, and than zlib's."""
    tokenizer = Tokenizer.from_file(FILE)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate([[*x.ids, 0] for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]).astype("<u4")
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    bits = 8 * len(encode_segment(ids)) / len(ids)
    assert bits < 8.0
    assert bits < -(share * np.log2(share)).sum()
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_joined_checksums():
    data = bytes(range(256)) * 9
    for cuts in ([], [0], [5, 5, 1000], list(range(0, 2304, 7))):
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        assert token_files.crc_of_joined([(zlib.crc32(x), len(x)) for x in parts]) == zlib.crc32(data)


def test_damage_is_found():
    data = encode_segment(np.arange(5000, dtype=np.uint32))
    for at in (0, 5, 21, 30, len(data) - 1, len(data) // 2):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            decode_segment(bytes(bad))
    with pytest.raises(ValueError):
        decode_segment(data[:-2])
    with pytest.raises(ValueError):
        encode_segment(np.array([70000]))
    with pytest.raises(ValueError):
        encode_segment(np.zeros(9), block=1)


@pytest.mark.parametrize("most", [1 << 23, 37])
def test_files(spark, tmp_path, most):
    tokenizer = Tokenizer.from_file(FILE)
    rows = [(5, "five !! five"), (2, None), (9, ""), (3, "long text " * 40), (None, "no id"), (2, "again"), (8, "a\t \tb   c\n d"), (7, "<|endoftext|>"), (6, "a <|endoftext|> b"), (4, "Wörter und\nmehr, 12 x.\n\nEnde"), (1, "y" * 3000)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, start int").repartition(3)
    token_files.write(docs, f"{tmp_path}/t", FILE, most=most)
    got = sorted(map(tuple, token_files.documents(token_files.read(spark, f"{tmp_path}/t")).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert next(r for r in want if r[0] == 6)[2] == 5  # a special token's string is its id
    light = token_files.documents(token_files.checksums(spark, f"{tmp_path}/t"))
    assert sorted(map(tuple, light.collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers(name):
    """A tokenizer that doesn't split by the public pattern gets whole texts."""
    theirs, ours = Tokenizer.from_file(P.path(name)), token_files._tokenizer(P.path(name))
    for text in ("Hello there, you.\nNew line", "a  b", "", "x <|endoftext|> y"):
        assert np.frombuffer(ours(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_few_strings_for_many_pieces(monkeypatch):
    """The library gets distinct pieces of all kinds many to a string, and their ids are those of whole texts."""
    import tokenizers

    given = []

    class Counting:
        def __init__(self, inner):
            self.__dict__["inner"] = inner

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(1500)]
    texts = [" ".join(f"{x}, {x}.{i} #{i} end{x}.\nNext{x}" for i, x in enumerate(names[a : a + 300])) for a in range(0, 1500, 300)]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    token_files._tokenizer.cache_clear()
    try:
        found = [token_files._tokenizer(FILE)(x) for x in texts]
    finally:
        token_files._tokenizer.cache_clear()
    theirs = Tokenizer.from_file(FILE)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [theirs.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(given) < 400  # of 7,500 pieces at least


def test_odd_texts():
    """Texts of marks, line ends and white space of all kinds, put together at random."""
    theirs, ours, rnd = Tokenizer.from_file(FILE), token_files._tokenizer(FILE), np.random.default_rng(5)
    bits = ["a", "Ab", "é", "ß", "你", "١", "7", "1234", ".", ",", "!!", "#", "'s", "'", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\x1c", "\x85", "\u200b", "e\u0301", "😀", "<|endoftext|>", "<|", "Ġ", "Ċ", "\x00"]
    texts = ["".join(rnd.choice(bits, rnd.integers(1, 12))) for _ in range(3000)] + ["\n", " ", "a\n", "\na", "a \nb", "a\n b", "a.\nb.", "a.\nb.\nc"]
    slices = list(ours.slices(pa.array(texts)))
    found = [some.tolist() for at, ids, ends in slices for some in np.split(ids, ends[:-1])]
    assert found == [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]


def test_carries():
    """Words that lanes left behind take carries, over runs of full words too; a block of many lanes comes back whole."""
    rnd = np.random.default_rng(11)
    for n, high in ((300_000, 50_257), (70_000, 3), (2_000_000, 40)):
        ids = (rnd.zipf(1.3, n) % high).astype("<u4")
        assert (decode_segment(encode_segment(ids)) == ids).all()


def test_empty_table(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", FILE)
    assert token_files.documents(token_files.read(spark, f"{tmp_path}/e")).count() == 0


def test_whole_table(spark):
    got = {r.doc_id: r for r in q_tokens.op7_token_files(spark, "/root/testdata/sf0.001").collect()}
    tokenizer, start = Tokenizer.from_file(FILE), 0
    for d in sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = np.array([*tokenizer.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)

"""Token-id output: documents' ids in range-coded segments, in ascending order of the documents' ids, and back.

A store is a folder of Parquet files whose rows are segments, so any file system that Spark writes will do: part
(task, in order), segment (in order within a part), the documents' ids and lengths, and the coded ids. A segment
holds a bounded number of ids, so a document may go over several segments; a row lists the pieces of documents that
it has, and says of each whether it begins and whether it ends its document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, small
from tidemark.llm.pretoken import PartEncoder
from tidemark.llm.range_coder import BLOCK, decode_segment, encode_segment
from tidemark.session import cut

END_ID = 0
_SEGMENT = "part int, segment int, doc_ids array<bigint>, lengths array<int>, first_of array<boolean>, last_of array<boolean>, ids binary"
_KINDS = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary()]
#: Bytes of text that a worker cuts at once.
SLICE_BYTES = 16 << 20
#: Pieces that the library takes as one string.
_TOGETHER = 50


def _cuts(tokenizer) -> bool:
    """Whether a tokenizer splits by the public pattern and by nothing else."""
    import json

    kind = json.loads(tokenizer.to_str())
    before = kind["pre_tokenizer"] or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    return bool(byte_level and kind["model"]["type"] == "BPE" and not (kind["normalizer"] or kind["truncation"] or kind["padding"]))


class _Library(PartEncoder):
    """Encodes as the library's encode(text, add_special_tokens=False) does, special tokens' strings included.

    The library takes some microseconds for a string, so it gets many pieces in one, which the ids of what stands between them
    part again: each such character must be a token, or begin one, as often as there are pieces. Then no merge went
    over it, and the ids are those of the pieces alone; else each is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are parallel already
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        super().__init__(self._alone, _cuts(self.library), tuple(x.content for x in self.library.get_added_tokens_decoder().values()), slice_bytes=SLICE_BYTES)
        if self.cuts:  # words are matches already, so the merges are all that they need
            self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.library.get_vocab()
        self.newline = vocabulary.get("\u010a", -1)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [i for i, x in enumerate(pieces) if (y := x[1:] if x[:1] == " " else x).split() == [y]]  # no white space but a space before
        joined = ["".join([f"{pieces[i]}\n" for i in lines[a : a + _TOGETHER]]) for a in range(0, len(lines), _TOGETHER)]
        found = _flat(self.library, joined)
        ends = np.flatnonzero(found == self.newline)
        if len(ends) != len(lines):
            return super()._pieces(pieces)
        out: list[bytes | None] = [None] * len(pieces)
        data, begin = found.tobytes(), 0
        for i, end in zip(lines, (4 * ends).tolist()):
            out[i], begin = data[begin:end], end + 4
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, self._alone([pieces[i] for i in left])):
            out[i] = ids
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) >> 2

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        stops = pa.array([*range(0, len(words), _TOGETHER), len(words)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(stops, words), " ").to_pylist()
        found = _flat(self.merges, [f" {x}" for x in joined])
        starts = np.flatnonzero(self.begins[found])
        return (found, np.diff(starts, append=len(found))) if len(starts) == len(words) else super()._words(words)


def _flat(tokenizer, texts: list[str]) -> np.ndarray:
    """Ids of texts, one after the other."""
    found = [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return np.concatenate([np.empty(0, "<u4"), *found])


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> _Library:
    return _Library(path)


def _written(path: str, most: int):
    """Rows (doc_id, text), sorted -> segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = _tokenizer(path), TaskContext.get().partitionId(), 0
        pieces: list[tuple] = []  # (doc_id, ids, begins its document, ends it)
        held = 0

        def made() -> pa.RecordBatch:
            columns = [[part], [segment], *([[p[c] if c != 1 else len(p[1]) for p in pieces]] for c in range(4)), [encode_segment(np.concatenate([p[1] for p in pieces]))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], [x.split()[0] for x in _SEGMENT.split(", ")])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, ends in encoder.slices(batch.column(1)):
                start = 0
                for doc_id, end in zip(doc_ids[at:], ends.tolist()):
                    data, start, first = np.append(ids[start:end], np.uint32(END_ID)), end, True
                    while len(data):
                        piece, data = data[: most - held], data[most - held :]
                        pieces.append((doc_id, piece, first, not len(data)))
                        held, first = held + len(piece), False
                        if held == most:
                            yield made()
                            pieces, held, segment = [], 0, segment + 1
        if pieces:
            yield made()
        pieces.clear()
        give_back()

    return run


def write(docs: DataFrame, folder: str, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", most: int = 4 * BLOCK) -> None:
    """Write all rows of docs: null texts as empty, rows without an id first, each with END_ID after its ids.

    Rows of one id are in the order of their texts; an empty table gives no segment. The library's call is the plain
    one: special tokens' strings in a text become their ids.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_written(tokenizer_file, most), _SEGMENT).write.option("compression", "none").parquet(folder)


def _decoded(what: pa.DataType, of: Callable[[np.ndarray], object]):
    """Segments with the ids before them -> pieces of documents, each with of(its ids)."""
    names = ["doc_id", "start", "n_tokens", "first", "last", "made"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                ids = decode_segment(r["ids"])
                lengths = np.array(r["lengths"], np.int64)
                at = np.concatenate(([0], np.cumsum(lengths)))
                if at[-1] != len(ids):
                    raise ValueError("lengths don't add up")
                made = [of(ids[a:b]) for a, b in zip(at, at[1:])]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + r["before"]), pa.array(lengths), pa.array(r["first_of"], pa.bool_()), pa.array(r["last_of"], pa.bool_()), pa.array(made, what)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments, each with the number of ids in all before it."""
    segments = spark.read.schema(_SEGMENT).parquet(folder)
    order = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for some millions of ids
    counts = segments.select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"))
    before = cut(counts.withColumn("before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n"))
    return segments.join(small(before), ["part", "segment"]).drop("part", "segment")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, first, last, ids binary) of every piece of a document, start counting all ids before it.

    ids are little-endian unsigned 32-bit numbers. first and last say whether a piece begins and ends its document, which
    else has more pieces in the segments before or after.
    """
    of = _decoded(pa.binary(), lambda ids: ids.tobytes())
    return _segments(spark, folder).mapInArrow(of, "doc_id long, start long, n_tokens long, first boolean, last boolean, made binary").withColumnRenamed("made", "ids")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As read(), with ids_crc32 in place of the ids themselves, which stay in the task that decodes them."""
    of = _decoded(pa.int64(), lambda ids: zlib.crc32(ids.tobytes()))
    return _segments(spark, folder).mapInArrow(of, "doc_id long, start long, n_tokens long, first boolean, last boolean, made long").withColumnRenamed("made", "ids_crc32")


_POLYNOMIAL, _ONE = 0xEDB88320, 1 << 31  # CRC-32 has its lowest power in the highest bit


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's."""
    out = 0
    for power in range(32):
        if a & _ONE >> power:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_of_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of strings one after the other, from (crc32, number of bytes) of each."""
    whole = 0
    for crc, size in parts:
        shift, square = _ONE, _ONE >> 8  # 1, and the power that a byte adds
        while size:
            if size & 1:
                shift = _times(shift, square)
            square, size = _times(square, square), size >> 1
        whole = _times(shift, whole) ^ crc
    return whole


def _joined_crc(parts):
    @F.pandas_udf("long")
    def made(rows: pd.Series) -> pd.Series:
        return pd.Series([crc_of_joined([(p["ids_crc32"], 4 * p["n_tokens"]) for p in row]) for row in rows], dtype="int64")

    return made(parts)


def documents(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of whole documents, from read() or checksums(), decoded once.

    Most pieces are a document. The others, two a segment at most, are put together by their checksums and lengths, so no
    document's ids need to meet.
    """
    if "ids" in pieces.columns:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    pieces = cut(pieces.select("doc_id", "start", "n_tokens", "first", "last", "ids_crc32"))
    alone = pieces.where("first AND last").select("doc_id", "start", "n_tokens", "ids_crc32")
    by_id = Window.partitionBy("doc_id").orderBy("start")
    split = pieces.where("NOT (first AND last)").withColumn("_d", F.sum(F.col("first").cast("int")).over(by_id))
    parts = split.groupBy("doc_id", "_d").agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("_parts"))
    return alone.unionByName(parts.select("doc_id", "start", "n_tokens", _joined_crc("_parts").alias("ids_crc32")))

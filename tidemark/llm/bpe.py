"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pairs wait in a bucket per merge rank, which holds their start positions. A bitmap has a bit for each bucket
with entries and a bit above for each group of buckets, so find-first-set gives the lowest rank in two steps,
whatever the length of the pre-token. Parts are a linked list over start positions; an entry whose pair has
changed since is skipped when it surfaces. Encoding takes O(n log n) in a pre-token's length.

Pre-tokens don't meet, so many of them share one queue: laid end to end with gaps that no pair crosses, a bucket then
holds the positions of all of them and is found once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.common import give_back
from tidemark.llm.pretoken import KEEP_BYTES, SLICE_BYTES, PartEncoder

#: The public pattern, for which common parts are told without it. A fixed value.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets under one word of the lower bitmap.
GROUP_BITS = 8
LOW_MASK = (1 << GROUP_BITS) - 1
#: Bytes of pre-tokens that share a queue; a longer one has its own.
QUEUE_BYTES = 1 << 14


class Ranks:
    """Merge ranks, and tables of the ids of single bytes and of the ranks of pairs of bytes (-1: none)."""

    def __init__(self, of: dict[bytes, int]):
        self.of = of
        self.single = np.array([of.get(bytes([a]), -1) for a in range(256)], np.int64)
        self.double = np.array([of.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)


def _queued(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of pre-tokens that aren't tokens themselves, as little-endian unsigned 32-bit numbers."""
    data, get = b"\0" + b"\0".join(pieces) + b"\0", ranks.of.get
    gaps = np.concatenate(([0], np.cumsum([len(x) + 1 for x in pieces])))
    codes, n = np.frombuffer(data, np.uint8).astype(np.int64), len(data)
    first = ranks.double[codes[:-1] << 8 | codes[1:]]
    first[gaps[:-1]] = first[gaps[1:] - 1] = -1
    follows = np.arange(1, n + 1)
    follows[gaps] = 0  # a gap has no part after it
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 0) :]
    known, at = np.unique(first[order], return_index=True)
    places, bounds = order.tolist(), [*at.tolist(), len(order)]
    buckets = {rank: places[a:b] for rank, a, b in zip(known.tolist(), bounds, bounds[1:])}
    low: dict[int, int] = {}
    for rank in buckets:
        low[rank >> GROUP_BITS] = low.get(rank >> GROUP_BITS, 0) | 1 << (rank & LOW_MASK)
    top = sum(1 << group for group in low)
    after, before, pair, ids = follows.tolist(), list(range(-1, n - 1)), [*first.tolist(), -1], ranks.single[codes].tolist()
    gone: list[int] = []

    def push(rank: int, bits: int) -> int:
        group = rank >> GROUP_BITS
        low[group] = low.get(group, 0) | 1 << (rank & LOW_MASK)
        return bits | 1 << group

    while top:
        group = (top & -top).bit_length() - 1
        word = low[group]
        lowest = word & -word
        rank = group << GROUP_BITS | lowest.bit_length() - 1
        low[group] = word ^ lowest
        if word == lowest:
            top ^= 1 << group
        bucket = buckets.pop(rank)
        bucket.sort()
        for turn, i in enumerate(bucket):
            if pair[i] != rank:  # stale
                continue
            j = after[i]
            after[i] = k = after[j]
            before[k], pair[j], ids[i] = i, -1, rank
            gone.append(j)
            least = rank + 1
            pair[i] = new = get(data[i:end], -1) if (end := after[k]) else -1
            if new >= 0:
                if (some := buckets.get(new)) is None:
                    buckets[new] = [i]
                    top = push(new, top)
                    least = min(least, new)
                else:
                    some.append(i)
            h = before[i]
            if after[h]:
                pair[h] = new = get(data[h:k], -1)
                if new >= 0:
                    if (some := buckets.get(new)) is None:
                        buckets[new] = [h]
                        top = push(new, top)
                        least = min(least, new)
                    else:
                        some.append(h)
            if least <= rank:  # a lower rank came up, which no trained vocabulary has: it goes first
                buckets.setdefault(rank, []).extend(bucket[turn + 1 :])
                top = push(rank, top)
                break
    lives = np.ones(n, bool)
    lives[gone] = lives[gaps] = False
    made = np.array(ids, "<u4")[lives].tobytes()
    ends = (4 * np.cumsum(lives)[gaps]).tolist()
    return [made[a:b] for a, b in zip(ends, ends[1:])]


def merged(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of each pre-token as little-endian unsigned 32-bit numbers."""
    out = [None if (whole := ranks.of.get(x)) is None else whole.to_bytes(4, "little") for x in pieces]
    left = [i for i, ids in enumerate(out) if ids is None and pieces[i]]
    sizes = np.cumsum([len(pieces[i]) for i in left])
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + QUEUE_BYTES, "right")))
        for i, ids in zip(left[at:to], _queued([pieces[i] for i in left[at:to]], ranks)):
            out[i] = ids
        at = to
    return [ids or b"" for ids in out]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    return np.frombuffer(merged([piece], Ranks(ranks))[0], "<u4").tolist()


class Codec:
    """Encodes and decodes with a rank file and a pre-token pattern."""

    def __init__(self, rank_file: str, pattern: str, keep_bytes: int = KEEP_BYTES, slice_bytes: int = SLICE_BYTES):
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.tokens = [b""] * (max(self.ranks.of.values()) + 1)
        for token, rank in self.ranks.of.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        # only the public pattern splits where parts are cut
        self.parts = PartEncoder(self._pieces, pattern == GPT_PATTERN, keep_bytes=keep_bytes, slice_bytes=slice_bytes)

    def _pieces(self, some: list[str]) -> list[bytes]:
        """Ids of each string, the matches of all of them merged together."""
        matches = [[x] if x.lstrip(" ").isalpha() else self.find(x) for x in some]
        each = list(dict.fromkeys(chain.from_iterable(matches)))
        of = dict(zip(each, merged([x.encode() for x in each], self.ranks)))
        return [of[found[0]] if len(found) == 1 else b"".join(map(of.__getitem__, found)) for found in matches]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.parts(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def codec(rank_file: str, pattern: str, keep_bytes: int = KEEP_BYTES, slice_bytes: int = SLICE_BYTES) -> Codec:
    """One codec a Python worker, with the pieces that it has kept (keep_bytes at most)."""
    return Codec(rank_file, pattern, keep_bytes, slice_bytes)


@lru_cache(maxsize=1)
def _decimals(most: int) -> list[str]:
    return [str(x) for x in range(most)]


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """array<int> of the ids of a text; null and empty texts have none. The rank file's path must exist on executors.

    A batch's ids must be under 2^31, or ValueError says to lower spark.sql.execution.arrow.maxRecordsPerBatch.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        made, ends = bytearray(), [np.zeros(1, np.int64)]  # one buffer, and one slice of texts at a time beside it
        for _, some, stops in codec(rank_file, pattern).parts.slices(texts):
            ends.append(stops + len(made) // 4)
            made += some.tobytes()
        if len(made) >> 2 >= 1 << 31:
            raise ValueError("a batch has over 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.frombuffer(made, "<i4")))

    return ids(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """binary of the bytes that ids stand for; null gives no bytes, an unknown id an error."""

    @F.arrow_udf("binary")
    def data(rows: pa.Array) -> pa.Array:
        tokens = codec(rank_file, pattern).tokens
        ends, values = rows.offsets.to_numpy(), rows.values.to_numpy()
        made = (b"".join(map(tokens.__getitem__, values[a:b].tolist())) for a, b in zip(ends, ends[1:]))
        return pa.array(made, pa.binary())

    # coalesce() between the functions: nested ones would run the inner again for every use of its result
    return data(F.coalesce(ids, F.array().cast("array<int>")))


_DIGESTS = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def digests(text: Column, rank_file: str, pattern: str, keep_bytes: int = KEEP_BYTES, slice_bytes: int = SLICE_BYTES) -> Column:
    """struct of the number of a text's ids, and the digests of the ids (decimal, one space between) and of what they
    decode to: as of encode() and decode(), but a slice of texts at a time, so that ids needn't leave the worker.

    keep_bytes and slice_bytes bound what a worker keeps of pieces and cuts at once: more of them takes less time.
    """

    @F.arrow_udf(_DIGESTS)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = codec(rank_file, pattern, keep_bytes, slice_bytes)
        decimals = _decimals(len(engine.tokens))
        for texts in batches:
            rows = []
            for _, ids, ends in engine.parts.slices(texts):
                start = 0
                for end in ends.tolist():
                    some = ids[start:end].tolist()
                    listed = " ".join(map(decimals.__getitem__, some)).encode()
                    whole = b"".join(map(engine.tokens.__getitem__, some))
                    rows.append((end - start, hashlib.sha256(listed).hexdigest(), hashlib.sha256(whole).hexdigest()))
                    start = end
            n, a, b = zip(*rows) if rows else ((), (), ())
            del texts
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
        engine.parts.kept.clear()
        give_back()

    return made(text)

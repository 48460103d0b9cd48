"""Media columns: bytes kept as 8-bit grey PNG images in binary columns, and hashes of what the images show.

Images are written and read here: chunks with their checksums tested, zlib streams, and row filters done and
undone with numpy. The hash has a bit for each low-frequency cosine coefficient, set where it exceeds their
median. It's computed in integers, so equal images hash alike on any machine.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY_8_BIT = (8, 0, 0, 0, 0)
WIDTH = 64
IDAT_BYTES = 1 << 16
LOW = 8
ROWS = 4096
SCALE = 1 << 12


def pad(data: bytes, to: int = WIDTH) -> bytes:
    """data and bytes 0 up to a positive multiple of to."""
    return data.ljust(max(1, -(-len(data) // to)) * to, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """The image whose rows are the samples; their number must be a positive multiple of width."""
    raw = np.frombuffer(samples, np.uint8).reshape(-1, width)
    left, up = raw.copy(), raw.copy()
    left[:, 1:] -= raw[:, :-1]
    up[1:] -= raw[:-1]
    # the filter with the least sum of signed differences; unfiltered text often packs best and wins ties
    kind, best = min(((0, raw), (1, left), (2, up)), key=lambda x: int(np.minimum(x[1], -x[1]).sum(dtype=np.int64)))
    rows = np.empty((len(raw), width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, best
    packed = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(raw), *GREY_8_BIT)
    parts = (_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return b"".join((SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")))


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows without their filters, of any of the five kinds; images of one kind up to 2 take no loop."""
    if len(kinds) and (kinds == kinds[0]).all() and kinds[0] < 3:
        return rows if kinds[0] == 0 else np.cumsum(rows, axis=int(kinds[0] == 1), dtype=np.uint8)
    out, above = np.empty_like(rows), np.zeros(rows.shape[1], np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows)):
        if kind == 0:
            above = row
        elif kind == 1:
            above = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            above = row + above
        elif kind in (3, 4):
            a, c, line = 0, 0, []
            for x, b in zip(row.tolist(), above.tolist()):
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                a, c = (x + guess) & 255, b
                line.append(a)
            above = np.array(line, np.uint8)
        else:
            raise ValueError(f"filter {kind}")
        out[y] = above
    return out


def from_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey image, rows by columns. A false signature, checksum, size or kind is a ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, head, packed, kind = 8, None, [], b""
    while at < len(data) and kind != b"IEND":
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != data[at + 8 + n : at + 12 + n]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None or head[2:] != GREY_8_BIT or kind != b"IEND":
        raise ValueError("cut off, or not an 8-bit grey image")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(packed), bufsize=height * (width + 1) or 1), np.uint8).reshape(height, width + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def _waves(n: int, start: int, stop: int) -> np.ndarray:
    """Columns start to stop of the LOW lowest cosine waves of n samples, as whole numbers."""
    return np.rint(np.cos(np.pi / n * np.outer(np.arange(LOW), np.arange(start, stop) + 0.5)) * SCALE).astype(np.int64)


@lru_cache(maxsize=64)
def _short_waves(n: int) -> np.ndarray:
    return _waves(n, 0, n)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: a bit for each of the 8 x 8 lowest frequencies, the constant one's bit always 0.

    Rows are taken ROWS at once, so that long images take no more memory than short ones; tables are kept up to that size.
    """
    h, w = image.shape
    across, low = _short_waves(w).T, np.zeros((LOW, LOW), np.int64)
    for start in range(0, h, ROWS):
        block = image[start : start + ROWS]
        # columns first, then rows; the shift keeps the second product under 63 bits for images up to 2^27 rows
        part = (block.astype(np.int64) @ across) >> 12
        low += (_short_waves(h) if h <= ROWS else _waves(h, start, start + len(block))) @ part
    low = low.ravel()
    bits = low[1:] > np.partition(low[1:], 31)[31]
    return np.packbits(np.concatenate(([False], bits))).tobytes().hex()


def png(data: Column, level: int = 6) -> Column:
    """binary: the PNG image of a string or binary column, padded with bytes 0; null counts as empty."""

    @F.arrow_udf("binary")
    def made(rows: pa.Array) -> pa.Array:
        return pa.array([to_png(pad(x or b""), level=level) for x in rows.cast(pa.binary()).to_pylist()], pa.binary())

    return made(data)


def read_png(media: Column) -> Column:
    """struct<payload binary, feature string> of a PNG column: its samples and their cosine hash; null for null and for no bytes."""

    @F.arrow_udf("struct<payload:binary,feature:string>")
    def read(rows: pa.Array) -> pa.Array:
        images = [None if x is None else from_png(x) for x in rows.to_pylist()]
        payload = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
        feature = pa.array([None if x is None else cosine_hash(x) for x in images], pa.string())
        return pa.StructArray.from_arrays([payload, feature], ["payload", "feature"])

    # nullif() between the functions: nested ones would run the inner again for every use of its result
    return read(F.nullif(media, F.lit(b"")))

"""PNG columns: exact round trips, checksums and filters."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import media, q_media


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, b"x" * 65, bytes(range(256)) * 50, np.random.default_rng(1).bytes(70_000)])
def test_round_trip(data):
    kept = media.from_png(media.to_png(media.pad(data))).tobytes()
    assert kept == data + b"\0" * (len(kept) - len(data)) and len(kept) % 64 == 0 and len(kept) > 0 and len(kept) - len(data) <= 64


def test_all_filters():
    rnd = np.random.default_rng(2)
    image = rnd.integers(0, 256, (10, 7), dtype=np.uint8)
    kinds, rows = np.arange(10) % 5, np.empty_like(image)
    for y in range(10):
        for x in range(7):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows[y, x] = (int(image[y, x]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256
    assert (media._unfilter(kinds, rows) == image).all()


def test_damage_is_found():
    image = bytearray(media.to_png(b"hello" * 64))
    image[45] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.from_png(bytes(image))
    with pytest.raises(ValueError):
        media.from_png(b"GIF89a")
    with pytest.raises((ValueError, struct.error)):
        media.from_png(media.to_png(b"hello" * 64)[:-12])


def test_hash_is_stable_and_tells_apart():
    a = np.arange(64 * 20, dtype=np.uint8).reshape(20, 64)
    assert media.cosine_hash(a) == media.cosine_hash(a.copy()) != media.cosine_hash(a.T[:20, ::-1])
    assert media.cosine_hash(np.zeros((1, 64), np.uint8)) == "0" * 16


def plain_hash(image):
    """The hash by sums over all samples, one frequency after the other."""
    h, w = len(image), len(image[0])
    wave = lambda n, k, i: round(math.cos(math.pi / n * k * (i + 0.5)) * media.SCALE)
    across = [[sum(v * wave(w, k, x) for x, v in enumerate(row)) >> 12 for k in range(8)] for row in image]
    low = [sum(wave(h, j, y) * row[k] for y, row in enumerate(across)) for j in range(8) for k in range(8)]
    middle = sorted(low[1:])[31]
    return "".join(str(int(n > 0 and v > middle)) for n, v in enumerate(low))


@pytest.mark.parametrize("height, rows", [(1, 4096), (9, 4096), (20, 7), (21, 7), (3, 1)])
def test_hash_against_plain_sums(monkeypatch, height, rows):
    monkeypatch.setattr(media, "ROWS", rows)
    image = np.random.default_rng(height).integers(0, 256, (height, 64), dtype=np.uint8)
    assert f"{int(media.cosine_hash(image), 16):064b}" == plain_hash(image.tolist())


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (None, "long " * 9000)]])
def test_query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, b"z") for r in rows], "doc_id long, text string, media binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = q_media.op3_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        for r in (x for x in got if x.doc_id == doc_id):
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(m := media.to_png(payload)), hashlib.sha256(m).hexdigest())

"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

Three orders predict an id. Order 2 and order 1 are tables, by the two ids before and the one before, of the id that
last followed and a confidence; order 0 are adaptive counts of all ids that neither of them gave. An id's
probability is the mix of the three, with a weight for each order that adapts to how often the orders were right at
these two confidences, and by whether they agree. The range coder takes an id in one step: an interval of order 2's
or order 1's weight, or inside that of order 0 the id's own. It leaves words of 16 bits behind; a carry into words that are
behind already is added when the block is done.

A block is dealt to lanes, stretches of the block that are coded side by side, a step for an id of each lane; all
lanes teach one model, which a step finds as the steps before left it. All arithmetic is of integers but for two
divisions, whose operands are under 2^53 and whose quotients lie further from the next integer than IEEE's rounding goes, so any
machine decodes alike. Coder and decoder know at which step a lane needs a word, so lanes' words stand in that order. Every block starts anew and has the checksums of its bytes and of its ids.

A segment: MAGIC, then little-endian u32: ids, ids a block, blocks, checksum of the header so far; per block u32
lanes, alphabet, bytes, checksum of them, checksum of its ids; then the blocks' bytes, words of 16 bits: the first three of
each lane, then the others as they are needed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDR3"
#: Ids of a block and blocks of a segment at most.
BLOCK, BLOCKS = 1 << 21, 8
#: Lanes of a block at most, and ids of a lane that a small block has at least.
LANES, STRETCH = 8192, 256
H2 = 1 << 16
#: Order 0's resolution, and that of the weights.
FINE, COARSE = 20, 9
#: After so many steps, and doubled from there on, order 0 takes up what it has seen.
REFRESH = 1
#: Steps from one mix of the weights to the next.
REMIX = 8
#: A lane's range is 2^48 at most, and 2^32 at least.
_BOTTOM, _TOP, _FIRST = 1 << 32, 1 << 48, 3
_M1, _M2 = 0x9E3779B1 & (H2 - 1) | 1, 0x85EBCA77 & (H2 - 1) | 1


class _Model:
    """What all lanes know. A step: predict(), then update() with the ids that came.

    An entry of an order's table is id * 4 + confidence (0 to 3). A case is the two confidences and whether both orders
    have one id (32 of them); an outcome adds 1 if order 2 was right and 2 if order 1 was (so 3: both, the same id).
    """

    def __init__(self, alphabet: int, decoding: bool):
        self.alphabet, self.decoding = alphabet, decoding
        self.order1, self.order2 = np.zeros(alphabet, np.int64), np.zeros(H2, np.int64)
        # outcomes seen, 4 of each case; a case without any is taken to be like this
        self.seen = np.tile(np.array([24, 4, 2, 2], np.int64), 32)
        self.count, self.fresh = np.zeros(alphabet, np.int64), []
        self.step, self.due = 0, REFRESH
        # what an outcome does to an entry that isn't replaced: right 1 up, wrong 1 down
        confidence2, confidence1 = np.repeat(np.arange(32) >> 3, 4), np.repeat(np.arange(32) >> 1 & 3, 4)
        change = lambda right, sure: np.where(right, (sure < 3) * 1, -1)
        self.change2, self.change1 = change(np.tile([0, 1, 0, 1], 32), confidence2), change(np.tile([0, 0, 1, 1], 32), confidence1)
        self._refresh()

    def _refresh(self) -> None:
        """Order 0's intervals from the counts; one more place stands for 'not by order 0'."""
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=self.alphabet)
            self.fresh = []
        free = (1 << FINE) - self.alphabet
        width = 1 + self.count * free // max(int(self.count.sum()), 1)
        width[0] += (1 << FINE) - int(width.sum())  # what rounding leaves
        self.width = np.append(width, 1)
        self.begin = np.append(np.cumsum(width) - width, 0)
        if self.decoding:
            self.id_at = np.repeat(np.arange(self.alphabet, dtype=np.uint16), width)

    def _mix(self) -> None:
        """Weights, and an outcome's interval: base + unit * (begin of the id in order 0, or 0), unit * (its width there, or 1)."""
        seen = self.seen.reshape(32, 4)
        total = seen.sum(axis=1) + 2
        w2 = 1 + (seen[:, 1] + seen[:, 3]) * ((1 << COARSE) - 3) // total  # also where both were right
        w1 = 1 + seen[:, 2] * ((1 << COARSE) - 3) // total
        w0 = (1 << COARSE) - w2 - w1
        mix = np.stack([w0, w2 << FINE, w1 << FINE, w2 << FINE], axis=1)
        base = np.stack([0 * w0, w0, w0 + w2, w0], axis=1) << FINE
        self.unit, self.base = mix.ravel(), base.ravel()
        if self.decoding:
            self.w0 = np.repeat(w0, 4).astype(float)
            self.end0, self.end2 = self.w0 * (1 << FINE), np.repeat(w0 + w2 << FINE, 4).astype(float)

    def predict(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Each lane's case, as its outcome 0, after these ids and those before them."""
        if self.step == self.due:
            self._refresh()
            self.due *= 2
        if self.step % REMIX == 0:
            self._mix()
        self.last, self.slot2 = last, (last * _M1 ^ before * _M2) & H2 - 1
        self.e2, self.e1 = self.order2.take(self.slot2, mode="clip"), self.order1.take(last, mode="clip")  # clip is the fastest mode; no index is out of bounds
        self.id2, self.id1, self.sure2, self.sure1 = self.e2 >> 2, self.e1 >> 2, self.e2 & 3, self.e1 & 3
        return self.sure2 << 5 | self.sure1 << 3 | (self.id2 == self.id1) << 2

    def intervals(self, outcome: np.ndarray, ids: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's interval in 2^(FINE + COARSE). right: lanes of which order 2 or 1 is right; they come into outcome."""
        here = ids.take(right)
        outcome[right] |= (here == self.id2.take(right)) | (here == self.id1.take(right)) << 1
        place = ids.copy()
        place[right] = self.alphabet
        unit = self.unit.take(outcome, mode="clip")
        return self.base.take(outcome, mode="clip") + unit * self.begin.take(place, mode="clip"), unit * self.width.take(place, mode="clip")

    def update(self, outcome: np.ndarray, ids: np.ndarray, by0: np.ndarray) -> None:
        """by0: the ids that order 0 gave."""
        new = ids << 2
        for table, at, entry, sure, id_there, change in ((self.order2, self.slot2, self.e2, self.sure2, self.id2, self.change2), (self.order1, self.last, self.e1, self.sure1, self.id1, self.change1)):
            there = np.flatnonzero(sure | (ids == id_there))  # others are wrong without confidence: the new id takes their place
            made = new.copy()
            made[there] = entry.take(there) + change.take(outcome.take(there))
            table[at] = made
        self.seen += np.bincount(outcome, minlength=128) << 4
        self.seen -= self.seen >> 5
        self.fresh.append(by0)
        self.step += 1


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = max(1, min(LANES, n // STRETCH))
    return lanes, -(-n // lanes)


def _encode_block(ids: np.ndarray, alphabet: int) -> tuple[int, bytes]:
    """Lanes, and the block's bytes."""
    lanes, steps = _shape(len(ids))
    padded = np.zeros(lanes * steps, np.uint16)  # the last lane is filled with 0
    padded[: len(ids)] = ids
    now = np.ascontiguousarray(padded.reshape(lanes, steps).T).astype(np.int64)
    last = before = np.zeros(lanes, np.int64)
    model = _Model(alphabet, False)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, _TOP)
    wide = 2 * steps + 8
    at, words, places = np.arange(lanes) * wide, [], []  # a lane's next place; what the steps leave behind, a word with its carry, and where
    for step in range(steps):
        here = now[step]
        outcome = model.predict(last, before)
        by_other = (here == model.id2) | (here == model.id1)
        start, width = model.intervals(outcome, here, np.flatnonzero(by_other))
        unit = size >> FINE + COARSE
        low += unit * start
        size = unit * width
        some = np.flatnonzero(size < _BOTTOM)
        while len(some):
            x, s = low.take(some), size.take(some) << 16
            place = at.take(some)
            words.append(x >> 32)
            places.append(place)
            at[some] = place + 1
            low[some], size[some] = (x & _BOTTOM - 1) << 16, s
            some = some[s < _BOTTOM]
        model.update(outcome, here, here[~by_other])
        before, last = last, here
    words += [low >> 32, low >> 16 & 0xFFFF, low & 0xFFFF]
    places += [at, at + 1, at + 2]
    words, places = np.concatenate(words), np.concatenate(places)
    out = np.empty(lanes * wide, np.int32)
    out[places] = words
    carry = places[words >> 16 != 0]
    while len(carry):
        out[carry] &= 0xFFFF
        out[carry - 1] += 1
        carry = carry[out[carry - 1] >> 16 != 0] - 1
    first = np.arange(lanes)[:, None] * wide + np.arange(_FIRST)
    # a lane needs a word when it leaves the word three places before it behind
    return lanes, out[np.append(first.ravel(), places[: len(places) - _FIRST * lanes] + _FIRST)].astype("<u2").tobytes()


def _decode_block(data: bytes, n: int, lanes: int, alphabet: int) -> np.ndarray:
    if lanes != _shape(n)[0] or len(data) < 2 * _FIRST * lanes or len(data) % 2:
        raise ValueError("lanes of a block")
    steps, model = _shape(n)[1], _Model(alphabet, True)
    words = np.frombuffer(data, "<u2").astype(np.int64)
    at, first = _FIRST * lanes, words[: _FIRST * lanes].reshape(lanes, _FIRST)
    code, size = first[:, 0] << 32 | first[:, 1] << 16 | first[:, 2], np.full(lanes, _TOP)  # code counts from the lane's low end
    out = np.empty((steps, lanes), np.uint16)
    last = before = np.zeros(lanes, np.int64)
    for step in range(steps):
        outcome = model.predict(last, before)
        unit = size >> FINE + COARSE
        value = code / unit
        here = model.id_at.take((value / model.w0.take(outcome, mode="clip")).astype(np.int64), mode="clip").astype(np.int64)
        by0 = value < model.end0.take(outcome, mode="clip")
        some = np.flatnonzero(~by0)
        here[some] = np.where(value.take(some) < model.end2.take(outcome.take(some)), model.id2.take(some), model.id1.take(some))
        start, width = model.intervals(outcome, here, some)
        code -= unit * start
        size = unit * width
        some = np.flatnonzero(size < _BOTTOM)
        while len(some):
            s = size.take(some) << 16
            code[some], size[some] = code.take(some) << 16 | words[at : at + len(some)], s
            at += len(some)
            some = some[s < _BOTTOM]
        out[step] = here
        model.update(outcome, here, here[by0])
        before, last = last, here
    if at != len(words):
        raise ValueError("length of a block")
    return np.ascontiguousarray(out.T).ravel()[:n]


def encode_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of ids, 0 to 65535, at most BLOCKS blocks of them."""
    n = len(ids)
    if n > block * BLOCKS:
        raise ValueError(f"{n} ids; a segment holds {block * BLOCKS}")
    if n and int(ids.max()) > 65535:
        raise ValueError("ids are 65535 at most")
    table, parts = [], []
    for at in range(0, n, block):
        some = np.asarray(ids[at : at + block])
        alphabet = int(some.max()) + 1
        lanes, data = _encode_block(some, alphabet)
        table.append((lanes, alphabet, len(data), zlib.crc32(data), zlib.crc32(some.astype("<u4").tobytes())))
        parts.append(data)
    packed = np.array(table, "<u4").tobytes()
    head = MAGIC + struct.pack("<3I", n, block, len(parts))
    return b"".join((head, struct.pack("<I", zlib.crc32(head + packed)), packed, *parts))


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError at any difference from what its checksums say."""
    if data[:4] != MAGIC or len(data) < 20:
        raise ValueError("not a segment")
    n, block, count, checksum = struct.unpack_from("<4I", data, 4)
    packed = data[20 : 20 + 20 * count]
    if len(packed) < 20 * count or zlib.crc32(data[:16] + packed) != checksum:
        raise ValueError("checksum of the header")
    at, made = 20 + 20 * count, []
    for i, (lanes, alphabet, size, of_bytes, of_ids) in enumerate(np.frombuffer(packed, "<u4").reshape(-1, 5).tolist()):
        some = data[at : at + size]
        at += size
        if len(some) < size or zlib.crc32(some) != of_bytes:
            raise ValueError(f"checksum of block {i}")
        ids = _decode_block(some, min(block, n - i * block), lanes, alphabet).astype("<u4")
        if zlib.crc32(ids.tobytes()) != of_ids:
            raise ValueError(f"checksum of block {i}'s ids")
        made.append(ids)
    return np.concatenate(made) if made else np.empty(0, np.uint32)

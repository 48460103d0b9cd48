"""Encoding texts from encodings of their parts, each distinct part of a slice of texts encoded once.

The public pre-token pattern starts a new match before a space that has a character other than white space on at
least one side: a run of white space gives all but its last character to one match, and its last character, if a
space, to what follows. So texts are cut before their spaces, all texts of a slice at once by Arrow, and the parts are
dictionary-encoded; ids of a slice are then gathered by numpy from those of its distinct parts. Texts with a space between
two white space characters, or between one and the end, are matched as a whole, and so are those with a given string.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut and gathered at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes that kept pieces and their ids may take in a worker, and the longest piece that is kept.
KEEP_BYTES, KEEP_CHARS = 20 << 20, 64
#: About what a kept piece takes beside its characters and ids.
_ENTRY = 180
_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
_INNER = rf"{_SPACE} (?:{_SPACE}|\z)"
#: Marks that are a match of their own after letters and before a space: never more than one id each.
_MARKS = ".,;:!?"
_MARK_AT = np.full(256, -1)
_MARK_AT[list(_MARKS.encode())] = np.arange(len(_MARKS))
_WORD = rf"\pL+[{_MARKS}]?"
_ONE, _TWO = rf"\A{_WORD}\z", rf"\A{_WORD}\n{_WORD}\z"


class Kept:
    """piece -> its ids as bytes. Two generations bound the memory by bytes: what the older one is asked for moves to the
    newer, and when that is full the older goes."""

    def __init__(self, most_bytes: int = KEEP_BYTES):
        self.most, self.taken, self.newer, self.older = most_bytes // 2, 0, {}, {}

    def get(self, pieces: list[str]) -> list[bytes | None]:
        found = list(map(self.newer.get, pieces))
        for i, ids in enumerate(found):
            if ids is None and (old := self.older.get(pieces[i])) is not None:
                found[i] = old
                self.put(pieces[i], old)
        return found

    def put(self, piece: str, ids: bytes) -> None:
        if len(piece) > KEEP_CHARS:
            return
        if self.taken >= self.most:
            self.older, self.newer, self.taken = self.newer, {}, 0
        self.newer[piece] = ids
        self.taken += _ENTRY + len(piece) + len(ids)

    def clear(self) -> None:
        self.taken, self.newer, self.older = 0, {}, {}


def _gathered(flat: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat (one after the other, of these lengths) in the order of code, and the end of each among them."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(flat.itemsize * lengths, out=offsets[1:])
    runs = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    taken = runs.take(pa.array(code))
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(code) + 1)[1:] // flat.itemsize
    return np.frombuffer(taken.buffers()[2] or b"", flat.dtype, int(ends[-1]) if len(ends) else 0), ends


def _stems(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words, without the mark at their end, as a dictionary's indices, and the mark's place among _MARKS or -1."""
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(words.buffers()[1] or b"", np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
    return pc.utf8_rtrim(words, _MARKS).dictionary_encode(), _MARK_AT[data[ends - 1]]


def pieces_of(part: str) -> list[str] | None:
    """The pattern's matches of the commonest parts: letters, with or without a space before, a mark at the end, or a
    newline between two such; None for others."""
    word = part[1:] if part[:1] == " " else part
    if word.isalpha():
        return [part]
    if word[-1:] in _MARKS and word[:-1].isalpha():
        return [part[:-1], part[-1]]
    left, newline, right = part.partition("\n")
    if newline and left and right and left != " " and right[0] != " ":
        a = pieces_of(left)
        if a is not None and (b := pieces_of(right)) is not None:
            return [*a, newline, *b]
    return None


class PartEncoder:
    """Encodes whole texts.

    encode(list of strings) gives the ids of each as bytes (little-endian unsigned 32-bit). cuts: whether the pattern
    is the public one, so that texts may be cut and parts taken by pieces_of(); without it every text is encoded as it
    is. apart: strings whose texts are encoded as they are.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cuts: bool, apart: tuple[str, ...] = (), keep_bytes: int = KEEP_BYTES, slice_bytes: int | None = None):
        self.encode, self.cuts, self.apart, self.kept, self.slice_bytes = encode, cuts, apart, Kept(keep_bytes), slice_bytes or SLICE_BYTES

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = self.kept.get(pieces)
        fresh = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(fresh, self.encode([pieces[i] for i in fresh])):
            found[i] = ids
            self.kept.put(pieces[i], ids)
        return found

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        coded = self._ids(pieces)
        return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) >> 2

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct strings of letters, each with a space before it."""
        return self._pieces([" " + x for x in words.to_pylist()])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _INNER) if self.cuts else pa.array(np.ones(len(texts), bool))
        for string in self.apart:
            odd = pc.or_(odd, pc.match_substring(texts, string))
        at_odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = self.encode([texts[int(i)].as_py() for i in at_odd])
        if len(at_odd):
            texts = pc.if_else(odd, "", texts)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        starts = offsets[:-1] - offsets[0]
        inner = values.dictionary_encode()
        first = values.take(pa.array(starts)).dictionary_encode()
        parts, code = inner.dictionary, inner.indices.to_numpy()
        # distinct parts: words, perhaps with a mark; two such with a newline between; others; then first parts, which have no
        # space before them, and whole texts. Their pieces: words with a space, all others, whole texts
        one, two = pc.match_substring_regex(parts, _ONE), pc.match_substring_regex(parts, _TWO)
        rest = pc.invert(pc.or_(one, two))
        n_one, sides = len(parts.filter(one)), pc.split_pattern(parts.filter(two), "\n").flatten()
        left = np.arange(0, len(sides), 2)
        words, mark = _stems(pa.concat_arrays([parts.filter(one), sides.take(pa.array(left))]))
        lines, mark_of_line = _stems(sides.take(pa.array(left + 1)))
        split = [pieces_of(" " + x) or [" " + x] for x in parts.filter(rest).to_pylist()]
        split += [(pieces_of(x) or [x]) if x else [] for x in first.dictionary.to_pylist()]
        marks_at = len(words.dictionary)
        of_lines = lines.dictionary.to_pylist()
        more = {x: i for i, x in enumerate(dict.fromkeys(chain(_MARKS, "\n", of_lines, chain.from_iterable(split))), marks_at)}  # the marks come first
        coded = [self._words(words.dictionary), self._pieces(list(more))]
        found = np.full((len(words), 5), -1)
        found[:, 0], found[:, 1] = words.indices.to_numpy(), np.where(mark < 0, -1, marks_at + mark)
        found[n_one:, 2], found[n_one:, 4] = more["\n"], np.where(mark_of_line < 0, -1, marks_at + mark_of_line)
        found[n_one:, 3] = np.fromiter(map(more.__getitem__, of_lines), np.int64, len(of_lines))[lines.indices.to_numpy()]
        there = found >= 0
        pieces = np.concatenate([found[there], np.fromiter(map(more.__getitem__, chain.from_iterable(split)), np.int64), np.arange(len(whole)) + marks_at + len(more)])
        per_part = np.concatenate([there.sum(axis=1), np.fromiter(map(len, split), np.int64, len(split)), np.ones(len(whole), np.int64)])
        coded.append((np.frombuffer(b"".join(whole), "<u4"), np.fromiter(map(len, whole), np.int64, len(whole)) >> 2))
        flat, ends = _gathered(*map(np.concatenate, zip(*coded)), pieces)
        del coded, more, split, words, found, there
        ends = np.concatenate(([0], ends))
        last = np.cumsum(per_part)
        of_part = ends[last] - ends[last - per_part]
        # from places in the dictionary to places in this order
        place = np.empty(len(parts), np.int64)
        at = 0
        for some in (one, two, rest):
            here = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            place[here] = np.arange(at, at + len(here))
            at += len(here)
        code = place[code]
        code[starts] = first.indices.to_numpy() + at
        code[starts[at_odd]] = np.arange(len(at_odd)) + at + len(first.dictionary)
        ids, ends = _gathered(flat, of_part, code)
        return ids, ends[offsets[1:] - offsets[0] - 1]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first text, ids of a run of texts, end of each text's ids among them); null texts are empty."""
        if not len(texts):
            return
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        collecting, at = gc.isenabled(), 0
        gc.disable()  # a slice makes hundreds of thousands of objects and no cycles
        try:
            while at < len(texts):
                before = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + self.slice_bytes, "right")))
                yield at, *self._slice(texts.slice(at, to - at))
                at = to
        finally:
            if collecting:
                gc.enable()

    def __call__(self, text: str | None) -> bytes:
        """The ids of one text as bytes."""
        return b"".join(ids.tobytes() for _, ids, _ in self.slices(pa.array([text], pa.string())))

"""Words of whole texts as arrays: bytes are folded and cut with table look-ups, many texts at a time.

The words are those of common.words: A-Z lower-cased, cut at every ASCII character but 0-9 and a-z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut into words at a time; a longer text is read in pieces of this size.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = 32


def _is_word(b: int) -> bool:
    return b >= 0x80 or chr(b).isascii() and chr(b).isalnum()


_FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and _is_word(b) else b if _is_word(b) else _SPACE for b in range(256))
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse mod 2^64; kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words (mod 2^64 polynomial of the words' hashes, finalised)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down, dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * up[: len(hashes) - n + 1])


class Words:
    """The words of some texts: folded bytes, where each word begins and ends in them, its hash, and the first word of each text."""

    __slots__ = ("data", "starts", "ends", "hashes", "bounds")

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        self.data, self.starts, self.ends, self.hashes, self.bounds = data, starts, ends, hashes, bounds

    def of(self, i: int) -> np.ndarray:
        """Hashes of the words of text i."""
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def joined(self, first: int, end: int) -> bytes:
        """Words first to end (numbers in all texts), joined by single spaces."""
        return b" ".join(self.data[self.starts[first] : self.ends[end - 1]].split()) if end > first else b""


def _cut(data: bytes, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in folded bytes; a word also ends where a mark stands."""
    raw = np.frombuffer(data, np.uint8)
    word = raw != _SPACE
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = marks[(marks > 0) & (marks < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def _buffers(column: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), None
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, data


def cut_texts(column: pa.Array, most: int = 4 * PIECE) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, their words) for groups of texts of about `most` bytes, at least one text each.  A null text has no words."""
    at, buffer = _buffers(column)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        begin, end = int(at[lo]), int(at[hi])
        parts, data = [], []
        place = begin
        while place < end:
            stop = min(end, place + PIECE)
            raw = bytes(memoryview(buffer)[place:stop]).translate(_FOLD)
            # A piece ends behind a word: at its last space, or else at the next one.
            while stop < end and (space := raw.rfind(b" ")) <= 0 and raw[-1:] != b" ":
                more = bytes(memoryview(buffer)[stop : min(end, stop + PIECE)]).translate(_FOLD)
                raw, stop = raw + more, stop + len(more)
            if stop < end and (space := raw.rfind(b" ")) > 0:
                stop, raw = place + space + 1, raw[: space + 1]
            marks = at[lo : hi + 1] - place
            starts, ends, hashes = _cut(raw, marks)
            parts.append((starts + (place - begin), ends + (place - begin), hashes))
            data.append(raw)
            place = stop
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        bounds = np.searchsorted(starts, at[lo : hi + 1] - begin)
        found = Words(b"".join(data), starts, ends, hashes, bounds)
        if nulls is not None and nulls[lo:hi].any():
            found = _without(found, nulls[lo:hi])
        yield lo, hi, found
        lo = hi


def _without(found: Words, nulls: np.ndarray) -> Words:
    """The words without those of null texts."""
    sizes = np.diff(found.bounds)
    kept = np.repeat(~nulls, sizes)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(nulls, 0, sizes))])
    return Words(found.data, found.starts[kept], found.ends[kept], found.hashes[kept], bounds)


def digest(found: Words, i: int, text: bytes) -> str:
    """md5 of the words of text i joined by spaces; of a line break and the text itself if it has none."""
    first, end = int(found.bounds[i]), int(found.bounds[i + 1])
    return hashlib.md5(found.joined(first, end) if end > first else b"\n" + text).hexdigest()

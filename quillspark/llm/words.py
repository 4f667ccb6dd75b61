"""Words of many texts at once: spans and 64-bit hashes by whole-array operations."""

from __future__ import annotations

import numpy as np

from .common import U64, mix64

SPACE, ALNUM, MARK, OTHER = 0, 1, 2, 3
_PAD = b" " * 8
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def classes(marks: bytes = b"") -> np.ndarray:
    """Class of each byte; only ASCII white space (9 to 13, 32) is SPACE."""
    out = np.full(256, OTHER, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    if marks:
        out[[*range(48, 58), *range(65, 91), *range(97, 123)]] = ALNUM
        out[list(marks)] = MARK
    return out


_PLAIN = classes()


class Words:
    """Words of a list of texts (bytes). With ``kinds`` that have MARK, a word also ends
    between a letter or digit and a mark.

    ``starts``, ``ends``: spans in ``data``; ``first``: for each text the number of its
    first word, and at the end the number of all words."""

    def __init__(self, texts: list[bytes], kinds: np.ndarray = _PLAIN):
        self.data = b" ".join(texts) + _PAD
        self.bytes = np.frombuffer(self.data, np.uint8)
        kind = kinds[self.bytes]
        inside = kind != SPACE
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        if kinds is not _PLAIN:
            begin[1:] |= (kind[1:] + kind[:-1] == ALNUM + MARK) & (kind[1:] != OTHER) & (kind[:-1] != OTHER)
        end = inside[:-1] & (~inside[1:] | begin[1:])
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        where = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.starts, where)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends - self.starts)


def hash_spans(data: bytes, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hashes of the spans of these starts and lengths, eight bytes at a time; only those
    that go on take part in the next round. Eight bytes must follow the last span."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = mix64(left.astype(U64) * U64(0x9E3779B97F4A7C15) ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
    on = np.flatnonzero(left > 8)
    at, left = at[on] + 8, left[on] - 8
    while len(on):
        out[on] = mix64(out[on] * U64(0x9E3779B97F4A7C15) + (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    return out


def first_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the codes 0 to n - 1 stands first."""
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)

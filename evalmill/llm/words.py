"""Word hashes of whole Arrow text columns, in numpy.

A word is a maximal run of bytes other than space and U+0009..U+000D. Short texts are
hashed together and long ones a piece at a time: a word's hash is a polynomial over its bytes,
taken from one running sum, so no Python object is made for a word. A text of any length costs
its words' places and hashes (24 bytes a word), and the running sums of one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text read together, and the most hashed at a time. About 40 bytes of memory for each.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Another base, where two hashes of a sequence are wanted.
OTHER_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_BASE, OTHER_BASE)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space, and every other ASCII byte that is no letter or digit.
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * powers(_INVERSE[int(base)], n + 1)[starts])


def word_bounds(data: np.ndarray, where: np.ndarray, apart: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; bytes ``apart`` part them, and so do the bounds ``where`` of texts."""
    n, starts, ends = len(data), [], []
    for a in range(0, n + 1, size):
        b = min(a + size, n + 1)
        inside = np.zeros(b - a + 1, dtype=bool)  # of the places a - 1 to b - 1
        low, high = max(a - 1, 0), min(b, n)
        inside[low - a + 1 : high - a + 1] = ~apart[data[low:high]]
        edge = np.zeros(b - a, dtype=bool)
        i, j = np.searchsorted(where, [a, b])
        edge[where[i:j] - a] = True  # a word ends with its text
        before, now = inside[:-1], inside[1:]
        starts.append(a + np.flatnonzero(now & (~before | edge)))
        ends.append(a + np.flatnonzero(before & (~now | edge)))
    return np.concatenate(starts), np.concatenate(ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of each word, about ``size`` bytes at a time; a longer word is summed up in pieces."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(int(np.searchsorted(ends, first + size, side="right")), at + 1)
        last = ends[to - 1]
        if last - first <= size:
            out[at:to] = run_hashes(_BYTE[data[first:last]], starts[at:to] - first, ends[at:to] - first)
        else:
            total = np.zeros(1, np.uint64)
            for k in range(first, last, size):
                piece = _BYTE[data[k : min(k + size, last)]]
                shift = np.array([pow(int(_BASE), int(k - first), 1 << 64)], np.uint64)
                total += np.sum(piece * powers(_BASE, len(piece)), dtype=np.uint64) * shift
            out[at] = mix(total)[0]
        at = to
    return out


@dataclass
class Words:
    """Words of consecutive texts: ``bounds[k]:bounds[k + 1]`` are those of text ``first + k``."""

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, k: int) -> np.ndarray:
        """Word hashes of one text."""
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]

    def joined(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """The words of one text, or those of them to ``keep``, joined by one space."""
        own = slice(self.bounds[k], self.bounds[k + 1])
        starts, ends = self.starts[own], self.ends[own]
        if keep is not None:
            starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return b""
        first, n = starts[0], ends[-1] - starts[0]
        data = np.append(self.data[first : first + n], np.uint8(32))
        data[ends - first] = 32
        stays = np.zeros(n + 2, np.int8)  # each word and the byte behind it
        stays[starts - first] += 1
        stays[ends - first + 1] -= 1
        return data[np.cumsum(stays[:-1], dtype=np.int8).view(bool)][:-1].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[where[0] : where[-1]] if len(where) else data[:0], where - where[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def read_words(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES, marks: bool = False, hashed: bool = True) -> Iterator[Words]:
    """The words of every text, a chunk of texts at a time; with ``marks`` ASCII marks part words too."""
    data, offsets = text_bytes(column)
    for at, to in chunks(offsets, size):
        own = data[offsets[at] : offsets[to]]
        where = offsets[at : to + 1] - offsets[at]
        if lower:
            own = _LOWER[own]
        starts, ends = word_bounds(own, where, _MARK if marks else _SPACE, max(size, 1))
        hashes = word_hashes(own, starts, ends, max(size, 1)) if hashed else np.zeros(0, np.uint64)
        yield Words(at, np.searchsorted(starts, where), hashes, starts, ends, own, where)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def grams(hashes: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words; they cross texts, so slice by text afterwards."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    if n > 8:
        for a in range(0, count, CHUNK_BYTES):
            at = np.arange(min(CHUNK_BYTES, count - a))
            out[a : a + len(at)] = run_hashes(hashes[a : a + len(at) + n - 1], at, at + n, base)
        return out
    for j in range(n):
        out += hashes[j : j + count] * _PLACES[j]
    return mix(out)


def short_gram(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer words than a shingle has."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        total = np.sum(hashes * _PLACES[:n], dtype=np.uint64) + _PLACES[32 + n]
    return mix(np.array([total], dtype=np.uint64))[0]

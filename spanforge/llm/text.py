"""Words, lines and their hashes over a whole Arrow batch of texts at once (numpy, no loop per row).

Texts are handled as UTF-8 bytes. A null text is an empty one. Stretches of bytes are hashed with XXH64; where equality itself
counts within a task, same_bytes and classes compare what hashes alike. Rolling hashes, polynomial in the bytes modulo
2**64, only choose among grams of a few bytes: what they choose is compared by other means.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa

from spanforge.llm.xxh import xxh64

#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64)
_powers = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII that is no letter or digit separates; other bytes belong to words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


class Texts:
    """Texts of one slice: buf holds their bytes one after another, text i is buf[at[i]:at[i + 1]]."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.buf, self.at, self.n = buf, at, len(at) - 1
        self._sums = None

    def sums(self) -> np.ndarray:
        """Prefix sums from which the hash of any stretch follows."""
        if self._sums is None:
            out = np.zeros(len(self.buf) + 1, np.uint64)
            np.multiply(_BYTE[self.buf], _power(_BASE, len(self.buf)), out=out[1:])
            np.add.accumulate(out, out=out)
            self._sums = out
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
        """XXH64 of each stretch [start, end)."""
        return xxh64(self.buf, start, end, seed)

    def rolling(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each stretch [start, end) of a few bytes, cheap for every place of the buffer."""
        s = self.sums()
        inv = _power(_BASE_INV, len(self.buf) + 1)
        return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one for each byte) in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def words(self, sep: np.ndarray = SPACE) -> Words:
        return Words(self, sep)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-separated lines, and the index of each text's first line."""
        breaks = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([breaks, self.at[1:]]), kind="stable")
        n = np.searchsorted(breaks, self.at, "left")
        return starts, ends, n + np.arange(self.n + 1)


class Words:
    """Words of the texts: start and end byte, and first[i], the index of text i's first word."""

    def __init__(self, texts: Texts, sep: np.ndarray):
        inside = ~sep[texts.buf]
        inner = texts.at[:-1][texts.at[:-1] < texts.at[1:]]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[inner] = inside[inner]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = texts.at[1:][texts.at[:-1] < texts.at[1:]] - 1
        stops[last] = inside[last]
        self.texts, self.inside = texts, inside
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, texts.at, "left")
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return self.texts.hashes(self.start, self.end)

    def bytes(self, a: int, b: int) -> list[bytes]:
        """The words from number a up to b."""
        return [self.texts.buf[i:j].tobytes() for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]

    def same(self, a: np.ndarray, b: np.ndarray, n: int = 1) -> np.ndarray:
        """Whether the n words from number a on are those from number b on, byte for byte."""
        out = np.ones(len(a), bool)
        for k in range(n):
            live = np.flatnonzero(out)
            x, y = a[live] + k, b[live] + k
            out[live] = same_bytes(self.texts.buf, self.start[x], self.end[x], self.start[y], self.end[y])
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts.n), self.count)

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words that lie in one text, and the index of each run's first word."""
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            total *= _BASE
            total += h[k : len(h) - n + 1 + k]
        own = self.owner()
        at = np.flatnonzero(own[: len(h) - n + 1] == own[n - 1 :])
        return mix(total[at]), at


def same_bytes(buf: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether buf[a:a_end] is buf[b:b_end], for each pair."""
    size = a_end - a
    out = size == b_end - b
    live = np.flatnonzero(out & (size > 0) & (a != b))
    for k in live[size[live] > 1024].tolist():
        out[k] = np.array_equal(buf[a[k] : a_end[k]], buf[b[k] : b_end[k]])
    live = live[size[live] <= 1024]
    # So many pairs at once that their bytes stay few.
    for some in np.array_split(live, int(size[live].sum()) // SLICE_BYTES + 1):
        if len(some):
            n = size[some]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(first, n)
            out[some] = np.logical_and.reduceat(buf[at + np.repeat(a[some], n)] == buf[at + np.repeat(b[some], n)], first)
    return out


def classes(key: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], name: Callable[[int], Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """(number, first): equal numbers for equal things, and the first thing of each number.

    key: a hash of each thing. same(a, b): whether the things a are the things b; name(a): what tells a thing from any other.
    Whatever hashes like another thing without being it gets a number by its name.
    """
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    wrong = np.flatnonzero(first[number] != np.arange(len(key)))
    wrong = wrong[~same(wrong, first[number[wrong]])]
    if len(wrong):
        named: dict[Hashable, int] = {}
        firsts = first.tolist()
        for k in wrong.tolist():
            number[k] = named.setdefault(name(k), len(firsts))
            if number[k] == len(firsts):
                firsts.append(k)
        first = np.array(firsts)
    return number, first


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 places at which its values begin. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, Texts) for stretches of rows of about most bytes in all."""
    buf, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, Texts(buf[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j

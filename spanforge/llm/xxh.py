"""XXH64 of many stretches of one byte buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the published XXH64 algorithm.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _of_length(lanes: np.ndarray, quads: np.ndarray, buf: np.ndarray, at: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    left, pos = length, at
    if length >= 32:
        acc = [np.full(len(at), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while left >= 32:
            for k in range(4):
                acc[k] = _round(acc[k], lanes[pos + 8 * k])
            pos, left = pos + 32, left - 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for k in range(4):
            h = (h ^ _round(np.uint64(0), acc[k])) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, np.uint64)
    h += np.uint64(length)
    while left >= 8:
        h = _rotl(h ^ _round(np.uint64(0), lanes[pos]), 27) * P1 + P4
        pos, left = pos + 8, left - 8
    if left >= 4:
        h = _rotl(h ^ (quads[pos].astype(np.uint64) * P1), 23) * P2 + P3
        pos, left = pos + 4, left - 4
    while left:
        h = _rotl(h ^ (buf[pos].astype(np.uint64) * P5), 11) * P1
        pos, left = pos + 1, left - 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


#: Bytes beyond which a stretch is hashed by itself, with the library.
LONG = 256


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of buf[start:end] for each pair; all short stretches of one length are worked on together."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    long = np.flatnonzero(end - start > LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh64_intdigest(view[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        short = np.flatnonzero(end - start <= LONG)
        out[short] = xxh64(buf, start[short], end[short], seed)
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    quads = np.ndarray((len(buf) + 1,), "<u4", padded, 0, (1,))
    length = end - start
    order = np.argsort(length.astype(np.uint16) if length.max() < 65536 else length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, i, j in zip(sizes, first, [*first[1:], len(order)], strict=True):
            rows = order[i:j]
            out[rows] = _of_length(lanes, quads, padded, start[rows], int(size), np.uint64(seed))
    return out

"""CRC-32 (zlib's) of many stretches of one byte buffer at once."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes beyond which a stretch is summed by itself, with the library.
LONG = 48


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _table()


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The unsigned checksum of buf[start:end] for each pair; before: those of the bytes that stand in front of each."""
    size = end - start
    state = (np.zeros(len(start), np.uint32) if before is None else before.astype(np.uint32)) ^ np.uint32(0xFFFFFFFF)
    short = np.flatnonzero(size <= LONG)
    # Longest first: those that still have a byte at place k are a prefix.
    short = short[np.argsort(-size[short], kind="stable")]
    at, now = start[short], state[short]
    live = np.searchsorted(-size[short], -np.arange(1, LONG + 1), "right")
    for k in range(int(size[short].max(initial=0))):
        n = live[k]
        now[:n] = _TABLE[(now[:n] ^ buf[at[:n] + k]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    state[short] = now
    out = (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = zlib.crc32(buf[start[k] : end[k]], 0 if before is None else int(before[k]))
    return out

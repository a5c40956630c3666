"""A table from words (byte strings) to numbers that is asked for very many words at once.

Words of at most 16 bytes are two 64-bit lanes and a length, which are compared whole: equal entries are equal words. They are
found by open addressing, all words of a batch side by side. Longer words are few and stand in a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from spanforge.llm.text import mix

#: Bytes that a buffer given to the table must have after its last word.
PADDING = 16
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)


class Generation:
    """Words of one generation: slots of the open addressing, and for each entry its lanes, length and number."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        most = 1 << (bits - 1)
        self.low, self.high = np.zeros(most, np.uint64), np.zeros(most, np.uint64)
        self.size, self.number = np.zeros(most, np.uint8), np.zeros(most, np.int64)
        self.n = 0
        self.long: dict[bytes, int] = {}

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each word; -1: not there."""
        out = np.full(len(h), -1, np.int64)
        place = h & self.mask
        entry = self.slots[place]
        live = np.flatnonzero(entry >= 0)
        while len(live):
            at = entry[live]
            same = (self.low[at] == low[live]) & (self.high[at] == high[live]) & (self.size[at] == size[live])
            out[live[same]] = self.number[at[same]]
            live = live[~same]
            place[live] = (place[live] + np.uint64(1)) & self.mask
            entry[live] = self.slots[place[live]]
            live = live[entry[live] >= 0]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, h: np.ndarray, number: np.ndarray) -> None:
        """Words that are not there yet, each once."""
        a, b = self.n, self.n + len(h)
        self.low[a:b], self.high[a:b], self.size[a:b], self.number[a:b] = low, high, size, number
        self.n = b
        place, live = h & self.mask, np.arange(len(h))
        while len(live):
            free = live[self.slots[place[live]] < 0]
            # Of those that meet at a free slot, the last one written has it.
            self.slots[place[free]] = (a + free).astype(np.int32)
            live = live[self.slots[place[live]] != a + live]
            place[live] = (place[live] + np.uint64(1)) & self.mask


class WordTable:
    """What is known of words: a number for each, which a subclass makes in learn.

    Two generations are kept, so that memory is bounded and words met again stay. A generation is followed by the next once
    a quarter of its slots is taken; what the rest of that batch finds no room for is learned and not kept.
    """

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.new, self.old = Generation(bits), Generation(1)

    def learn(self, words: list[bytes]) -> np.ndarray:
        """A number for each word, none of which is known."""
        raise TypeError("a subclass must say what is kept of a word")

    def carried(self, numbers: np.ndarray) -> np.ndarray:
        """The numbers in the new generation of what has these in the old one."""
        return numbers

    def rotated(self) -> None:
        """The new generation is the old one from now on; what belonged to the one before is no longer asked for."""

    def numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word buf[start:end], valid until the next call; buf goes on for PADDING bytes after the last one."""
        if self.new.n + len(self.new.long) > len(self.new.low) // 2:
            self.old, self.new = self.new, Generation(self.bits)
            self.rotated()
        length = end - start
        lanes = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        short = length <= PADDING
        which = None if short.all() else np.flatnonzero(short)
        a, n = (start, length) if which is None else (start[which], length[which])
        low = lanes[a] & _MASKS[np.minimum(n, 8)]
        high = np.zeros(len(a), np.uint64)
        over = np.flatnonzero(n > 8)
        high[over] = lanes[a[over] + 8] & _MASKS[n[over] - 8]
        size = n.astype(np.uint8)
        h = mix(low * _A + high * _B + size * _C)
        got = self.new.find(low, high, size, h)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            got[miss] = self._missed(buf, a, low, high, size, h, miss)
        if which is None:
            return got
        out = np.empty(len(start), np.int64)
        out[which] = got
        rest = np.flatnonzero(~short)
        out[rest] = self._long([buf[i:j].tobytes() for i, j in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
        return out

    def _missed(self, buf: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, h: np.ndarray, miss: np.ndarray) -> np.ndarray:
        order = np.lexsort((low[miss], high[miss], size[miss], h[miss]))
        at = miss[order]
        x, y = at[1:], at[:-1]
        new = np.append(True, (h[x] != h[y]) | (low[x] != low[y]) | (high[x] != high[y]) | (size[x] != size[y]))
        one = at[new]
        number = self.old.find(low[one], high[one], size[one], h[one])
        met = number >= 0
        number[met] = self.carried(number[met])
        unseen = one[~met]
        number[~met] = self.learn([buf[i : i + k].tobytes() for i, k in zip(a[unseen].tolist(), size[unseen].tolist(), strict=True)])
        room = len(self.new.low) - self.new.n
        one, kept = one[:room], number[:room]
        self.new.add(low[one], high[one], size[one], h[one], kept)
        out = np.empty(len(miss), np.int64)
        out[order] = number[np.cumsum(new) - 1]
        return out

    def _long(self, words: list[bytes]) -> list[int]:
        different = set(words)
        known = {w: self.new.long[w] for w in different if w in self.new.long}
        met = [w for w in different if w not in known and w in self.old.long]
        unseen = [w for w in different if w not in known and w not in self.old.long]
        fresh = dict(zip(met, self.carried(np.array([self.old.long[w] for w in met], np.int64)).tolist(), strict=True))
        fresh |= dict(zip(unseen, self.learn(unseen).tolist(), strict=True))
        room = max(0, len(self.new.low) - len(self.new.long))
        # Very long words aren't kept: they take memory, and hardly come again.
        self.new.long |= {w: k for w, k in list(fresh.items())[:room] if len(w) <= 256}
        known |= fresh
        return [known[w] for w in words]

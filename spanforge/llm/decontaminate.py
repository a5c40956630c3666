"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming candidates, exact verification.

A window of a document has as many words as the item it is held against; a document of fewer words is one window, which is
compared at once. Windows that share no word shingle with any
item of that size have similarity zero and are left out before any fingerprint is made; this loses nothing. Of the
others, those whose fingerprint lies within the radius of an item's are found through three blocks of bits: in one at least
they differ in no more than a third of the radius, and a table of each block's different values names the items that have
them. Of random fingerprints that leaves an eighth. What is found is verified by exact weighted-shingle similarity, on the
words themselves.

The benchmark comes in blocks of bounded bytes, each held against every document in a pass of its own; no pair of documents
is ever made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import Scratch, small_batches, table
from spanforge.llm.text import NOT_ALNUM, Texts, Words, mix, slices

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of 64. At similarity 0.8 about 10 are expected, with a deviation of 3.
RADIUS = 20
#: Blocks of bits that fingerprints are looked up by.
BLOCKS = 3
#: Windows that are fingerprinted at once, and pairs of block values that are compared at once.
WINDOWS, CELLS = 1 << 15, 1 << 22
#: Bytes of benchmark text that go to the tasks at once.
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 20


@dataclass
class Items:
    """Items of one size: their shingles (sorted distinct hashes with weights) and fingerprints."""

    size: int
    ids: list[int] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    tables: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _print(total: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(total > 0, axis=-1, bitorder="little")).view("<u8").ravel()


def _words(texts: Texts) -> tuple[Words, np.ndarray]:
    words = texts.words(NOT_ALNUM)
    return words, words.hashes()


def index(rows: list[tuple[int, str | None]], shingle: int, radius: int = RADIUS) -> list[Items]:
    """The items by size; items without a word are left out. An item of fewer words than a shingle is one shingle."""
    by_size: dict[int, Items] = {}
    if not rows:
        return []
    for i, _, texts in slices(pc.utf8_lower(pa.array([t for _, t in rows], pa.large_string()))):
        words, h = _words(texts)
        for k in range(texts.n):
            size = int(words.count[k])
            if not size:
                continue
            own = h[words.first[k] : words.first[k + 1]]
            n = min(shingle, size)
            grams = _grams(own, n)
            items = by_size.setdefault(size, Items(size))
            s, w = np.unique(grams, return_counts=True)
            items.ids.append(rows[i + k][0])
            items.words.append(words.bytes(int(words.first[k]), int(words.first[k + 1])))
            items.shingles.append(s)
            items.weights.append(w)
            total = sum(_signs(grams[x : x + WINDOWS]).sum(axis=0) for x in range(0, len(grams), WINDOWS))
            items.prints = np.append(items.prints, _print(total))
    for items in by_size.values():
        items.known = np.unique(np.concatenate(items.shingles))
        items.tables = block_tables(items.prints, radius)
    return [by_size[k] for k in sorted(by_size)]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    total = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix(total)


def block_tables(prints: np.ndarray, radius: int) -> list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]]:
    """(mask, different values, first place of each, items in that order) of each block of bits."""
    n = min(BLOCKS, radius + 1)
    cut, out = [64 * i // n for i in range(n + 1)], []
    for a, b in zip(cut, cut[1:], strict=False):
        mask = np.uint64(((1 << (b - a)) - 1) << a)
        order = np.argsort(prints & mask, kind="stable")
        values, first = np.unique((prints & mask)[order], return_index=True)
        out.append((mask, values, np.append(first, len(order)), order))
    return out


def candidates(windows: np.ndarray, tables: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (window, item) that differ in no more than a block's share of the radius in some block, block by block: all
    pairs within the radius are among them. A block's different values are compared, each once."""
    share = radius // len(tables) if tables else 0
    for mask, values, first, order in tables:
        asked, of = np.unique(windows & mask, return_inverse=True)
        at = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[at], np.arange(len(asked) + 1))
        for some in np.array_split(np.arange(len(asked)), len(asked) * len(values) // CELLS + 1):
            x, y = np.nonzero(np.bitwise_count(asked[some][:, None] ^ values[None, :]) <= share)
            x = some[x]
            # Every window with the one value meets every item with the other.
            n, m = begin[x + 1] - begin[x], first[y + 1] - first[y]
            k = np.repeat(np.arange(len(x)), n * m)
            inner = np.arange(len(k)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            yield at[begin[x[k]] + inner // m[k]], order[first[y[k]] + inner % m[k]]


def within(windows: np.ndarray, prints: np.ndarray, tables: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (window, item) within the radius."""
    found = [np.zeros(0, np.int64)]
    for w, i in candidates(windows, tables, radius):
        near = np.bitwise_count(windows[w] ^ prints[i]) <= radius
        found.append(w[near] * len(prints) + i[near])
    return np.divmod(np.unique(np.concatenate(found)), max(1, len(prints)))


def similarity(grams: np.ndarray, shingles: np.ndarray, weights: np.ndarray) -> float:
    """Sum of least weights over sum of greatest, weights being how often a shingle occurs."""
    s, w = np.unique(grams, return_counts=True)
    _, a, b = np.intersect1d(s, shingles, assume_unique=True, return_indices=True)
    both = int(np.minimum(w[a], weights[b]).sum())
    return both / (int(w.sum()) + int(weights.sum()) - both)


def word_similarity(doc: list[bytes], item: list[bytes], n: int) -> float:
    """similarity, on the words themselves."""
    a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (doc, item))
    return (a & b).total() / (a | b).total()


class Scanner:
    def __init__(self, items: list[Items], shingle: int, least: float, radius: int):
        self.items, self.shingle, self.least, self.radius = items, shingle, least, radius
        self.by_gram: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {min(shingle, x.size) for x in items}:
            known = np.unique(np.concatenate([x.known for x in items if min(shingle, x.size) == n]))
            some = np.zeros(1 << _FILTER_BITS, bool)
            some[known >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_gram[n] = known, some

    def find(self, texts: Texts) -> list[tuple[int, int, float, int, int]]:
        """(text, item id, best similarity, first word of the best window, words in it) for each leak."""
        words, h = _words(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for n, (known, some) in self.by_gram.items():
            grams, at = words.grams(h, n) if n > 1 else (_grams(h, 1), np.arange(len(h)))
            maybe = np.flatnonzero(some[grams >> np.uint64(64 - _FILTER_BITS)])
            place = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
            hits = at[maybe[known[place] == grams[maybe]]]
            if not len(hits):
                continue
            own = np.searchsorted(words.first, hits, "right") - 1
            for text in np.unique(own):
                a, b = int(words.first[text]), int(words.first[text + 1])
                local = _grams(h[a:b], n)
                for items in self.items:
                    if min(self.shingle, items.size) == n and items.size <= b - a:
                        for i, start in self._text(local, hits[own == text] - a, b - a, n, items):
                            # What hashes alike is compared by its words.
                            sim = word_similarity(words.bytes(a + start, a + start + items.size), items.words[i], n)
                            key = int(text), items.ids[i]
                            if sim >= self.least and sim > best.get(key, (-1.0,))[0]:
                                best[key] = sim, start, items.size
                    # A text of fewer words is one window, as long as it has shingles enough for the least similarity.
                    elif min(self.shingle, items.size) == n and len(local) >= self.least * (items.size - n + 1) and np.isin(local, items.known).any():
                        for item, own_words, s, w in zip(items.ids, items.words, items.shingles, items.weights, strict=True):
                            if similarity(local, s, w) < self.least:
                                continue
                            sim, key = word_similarity(words.bytes(a, b), own_words, n), (int(text), item)
                            if sim >= self.least and sim > best.get(key, (-1.0,))[0]:
                                best[key] = sim, 0, b - a
        return [(*k, *v) for k, v in sorted(best.items())]

    def _text(self, grams: np.ndarray, hits: np.ndarray, n_words: int, n: int, items: Items) -> Iterator[tuple[int, int]]:
        """(item, first word) of the windows whose hashes say that they are similar enough."""
        size, per = items.size, items.size - n + 1
        mine = hits[np.isin(grams[hits], items.known)]
        if not len(mine):
            return
        # A shared shingle lies in the per windows that begin with it or before: these are stretches of first words, merged.
        low, high = np.clip(mine - per + 1, 0, n_words - size), np.clip(mine, 0, n_words - size)
        new = np.append(True, low[1:] > np.maximum.accumulate(high)[:-1] + 1)
        begins, ends = low[new], np.append(np.maximum.accumulate(high)[:-1][new[1:]], high.max())
        for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
            for a in range(lo, hi + 1, WINDOWS):
                yield from self._windows(grams, a, min(hi + 1, a + WINDOWS), per, items)

    def _windows(self, grams: np.ndarray, a: int, b: int, per: int, items: Items) -> Iterator[tuple[int, int]]:
        """_text for the windows that begin with word a or later, before b."""
        # Running sums of signs where windows begin and end; between these places only the sum counts.
        now = np.zeros(64, np.int64)
        for x in range(a, a + per, WINDOWS):
            now += _signs(grams[x : min(x + WINDOWS, a + per)]).sum(axis=0)
        sums = np.zeros((b - a, 64), np.int32)
        sums[0] = now
        if b - a > 1:
            np.cumsum(_signs(grams[a + per : b - 1 + per]) - _signs(grams[a : b - 1]), axis=0, out=sums[1:])
            sums[1:] += sums[0]
        prints = _print(sums)
        for w, i in zip(*within(prints, items.prints, items.tables, self.radius), strict=True):
            start = a + int(w)
            if similarity(grams[start : start + per], items.shingles[i], items.weights[i]) >= self.least:
                yield int(i), start


def _scanners(benchmark: DataFrame, item: str, text: str, shingle: int, least: float, radius: int, block_bytes: int) -> Iterator[Scanner]:
    """One for each block of the benchmark. Rows come to the driver one partition at a time and leave with their block."""
    rows, size, any_yet = [], 0, False
    for r in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        rows.append((r.i, r.t))
        size += len(r.t)
        if size >= block_bytes:
            yield Scanner(index(rows, shingle, radius), shingle, least, radius)
            rows, size, any_yet = [], 0, True
    if rows or not any_yet:
        yield Scanner(index(rows, shingle, radius), shingle, least, radius)


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, similarity, first_word, n_words): for each row of docs and item that it holds, the best window.

    Words are runs of letters and digits in lower case. Null and blank texts hold nothing; ties go to the first window;
    repeated rows are each reported; an item that is null or has no word matches nothing.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(id, F.col(text).alias("__text"))
    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, item_id long, similarity double, first_word long, n_words long"

    def run_with(scanner: Scanner):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, _, texts in slices(pc.utf8_lower(batch.column(1))):
                    if found := scanner.find(texts):
                        text, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + t for t in text])), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True))], names=[id, "item_id", "similarity", "first_word", "n_words"])

        return run

    out = None
    for scanner in _scanners(benchmark, item, item_text, shingle, least, radius, block_bytes):
        found = narrow.mapInArrow(run_with(scanner), schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; nothing is shuffled.

    Null, empty and blank texts hold nothing and stay; rows without an id are judged by their text; repeated rows are each judged; a
    very long text is scanned whole. A benchmark of several blocks takes a pass for each, written in between, so that a
    task never holds more than one.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    at = docs.columns.index(text)

    def run_with(scanner: Scanner):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                for i, _, texts in slices(pc.utf8_lower(batch.column(at))):
                    stay[[i + f[0] for f in scanner.find(texts)]] = False
                yield batch.filter(pa.array(stay))

        return run

    scanners = _scanners(benchmark, item, item_text, shingle, least, radius, block_bytes)
    left = docs.mapInArrow(run_with(next(scanners)), docs.schema)
    for scanner in scanners:
        left = scratch.written(left, "kept").mapInArrow(run_with(scanner), docs.schema)
        scratch.forget(1)
    return left


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for every document and benchmark item that it holds, over whole tables.

    Null, empty and blank texts and items hold and match nothing; a very long text is scanned whole, in one slice; of windows
    that tie the first is named; repeated rows are each reported; an empty table on either side gives an empty one.
    """
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

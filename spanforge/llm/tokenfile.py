"""Token-ID files in document order, and a minimal perfect hash index from document keys to places in them.

A shard file is MAGIC, the numbers of documents and ids and the bytes of an id, the ids of all its documents one after another,
then for each document its key, its copy number, whether the key is there at all, and the place of its first id; TRAILER ends
the file. Shards' names sort as their documents do.

The index has one row for a bucket of keys: bit arrays by level (a key's slot is the rank of its first bit that no other key of
its level shares), and for each slot a fingerprint of the key, the shard, the place in it and the number of ids. A lookup reads
one bucket, tries its levels and compares the fingerprint; no key is stored.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm._shared import fresh_path, small_batches, table, written
from spanforge.llm.rawfiles import read_files, read_stretches, write_files
from spanforge.llm.text import mix
from spanforge.llm.tokens import TOKENIZER, bpe, grouped
from spanforge.llm.wordtable import WordTable

MAGIC, TRAILER = b"TOKSHRD1", b"TOKSEND1"
_HEAD = struct.Struct("<8sQQQ")
#: Ids of a shard at least; a document lies in one shard.
SHARD_IDS = 8 << 20
#: Characters that are encoded at once; each takes about a hundred bytes meanwhile.
ENCODED_CHARS = 1 << 17
#: Keys of an index bucket, on average.
BUCKET_KEYS = 1 << 14
#: Bits for each key left at a level.
ROOM = 2
END_ID = 2


class Ids(WordTable):
    """Ids of words. A number holds a place in the generation's ids, how many they are, and the generation's parity."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.machine = bpe(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.visible = {b: c for b, c in enumerate(map(chr, (self.machine.shown[b] for b in range(256))))}
        self.parity = 0
        self.flat, self.used = [np.zeros(1 << 20, self.dtype), np.zeros(0, self.dtype)], [0, 0]

    def _kept(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        p, a = self.parity, self.used[self.parity]
        if a + len(ids) > len(self.flat[p]):
            self.flat[p] = np.concatenate([self.flat[p][:a], np.zeros(a + len(ids), self.dtype)])
        self.flat[p][a : a + len(ids)] = ids
        self.used[p] = a + len(ids)
        return (((a + np.cumsum(n) - n) << 24 | n) << 1) | p

    def learn(self, words: list[bytes]) -> np.ndarray:
        special, visible, tokenize = self.machine.special_bytes, self.visible, self.library.model.tokenize
        # The library's model takes a word of the split pattern with its bytes as visible characters.
        ids = [[special[w]] if w in special else [x.id for x in tokenize(w.decode("latin-1").translate(visible))] for w in words]
        n = np.array([len(x) for x in ids], np.int64)
        return self._kept(np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(n.sum())), n)

    def carried(self, numbers: np.ndarray) -> np.ndarray:
        return self._kept(*self.ids(numbers))

    def rotated(self) -> None:
        self.parity = 1 - self.parity
        self.flat[self.parity], self.used[self.parity] = np.zeros(1 << 20, self.dtype), 0

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        n, a = numbers >> 1 & 0xFFFFFF, numbers >> 25
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        odd = (numbers & 1).astype(bool)
        if not odd.any() or odd.all():
            return self.flat[int(odd[:1].any())][at], n
        odd = np.repeat(odd, n)
        out = np.empty(len(at), self.dtype)
        out[odd], out[~odd] = self.flat[1][at[odd]], self.flat[0][at[~odd]]
        return out, n


class Encoder:
    """Texts to ids with the tokenizers library; what it says of a word of the split pattern is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known = Ids(path)
        self.dtype, self.machine = self.known.dtype, self.known.machine

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        for group in grouped(texts, ENCODED_CHARS):
            buf, begin, end, first = self.machine.words_of([t for _, t in group])
            ids, n = self.known.ids(self.known.numbers(buf, begin, end))
            at = np.concatenate([[0], np.cumsum(n)])[first] * self.dtype.itemsize
            raw = ids.tobytes()
            for (k, _), a, b in zip(group, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[k].append(raw[a:b])
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Shard:
    """Documents being gathered for one file."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.parts, self.keys, self.copies, self.there, self.sizes = dtype, [], [], [], [], []
        self.ids = 0

    def add(self, key: int | None, copy: int, ids: bytes) -> None:
        self.parts.append(ids)
        self.keys.append(key or 0)
        self.copies.append(copy)
        self.there.append(key is not None)
        self.sizes.append(len(ids) // self.dtype.itemsize)
        self.ids += self.sizes[-1]

    def body(self) -> bytes:
        """The shard as bytes; its documents' ids are let go."""
        at = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        parts, self.parts = self.parts, []
        return b"".join([_HEAD.pack(MAGIC, len(self.keys), self.ids, self.dtype.itemsize), *parts, np.array(self.keys, "<i8").tobytes(), np.array(self.copies, "<u4").tobytes(), np.array(self.there, np.uint8).tobytes(), at.astype("<u8").tobytes()])


@dataclass
class Parsed:
    ids: np.ndarray
    keys: np.ndarray
    copies: np.ndarray
    there: np.ndarray
    at: np.ndarray

    def ends(self) -> np.ndarray:
        return np.append(self.at[1:], len(self.ids)).astype(np.int64)


def parse(body: bytes) -> Parsed:
    magic, n, ids, width = _HEAD.unpack_from(body)
    if magic != MAGIC or body[-len(TRAILER) :] != TRAILER:
        raise ValueError("no whole shard file")
    at, out = _HEAD.size, []
    for count, kind in ((ids, f"<u{width}"), (n, "<i8"), (n, "<u4"), (n, "u1"), (n, "<u8")):
        out.append(np.frombuffer(body, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return Parsed(*out[:3], out[3].astype(bool), out[4].astype(np.int64))


def write_shards(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """The token files of docs in ascending order of id (rows without id first; repeated ids in order of their texts)."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        last = np.array([end_id], library.dtype).tobytes()
        part, number, shard = TaskContext.get().partitionId(), 0, Shard(library.dtype)
        before, copy = object(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:07d}-{number:07d}"]), pa.array([shard.body()], pa.binary())], names=["name", "body"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), library.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                copy = copy + 1 if key == before else 0
                before = key
                shard.add(key, copy, ids + last)
                if shard.ids >= shard_ids:
                    yield out()
                    number, shard = number + 1, Shard(library.dtype)
        if shard.keys:
            yield out()

    write_files(dealt.mapInArrow(run, "name string, body binary"), path, TRAILER)


def directory(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """(shard, key, copy, at, n_ids) of every document in the files, with the crc32 of its ids as 32-bit numbers if asked for."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                shard = parse(body.as_buffer())
                end = shard.ends()
                columns = {
                    "shard": pa.array([name.as_py()] * len(end), pa.string()),
                    "key": pa.array(shard.keys, pa.int64(), mask=~shard.there),
                    "copy": pa.array(shard.copies.astype(np.int64)),
                    "at": pa.array(shard.at),
                    "n_ids": pa.array(end - shard.at),
                }
                if checksums:
                    wide = memoryview(shard.ids.astype("<u4")).cast("B")
                    columns["ids_crc32"] = pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(shard.at.tolist(), end.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    return read_files(spark, path).mapInArrow(run, "shard string, key long, copy long, at long, n_ids long" + ", ids_crc32 long" * checksums)


# The index.


def key_hash(key: np.ndarray, there: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return mix(mix(key.astype(np.int64).view(np.uint64)) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (~there).astype(np.uint64))


def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)) % np.uint64(size)).astype(np.int64)


def perfect_levels(h: np.ndarray) -> list[np.ndarray]:
    """Bit arrays by level for distinct hashes: in each, the bits that exactly one of the keys left has."""
    levels = []
    while len(h):
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
        at = _slot(h, len(levels), max(1, ROOM * len(h)))
        bits = np.bincount(at, minlength=max(1, ROOM * len(h))) == 1
        levels.append(bits)
        h = h[~bits[at]]
    return levels


def packed_levels(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words, ranks): the bits of all levels in 64-bit words, each level from a new word on, and the bits set before each word."""
    rows = [np.packbits(np.concatenate([x, np.zeros(-len(x) % 64, bool)]), bitorder="little").view("<u8") for x in levels]
    words = np.concatenate([*rows, np.zeros(0, "<u8")]).astype("<u8")
    ranks = (np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)).astype("<u4")
    return words, ranks


def perfect_slots(h: np.ndarray, sizes: list[int], words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each hash: the rank of its first bit that is set; -1 for one that no level has (it is no key).

    One bit, one word's count and one stored rank a level; a key is expected to be found within two levels.
    """
    out, first, live = np.full(len(h), -1, np.int64), 0, np.arange(len(h))
    for level, size in enumerate(sizes):
        if not len(live):
            break
        at = _slot(h[live], level, size)
        word, bit = words[first + (at >> 6)], (at & 63).astype(np.uint64)
        found = (word >> bit & np.uint64(1)).astype(bool)
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[live[found]] = (ranks[first + (at >> 6)] + below)[found]
        live, first = live[~found], first + -(-size // 64)
    return out


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


_INDEX = "bucket long, level_bits array<long>, bits binary, ranks binary, fingerprints binary, shards array<string>, shard_of binary, at binary, n_ids binary"


def _build(batch: pa.Table) -> pa.Table:
    column = {c: batch.column(c) for c in batch.column_names}
    there = ~np.asarray(column["key"].is_null())
    h = key_hash(np.asarray(column["key"].fill_null(0)), there, np.asarray(column["copy"]))
    levels = perfect_levels(h)
    words, ranks = packed_levels(levels)
    order = np.empty(len(h), np.int64)
    order[perfect_slots(h, [len(x) for x in levels], words, ranks)] = np.arange(len(h))
    names, shard_of = np.unique(np.array(column["shard"].to_pylist(), object).astype(str), return_inverse=True)
    row = {
        "bucket": [column["bucket"][0].as_py()],
        "level_bits": [[len(x) for x in levels]],
        "bits": [words.tobytes()],
        "ranks": [ranks.tobytes()],
        "fingerprints": [_fingerprint(h)[order].tobytes()],
        "shards": [names.tolist()],
        "shard_of": [shard_of[order].astype("<u4").tobytes()],
        "at": [np.asarray(column["at"])[order].astype("<u8").tobytes()],
        "n_ids": [np.asarray(column["n_ids"])[order].astype("<u8").tobytes()],
    }
    kinds = {"bucket": pa.int64(), "level_bits": pa.list_(pa.int64()), "shards": pa.list_(pa.string())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()})


def _bucket(n_buckets: int):
    return F.pmod(F.xxhash64(F.coalesce("key", F.lit(0)), F.isnull("key"), "copy"), F.lit(n_buckets).cast("long"))


def build_index(entries: DataFrame, path: str, bucket_keys: int = BUCKET_KEYS) -> int:
    """Write the index of a directory of shard files; returns its number of buckets (which a lookup needs)."""
    n_buckets = max(1, -(-entries.count() // bucket_keys))
    entries.select("shard", "key", "copy", "at", "n_ids", _bucket(n_buckets).alias("bucket")).groupBy("bucket").applyInArrow(_build, _INDEX).write.parquet(path)
    return n_buckets


def _find(keys: pa.Table, index: pa.Table) -> pa.Table:
    shard, at, n_ids = [None] * len(keys), np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
    if len(index) and len(keys):
        row = {c: index.column(c)[0] for c in index.column_names}
        there = ~np.asarray(keys.column("key").is_null())
        h = key_hash(np.asarray(keys.column("key").fill_null(0)), there, np.asarray(keys.column("copy")))
        slot = perfect_slots(h, row["level_bits"].as_py(), np.frombuffer(row["bits"].as_buffer(), "<u8"), np.frombuffer(row["ranks"].as_buffer(), "<u4"))
        stored = np.frombuffer(row["fingerprints"].as_buffer(), np.uint32)
        ok = np.flatnonzero((slot >= 0) & (stored[slot] == _fingerprint(h)))
        names = row["shards"].as_py()
        which = np.frombuffer(row["shard_of"].as_buffer(), "<u4")[slot[ok]]
        for k, w in zip(ok.tolist(), which.tolist(), strict=True):
            shard[k] = names[w]
        at[ok] = np.frombuffer(row["at"].as_buffer(), "<u8")[slot[ok]]
        n_ids[ok] = np.frombuffer(row["n_ids"].as_buffer(), "<u8")[slot[ok]]
    return pa.table({"key": keys.column("key"), "copy": keys.column("copy"), "shard": pa.array(shard, pa.string()), "at": pa.array(at), "n_ids": pa.array(n_ids)})


def look_up(keys: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """(key, copy, shard, at, n_ids) for each row of keys(key, copy); the shard is null where the index has no such key."""
    small_batches(keys.sparkSession)
    found = keys.withColumn("bucket", _bucket(n_buckets)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_find, "key long, copy long, shard string, at long, n_ids long")
    return found


def read_ids(spark: SparkSession, shards: str, index: str, n_buckets: int, ids: list[int]) -> dict[int, np.ndarray]:
    """The token ids of a few documents (their first copies): one index bucket, one header and one stretch of a shard each."""
    keys = spark.createDataFrame([(i, 0) for i in ids], "key long, copy long")
    out = {}
    for r in look_up(keys, spark.read.parquet(index), n_buckets).where("shard is not null").collect():
        (head,) = read_stretches(spark, shards, r.shard, [(0, _HEAD.size)])
        magic, _, _, width = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("no whole shard file")
        (body,) = read_stretches(spark, shards, r.shard, [(_HEAD.size + width * r.at, width * r.n_ids)])
        out[r.key] = np.frombuffer(body, f"<u{width}").astype(np.uint32)
    return out


def written_and_read(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each row of docs, from the files: places by the index, checksums from the ids."""
    spark = docs.sparkSession
    shards, index = fresh_path(spark, "tokens"), fresh_path(spark, "token-index")
    write_shards(docs, shards, tokenizer, id, text, end_id)
    if not docs.limit(1).count():
        return spark.createDataFrame([], f"`{id}` long, start long, n_tokens long, ids_crc32 long")
    entries = written(directory(spark, shards, checksums=True), "token-directory")
    n_buckets = build_index(entries, index)
    keys = docs.groupBy(F.col(id).cast("long").alias("key")).agg(F.count("*").alias("n")).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    places = look_up(keys, spark.read.parquet(index), n_buckets).select("key", "shard", "at", "n_ids")
    content = entries.select("shard", "at", "ids_crc32", "n_ids")
    # Ids before a shard: those of its writing task's earlier shards, and of the tasks before, of which there are as many as partitions.
    before = (Window.unboundedPreceding, -1)
    sums = content.groupBy("shard").agg(F.sum("n_ids").alias("ids")).withColumn("part", F.substring("shard", 1, 7))
    parts = sums.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(*before)), F.lit(0))
    bases = sums.withColumn("inside", inside).join(parts, "part").select("shard", (F.col("first") + F.col("inside")).cast("long").alias("base"))
    found = places.join(content.drop("n_ids"), ["shard", "at"]).join(bases, "shard")
    return found.select(F.col("key").alias(id), (F.col("base") + F.col("at")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files: null and empty texts have the end id alone.

    Rows without id come first, rows that share an id in order of their texts (all of one id are written by one task); very
    long texts are encoded in pieces; an empty table gives an empty one.
    """
    import public_tokenizers

    return written_and_read(table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))

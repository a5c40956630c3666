"""SimHash near-duplicate groups, candidates pruned by chains of ring segments."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import small_batches, table, unused, written
from spanforge.llm.graph import components
from spanforge.llm.text import LOWER, Texts, slices
from spanforge.llm.xxh import xxh64

#: Members of a bucket that are compared with each other inside one task; larger buckets are linked through shared neighbours.
SMALL_BUCKET = 256
#: Ids that are broadcast at most, of eight bytes each.
MOST_BROADCAST = 1_000_000

_SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))
_SPREAD = _SPREAD.sum(axis=1, dtype=np.uint64)


def majority_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group h[first[i]:first[i + 1]]: the 64 bits that are set in over half of its values; no values: zero.

    Byte lanes: each byte of h becomes eight counters in one 64-bit word, summed over runs of at most 255 values.
    """
    n, sizes = len(first) - 1, np.diff(first)
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    runs = np.concatenate([np.arange(a, b, 255) for a, b in zip(first[:-1], first[1:], strict=True) if b > a])
    whose = np.searchsorted(first, runs, "right") - 1
    lanes = _SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(lanes, runs, axis=0).astype("<u8").view(np.uint8).reshape(len(runs), 64)
    change = np.flatnonzero(np.diff(whose, prepend=-1))
    totals = np.add.reduceat(counts, change, axis=0, dtype=np.int64)
    who = whose[change]
    bits = np.packbits(totals * 2 > sizes[who][:, None], axis=1, bitorder="little")
    out[who] = np.ascontiguousarray(bits).view("<u8").ravel()
    return out


def fingerprints(texts: Texts, shingle: int = 3) -> np.ndarray:
    """SimHash of each text: XXH64 (seed 42) of its space-joined word shingles, A-Z lowered; fewer words: one shingle of all."""
    words = texts.words()
    inside = np.flatnonzero(words.inside)
    # The words again, one space after each: a shingle is then one stretch of bytes.
    begins = np.zeros(len(texts.buf), bool)
    begins[words.start] = True
    number = np.cumsum(begins[inside]) - 1
    joined = np.full(len(inside) + len(words.start), 32, np.uint8)
    joined[np.arange(len(inside)) + number] = LOWER[texts.buf[inside]]
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    own = words.owner()
    # One shingle for each word that has shingle - 1 more after it in its text; in a shorter text, one for its first word.
    after = np.repeat(words.first[1:], words.count) - np.arange(len(own))
    at = np.flatnonzero((after >= shingle) | ((np.repeat(words.count, words.count) < shingle) & (np.arange(len(own)) == np.repeat(words.first[:-1], words.count))))
    stop = at + np.minimum(shingle, after[at]) - 1
    h = xxh64(joined, start[at], end[stop])
    return majority_bits(h, np.searchsorted(own[at], np.arange(texts.n + 1), "left"))


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with fp, the 64-bit fingerprint as a signed long. Null text: no words."""
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text).alias("__text"))
    schema = narrow.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, column = batch.columns
            fp = np.concatenate([np.zeros(0, np.uint64), *(fingerprints(t, shingle) for _, _, t in slices(column))])
            yield pa.RecordBatch.from_arrays([*rest, pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return narrow.mapInArrow(run, schema)


def segments(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of n segments that divide the ring of bits."""
    at = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links_within(fp: np.ndarray, start: int, radius: int, n_segments: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, members later than i that are within the radius and viable from segment start).

    Pigeonring: some chain of segments that begins at start must differ, over its first l segments, in at most
    l * radius / n_segments bits, for every l. Members that break this for a short chain go before the full count.
    """
    cut = segments(n_segments)
    masks, mask = [], np.uint64(0)
    for step in range(n_segments):
        shift, width = cut[(start + step) % n_segments]
        mask |= np.uint64(((1 << width) - 1) << shift)
        masks.append(mask)
    for i in range(len(fp) - 1):
        rest = np.arange(i + 1, len(fp))
        differ = fp[i] ^ fp[i + 1 :]
        for step in range(n_segments):
            ok = _count(differ & masks[step]) * n_segments <= (step + 1) * radius
            rest, differ = rest[ok], differ[ok]
        if len(rest):
            yield i, rest


def _signed(mask: int) -> int:
    return mask - (1 << 64) * (mask >> 63)


def viable(a: Column, b: Column, radius: int, n_segments: int) -> Column:
    """Whether two fingerprints are within the radius, as an expression: first some chain of segments must keep its budgets
    (see links_within), then the full count decides."""
    cut = segments(n_segments)
    differ = a.bitwiseXOR(b)
    chains = []
    for start in range(n_segments):
        mask, kept = 0, F.lit(True)
        for step in range(n_segments - 1):
            shift, width = cut[(start + step) % n_segments]
            mask |= ((1 << width) - 1) << shift
            kept = kept & (F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)).cast("long"))) <= (step + 1) * radius // n_segments)
        chains.append(kept)
    return functools.reduce(operator.or_, chains) & (F.bit_count(differ) <= radius)


def _bucket_links(radius: int, n_segments: int):
    """mapInArrow function: rows sorted by (segment, key) -> for each bucket a spanning forest of its links."""

    def forest(seg: int, fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
        root, out = list(range(len(fp))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, others in links_within(fp, seg, radius, n_segments):
            for j in others:
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(rep[i]), int(rep[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        for batch in _with_end(batches):
            rows = np.stack([np.asarray(c) for c in batch.columns]) if batch is not None else np.zeros((4, 0), np.int64)
            rows = np.concatenate([*left, rows], axis=1)
            if not rows.shape[1]:
                continue
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            at = [0, *change.tolist(), rows.shape[1]]
            stop = len(at) - 1 if batch is None else len(at) - 2
            found: list[tuple[int, int]] = []
            for a, b in zip(at[:stop], at[1 : stop + 1], strict=True):
                if b - a > 1:
                    found += forest(int(rows[0, a]), rows[2, a:b].astype(np.int64).view(np.uint64), rows[3, a:b])
            left = [rows[:, at[stop] :]] if batch is not None else []
            if found:
                pair = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, radius: int = 2, n_segments: int = 5, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges (u, v) between rows of prints(rep, fp), fp distinct, that connect all pairs within the radius.

    Candidates: the leading segments of a viable chain must be equal, so those form the bucket's key. Buckets of at most
    small_bucket members are compared inside one task, which returns a spanning forest of the links and not all pairs.
    For larger ones no task holds the bucket: each member names the values one bit away from it, and members that share
    a value (they are within two bits) are joined to the least of them; this needs radius 2, others take the first way.
    """
    cut = segments(n_segments)
    exact = next(n for n in range(1, n_segments + 1) if (n + 1) * radius // n_segments or n == n_segments)
    if exact * radius // n_segments:
        raise ValueError("radius is too large for so few segments")

    def key(start: int):
        at = [cut[(start + k) % n_segments] for k in range(exact)]
        mask = sum(((1 << w) - 1) << s for s, w in at)
        return F.struct(F.lit(start).cast("long").alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("key"))

    rows = prints.select(F.explode(F.array(*(key(k) for k in range(n_segments)))).alias("k"), "fp", "rep").select("k.seg", "k.key", "fp", "rep")
    sizes = rows.groupBy("seg", "key").agg(F.count("*").alias("size")).where("size > 1")
    if radius != 2:
        small_bucket = 1 << 62
    crowded = rows.join(sizes.where(F.col("size") > small_bucket), ["seg", "key"], "left_semi").select("fp", "rep").distinct()
    few = rows.join(sizes.where(F.col("size") <= small_bucket), ["seg", "key"], "left_semi").select("seg", "key", "fp", "rep")
    few = few.repartition("seg", "key").sortWithinPartitions("seg", "key", "fp").mapInArrow(_bucket_links(radius, n_segments), "u long, v long")
    one = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    near = crowded.select(F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in one))).alias("near"), "rep")
    hub = near.groupBy("near").agg(F.min("rep").alias("least"))
    return few.union(near.join(hub, "near").where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2, n_segments: int = 5, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    component_id is the least id reachable over links of at most radius differing bits. Null or blank texts have the
    fingerprint zero and are linked like any other. A row without an id makes no links; its component is that of
    the rows with its very fingerprint (null if there are none). Repeated rows each get a row.
    """
    prints = written(with_fingerprints(docs, text, shingle, [id]), "prints")
    reps = written(prints.where(F.col(id).isNotNull()).groupBy("fp").agg(F.min(id).cast("long").alias("rep")), "reps")
    found = components(links(reps, radius, n_segments))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def least_of_each_group(docs: DataFrame, groups: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the component_id that groups(id, component_id) names, and those without id.

    groups has a row for each row of docs. Of rows that repeat both the least id and its text one stays; rows with that id and another
    text stay as well. The ids that go and those that repeat are found on ids alone; where they are at most MOST_BROADCAST the
    texts stay where they are, but for those of repeated ids, and else they meet the ids in one join.
    """
    seen = groups.where(F.col(id).isNotNull()).groupBy(id).agg(F.max(F.col(id) == F.col("component_id")).alias("__stays"), F.count("*").alias("__n")).where("NOT __stays OR __n > 1")
    special = written(seen, "special")
    few = special.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    met = F.broadcast if few else (lambda df: df)
    once = docs.join(met(special.select(id)), id, "left_anti")
    digest = unused(docs, "digest")
    repeated = docs.join(met(special.where("__stays AND __n > 1").select(id)), id, "left_semi").withColumn(digest, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    return once.select(*docs.columns).unionByName(repeated.dropDuplicates([id, digest]).select(*docs.columns))


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the one with the least id (rows without id stay)."""
    return least_of_each_group(docs, near_duplicates(docs, id, text, **options), id, text)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, links at two bits; the cases are those of near_duplicates.

    A very long text is hashed whole, in one slice; an empty table gives an empty one.
    """
    return near_duplicates(table(spark, sf_dir, "documents"))

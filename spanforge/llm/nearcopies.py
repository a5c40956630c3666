"""SimHash near copies at a shingle similarity of 0.8, where the fingerprints' radius is too wide for keys of equal segments.

A text is the set of its distinct shingles of five words (A-Z lowered, between ASCII white space); fewer words make one shingle.
Equal sets become one node first. At similarity 0.8 about 10 of 64 bits differ, which no segments of useful width survive; so
candidates share one of BANDS keys of ROWS minima (two sets of similarity s do with probability 1 - (1 - s**ROWS)**BANDS, 0.99997
at 0.8). Chains of SimHash segments with proportional budgets then prune the pairs, the full Hamming distance within RADIUS is
checked, and the exact similarity of the whole sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm._shared import Scratch, small_batches
from spanforge.llm.graph import components
from spanforge.llm.simhash import fingerprints, least_of_each_group, viable
from spanforge.llm.text import LOWER, Texts, mix, slices

SHINGLE = 5
#: Links need a similarity of 4 / 5; in whole numbers, so that no rounding decides.
LEAST = (4, 5)
BANDS, ROWS = 20, 4
#: Differing bits of SimHash, and segments of its ring. At similarity 0.8, 9.7 bits differ on average, with a deviation of 2.9.
RADIUS, SEGMENTS = 24, 8
#: Buckets of more members are first compared with one member each.
SMALL_BUCKET = 8
#: Shingles of a block of members that are compared in one task (64 more are counted for each member).
BLOCK_SHINGLES = 1 << 19
#: Bits of the filter on the ids whose texts are needed, for each and at most: it only spares work, a join decides.
FILTER_BITS, MOST_FILTER_BITS = 32, 1 << 27
#: Sets from which on a shingle is a column of a matrix; columns and asking sets of one product.
OFTEN, COLUMNS, TOGETHER = 32, 512, 512

_ODD = np.random.Generator(np.random.PCG64(30)).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, ascending in each, and the index of each text's first one."""
    lowered = Texts(LOWER[texts.buf], texts.at)
    words = lowered.words()
    h, own = words.hashes(), words.owner()
    found, whose = [], []
    for n in range(1, shingle + 1):
        grams, at = words.grams(h, n)
        if n < shingle:
            few = words.count[own[at]] == n
            grams, at = grams[few], at[few]
        found.append(mix(grams + np.uint64(n)))
        whose.append(own[at])
    g, own = np.concatenate(found), np.concatenate(whose)
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])])
        g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(texts.n + 1), "left")


def names(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set. No shingles: zeros."""
    full = np.flatnonzero(np.diff(first))
    a, b = np.zeros(len(first) - 1, np.uint64), np.zeros(len(first) - 1, np.uint64)
    if len(full):
        a[full] = np.add.reduceat(mix(g + np.uint64(1)), first[full])
        b[full] = np.add.reduceat(mix(g + np.uint64(2)), first[full])
    return a, b


def band_keys(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key for each band of each set that has shingles."""
    at = first[np.flatnonzero(np.diff(first))]
    keys = np.zeros((len(at), BANDS), np.uint64)
    if len(at):
        for band in range(BANDS):
            key = np.full(len(at), band, np.uint64)
            for odd in _ODD[band]:
                key = mix(key + np.minimum.reduceat(g * odd, at))
            keys[:, band] = key
    return keys


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(1)):
                g, first = shingle_sets(texts, shingle)
                (a, b), size = names(g, first), np.diff(first)
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(g, first).ravel().view(np.int64)))
                fp = fingerprints(texts, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in (a.view(np.int64), b.view(np.int64), size, fp)), lists], names=["id", "a", "b", "size", "fp", "keys"])

    return run


def _places(ids: pa.Array, words: int) -> np.ndarray:
    return mix(np.asarray(ids.fill_null(0)).view(np.uint64)) % np.uint64(64 * words)


def _filter(needed: DataFrame) -> np.ndarray:
    """Bits in 64-bit words, of which those of all ids of needed(rep) are set."""
    words = max(1, min(FILTER_BITS * needed.count(), MOST_FILTER_BITS) >> 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    found = needed.select("rep").mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _sets(shingle: int, given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = given.value
        for batch in batches:
            at = _places(batch.column(0), len(bits))
            asked = (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            batch = batch.filter(pa.array(asked & np.asarray(batch.column(0).is_valid())))
            for i, j, texts in slices(batch.column(1)):
                g, first = shingle_sets(texts, shingle)
                a, b = names(g, first)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=["rep", "a", "b", "grams"])

    return run


def _sets_of(needed: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(rep, grams) of needed(rep). Sets are made again for what is needed, not kept for all; no text is shuffled."""
    given = docs.sparkSession.sparkContext.broadcast(_filter(needed))
    sets = docs.select("id", "text").mapInArrow(_sets(shingle, given), "rep long, a long, b long, grams array<long>")
    # An id may stand on rows with different texts; of these, the sets that it represents count.
    wanted = reps.select("rep", "a", "b").join(needed, "rep", "left_semi")
    return sets.join(wanted, ["rep", "a", "b"], "left_semi").dropDuplicates(["rep", "a", "b"]).select("rep", "grams")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) of reps whose sets are similar enough."""
    sets = scratch.written(_sets_of(pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), reps, docs, shingle), "sets")
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("grams").alias("x")), "u").join(sets.select(F.col("rep").alias("v"), F.col("grams").alias("y")), "v")
    shared, (top, bottom) = F.size(F.array_intersect("x", "y")), LEAST
    return both.where(shared * (top + bottom) >= (F.size("x") + F.size("y")) * top).select("u", "v")


def shared_shingles(flat: np.ndarray, at: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, shingles that set k shares with each set) for each k of asks; set i is flat[at[i]:at[i + 1]].

    Shingles of many of the sets are columns of a matrix, the others lists of the sets that have them.
    """
    n, size = len(at) - 1, np.diff(at)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    whose = np.repeat(np.arange(n), size)
    often = times >= OFTEN
    column = np.cumsum(often) - 1
    in_matrix = often[number]
    row, col = whose[in_matrix], column[number[in_matrix]]
    by_col = np.argsort(col, kind="stable")
    row, col = row[by_col], col[by_col]
    edges = np.searchsorted(col, np.arange(0, int(often.sum()) + COLUMNS, COLUMNS))
    order = np.argsort(number, kind="stable")
    listed, first = whose[order], np.concatenate([[0], np.cumsum(times)])
    for some in (asks[i : i + TOGETHER] for i in range(0, len(asks), TOGETHER)):
        total = np.zeros((len(some), n), np.float32)
        for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            m = np.zeros((n, COLUMNS), np.float32)
            m[row[a:b], col[a:b] - c * COLUMNS] = 1
            total += m[some] @ m.T
        for k, have in zip(some.tolist(), total.astype(np.int64), strict=True):
            own = number[at[k] : at[k + 1]]
            own = own[~often[own]]
            a, many = first[own], times[own]
            met = listed[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            yield k, have + np.bincount(met, minlength=n)


def _block_links(rows: pa.Table) -> pa.Table:
    """Links between the asking members of a block and its others: enough of them to join what they join."""
    t = rows.combine_chunks()
    asks, rep, component = (np.asarray(t.column(c)) for c in ("asks", "rep", "component"))
    grams = t.column("grams").chunk(0)
    flat, at = np.asarray(grams.flatten()), np.asarray(grams.offsets).astype(np.int64)
    at, size = at - at[0], np.diff(at)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    top, bottom = LEAST
    found = []
    for k, shared in shared_shingles(flat, at, np.flatnonzero(asks)):
        near = np.flatnonzero((shared * (top + bottom) >= (size + size[k]) * top) & (component != component[k]))
        for j in near.tolist():
            x, y = find(int(component[k])), find(int(component[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((int(rep[k]), int(rep[j])))
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _rest(crowded: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, scratch: Scratch, block: int) -> DataFrame:
    """Links (u, v) that found lacks between members of one crowded bucket in different components.

    The members outside a bucket's commonest component ask all others. Both are dealt into blocks of about block shingles; a task
    holds two blocks, compares whole sets and gives a spanning forest of the links, so that no pairs are ever rows.
    """
    named = crowded.join(components(found).withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component"))
    main = named.groupBy("key").agg(F.mode("component", True).alias("main"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    open_ = scratch.written(named.join(main.select("key", "main"), "key").withColumn("asks", F.expr("component <> main")), "open")
    # A bucket's pairs within the commonest component need no look; one that all asking members share is asked for once.
    cost = F.col("size") + F.lit(64)
    sums = open_.groupBy("key").agg(F.sum(F.when(F.col("asks"), cost).otherwise(0)).alias("a"), F.sum(cost).alias("b"))
    parts = sums.select("key", F.ceil(F.col("a") / block).alias("na"), F.ceil(F.col("b") / block).alias("nb"))
    dealt = open_.join(parts, "key").withColumn("h", F.xxhash64("rep", "key"))
    asking = dealt.where("asks").select("key", F.pmod("h", "na").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("j"), "rep", "component", F.lit(True).alias("asks"))
    others = dealt.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)).alias("i"), F.pmod("h", "nb").alias("j"), "rep", "component", F.lit(False).alias("asks"))
    sets = scratch.written(_sets_of(open_.select("rep").distinct(), reps, docs, shingle), "sets")
    blocks = asking.unionByName(others).join(sets, "rep")
    return blocks.groupBy("key", "i", "j").applyInArrow(_block_links, "u long, v long")


def links(reps: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, small_bucket: int = SMALL_BUCKET, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (u, v) between reps(rep, a, b, size, fp, keys) that connect all that share a key and are similar enough.

    Small buckets are compared in all pairs. In a larger one each member meets the bucket's hub, the member whose keys are the
    most crowded: a text from which a group of near copies was made has more keys in common with them than they have with each
    other. What its buckets' commonest components still lack is compared in blocks. Nothing is left out by a bound.
    """
    top, bottom = LEAST
    rows = reps.select("rep", "size", "fp", F.explode("keys").alias("key"))
    counted = scratch.written(rows.join(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key"), "buckets")
    few, crowded = counted.where(F.col("members") <= small_bucket), counted.where(F.col("members") > small_bucket)

    def near(pairs: DataFrame, other: str) -> DataFrame:
        small, large = F.least("size", f"{other}.size"), F.greatest("size", f"{other}.size")
        alike = (F.col("rep") != F.col(f"{other}.rep")) & (small * bottom >= large * top) & viable(F.col("fp"), F.col(f"{other}.fp"), RADIUS, SEGMENTS)
        return pairs.where(alike).select(F.least("rep", f"{other}.rep").alias("u"), F.greatest("rep", f"{other}.rep").alias("v"))

    other = few.select("key", F.struct("rep", "size", "fp").alias("other"))
    pairs = near(few.join(other, "key").where("rep < other.rep"), "other")
    central = crowded.groupBy("rep").agg(F.sum("members").alias("crowd"))
    hubs = crowded.join(central, "rep").groupBy("key").agg(F.max(F.struct("crowd", F.xxhash64("rep").alias("h"), "rep", "size", "fp")).alias("hub"))
    pairs = scratch.written(pairs.union(near(crowded.join(hubs, "key"), "hub")).distinct(), "pairs")
    found = scratch.written(_verified(pairs, reps, docs, shingle, scratch), "links")
    if crowded.isEmpty():
        return found
    return found.unionByName(_rest(crowded.select("key", "rep", "size"), found, reps, docs, shingle, scratch, block))


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, small_bucket: int = SMALL_BUCKET, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, component_id) for each row of docs: the least id reachable over links of similarity 0.8 or more.

    Null and blank texts are copies of each other. A row without an id makes no links; its component is that of the rows with
    its very set (null if there are none). Repeated rows each get a row; rows that share an id are one node. A very long text
    is one set in one task, eight bytes for each of its words. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    made = scratch.written(narrow.mapInArrow(_sketched(shingle), "id long, a long, b long, size long, fp long, keys array<long>"), "sketches")
    reps = scratch.written(made.where("id IS NOT NULL").groupBy("a", "b").agg(F.min(F.struct("id", "size", "fp", "keys")).alias("r")).select("a", "b", F.col("r.id").alias("rep"), "r.size", "r.fp", "r.keys"), "reps")
    found = components(links(reps, narrow, scratch, shingle, small_bucket, block))
    component = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", F.coalesce("component", "rep").alias("component_id"))
    return scratch.result(made.join(component, ["a", "b"], "left").select(F.col("id").alias(id), "component_id"), "near-copies")


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the one with the least id (rows without id stay)."""
    return least_of_each_group(docs, near_copies(docs, id, text, **options), id, text)

"""Removal of byte strings that already occurred, by suffix arrays over the only stretches that can hold them.

1. Every window of WINDOW bytes selects its least GRAM-byte gram (the last of equals). Equal windows select the same gram at
   the same offset, so windows whose gram occurs once in the corpus are unique. Neighbouring windows that select one gram
   form a context; only its hashes and place are shuffled, to the gram.
2. Where a gram's context occurs again (its rolling hash and its XXH64, 128 bits in all, agree), every later copy is covered; tasks do this for what they hold before
   the shuffle, so that a passage in a third of all rows arrives once a batch. Of each different context the first remains.
3. Grams with several contexts go to shards. A shard's suffix array and common prefixes give the classes of equal windows; all
   but the first of a class are covered. The windows of a gram with very many contexts are grouped by their own hashes.
4. The covered stretches meet their documents once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import small_batches, table, written
from spanforge.llm.suffix import permuted_lcp, suffix_array
from spanforge.llm.text import Texts, mix, slices

WINDOW, GRAM = 100, 24
#: Bytes of contexts in a shard, at least; contexts of one gram beyond which its windows are grouped instead.
SHARD_BYTES, CROWD = 2 << 20, 4000
#: Bytes of one document that are worked on at once.
STRETCH = 4 << 20

_ROW = "kind int, h long, c long, id long, dh long, start long, len int"
_NAMES = ["kind", "h", "c", "id", "dh", "start", "len"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_COVER, _CONTEXT = 1, 2


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    out, have = key, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def contexts(texts: Texts, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram's hash, context's hash, start, end) of every context, in bytes of the slice."""
    n = len(texts.buf)
    if n < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    at = np.arange(n - gram + 1)
    grams = texts.rolling(at, at + gram)
    bits = np.uint64(24)
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | (low - at.astype(np.uint64) % np.uint64(1 << 24))
    least = _least(key, window - gram + 1)
    del key
    whole = np.zeros(len(least), bool)
    for a, b in zip(texts.at[:-1].tolist(), texts.at[1:].tolist(), strict=True):
        if b - a >= window:
            whole[a : b - window + 1] = True
    begin = np.flatnonzero(whole)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    chosen = (low - (least[begin] & low)).astype(np.int64)
    del least, bits
    # A context ends where the next window selects another gram or isn't the next byte's.
    cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(begin) != 1)) + 1
    first = begin[np.concatenate([[0], cut])]
    last = begin[np.concatenate([cut, [len(begin)]]) - 1]
    place = chosen[np.concatenate([[0], cut])]
    end = last + window
    return grams[place], texts.hashes(first, end), first, end


def _stretches(texts: Texts, window: int) -> Iterator[tuple[Texts, int]]:
    """The texts, or, of one that is too long, stretches that overlap by window - 1 bytes, each with its start."""
    if texts.n > 1 or len(texts.buf) <= STRETCH:
        yield texts, 0
        return
    for a in range(0, len(texts.buf), STRETCH):
        b = min(len(texts.buf), a + STRETCH + window - 1)
        yield Texts(texts.buf[a:b], np.array([0, b - a])), a


def _scan(window: int, gram: int):
    """mapInArrow function: (id, dh, text) -> contexts; of equal contexts in a batch all but the first come as covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dhs = (np.asarray(batch.column(k)) for k in (0, 1))
            parts: list[list[np.ndarray]] = []
            for i, _, texts in slices(batch.column(2)):
                for stretch, base in _stretches(texts, window):
                    h, c, start, end = contexts(stretch, window, gram)
                    own = np.searchsorted(stretch.at, start, "right") - 1
                    parts.append([h.view(np.int64), c.view(np.int64), ids[i + own], dhs[i + own], start - stretch.at[own] + base, end - start])
            if not parts:
                continue
            h, c, id, dh, start, length = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, dh, id, c, h))
            again = np.zeros(len(h), bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
            # An identical row (a repeated document) is not later than itself.
            twin = np.zeros(len(h), bool)
            lead = np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order)))) if len(order) else order
            twin[order] = (id[order] == id[order[lead]]) & (dh[order] == dh[order[lead]]) & (start[order] == start[order[lead]])
            keep = ~(again & twin)
            kind = np.where(again, _COVER, _CONTEXT)
            # Covers have no gram to meet at: they are dealt out evenly.
            h = np.where(again, mix(start.astype(np.uint64) + id.view(np.uint64)).view(np.int64), h)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip((kind, h, c, id, dh, start, length), _KINDS, strict=True)], names=_NAMES)

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, c, id, dh, start): later equal contexts become covers; of grams with several contexts, each first one stays.

    Between batches only the last context and the last first one are kept.
    """
    tail: np.ndarray | None = None  # the latest first context
    tail_met = False  # whether it has been preceded by another of its gram
    for batch in batches:
        rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
        out = [rows[:, rows[0] == _COVER]]
        rows = rows[:, rows[0] == _CONTEXT]
        if rows.shape[1]:
            if tail is not None:
                rows = np.concatenate([tail, rows], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[1, 1:] != rows[1, :-1]) | (rows[2, 1:] != rows[2, :-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = ~new & (rows[3:6] != rows[3:6][:, lead]).any(axis=0)
            covers = rows[:, later].copy()
            covers[0] = _COVER
            firsts = rows[:, new]
            same = firsts[1, 1:] == firsts[1, :-1]
            before = np.concatenate([[tail_met], same])
            after = np.append(same, False)
            out += [covers, firsts[:, :-1][:, (before | after)[:-1]]]
            tail, tail_met = firsts[:, -1:], bool(before[-1])
        rows = np.concatenate(out, axis=1)
        if rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _KINDS, strict=True)], names=_NAMES)
    if tail is not None and tail_met:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(tail, _KINDS, strict=True)], names=_NAMES)


_CUT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dh, text, wanted[start, len, h, crowd]) -> (h, id, dh, start, bytes, crowd) for each wanted context."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _CUT, strict=True)], names=["h", "id", "dh", "start", "bytes", "crowd"])

    for batch in batches:
        rows: list[tuple] = []
        for id, dh, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            rows += [(w["h"], id, dh, w["start"], data[w["start"] : w["start"] + w["len"]], bool(w["crowd"])) for w in wanted]
            if len(rows) > 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def repeated_windows(data: list[bytes], id: np.ndarray, dh: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): stretches of the contexts' bytes that windows cover which an earlier context, or place, has too."""
    sizes = np.array([len(x) for x in data])
    # Bytes are moved up by one: 0 stands between contexts. UTF-8 has no byte 255.
    buf = np.frombuffer(b"\xff".join(data) + b"\xff", np.uint8) + np.uint8(1)
    at = np.cumsum(sizes + 1) - sizes - 1
    sa = suffix_array(buf)
    lcp = permuted_lcp(buf, sa)
    own = np.repeat(np.arange(len(data)), sizes + 1)
    whole = np.arange(len(buf)) - at[own] <= sizes[own] - window
    joined = np.zeros(len(buf), bool)
    joined[1:] = lcp[sa[1:]] >= window
    keep = whole[sa]
    places, joined = sa[keep], joined[keep]
    number = np.cumsum(~joined)
    crowd = np.bincount(number)
    many = crowd[number] > 1
    places, number = places[many], number[many]
    who = own[places]
    order = np.lexsort((start[who] + places - at[who], dh[who], id[who], number))
    places, number, who = places[order], number[order], who[order]
    new = np.diff(number, prepend=-1) != 0
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    where = start[who] + places - at[who]
    later = ~new & ((id[who] != id[who[lead]]) | (dh[who] != dh[who[lead]]) | (where != where[lead]))
    hit = np.sort(places[later])
    if not len(hit):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.flatnonzero(np.diff(hit) != 1) + 1
    a, b = hit[np.concatenate([[0], edge])], hit[np.concatenate([edge, [len(hit)]]) - 1]
    return own[a], a - at[own[a]], b - at[own[a]] + window


def _shards(window: int):
    """mapInArrow function: contexts sorted by gram -> covers (id, dh, start, end). A shard is whole grams of SHARD_BYTES in all."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks()
        id, dh, start = (np.asarray(t.column(k)) for k in (1, 2, 3))
        who, a, b = repeated_windows(t.column(4).to_pylist(), id, dh, start, window)
        if len(who):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (id[who], dh[who], start[who] + a, start[who] + b)], names=["id", "dh", "start", "end"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(4).nbytes
            if size >= SHARD_BYTES:
                h = np.asarray(batch.column(0))
                first = int(np.searchsorted(h, h[-1], "left"))
                # The last gram may go on in the next batch.
                if first:
                    held[-1] = batch.slice(0, first)
                    rest = [batch.slice(first)]
                elif len(held) > 1 and np.asarray(held[-2].column(0))[-1] != h[0]:
                    rest = [held.pop()]
                else:
                    continue
                if out := solve(held):
                    yield out
                held, size = rest, sum(x.column(4).nbytes for x in rest)
        if held and (out := solve(held)):
            yield out

    return run


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(id, dh, start, end): stretches of docs(id, dh, text) made of windows that begin earlier too; they may overlap."""
    found = docs.mapInArrow(_scan(window, gram), _ROW).repartition("h").sortWithinPartitions("h", "c", "id", "dh", "start").mapInArrow(_first_of_each, _ROW)
    found = written(found, "contexts")
    wanted = found.where(F.col("kind") == _CONTEXT)
    crowds = wanted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("h", F.lit(True).alias("crowd"))
    listed = wanted.join(crowds, "h", "left").groupBy("id", "dh").agg(F.collect_list(F.struct("start", "len", "h", "crowd")).alias("wanted"))
    # A document that is there twice gives its contexts twice; they are not later than themselves. Both uses of the texts, here
    # and in the end, are one plan with one exchange of them.
    cut = docs.join(listed, ["id", "dh"]).select("id", "dh", "text", "wanted").mapInArrow(_cut_out, "h long, id long, dh long, start long, bytes binary, crowd boolean")
    few = cut.where("NOT crowd").select("h", "id", "dh", "start", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(_shards(window), "id long, dh long, start long, end long")
    each = cut.where("crowd").select("id", "dh", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("bytes") - window + 1), lambda k: F.sha2(F.substring("bytes", k, F.lit(window)), 256))).alias("k", "w"), "start").select("w", F.struct("id", "dh", (F.col("start") + F.col("k")).alias("start")).alias("place"))
    first = each.groupBy("w").agg(F.min("place").alias("first"))
    more = each.join(first, "w").where("place <> first").select("place.id", "place.dh", "place.start", (F.col("place.start") + window).alias("end"))
    copies = found.where(F.col("kind") == _COVER).select("id", "dh", "start", (F.col("start") + F.col("len")).alias("end"))
    return copies.unionByName(few).unionByName(more)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> (id, text, n_bytes, n_removed, n_spans, kept)."""
    for batch in batches:
        data = batch.column(1).cast(pa.binary()).to_pylist()
        removed, runs, kept = [], [], []
        starts, ends = (batch.column(k) for k in (2, 3))
        for x, start, end in zip(data, starts, ends, strict=True):
            if not start.is_valid:
                removed.append(0), runs.append(0), kept.append(x)
                continue
            a, b = np.asarray(start.values), np.asarray(end.values)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.append(True, a[1:] > b[:-1])
            a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            removed.append(int((b - a).sum()))
            runs.append(len(a))
            kept.append(b"".join(x[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(x)], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) for each row: kept is the text, as bytes, without what began earlier.

    Documents come in order of id, those without id last, and of equal ids in order of a hash of their texts; rows equal in
    both are one document, whose result each of them gets. A null text is an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    last = (1 << 63) - 1
    key = F.coalesce(F.col(id).cast("long"), F.lit(last)).alias("id")
    # Hashes of the texts tell apart what shares an id; where nothing does, a constant takes up no room in the shuffles.
    shared = docs.select(key).groupBy("id").count().where("count > 1").limit(1).count()
    plain = docs.select(key, (F.xxhash64(F.coalesce(text, F.lit(""))) if shared else F.lit(0).cast("long")).alias("dh"), F.coalesce(text, F.lit("")).alias("text"))
    spans = covered(plain, window, gram).groupBy("id", "dh").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    joined = plain.join(spans, ["id", "dh"], "left").select("id", "text", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    out = joined.mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.select(F.nullif("id", F.lit(last)).alias(id), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; the cases are those of without_repeats.

    Very long texts are worked on in stretches; an empty table gives an empty one.
    """
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")

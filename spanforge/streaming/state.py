"""Keyed state with timers: mates and loci that are given out once the watermark says that nothing more can join them.

State holds what is still open of one key: the reads of one name that wait for their mates, or the last open island of a group. Rows
that come later than the watermark are dropped by Spark, which counts them (numRowsDroppedByWatermark of a query's progress).
Queries go on from their checkpoint with the state as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.session import importable_on_workers


def _millis(column: str):
    return F.unix_millis(F.col(column))


def paired_or_expired(reads: DataFrame, time: str, read: str, contig: str, left: str, mate_left: str, wait: int, late: str) -> DataFrame:
    """(read, contig, left, mate_left, status): reads of a stream that name each other's place, as PAIR, with left the lesser place.

    A read whose mate has not come wait milliseconds after it, by the times of events, is put out once, as SINGLE; so is at once one
    that names no mate. Of several that fit the earliest is taken. late: how long Spark waits for rows that are out of order.
    """
    importable_on_workers(reads.sparkSession)
    narrow = reads.withWatermark(time, late).select(F.col(read).alias("read"), F.col(contig).alias("contig"), F.col(left).cast("long").alias("left"), F.col(mate_left).cast("long").alias("mate_left"), F.col(time).alias("at"), _millis(time).alias("ms"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            out = [(*key, a, b, "SINGLE") for a, b, ms in open_ if ms + wait <= now]
            open_ = [x for x in open_ if x[2] + wait > now]
        else:
            rows = sorted((int(ms), int(a), -1 if pd.isna(b) else int(b)) for pdf in batches for ms, a, b in zip(pdf.ms, pdf.left, pdf.mate_left, strict=True))
            for ms, a, b in rows:
                if b < 0:
                    out.append((*key, a, None, "SINGLE"))
                    continue
                fits = next((k for k, x in enumerate(open_) if x[0] == b and x[1] == a), None)
                if fits is None:
                    open_.append([a, b, ms])
                else:
                    open_.pop(fits)
                    out.append((*key, min(a, b), max(a, b), "PAIR"))
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            # A timer must lie beyond the watermark.
            state.setTimeoutTimestamp(max(min(x[2] for x in open_) + wait, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["read", "contig", "left", "mate_left", "status"])
        yield frame.astype({"left": "Int64", "mate_left": "Int64"})

    return narrow.groupBy("read", "contig").applyInPandasWithState(step, "read string, contig string, left long, mate_left long, status string", "lefts array<long>, mates array<long>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def closed_islands(spans: DataFrame, time: str, group: str, lo: str, hi: str, slack: int, wait: int, late: str) -> DataFrame:
    """(group, lo, hi, n): islands of a stream's intervals, each given out once no row has joined it for wait milliseconds of events' time.

    Rows of a group may come in any order while an island is open; an interval joins all open islands that it comes within slack
    of. One that comes after its island was given out begins another.
    """
    importable_on_workers(spans.sparkSession)
    narrow = spans.withWatermark(time, late).select(F.col(group).cast("string").alias("grp"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), F.col(time).alias("at"), _millis(time).alias("ms"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            out = [(key[0], a, b, n) for a, b, n, ms in open_ if ms + wait <= now]
            open_ = [x for x in open_ if x[3] + wait > now]
        else:
            rows = [[int(a), int(b), 1, int(ms)] for pdf in batches for a, b, ms in zip(pdf.lo, pdf.hi, pdf.ms, strict=True)]
            merged: list[list[int]] = []
            for a, b, n, ms in sorted(open_ + rows):
                if merged and a < merged[-1][1] + slack:
                    last = merged[-1]
                    merged[-1] = [last[0], max(last[1], b), last[2] + n, max(last[3], ms)]
                else:
                    merged.append([a, b, n, ms])
            open_ = merged
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            state.setTimeoutTimestamp(max(min(x[3] for x in open_) + wait, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["grp", "lo", "hi", "n"])

    found = narrow.groupBy("grp").applyInPandasWithState(step, "grp string, lo long, hi long, n long", "los array<long>, his array<long>, ns array<long>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("grp", group)

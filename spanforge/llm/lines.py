"""Removal of runs of lines that already occurred, found by winnowing.

A line counts by what stands between its first and last word; lines without a word don't count. Every window of `lines` counted
lines selects the least hash of its grams of GRAM lines (the last of equals), so that equal windows select the same gram at the
same offset. Windows whose gram occurs once in the corpus are unique and go no further. Those of repeated grams are compared by
a second hash of all their lines: these are the matches, extended to both sides of the fingerprint as far as its windows reach,
and neighbouring ones make up longer runs. A line of LONG_LINE words is a window and its own fingerprint besides, so that a
passage of twice as many words is found however few lines it stands on. The first occurrence stays (least id, then earliest
line); every line of a later one goes. Fingerprint and second hash come from XXH64 of the lines with two seeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import small_batches, table, written
from spanforge.llm.text import Texts, mix, slices

#: Runs of this many lines are removed; hashes of so many lines are the fingerprints.
LINES, GRAM = 3, 2
#: Words from which on a line is a run by itself.
LONG_LINE = 25


def counted_lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, text, words) of each line with a word."""
    words = texts.words()
    start, end, first = texts.lines()
    a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = np.flatnonzero(b > a)
    own = np.searchsorted(first, full, "right") - 1
    span = words.start[a[full]], words.end[b[full] - 1]
    return texts.hashes(*span), texts.hashes(*span, seed=43), own, b[full] - a[full]


def winnowed(h: np.ndarray, second: np.ndarray, own: np.ndarray, lines: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, fingerprint, hash of all lines, whether the gram is another than the window before chose) of each window in one text."""
    n = len(h) - lines + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def run(h: np.ndarray, width: int) -> np.ndarray:
        total = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        return mix(total)

    grams, whole = run(h, gram), run(second, lines)
    chosen = np.arange(n)
    for k in range(1, lines - gram + 1):
        chosen = np.where(grams[k : k + n] <= grams[chosen], np.arange(k, k + n), chosen)
    at = np.flatnonzero(own[:n] == own[lines - 1 :])
    chosen = chosen[at]
    return at, grams[chosen], whole[at], np.diff(chosen, prepend=-1) != 0


def _scan(lines: int, gram: int, long_line: int):
    names = ["fp", "w", "id", "dh", "line", "n", "new"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dhs = (np.asarray(batch.column(k)) for k in (0, 1))
            for i, _, texts in slices(batch.column(2)):
                h, second, own, words = counted_lines(texts)
                at, fp, whole, new = winnowed(h, second, own, lines, gram)
                long = np.flatnonzero(words >= long_line)
                size = np.repeat([lines, 1], [len(at), len(long)])
                at, new = np.concatenate([at, long]), np.concatenate([new, np.ones(len(long), bool)])
                fp, whole = np.concatenate([fp, mix(h[long] + np.uint64(1))]), np.concatenate([whole, mix(second[long] + np.uint64(1))])
                first = np.searchsorted(own, np.arange(texts.n))
                rows = (fp.view(np.int64), whole.view(np.int64), ids[i + own[at]], dhs[i + own[at]], at - first[own[at]], size, new.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names)

    return run


def repeated(docs: DataFrame, lines: int = LINES, gram: int = GRAM, long_line: int = LONG_LINE) -> DataFrame:
    """(id, dh, line, n): first lines (counted in the document) and lines of windows of docs(id, dh, text) that occur earlier too."""
    windows = written(docs.mapInArrow(_scan(lines, gram, long_line), "fp long, w long, id long, dh long, line long, n long, new long"), "windows")
    # Grouped sums are combined before the shuffle; the joins' hot keys can be split.
    prints = windows.groupBy("fp").agg(F.sum("new").alias("times")).where("times > 1").select("fp")
    matches = windows.join(prints, "fp")
    first = matches.groupBy("fp", "w").agg(F.min(F.struct("id", "dh", "line")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    return matches.join(first, ["fp", "w"]).where(F.struct("id", "dh", "line") > F.col("first")).select("id", "dh", "line", "n")


def _cut():
    """mapInArrow function: (id, text, windows[line, n]) -> (id, n_lines, n_removed, n_runs, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_lines, n_removed, n_runs, kept = [], [], [], []
            for text, starts in zip(texts, batch.column(2).to_pylist(), strict=True):
                rows = text.split("\n")
                n_lines.append(len(rows))
                if not starts:
                    n_removed.append(0), n_runs.append(0), kept.append(text)
                    continue
                counted = [k for k, row in enumerate(rows) if row.strip(" \t\n\x0b\x0c\r")]
                gone = sorted({s["line"] + k for s in starts for k in range(s["n"])})
                drop: set[int] = set()
                runs = 0
                for k, g in enumerate(gone):
                    if k and gone[k - 1] == g - 1:
                        drop.update(range(counted[g - 1], counted[g] + 1))
                    else:
                        drop.add(counted[g])
                        runs += 1
                n_removed.append(len(gone))
                n_runs.append(runs)
                kept.append("\n".join(row for k, row in enumerate(rows) if k not in drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_lines, n_removed, n_runs)), pa.array(kept, pa.string())], names=["id", "n_lines", "n_removed", "n_runs", "text"])

    return run


def without_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", lines: int = LINES, gram: int = GRAM, long_line: int = LONG_LINE) -> DataFrame:
    """(id, n_lines, n_removed, n_runs, text) for each row: text without the runs of lines that occurred earlier.

    n_removed counts lines with a word, n_runs unbroken runs of these; lines without a word between two removed ones go too.
    Documents come in order of id, those without id last, of equal ids in order of a hash of the text; rows equal in both are
    one document, whose result each gets. A null text is an empty one; texts of fewer lines than a run lose but long lines. A very
    long text is worked on whole, in one slice.
    """
    small_batches(docs.sparkSession)
    last = (1 << 63) - 1
    plain = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(last)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("dh"), F.coalesce(text, F.lit("")).alias("text"))
    starts = repeated(plain, lines, gram, long_line).groupBy("id", "dh").agg(F.collect_set(F.struct("line", "n")).alias("starts"))
    joined = plain.join(starts, ["id", "dh"], "left").select("id", "text", "starts")
    out = joined.mapInArrow(_cut(), "id long, n_lines long, n_removed long, n_runs long, text string")
    return out.select(F.nullif("id", F.lit(last)).alias(id), "n_lines", "n_removed", "n_runs", F.col("text").alias(text))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_chars, kept_sha256) of every document after without_repeated_lines.

    Null is the empty text, of one line; the cases of ties, repeated rows and rows without id are those of that operator; a very
    long text is worked on whole; an empty table gives an empty one.
    """
    found = without_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, line, trim(line, E' \t\n\x0b\x0c\r') AS t
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
c AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE t <> ''),
w AS (SELECT doc_id, i, k, t AS t1, lead(t, 1) OVER d AS t2, lead(t, 2) OVER d AS t3 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, k) AS n FROM w WHERE t3 IS NOT NULL),
o AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS n FROM c WHERE len(regexp_extract_all(t, '[^ \t\n\x0b\x0c\r]+')) >= 25),
g AS (SELECT DISTINCT doc_id, k + d AS k FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 UNION SELECT doc_id, k FROM o WHERE n > 1),
x AS (SELECT doc_id, c.i, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g JOIN c USING (doc_id, k)),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) AS b, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, count(*) AS n_runs FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM runs) USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       length(coalesce(text, ''))::BIGINT AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256
FROM n LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

The base figures follow from the text alone. The model holds two multinomials over hashed words and word pairs: one of
the trusted documents (a bounded, deterministic choice of labelled rows), one of every document. A document's score is
the mean log ratio over its n-grams; a threshold fitted on the labelled rows alone decides every document the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import small_batches, table
from spanforge.llm.text import Texts, Words, classes, mix, same_bytes, slices

#: At most so many labelled rows fit the model (those with the least hash of their id).
MOST_LABELLED = 20_000
#: 2 ** BUCKET_BITS counters for each multinomial.
BUCKET_BITS = 14
#: A wrongly rejected trusted document weighs as much as so many wrongly kept others when the threshold is fitted.
KEEP_WEIGHT = 4.0
MIN_WORDS, MOST_REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: The base columns, in order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Model:
    """weights: log ratio of each bucket; threshold: the least score that is kept."""

    weights: np.ndarray
    threshold: float


def base_figures(texts: Texts, words: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of each text; h: the hashes of its words."""
    n = texts.n
    grams, at = words.grams(h, REPEAT_WINDOW)
    own, spread = words.owner(), np.uint64(0x9E3779B97F4A7C15)

    def same_windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (own[at[a]] == own[at[b]]) & words.same(at[a], at[b], REPEAT_WINDOW)

    def window(k: int) -> tuple:
        return int(own[at[k]]), *(texts.buf[words.start[w] : words.end[w]].tobytes() for w in range(at[k], at[k] + REPEAT_WINDOW))

    number, _ = classes(mix(grams + own[at].astype(np.uint64) * spread), same_windows, window)
    twice = at[np.bincount(number)[number] > 1] if len(at) else at
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    repeated = np.bincount(own, weights=np.cumsum(cover)[:-1] > 0, minlength=n).astype(np.int64) if len(h) else np.zeros(n, np.int64)
    start, end, first = texts.lines()
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    line_own = np.repeat(np.arange(n), np.diff(first))[full]
    start, end = start[full], end[full]

    def same_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (line_own[a] == line_own[b]) & same_bytes(texts.buf, start[a], end[a], start[b], end[b])

    _, one = classes(mix(texts.hashes(start, end) + line_own.astype(np.uint64) * spread), same_lines, lambda k: (int(line_own[k]), texts.buf[start[k] : end[k]].tobytes()))
    again = np.ones(len(start), bool)
    again[one] = False
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": texts.per_text(words.inside & ((texts.buf & 0xC0) != 0x80)),
        "n_symbols": texts.per_text(_SYMBOL[texts.buf]),
        "n_dup_lines": np.bincount(line_own[again], minlength=n).astype(np.int64),
        "n_repeat_words": repeated,
    }


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def buckets(words: Words, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and word pair, and its text."""
    pairs, at = words.grams(h, 2)
    own = words.owner()
    return (np.concatenate([mix(h), pairs]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([own, own[at]])


def scores(words: Words, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight over the n-grams of each text; none: 0."""
    at, own = buckets(words, h, int(len(weights)).bit_length() - 1)
    total = np.bincount(own, weights=weights[at], minlength=words.texts.n)
    return total / np.maximum(1, np.bincount(own, minlength=words.texts.n))


def _counts(trusted: np.ndarray, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            for i, j, texts in slices(batch.column(1)):
                words = texts.words()
                at, own = buckets(words, words.hashes(), bits)
                raw += np.bincount(at, minlength=1 << bits)
                good += np.bincount(at[np.isin(ids[i:j], trusted)[own]], minlength=1 << bits)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    return run


def fit_threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least weighted error between the two classes; the middle of its gap, the lowest such gap. One class only: no cut."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    passed = (~g).sum() - np.concatenate([[0], np.cumsum(~g)])
    error = KEEP_WEIGHT * lost + passed / (~g).sum()
    error[1:-1][s[1:] == s[:-1]] = np.inf
    k = int(np.argmin(error))
    return float("-inf") if k == 0 else float("inf") if k == len(s) else float((s[k - 1] + s[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality", most_labelled: int = MOST_LABELLED, bits: int = BUCKET_BITS) -> Model:
    """The model of the documents. labels(id, quality): 1 is trusted, 0 is not; an id with both counts as 0.

    Corpus counts are sums over every document, made in each task and added up by bucket; what comes to the driver is
    2 ** bits pairs of counts and at most most_labelled labelled rows with their scores.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(quality).isin(0, 1) & F.col(id).isNotNull()).groupBy(id).agg(F.min(quality).alias("q")).orderBy(F.xxhash64(id), id).limit(most_labelled).collect()
    trusted = np.sort(np.array([r[0] for r in chosen if r[1] == 1], np.int64))
    others = np.sort(np.array([r[0] for r in chosen if r[1] == 0], np.int64))
    narrow = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sums = narrow.mapInArrow(_counts(trusted, bits), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.ones(1 << bits), np.ones(1 << bits)
    for r in sums:
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    weights = np.log(good / good.sum()) - np.log(raw / raw.sum()) if len(trusted) else np.zeros(1 << bits)
    labelled = np.sort(np.concatenate([trusted, others]))

    def score_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            known = np.isin(ids, labelled)
            if not known.any():
                continue
            batch, ids = batch.filter(pa.array(known)), ids[known]
            for i, j, texts in slices(batch.column(1)):
                words = texts.words()
                h = words.hashes()
                base = base_figures(texts, words, h)
                passed = ~base_failed(base["n_words"], base["n_repeat_words"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][passed]), pa.array(scores(words, h, weights)[passed])], names=["id", "score"])

    found = narrow.mapInArrow(score_labelled, "id long, score double").groupBy("id").agg(F.max("score").alias("score")).orderBy("id").collect()
    score = np.array([r.score for r in found], float)
    return Model(weights, fit_threshold(score, np.isin(np.array([r.id for r in found], np.int64), trusted)))


def _judge(column: pa.Array, model: Model) -> dict[str, np.ndarray]:
    parts: list[dict[str, np.ndarray]] = []
    for _, _, texts in slices(column):
        words = texts.words()
        h = words.hashes()
        part = base_figures(texts, words, h)
        part["base_failed"] = base_failed(part["n_words"], part["n_repeat_words"])
        part["score"] = scores(words, h, model.weights)
        part["kept"] = ~part["base_failed"] & (part["score"] >= model.threshold)
        parts.append(part)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def judged(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base columns, base_failed, score, kept) for each row; a null text has no words and fails the base rules."""
    small_batches(docs.sparkSession)
    narrow = docs.select(id, F.col(text).alias("__text"))
    types = ", ".join([*(f"{c} long" for c in BASE), "base_failed boolean", "score double", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if out := _judge(batch.column(1), model):
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out.values())], names=[id, *out])

    return narrow.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, {types}")


def filtered(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if out := _judge(batch.column(at), model):
                yield batch.filter(pa.array(out["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, base figures, base_failed, score, kept) of every document, by the model fitted on documents and labels.

    Null, empty and blank texts have no words and fail the base rules; a very long text is judged whole; a score equal to the
    threshold is kept; repeated rows are each judged; without labels of both kinds only the base rules reject; an empty
    table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))

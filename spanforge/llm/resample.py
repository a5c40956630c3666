"""Importance resampling towards a target: hashed word-run features, weights, and a seeded draw without replacement.

Every document has as features its runs of 1 to n words, hashed into buckets. A bucket's gain is the log ratio of its smoothed
shares in the target texts and in all documents; a document's weight is the sum of its features' gains. Gumbel noise that
depends on the seed and the id alone is added, and the documents with the highest scores are drawn.

Very long texts would leave their tasks behind the others: they are cut at word boundaries into overlapping chunks, dealt over
the tasks, counted and weighed apart and summed up again. A chunk carries n - 1 words more than it owns, so that each run of
words is counted in the one chunk that owns the word it starts with.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm._shared import Scratch, small_batches, table
from spanforge.llm.crc import crc32
from spanforge.llm.text import LOWER, NOT_ALNUM, Texts, buffers, slices

BUCKETS = 10_000
#: Longest run of words that is a feature.
MOST_WORDS = 1
#: A text of more bytes is cut into chunks of about so many.
CHUNK_BYTES = 256 << 10
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20

_CHUNK = "id {id}, digest binary, part int, own long, text string"


def cut(text: Texts, carry: int, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, int]]:
    """(first byte, byte after the last, words owned) of each chunk of one text; a text without words is one empty chunk.

    A chunk owns whole words, of about most bytes together, and carries the first carry words of those after it.
    """
    words = text.words(NOT_ALNUM)
    n, a = len(words.start), 0
    if not n:
        yield 0, 0, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(words.end, words.start[a] + most, "right")))
        yield int(words.start[a]), int(words.end[min(n, b + carry) - 1]), b - a
        a = b


def _chunks(docs: DataFrame, id: str, text: str, carry: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(texts of at most so many bytes, chunks of the others), both with the columns of _CHUNK; chunks are dealt over the tasks.

    digest is that of a whole text that was cut, null for the others. It and the id bring chunks together again, so that no
    number has to be made up for a row, which would differ when a lost task runs again.
    """
    narrow = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = _CHUNK.format(id=docs.schema[id].dataType.simpleString())
    whole = narrow.where(F.col("text").isNull() | (F.octet_length("text") <= most))
    whole = whole.select("id", F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("own"), "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                buf, at = buffers(batch.column(1).slice(row, 1))
                digest = hashlib.sha256(buf).digest()
                for part, (a, b, own) in enumerate(cut(Texts(buf, at), carry, most)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, 1), pa.array([digest]), pa.array([part], pa.int32()), pa.array([own], pa.int64()), pa.array([buf[a:b].tobytes()]).cast(pa.string())],
                        names=["id", "digest", "part", "own", "text"],
                    )

    return whole, narrow.where(F.octet_length("text") > most).mapInArrow(split, schema).repartition("id", "digest", "part")


def features(texts: Texts, own: np.ndarray, most_words: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text, words owned by each text). own: words that a text owns; below 0: all of its own."""
    texts = Texts(LOWER[texts.buf], texts.at)
    words = texts.words(NOT_ALNUM)
    own = np.where(own < 0, words.count, own)
    # Of what separates two words one place is kept, as a space.
    keep = words.inside.copy()
    after = words.end[words.end < len(keep)]
    after = after[~words.inside[after]]
    keep[after] = True
    texts.buf[after] = 0x20
    place = np.concatenate([[0], np.cumsum(keep)])
    buf, start, end = texts.buf[keep], place[words.start], place[words.end]
    owner = words.owner()
    rank = np.arange(len(start)) - words.first[owner]
    bucket, of = [], []
    for n in range(1, most_words + 1):
        at = np.flatnonzero((rank < own[owner]) & (rank + n <= words.count[owner]))
        bucket.append(crc32(buf, start[at], end[at + n - 1]) % n_buckets)
        of.append(owner[at])
    return np.concatenate(bucket), np.concatenate(of), own


def _own(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False)


def bucket_counts(docs: DataFrame, text: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """How many features of all texts are in each bucket. Counted in the tasks; what comes to the driver is a number a bucket."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own = _own(batch)
            for i, j, texts in slices(batch.column(4)):
                total += np.bincount(features(texts, own[i:j], most_words, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    whole, parts = _chunks(docs.select(F.lit(0).alias("id"), F.col(text).alias("text")), "id", "text", most_words - 1, chunk_bytes)
    out = np.zeros(buckets, np.int64)
    for r in whole.union(parts).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to that in the raw texts, one count added to each."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray, most_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = _own(batch), []
            for i, j, texts in slices(batch.column(4)):
                bucket, of, words = features(texts, own[i:j], most_words, len(gain))
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, of, gain[bucket])
                out.append((words, np.bincount(of, minlength=j - i), weight))
            if out:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "digest", "part", "n_words", "n_features", "weight"])

    return run


def weighed(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_features, weight) for each row of docs; chunks of a text that was cut are summed up.

    Rows of one id and one long text are counted by their first chunks, and each gets its row again.
    """
    small_batches(docs.sparkSession)
    figures = ["n_words", "n_features", "weight"]
    schema = f"id {docs.schema[id].dataType.simpleString()}, digest binary, part int, " + ", ".join(f"{c} long" for c in figures)
    whole, parts = (x.mapInArrow(_weigh(gain, most_words), schema) for x in _chunks(docs, id, text, most_words - 1, chunk_bytes))
    summed = parts.groupBy("id", "digest").agg(*(F.sum(c).alias(c) for c in figures), F.sum((F.col("part") == 0).cast("int")).alias("rows"))
    again = summed.select("id", F.explode(F.sequence(F.lit(1), "rows")), *(F.expr(f"{c} div rows").alias(c) for c in figures))
    return whole.select("id", *figures).union(again.select("id", *figures)).withColumnRenamed("id", id)


def scored(weights: DataFrame, id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """weights with score: weight and Gumbel noise in thousandths, from the digest of seed and id. A null id has none."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def drawn(scores: DataFrame, id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores with rank: 1, 2, 3... by falling score, ties to the lesser id, for the best percent of all rows with enough words.

    Rows without an id are not drawn and don't count. Ranks are made inside ranges of scores, of about equally many rows, and
    begin after those of the ranges above; what comes to the driver is a bound and a count for each range.
    """
    spark = scores.sparkSession
    small_batches(spark)
    fit = F.col(id).isNotNull() & (F.col("n_words") >= least_words)
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = percent / 100
    found = scores.where(fit).approxQuantile("score", np.linspace(max(0, 1 - 1.05 * share), 1, ranges).tolist(), share / (4 * ranges))
    bounds = np.unique(np.array(found, float))

    @F.pandas_udf("int")
    def place(score: pd.Series) -> pd.Series:
        """The number of bounds that are greater."""
        return pd.Series((len(bounds) - np.searchsorted(bounds, score.to_numpy(float), "right")).astype(np.int32))

    placed = scores.withColumn("__range", F.when(fit, place("score")))
    total, begins = 0, []
    for r in placed.where(fit).groupBy("__range").count().orderBy("__range").collect():
        begins.append((r["__range"], total))
        total += r["count"]
    most = percent * total // 100
    begins = [b for b in begins if b[1] < most]
    last = begins[-1][0] if begins else -1
    before = F.broadcast(spark.createDataFrame(begins, "__range int, __before long"))
    order = Window.partitionBy("__range").orderBy(F.col("score").desc(), id, "n_words", "n_features", "weight")
    ranked = placed.where(F.col("__range") <= last).join(before, "__range").withColumn("rank", F.col("__before") + F.row_number().over(order))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = placed.where(F.col("__range").isNull() | (F.col("__range") > last)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scores.columns, "rank").union(rest.select(*scores.columns, "rank"))


def resampled(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS,
    seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for each row of docs, drawn towards the texts of target.

    Null and empty texts have no features, weight 0, and are not drawn; a null id has no score and is not drawn, its text
    counts among all; repeated rows are each counted and may each be drawn; a very long text is worked on in chunks, whole;
    without target texts all gains are those of an empty target; an empty table gives an empty one.
    """
    gain = gains(bucket_counts(docs, text, most_words, buckets, chunk_bytes), bucket_counts(target, target_text, most_words, buckets, chunk_bytes))
    scratch = Scratch(docs.sparkSession)
    scores = scratch.written(scored(weighed(docs, gain, id, text, most_words, chunk_bytes), id, seed), "scores")
    return scratch.result(drawn(scores, id, percent, least_words), "resampled")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn towards benchmark; resampled says what each case gets."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum is written out, as a fold over the bytes with the table of the polynomial.
CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
)"""
CRC_OF = """xor(list_reduce(list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT),
  lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295), 4294967295)"""

OP13_SQL = f"""
WITH {CRC_SQL.strip()},
lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, 0 AS target FROM documents
  UNION ALL SELECT NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1 FROM benchmark),
words AS (SELECT doc_id, target, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM lowered),
counted AS (SELECT doc_id, target, f, count(*) AS n FROM words GROUP BY ALL),
hashed AS (SELECT f, {CRC_OF} % 10000 AS b FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM counted), crc_table),
held AS (
  SELECT b, coalesce(sum(n) FILTER (target = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t
  FROM counted JOIN hashed USING (f) GROUP BY b),
gain AS (
  SELECT b, floor(1000.0::DOUBLE * ln((t + 1) * ((SELECT sum(s) FROM held) + 10000) / ((s + 1) * ((SELECT sum(t) FROM held) + 10000))))::BIGINT AS g FROM held),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
  FROM counted JOIN hashed USING (f) JOIN gain USING (b) WHERE target = 0 GROUP BY doc_id),
scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
best AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE n_features >= 20
  QUALIFY rank <= 10 * (SELECT count(*) FROM scores WHERE n_features >= 20) // 100)
SELECT doc_id, n_features, weight, score, rank FROM scores LEFT JOIN best USING (doc_id)
"""

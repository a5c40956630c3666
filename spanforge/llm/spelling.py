"""Groups of spelling variants: words one edit apart, found by anagram hashing.

A word's key is the sum of a power of each of its letters, the same for all its anagrams. Words that differ by one letter more or
less have keys that differ by that letter's power; if a letter is exchanged, the keys differ by the exchange value, the
difference of two powers. The keys are joined on what is left when one letter's power is taken away, which all three have in
common. Since an edit leaves one half of the longer word as it was, a hash of that half goes with the key: anagrams of each other don't
meet unless they also share it. Whether the letters are in order is verified on each candidate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import Scratch, small_batches, table
from spanforge.llm.crc import crc32
from spanforge.llm.resample import CRC_OF, CRC_SQL
from spanforge.llm.text import LOWER, Texts, classes, same_bytes, slices

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A run whose checksum this divides loses a letter.
NOISE = 97
#: The other spelling must occur so many times as often.
RATIO = 2
#: Counts double along a chain of forms, so that no chain has more links than a count has bits, and 2 ** 7 are enough.
MOST_ROUNDS = 7

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def occurrences(texts: Texts, ids: list[str], noise: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the lower-cased runs of letters of at least so many code points, after letters were taken out."""
    buf = LOWER[texts.buf]
    # All of U+00C0 to U+00FF, and nothing else, has C3 as its first byte of two.
    lead = buf == 0xC3
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    words = Texts(np.where(inside, buf, 0x20).astype(np.uint8), texts.at).words()
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    n = points[words.end] - points[words.start]
    some = np.flatnonzero(n >= least)
    start, end, n = words.start[some], words.end[some], n[some]
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crc32(buf, start, end, prefix[words.owner()[some]])
    hit = np.flatnonzero(h % noise == 0)
    place = np.flatnonzero((buf & 0xC0) != 0x80)[points[start[hit]] + h[hit] % n[hit]]
    gone = np.zeros(len(buf), bool)
    gone[place] = True
    gone[place[buf[place] >= 0xC0] + 1] = True
    at = np.concatenate([[0], np.cumsum(~gone)])
    n[hit] -= 1
    left = n >= least
    return buf[~gone], at[start[left]], at[end[left]]


def words(docs: DataFrame, id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): every different run with its count over all documents, of those that are long and frequent enough."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null("").to_pylist()
            for i, j, texts in slices(batch.column(1)):
                buf, start, end = occurrences(texts, ids[i:j], noise, least_letters)
                spelled = Texts(buf, texts.at)

                def same(a: np.ndarray, b: np.ndarray, buf: np.ndarray = buf, start: np.ndarray = start, end: np.ndarray = end) -> np.ndarray:
                    return same_bytes(buf, start[a], end[a], start[b], end[b])

                def name(k: int, buf: np.ndarray = buf, start: np.ndarray = start, end: np.ndarray = end) -> bytes:
                    return buf[start[k] : end[k]].tobytes()

                number, first = classes(spelled.hashes(start, end), same, name)
                yield pa.RecordBatch.from_arrays([pa.array([name(k) for k in first.tolist()], pa.binary()).cast(pa.string()), pa.array(np.bincount(number, minlength=len(first)))], names=["word", "n"])

    narrow = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _power(letter: Column) -> Column:
    """The fifth power of a letter's number: 1 to 26, then 27 to 90 for U+00C0 to U+00FF."""
    v = (F.ascii(letter) - F.when(F.ascii(letter) < 128, 96).otherwise(165)).cast("long")
    return v * v * v * v * v


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, letter: total + _power(letter))


def near(counted: DataFrame) -> DataFrame:
    """(word, other, n_other) for all words of counted(word, n) that one inserted, deleted or exchanged code point makes another.

    A word has one row for each different letter of either half, whatever its length; a word that lacks a letter of another has two.
    """
    size = F.char_length("word")
    with_key = counted.select("word", "n", anagram_key(F.col("word")).alias("key"), size.alias("size"))

    def halves(longer: Column) -> tuple[Column, Column]:
        """First half of the longer word, and where its second half begins."""
        return F.floor(longer / 2).cast("int"), F.floor(longer / 2).cast("int") + 1

    def head(to: Column) -> Column:
        return F.xxhash64(F.lit("head"), F.substring("word", F.lit(1), to))

    def tail(since: Column) -> Column:
        return F.xxhash64(F.lit("tail"), F.substring("word", since, size))

    half, second = halves(F.col("size"))

    def left(letters: Column, kept: Column) -> Column:
        return F.transform(F.array_distinct(F.split(letters, "")), lambda c: F.struct((F.col("key") - _power(c)).alias("left"), kept.alias("half"), _power(c).alias("taken")))

    without = F.concat(left(F.substring("word", second, size), head(half)), left(F.substring("word", F.lit(1), half), tail(second)))
    minus = with_key.select("word", "n", "size", F.explode(without).alias("m")).select("word", "n", "size", "m.*")
    half, second = halves(F.col("size") + 1)
    whole = with_key.select("word", "n", (F.col("size") + 1).alias("size"), F.explode(F.array(head(half), tail(second - 1))).alias("half"), F.col("key").alias("left"))
    keys, apart = ["size", "left", "half"], F.levenshtein("word", "other", 1) == 1

    def named(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col("word").alias("other"), F.col("n").alias("n_other"), *([F.col("taken").alias("given")] if "taken" in df.columns else []))

    # Spark sizes rows that are laid out from a row as that row: it would send all of them to every task by way of the driver.
    exchanged = minus.join(named(minus).hint("merge"), keys).where((F.col("word") < F.col("other")) & (F.col("taken") != F.col("given")) & apart).select("word", "n", "other", "n_other")
    removed = minus.join(named(whole).hint("merge"), keys).where(apart).select("word", "n", "other", "n_other").distinct()
    both = F.array(F.struct("word", "other", "n_other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("n_other")))
    return exchanged.union(removed).select(F.explode(both).alias("p")).select("p.*")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int = NOISE, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the documents.

    Null and empty texts have no words; a null id counts as an empty one where runs lose letters; repeated rows are each
    counted; of near words with one count the lesser is the form; a word without a form is its own root; a very long word is
    one like others; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.written(words(docs, id, text, least_letters, least_count, noise), "words")
    best = near(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("b"))
    best = best.select("word", "n_near", F.col("b.other").alias("other"), (-F.col("b.less")).alias("other_n"))
    joined = counted.join(best.hint("merge"), "word", "left")
    taken = F.col("other_n") >= ratio * F.col("n")
    formed = scratch.written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("other")).alias("form"), F.when(taken, F.col("other_n")).alias("form_n")), "formed"
    )
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    for _ in range(MOST_ROUNDS):
        beyond = links.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        hopped = scratch.written(links.join(beyond.hint("merge"), "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "links")
        moved = hopped.where("moved").limit(1).count()
        links = hopped.select("word", "to")
        if not moved:
            break
    return scratch.result(formed.join(links.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root")), "variants")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of documents; variants says what each case gets."""
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS prefix, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
  FROM documents),
counted AS (SELECT prefix, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {CRC_OF} AS h FROM (SELECT run, n, hex(encode(prefix || run)) AS x FROM counted), crc_table),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
minus AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS m FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
removed AS (SELECT DISTINCT a.word AS word, a.n AS n, b.word AS other, b.n AS n_other FROM minus a JOIN words b ON a.m = b.word),
near AS (
  SELECT a.word, b.word AS other, b.n AS n_other FROM minus a JOIN minus b ON a.m = b.m AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT word, other, n_other FROM removed
  UNION ALL SELECT other, word, n FROM removed),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n_other, other)) AS other, max(n_other) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS reached FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.reached = formed.word WHERE formed.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, reached AS root
FROM formed JOIN (SELECT chain.word, chain.reached FROM chain JOIN formed ON chain.reached = formed.word WHERE formed.form IS NULL) USING (word)
"""

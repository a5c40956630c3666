"""Importance resampling against brute force: chunks of long texts, runs of words, ties, nulls, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import crc, resample, text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def runs(t, n):
    w = words_of(t)
    return [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute(rows, target, n, buckets, seed=2024, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in runs(x, n)), Counter(bucket(f) for x in target for f in runs(x, n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, x in rows:
        f = runs(x, n)
        weight = sum(gain(bucket(g)) for g in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words_of(x)), len(f), weight, score, None])
    able = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], r[1:4]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=90), st.integers(0, 2**32 - 1)), max_size=12))
def test_checksums_equal_the_library(parts):
    at = np.cumsum([0, *(len(b) for b, _ in parts)])
    buf = np.frombuffer(b"".join(b for b, _ in parts), np.uint8)
    before = np.array([s for _, s in parts], np.uint32)
    assert crc.crc32(buf, at[:-1], at[1:]).tolist() == [zlib.crc32(b) for b, _ in parts]
    assert crc.crc32(buf, at[:-1], at[1:], before).tolist() == [zlib.crc32(b, s) for b, s in parts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", " ", "  ", "-", "9", "\n", "漢字", "xyz"]), max_size=40).map("".join), st.integers(1, 4), st.integers(1, 12))
def test_chunks_count_every_run_once(t, n, most):
    (_, _, texts), *_ = [*text.slices(pa.array([t], pa.string()))]
    found = Counter()
    raw = t.encode()
    for a, b, own in resample.cut(texts, n - 1, most):
        (_, _, part), *_ = [*text.slices(pa.array([raw[a:b].decode()], pa.string()))]
        bucket, _, owned = resample.features(part, np.array([own]), n, 1 << 32)
        found += Counter(bucket.tolist())
        assert owned.tolist() == [own] and b - a <= most + 14 * n or own == 1
    assert found == Counter(zlib.crc32(f.encode()) for f in runs(t, n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "é", "漢字", "x9", "--"]) for _ in range(n))
    out = [(i, some(rng.randint(0, 60))) for i in range(120)]
    long = some(3000)
    out += [(500, long), (500, long), (501, long), (None, long), (500, "short " * 30), (502, None), (503, ""), (504, " - "), (505, "w" * 4000), (None, None), (7, out[7][1])]
    return out


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (3, 64, 35), (2, 1000, 100)])
def test_draw_equals_brute_force(spark, rows, n, buckets, percent):
    target = ["alpha beta alpha", "Gamma x9", None, "", "alpha " * 500]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("mine"), "rank": F.lit("mine"), "id": F.lit("mine"), "digest": F.lit(1)}).repartition(5)
    df = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), most_words=n, buckets=buckets, percent=percent, chunk_bytes=700)
    assert df.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, df.collect())) == brute(rows, target, n, buckets, percent=percent)


def test_draw_from_nothing_and_towards_nothing(spark, rows):
    docs, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "text string")
    assert resample.resampled(docs.where("false"), docs).count() == 0
    assert Counter(map(tuple, resample.resampled(docs, none).collect())) == brute(rows, [], 1, 10_000)
    few = [(1, "too few words")]
    assert [r["rank"] for r in resample.resampled(spark.createDataFrame(few, SCHEMA), docs).collect()] == [None]


def test_ties_go_to_the_lesser_id(spark):
    scores = spark.createDataFrame([(k, 30, 30, 5, 7) for k in (9, 4, 4, 2, 8)] + [(1, 19, 19, 5, 99), (None, 30, 30, 5, None)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = resample.drawn(scores, percent=60).collect()
    assert sorted((r.doc_id, r["rank"]) for r in got if r["rank"]) == [(2, 1), (4, 2), (4, 3)] and len(got) == 7

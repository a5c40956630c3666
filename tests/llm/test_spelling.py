"""Spelling variants against brute force over all pairs: noise, halves, chains, ties, nulls, long words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SCHEMA = "doc_id long, text string"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, noise=97, least_count=3, ratio=2):
    n = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % noise else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= least_count}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            form[w] = best if n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, n[w], len(near[w]), f, n[f] if f else None, root))
    return out


def rows():
    rng = random.Random(4)
    base = ["house", "größe", "ÿÀÖ×÷aab", "letters", "abcdefgh", "aabbaabb"]
    words = set(base)
    for w in base:
        for _ in range(40):
            v = list(rng.choice(sorted(words))) if rng.random() < 0.4 else list(w)
            k = rng.randrange(len(v))
            rng.choice([lambda v=v, k=k: v.pop(k), lambda v=v, k=k: v.insert(k, rng.choice("abeßÿ")), lambda v=v, k=k: v.__setitem__(k, rng.choice("abeßÿ"))])()
            words.add("".join(v))
    words = sorted(words) + ["q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1500]
    out = []
    for i in range(60):
        out.append((i, " ".join(w if rng.random() < 0.7 else w.upper() if w.isascii() else w for w in rng.choices(words, k=80)) + "4Letters,house漢字house"))
    out += [(None, "House house, HOUSE"), (100, None), (101, ""), (102, "1 2 - ß"), (3, out[3][1]), (103, " ".join(["chain", "chains", "chains"] * 3 + ["chainse"] * 20))]
    return out


@pytest.mark.parametrize("noise", [97, 3])
def test_variants_equal_brute_force(spark, noise):
    docs = spark.createDataFrame(rows(), SCHEMA).withColumns({"word": F.lit("mine"), "n": F.lit(1), "id": F.lit("mine")}).repartition(5)
    df = spelling.variants(docs, noise=noise)
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got, want = [tuple(r) for r in df.collect()], brute(rows(), noise)
    assert len(got) == len(want) and set(got) == want
    assert any(r[3] is not None and r[3] != r[5] for r in want)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "few")], SCHEMA)
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.where("false")).count() == 0


def test_long_chains_end(spark):
    words = ["a" * k for k in range(5, 25)]
    text = " ".join(w for k, w in enumerate(words) for _ in range(3 * 2 ** min(k, 12)))
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame([(1, text)], SCHEMA), noise=1 << 40).collect()}
    assert got == {w: words[12] if k <= 12 else w for k, w in enumerate(words)}


def test_no_words_go_through_the_driver(spark, tmp_path):
    """Keys are many times the words that Spark sizes them by: neither planned nor adaptive joins may broadcast them."""
    spark.createDataFrame([("a" * k + "b" * j, k + 3) for k in range(3, 9) for j in range(3, 9)], "word string, n long").write.parquet(str(tmp_path / "words"))
    found = spelling.near(spark.read.parquet(str(tmp_path / "words")))
    plan = found._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()
    assert found.count() and "Broadcast" not in plan.executedPlan().toString()


@settings(max_examples=15, deadline=None)
@given(st.sets(st.text(alphabet="abß×", min_size=4, max_size=9), max_size=40))
def test_near_words_equal_all_pairs(spark, words):
    counted = spark.createDataFrame([(w, k + 3) for k, w in enumerate(sorted(words))], "word string, n long")
    got = [(r.word, r.other) for r in spelling.near(counted).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_apart(a, b)}

"""The hidden Markov model against plain recursions and a plain Baum-Welch; blocks, segments, nulls, long texts, empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import hmm
from spanforge.llm._shared import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def tokens_of(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), hmm.END]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def plain(b, start, move):
    """(log likelihood, state probabilities at each token, expected transitions) of one sequence with emissions b."""
    n, k = b.shape
    alpha, scale, now = np.zeros((n, k)), np.zeros(n), start
    for t in range(n):
        v = now * b[t]
        scale[t] = v.sum()
        alpha[t] = v / scale[t]
        now = alpha[t] @ move
    beta, pairs = np.ones(k), np.zeros((k, k))
    gamma = np.zeros((n, k))
    for t in range(n - 1, -1, -1):
        gamma[t] = alpha[t] * beta
        ahead = b[t] * beta / scale[t]
        if t:
            pairs += move * np.outer(alpha[t - 1], ahead)
        beta = move @ ahead
    return np.log(scale).sum(), gamma, pairs


@pytest.mark.parametrize("segment", [1000, 8, 3, 1])
@pytest.mark.parametrize("at_once", [100_000, 20, 1])
def test_recursions_equal_plain_ones(segment, at_once):
    rng = np.random.default_rng(segment)
    k = 3
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    emit = rng.random((6, k)) * 0.1 + 1e-9
    size = np.array([1, 7, 30, 2, 64, 13])
    tokens, first = rng.integers(0, 6, size.sum()).astype(np.int32), np.cumsum(size) - size
    seqs = hmm.Sequences(hmm.Model(start, move, np.ones(k), np.full(k, 0.1)), tokens, emit, first, size, segment, at_once)
    words, firsts, pairs, log = seqs.expected()
    each = [plain(emit[tokens[a : a + n]], start, move) for a, n in zip(first, size, strict=True)]
    want = np.zeros((6, k))
    for (_, g, _), a, n in zip(each, first, size, strict=True):
        np.add.at(want, tokens[a : a + n], g)
    assert np.allclose(seqs.log_likelihoods(len(size)), [e[0] for e in each], rtol=1e-12)
    assert np.isclose(log, sum(e[0] for e in each), rtol=1e-12)
    assert np.allclose(words, want) and np.allclose(firsts, sum(e[1][0] for e in each)) and np.allclose(pairs, sum(e[2] for e in each))


def brute(rows, states, rounds):
    """Plain Baum-Welch over all rows that are not held out, with the counts rounded as the module says; then every row's score."""
    training = [tokens_of(t) for i, t in rows if not held_out(i)]
    words = Counter(w for t in training for w in t)
    total, distinct = sum(words.values()), len(words)
    often = sorted((w for w, n in words.items() if n >= max(hmm.OWN_COUNT, hmm.OWN_SHARE * total)), key=lambda w: (-words[w], w))

    def kind(w):
        return w if w in often else f" {(words[w] > 1) * 256 + zlib.crc32(w[-2:].encode()) % 256}"

    c = Counter()
    for w, n in words.items():
        c[kind(w)] += n
    counts = {}
    for w in c:
        u = np.array([1 + zlib.crc32(f"{k} {w}".encode()) % 1024 / 512 for k in range(states)])
        counts[w] = c[w] * u / u.sum()
    start, move = np.full(states, 1 / states), np.full((states, states), (1 - hmm.STAY) / max(1, states - 1))
    np.fill_diagonal(move, hmm.STAY if states > 1 else 1)

    def emissions():
        n = sum(counts.values()) if counts else np.zeros(states)
        once = sum((counts[w] for w in c if w[:1] == " " and int(w) < 256), np.zeros(states))
        unknown = (np.minimum(once, n / 2) + 1) / (n + 2) if total else np.ones(states)
        out = {w: (1 - unknown) * ((1 - hmm.SHARED) * counts[w] / n + hmm.SHARED * c[w] / total) for w in c}
        # All words and the unknown one have probability one together.
        assert not out or np.allclose(sum(out[kind(w)] * words[w] / c[kind(w)] for w in words) + unknown, 1)
        return out, unknown

    for _ in range(rounds):
        known, unknown = emissions()
        new, firsts, pairs = defaultdict(lambda: np.zeros(states)), np.zeros(states), np.zeros((states, states))
        for t in training:
            _, g, x = plain(np.array([known[kind(w)] for w in t]), start, move)
            for w, p in zip(t, g, strict=True):
                new[kind(w)] += p
            firsts, pairs = firsts + g[0], pairs + x
        counts = {w: np.rint(new[w] * hmm.UNIT) / hmm.UNIT for w in c}
        firsts, pairs = np.rint(firsts * hmm.UNIT) / hmm.UNIT, np.rint(pairs * hmm.UNIT) / hmm.UNIT
        if training:
            start, move = (firsts + 1) / (firsts + 1).sum(), (pairs + 1) / (pairs + 1).sum(1, keepdims=True)
    known, unknown = emissions()
    out = []
    for i, t in rows:
        t = tokens_of(t)
        ll, _, _ = plain(np.array([known.get(kind(w), unknown) for w in t]), start, move)
        ll += sum(math.log(words[w] / c[kind(w)]) for w in t if words[w])
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in t)
        out.append((i, held_out(i), len(t), sum(words[w] > 0 for w in t), total, base, ll / math.log(10)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    kinds = [["le", "la", "est", "Étude", "petit"], ["der", "die", "Straße", "und", "漢字"]]
    some = lambda k, n: " ".join(rng.choice(kinds[k]) if rng.random() < 0.9 else f"w{rng.randint(0, 40)}" for _ in range(n))
    out = [(i, some(i % 2, rng.randint(0, 40)) + rng.choice(["", "\n", "\t x"])) for i in range(60)]
    return out + [(7, out[7][1]), (7, "another text"), (None, "le la"), (None, None), (100, None), (101, ""), (102, " \n "), (103, some(0, 400)), (104, "x" * 3000)]


@pytest.mark.parametrize(("states", "rounds", "block", "segment"), [(3, 2, 10**6, 10**6), (2, 3, 60, 16), (1, 1, 500, 50)])
def test_scores_equal_plain_baum_welch(spark, rows, states, rounds, block, segment):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("mine"), "block": F.lit("mine"), "id": F.lit("mine"), "score": F.lit(1)}).coalesce(1 if block == 10**6 else 2)
    df = hmm.scored(docs, states=states, rounds=rounds, block_tokens=block, segment=segment, at_once=300)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(brute(rows, states, rounds), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    # Counts come from single precision and are rounded to 1 / 4096 in each block.
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-4)


def test_likelihood_of_training_documents_rises(spark, rows):
    written = Scratch(spark).written(hmm.blocks(spark.createDataFrame(rows, SCHEMA), "doc_id", "text"), "blocks")
    words = hmm.words_of(written)
    classes = hmm.classes_of(words)
    model, _, logs = hmm.train(hmm.coded(written, words, classes), classes, 2, 5)
    assert all(b > a for a, b in zip(logs, logs[1:], strict=False)) and np.allclose(model.move.sum(1), 1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(40) if held_out(i)], SCHEMA)
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(abs(r.score), 9)) for r in hmm.scored(docs).collect()} == {(3, 0, 0, 0.0, 0.0)}
    assert hmm.scored(docs.where("false")).count() == 0


def test_long_text_goes_in_piece_by_piece(monkeypatch, spark):
    monkeypatch.setattr(hmm, "SLICE_BYTES", 64)
    from spanforge.llm.text import Texts

    t = " ".join(f"w{k % 37}" for k in range(300)) + " " + "y" * 200 + " end "
    buf = np.frombuffer(t.encode(), np.uint8)
    block = hmm._Block()
    block.ids, block.held = [1], [False]
    hmm._added(block, Texts(buf, np.array([0, len(buf)])))
    row = block.row("b")
    assert [row["words"][k] for k in hmm.unpacked(row["tokens"])] == tokens_of(t) and row["sizes"] == [len(tokens_of(t))]


def test_held_out_documents_score_above_the_base(spark):
    rows = [r for r in hmm.scored(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and len(rows) > 10


@pytest.mark.parametrize(("block", "part"), [(10**6, 1 << 20), (60, 40)])
def test_words_below_the_share_have_their_own_emissions(spark, rows, monkeypatch, block, part):
    want = brute(rows, 2, 2)
    # With this share hardly a word is in every task's table, as in a large corpus.
    monkeypatch.setattr(hmm, "OWN_SHARE", 0.05)
    monkeypatch.setattr(hmm, "PART_TOKENS", part, raising=False)
    got = hmm.scored(spark.createDataFrame(rows, SCHEMA).coalesce(2), states=2, rounds=2, block_tokens=block, segment=50).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-4)

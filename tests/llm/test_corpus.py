"""The corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import itertools
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import decontaminate, exact, extract, graph, lines, mixing, nearcopies, quality, simhash, suffix, text, tokenfile, tokens, warc, wordtable

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path(tokens.TOKENIZER))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def fixture_rows():
    rng = random.Random(5)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.randint(12, 120)) + "\n" + sentence(rng, 20), "en", "s0" if i % 3 else None, 1) for i in range(40)]
    rows += [(100 + i, sentence(rng, 8) + "\n" + passage + "\n" + sentence(rng, 9), "de", "s1", 1) for i in range(8)]
    rows += [(7, rows[7][1], "en", "s1", 1)]  # a repeated row
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \n\t ", "en", "s0", 1), (203, "word", "en", "s0", 1), (None, passage, "en", "s0", 1), (None, None, None, None, None)]
    rows += [(204, "x" * 3000, "en", "s0", 1), (205, "ab " * 2000, "en", "s0", 1), (206, "É漢字😀 ß " * 40, "fr", "s0", 1), (207, rows[3][1], "en", "s0", 1), (208, rows[3][1] + " tail", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(fixture_rows(), SCHEMA)
    # Columns whose names the operators use themselves.
    return df.withColumns({"fp": F.lit("mine"), "n_words": F.lit("mine"), "h": F.lit(1), "id": F.lit("mine")}).repartition(4)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Shared parts.


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tÉ漢", max_size=30), max_size=8))
def test_words_and_lines_of_texts(texts):
    for i, j, t in text.slices(pa.array(texts, pa.string()), 16):
        w, (start, end, first) = t.words(), t.lines()
        for k in range(i, j):
            found = [bytes(t.buf[a:b]).decode() for a, b in zip(w.start[w.first[k - i] : w.first[k - i + 1]], w.end[w.first[k - i] : w.first[k - i + 1]], strict=True)]
            assert found == WORD.findall(texts[k])
            assert [bytes(t.buf[a:b]).decode() for a, b in zip(start[first[k - i] : first[k - i + 1]], end[first[k - i] : first[k - i + 1]], strict=True)] == texts[k].split("\n")


def test_components_by_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] and None not in e for e in edges)}


# 1. Decontamination.


def brute_leaks(rows, items):
    clean = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for d, t in rows:
        w = clean(t)
        for i, x in items:
            v = clean(x)
            if i is None or not v or len(v) > len(w):
                continue
            n = min(5, len(v))
            b = grams(v, n)
            for s in range(len(w) - len(v) + 1):
                a = grams(w[s : s + len(v)], n)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark, docs, nothing):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(12, 50))) for i in range(6)] + [(6, "two words"), (7, None), (8, "  "), (None, sentence(rng, 20)), (9, "solo")]
    rows = fixture_rows()
    for k, (_, x) in enumerate(items[:6]):
        v = x.split()
        rows.append((300 + k, sentence(rng, 30) + " " + x.upper() + ", " + sentence(rng, 5), "en", "s", 1))
        rows.append((310 + k, sentence(rng, 30) + " " + " ".join(v[1:]) + " " + sentence(rng, 5), "en", "s", 1))
        rows.append((320 + k, " ".join(v[: len(v) // 2]), "en", "s", 1))
    rows += [(330, "these are two words indeed", "en", "s", 1), (331, "solo", "en", "s", 1)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute_leaks([(r[0], r[1]) for r in rows], items)
    for block in (1 << 20, 40):
        got = decontaminate.leaks(df, benchmark, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected
    gone = {d for d, _ in expected}
    stay = decontaminate.without_leaks(df, benchmark)
    assert stay.columns == df.columns and Counter(r.doc_id for r in stay.collect()) == Counter(r[0] for r in rows if r[0] not in gone)
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.without_leaks(docs, benchmark.where("false")).count() == docs.count()


def test_documents_shorter_than_the_item():
    words = sentence(random.Random(8), 50).split()
    items = decontaminate.index([(1, " ".join(words)), (2, "two words"), (3, "solo")], 5)
    scanner = decontaminate.Scanner(items, 5, 0.8, decontaminate.RADIUS)
    docs = [" ".join(words[:49]), " ".join(words[9:]), " ".join(words[4:45]), "two", ""]
    (_, _, t), = text.slices(pa.array(docs, pa.large_string()))
    assert scanner.find(t) == [(0, 1, 45 / 46, 0, 49), (1, 1, 37 / 46, 0, 41), (2, 1, 37 / 46, 0, 41)]
    (_, _, t), = text.slices(pa.array([" ".join(words[:40]), "words"], pa.large_string()))
    assert scanner.find(t) == []


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 50, dtype=np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)
    b[:20] = a[:20] ^ np.uint64(0b1011 << 7)
    for radius in (3, 10, 24):
        got = set(zip(*map(list, decontaminate.within(a, b, decontaminate.block_tables(b, radius), radius)), strict=True))
        assert got == {(i, j) for i in range(50) for j in range(40) if bin(int(a[i] ^ b[j])).count("1") <= radius}


def test_blocks_prune_most_pairs():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (2000, 1000))
    tables = decontaminate.block_tables(b, decontaminate.RADIUS)
    pairs = sum(len(w) for w, _ in decontaminate.candidates(a, tables, decontaminate.RADIUS))
    assert pairs < len(a) * len(b) / 5


@pytest.mark.parametrize("windows", [7, 1 << 15])
def test_windows_in_pieces_lose_nothing(monkeypatch, windows):
    monkeypatch.setattr(decontaminate, "WINDOWS", windows)
    rng = random.Random(8)
    items = [(i, sentence(rng, n)) for i, n in enumerate((3, 8, 8, 20, 60))]
    scanner = decontaminate.Scanner(decontaminate.index(items, 5), 5, 0.8, 20)
    for _ in range(40):
        t = " ".join([sentence(rng, rng.randint(0, 30)), *(rng.choice(items)[1] + " " + sentence(rng, rng.randint(0, 4)) for _ in range(rng.randint(0, 4)))])
        (_, _, texts), *_ = [*text.slices(pa.array([t], pa.string()))]
        assert {(0, f[1]) for f in scanner.find(texts)} == brute_leaks([(0, t)], items)


def test_very_long_items_take_linear_memory():
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(100_000)]
    scanner = decontaminate.Scanner(decontaminate.index([(1, " ".join(words))], 5), 5, 0.8, 20)
    doc = " ".join(["before", *words[:60_000], "between", *words[60_000:], "after"])
    tracemalloc.start()
    (_, _, texts), *_ = [*text.slices(pa.array([doc], pa.string()))]
    found = scanner.find(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[1] for f in found] == [1] and found[0][2] > 0.99 and peak < 500 << 20


def test_benchmark_in_several_blocks(spark, docs):
    rng = random.Random(10)
    items = [(i, fixture_rows()[i][1].split("\n")[0]) for i in (3, 9, 21)] + [(50, sentence(rng, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(repr, decontaminate.without_leaks(docs, benchmark, block_bytes=b).collect())) for b in (32 << 20, 40))
    assert one == many and len(one) < docs.count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_leaks(docs, none).count() == docs.count() and decontaminate.without_leaks(docs.where("false"), benchmark).count() == 0


# 2. Lines.


def thue_morse(bits):
    """Two different strings of 2**bits letters on which every hash that is polynomial modulo 2**64 agrees from 10 bits on."""
    a, b = "a", "b"
    for _ in range(bits):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("bits", [9, 10, 11])
def test_lines_on_which_polynomials_collide(spark, bits):
    a, b = thue_morse(bits)
    page = pa.array([f"{a}\n{b}\n{a}\n{b} {b} x\n", "\n".join([a, b, a]), " ".join([a, b] * 5)])
    ((_, _, t),) = text.slices(page, 1 << 30)
    w = t.words()
    assert quality.base_figures(t, w, w.hashes())["n_dup_lines"].tolist() == [1, 1, 0]
    rows = [(1, f"{a}\n{a}\n{a}"), (2, f"{b}\n{b}\n{b}"), (3, f"{a}\n{b}\n{a}"), (4, f"{b}\n{b}\n{b}")]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 3)]
    items = decontaminate.index([(1, " ".join([a] * 6))], 5)
    scanner = decontaminate.Scanner(items, 5, 0.8, decontaminate.RADIUS)
    ((_, _, t),) = text.slices(pa.array([" ".join([b] * 6), " ".join([a] * 6)], pa.large_string()), 1 << 30)
    assert [f[:2] for f in scanner.find(t)] == [(1, 1)]


def test_equal_hashes_do_not_make_equal_things():
    data = [b"ab", b"cd", b"ab", b"cd", b"ef", b"", b"ab"]
    at = np.cumsum([0, *map(len, data)])
    buf, start, end = np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:]
    number, first = text.classes(np.zeros(len(data), np.uint64), lambda a, b: text.same_bytes(buf, start[a], end[a], start[b], end[b]), lambda k: data[k])
    assert [data[first[n]] for n in number] == data and len(set(number.tolist())) == 4
    x = np.random.default_rng(0).integers(0, 2, 6000).astype(np.uint8)
    a, b, n = np.array([0, 0, 0, 5]), np.array([3000, 0, 3000, 6]), np.array([2900, 2900, 5, 0])
    x[3000:5900] = x[:2900]
    x[5000] ^= 1
    assert text.same_bytes(x, a, a + n, b, b + n).tolist() == [False, True, True, True]


def test_a_long_line_is_a_run(spark):
    line = " ".join(f"w{k}" for k in range(lines.LONG_LINE))
    rows = [(1, f"x\n {line}\t\ny"), (2, f"{line}\nz"), (3, line.rsplit(" ", 1)[0]), (4, line.rsplit(" ", 1)[0]), (5, f"\n{line}\n{line}")]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_runs, r.text) for r in got if r.n_removed) == [(2, 1, 1, "z"), (5, 2, 1, "")]


def brute_lines(rows, n=3):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        all_lines = (rows[k][1] or "").split("\n")
        counted = [i for i, x in enumerate(all_lines) if x.strip(" \t\n\x0b\x0c\r")]
        keys = [tuple(all_lines[i].strip(" \t\n\x0b\x0c\r") for i in counted[j : j + n]) for j in range(len(counted) - n + 1)]
        gone = set()
        for j, key in enumerate(keys):
            if key in seen:
                gone.update(range(j, j + n))
            seen.add(key)
        drop = {counted[g] for g in gone} | {i for g in gone if g - 1 in gone for i in range(counted[g - 1], counted[g])}
        out.append((rows[k][0], len(gone), "\n".join(x for i, x in enumerate(all_lines) if i not in drop)))
    return sorted(out, key=repr)


def test_line_runs_equal_brute_force(spark, nothing):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "d e f", "", " g "]) for _ in range(rng.randint(0, 14)))) for i in range(30)] + [(50, None), (51, ""), (52, "a b\r\nc\n\nd e f"), (None, "c\nc\nc\nc")]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_removed, r.text) for r in got), key=repr) == brute_lines(rows)
    assert lines.without_repeated_lines(nothing).count() == 0


def test_repeated_rows_are_one_document_of_lines(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in lines.without_repeated_lines(df).collect()) == [(1, 0), (1, 0), (2, 3)]


# 3. Mixing.


def test_mixing_meets_its_marginals(spark, docs, nothing):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 30), rng.choice(["en", "en", "en", "de"]), rng.choice(["a", "a", "a", "b"]), 1) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    share = lambda x: spark.createDataFrame(list(x.items()), "value string, share double")
    targets = {"source": share({"a": 0.5, "b": 0.5}), "lang": share({"en": 0.6, "de": 0.4}), "topic": share({"short": 1.0})}
    got = mixing.calibrated(df, targets, rate=0.3, rounds=20).where("__sampled").groupBy("source", "lang").agg(F.sum("__cell.tokens").alias("t")).collect()
    total = sum(r.t for r in got)
    assert abs(total / (4000 * 30) - 0.3) < 0.03
    assert abs(sum(r.t for r in got if r.source == "a") / total - 0.5) < 0.05 and abs(sum(r.t for r in got if r.lang == "en") / total - 0.6) < 0.05
    clash = df.withColumns({"__key": F.lit(1), "__cell": F.lit(2), "__probability": F.lit(3), "doc": F.lit(4), "factor": F.lit(5), "tokens": F.lit(6)})
    assert mixing.mixed(clash).columns == clash.columns
    assert set(mixing.calibrated(clash).columns) == {*clash.columns, "__sampled"}
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and mixing.mixed(nothing).count() == 0
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, mixing.mixed(docs.repartition(2)).collect()))


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.01), ("sf0.01", 0.005)])
def test_default_targets_are_met(spark, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = mixing.calibrated(docs)
    fitted = found.groupBy("__cell.source", "__cell.lang", "__cell.topic").agg(F.sum("__cell.tokens").alias("tokens"), F.first("__probability").alias("probability"))
    targets = {k: mixing.tempered(fitted, k, mixing.TEMPER) for k in mixing.DIMENSIONS}
    rows = mixing.residuals(fitted, targets).collect()
    total = sum(r.target for r in rows) / 3
    assert rows and max(abs(r.target - r.expected) for r in rows) <= least * total
    for k in mixing.DIMENSIONS:
        assert abs(sum(r.target for r in rows if r.dimension == k) / total - 1) < 1e-9


# 4. HTML.


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><p>The name of the site and of the house</p></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About the us</a></li></ul></nav><div class="cookie-notice"><p>We use the cookies of the site for you and that is it. Do you accept the use of them and of all?</p></div>
<div id=content><h2>A headline of the page</h2><p>This is the text of the page, and it has to be that which is found by the rules of the operator for the test. It is not short
and it goes on with more of the words that are in every text of this kind &amp; there &lt;is&gt; more&nbsp;to it, as you see when you read on.</p><p>Also this.</p>
<p>There is another one that is as long as the first of them, so that both of these have to be good by the length and the share of the words that stop, which is what they are for in the end.</p></div>
<aside>The side of the page has the text that is not for you and is not of the page.</aside><form><p>Sign up for the news of the site and of the world.</p></form>
<section class="comments"><p>I think that the text is not as good as the one that was here in the past and I will not read it again, that is for sure.</p></section>
<script>var x = "<p>the and of</p>"</script><footer>All of the rights are with the owner of the site.</footer></body></html>"""


def test_main_text_without_article_tags():
    text = extract.main_text(PAGE)
    assert text.startswith("A headline of the page This is the text") and text.endswith("what they are for in the end.") and " Also this. " in text and "& there <is> more to it" in text
    assert not re.search(r"cookies|Home|name of the site|side of the page|Sign up|I think|rights|var x", text)


def test_articles_keep_short_and_odd_blocks(spark):
    page = "<nav><a href=/>x</a></nav><article><h1>Ab</h1><p>Cd&#233;<b>e</b>f<br>g<p>h</article><footer>The end of the page</footer>"
    assert extract.main_text(page) == "Ab Cdéef g h"
    assert [extract.main_text(x) for x in (None, "", "   ", "<p>", "<", "<article><p>unclosed", "<!-- x", "<script>the of and")] == ["", "", "", "", "", "unclosed", "", ""]
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = extract.extracted(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "Ab Cdéef g h", 12), (1, "Ab Cdéef g h", 12)]


SENTENCES = {
    "en": "it is the work of the house that was there and of all the people who have been in it for a very long time",
    "ru": "это длинный рассказ о старом доме который стоял на берегу реки и о людях которые жили в нём много лет подряд",
    "zh": "这是一个关于河边老房子的很长的故事以及多年来住在那里的人们和他们的生活还有他们每天所做的事情",
}
JUNK = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href=/b>All of the news</a></li></ul></nav>",
    "<header class=site-header><p>The name of the house and of the people who have it for all of the time</p></header>",
    "<footer>All rights are with the owner of the site and of the house that is there</footer>",
    "<aside><p>There is more to the left of the text, and it is for all who have the time to read it</p></aside>",
    "<div class='cookie-notice'><p>We use the cookies of this site for you and for all the people who are here and have been here before</p></div>",
    "<div id=sidebar><p>The side of the page is for the news that have not been in the text and will not be in it for now</p></div>",
    "<form><p>Sign up for all the news of the site and of the people who are there and have been</p><input name=a></form>",
    "<section class='comments'><p>I have been there and it was not as it is in the text, and that is what I have to say of it</p></section>",
    "<script>if (a < b) { document.write('<p>the and of it is</p>') }</script><style>p > a {}</style>",
    "<div style='display: none'><p>the of and it is that was for on with as are be at by this from have</p></div>",
    "<button type=button>Share it with the people of the house</button><select><option>the one<option>and the other</select>",
    "<!-- <p>the and of it is that was there for the people</p> -->",
]


def made_page(rng, lang):
    """(page, its main text): paragraphs with markup that changes nothing among boilerplate."""
    inert = ["<svg class='i' viewBox='0 0 1 1'/>", "<img src=a.png alt='the \"best\" of it'>", "<wbr>", "<b>", "</b>", "<span data-x='a > b'>", "</span>", "<object data=x />", "<!-- x -->", "<button>", "<svg><path d='M0'/></svg>"]
    paragraphs, body = [], ""
    for k in range(rng.randint(2, 5)):
        text = f"{k} " + " ".join(SENTENCES[lang] for _ in range(rng.randint(3, 5)))
        paragraphs.append(text)
        words = text.split(" ")
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(1, len(words))
            words[at] = rng.choice([x for x in inert if x != "<button>"]) + words[at]
        opened = rng.choice(["<p>", '<p class="x>', "<p class='lead' id=a>", "<div><p>", "<P\nDATA-A=1>"])
        body += opened + " ".join(words) + ("</p></div>" if opened == "<div><p>" else rng.choice(["</p>", ""]) if opened != "<div><p>" else "") + "\n"
    around = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class='content has-sidebar'>%s</div>", "<div class='page no-sidebar with-menu'>%s</div>", "<div id=text>%s</div>", "<form id=aspnet><div>%s</div></form>"])
    before, after = (" ".join(rng.sample(JUNK, rng.randint(0, 3))) for _ in range(2))
    return f"<!doctype html><html><head><title>The title</title></head><body class='js with-sidebar'>{before}{around % body}{after}</body></html>", " ".join(paragraphs)


@pytest.mark.parametrize("lang", SENTENCES)
def test_main_text_equals_what_pages_are_made_from(lang):
    rng = random.Random(lang)
    for _ in range(150):
        page, text = made_page(rng, lang)
        assert extract.main_text(page) == text, page


def test_broken_markup_loses_no_text():
    p = "<p>" + SENTENCES["en"] * 3 + "</p>"
    text = SENTENCES["en"] * 3
    for page in (f"<svg class='i'/>{p}", f"<object data=x />{p}", f"<div><button>x{p}</div>", f"<video src=a>{p}", f"<div class=has-sidebar>{p}</div>", f"<section class='page with-sidebar'>{p}</section>", f"<div class='layout'><div class='sidebar-left-layout main'>{p}</div></div>", f"<textarea>{p}"):
        assert text in extract.main_text(page), page
    assert extract.main_text(f"<article>{p}<p class=\"x>{text}</p><p id='y>{text}</p></article>") == " ".join([text] * 3)
    assert extract.main_text(f"<button>a<button>b</button>{p}<svg><svg/><g>the</svg>") == text
    long = "<div>" * 3000 + p * 200 + "<b" * 5000 + "<!--" * 3000
    assert extract.main_text(long).startswith(text)


REMARK = "<p>I have been there and it was not as it is in the text, and that is what I have to say of it as one of the people.</p>"


@pytest.mark.parametrize("opened", ["<div class='reader-comments'>", "<ol class=commentlist>", "<section id=comments-section>", "<div class='comment-list'>", "<div id=disqus_thread>", "<div class='comments list'>", "<div class=discussion>"])
@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("closed", [True, False])
def test_comments_go_whatever_they_hold(opened, inside, closed):
    text = SENTENCES["en"] * 3
    signed = "<span class='author'>A</span> <time>now</time>" if "discussion" in opened else ""
    block = opened + f"<div>{signed}{REMARK}</div>" * 30 + (f"</{opened[1:].split()[0]}>" if closed or signed else "")
    page = f"<body><article><p>{text}</p>{block}</article></body>" if inside else f"<body><article><p>{text}</p></article>{block}</body>"
    assert extract.main_text(page) == text


@pytest.mark.parametrize("name", "share-price related-work ad-hoc-analysis login-flow navigation-history notice-period menu-planning comment-on-the-law comments-on-law discussion review".split())
def test_sections_of_an_article_stay(name):
    text = SENTENCES["en"]
    page = f"<article><p>{text}</p><section class='{name}'><h2>A part</h2><p>{text}</p></section><p><a href=/x>All of this paragraph is a link</a></p><aside>As an aside it is said.</aside></article>"
    assert extract.main_text(page) == f"{text} A part {text} All of this paragraph is a link As an aside it is said."
    bare = f"<article class='comment'><p>{text}</p></article>"
    assert extract.main_text(bare) == text


def test_parts_of_an_article_that_are_none_of_it_go():
    text = SENTENCES["en"]
    for junk in ("<div class='share-buttons'>Share it</div>", "<ul class=related-posts><li>More of it</ul>", "<div class=ad>Buy it</div>", "<div class='newsletter'><p>Sign up for it</div>", "<ul><li><a href=/a>One of them</a><li><a href=/b>Two of them</a></ul>", "<aside class=sidebar>Side</aside>"):
        assert extract.main_text(f"<article><p>{text}</p>{junk}<p>{text}</p></article>") == f"{text} {text}", junk


def test_short_pages_keep_their_text():
    assert extract.main_text("<p>Hello world.</p>") == "Hello world."
    assert extract.main_text("<h1>Short note</h1><p>Closed today.</p>") == "Short note Closed today."
    assert extract.main_text("<nav><a href=/>Home</a></nav><p>Hello world.</p><footer>Rights</footer>") == "Hello world."
    assert extract.main_text("<ul><li><a href=/>Home</a></ul><p>Hello world.</p>") == "Hello world."


@pytest.mark.parametrize("unit", ["<div>x ", "<div class=ad>x ", "<div class=thread><article>x ", "<section></div>x ", "<main>x ", "<li>x", "</div>", "<a href='x>", "<button>x", "<p class=\"x>y"])
def test_time_is_linear_in_nesting(unit):
    took = []
    for n in (5_000, 50_000):
        began = time.process_time()
        extract.main_text(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.05)


class Plain(HTMLParser):
    """All text of a page, by the standard library's parser: a second opinion on markup, references and white space."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "svg")
        self.between(tag)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "svg")
        self.between(tag)

    def between(self, tag):
        if tag not in extract._INLINE and tag not in ("script", "style", "svg", "g"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(" ".join(data.split("\n")) if data.strip("\n") else " ")


def test_articles_equal_a_plain_parser():
    rng = random.Random(12)
    bits = ["word", "of the", " ", "\n", "&amp;", "&#233;", "&nbsp;", "&lt;b&gt;", "<b>", "</b>", "<br>", "<i class='a'>", "</i>", "</p><p>", "<h2>", "</h2>", "<div>", "</div>", "<blockquote>", "</blockquote>", "<script>the <p>of</script>", "<!-- the -->", "<img alt='the'>", "漢字", "<svg><g>x</g></svg>"]
    for _ in range(300):
        body = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        parser = Plain()
        parser.feed(body)
        parser.close()
        assert extract.main_text(f"<article>{body}</article>") == " ".join("".join(parser.parts).split()), body


# 5. Near duplicates.


def brute_print(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
    shingles = ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]) if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_groups_equal_brute_force(docs, nothing):
    rows = fixture_rows()
    prints = [brute_print(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    by_print = {p: min(least[find(i)]) for i, p in enumerate(prints) if rows[i][0] is not None}
    expected = sorted(((r[0], f"{p:016x}", by_print.get(p)) for r, p in zip(rows, prints, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr) == expected
    stay = simhash.one_of_each_group(docs)
    ids = {e[2] for e in expected if e[0] is not None}
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == Counter({**dict.fromkeys(ids, 1), None: 2})
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each_group(nothing).count() == 0


@pytest.mark.parametrize("small_bucket", [1, 256])
def test_links_connect_all_pairs_within_radius(spark, small_bucket):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(6)})
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    edges = simhash.links(spark.createDataFrame(signed, "rep long, fp long"), small_bucket=small_bucket)
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert {i: got.get(i, i) for i in range(len(prints))} == {i: find(i) for i in range(len(prints))}


# 6. WARC.


def test_archive_round_trip(spark):
    body = "<p>é" + "x" * 120
    rows = [(3, "http://a b/\r\n", body), (1, None, body), (9, "u", "tiny"), (8, "u", "tiny"), (4, "u", None), (5, "u", ""), (None, "u", body), (3, "http://a b/\r\n", body)]
    path = warc.fresh_path(spark, "t")
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect()), key=repr)
    expected = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = p == 3
        expected.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(expected, key=repr)
    for p, h in ((3, body), (1, body), (9, "tiny"), (4, "")):
        assert warc.read_payload(spark, path, index, p) == h.encode()
    assert warc.read_payload(spark, path, index, 77) is None
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), warc.fresh_path(spark, "t")).count() == 0


def test_bundles_are_plain_zstandard():
    import io

    import zstandard

    b = warc.Bundle()
    records = [warc.record(i, "u", os.urandom(70_000), "d", None) for i in range(10)]
    for r in records:
        b.add(r)
    data = b.body() + warc.TRAILER
    table = warc.seek_table(data)
    assert len(table) > 1 and b"".join(warc.frame(data, x) for x in table) == b"".join(records)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)


# 7. Suffix arrays.


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 4 for x in b)))
def test_suffix_array_and_common_prefixes(b):
    s = np.frombuffer(b, np.uint8)
    sa = suffix.suffix_array(s)
    assert list(sa) == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = suffix.permuted_lcp(s, sa)
    for r in range(1, len(b)):
        i, j, n = int(sa[r]), int(sa[r - 1]), 0
        while max(i, j) + n < len(b) and b[i + n] == b[j + n] != 0:
            n += 1
        assert lcp[i] == n


def brute_repeats(rows, width=100):
    first, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b, cover = (t or "").encode(), set()
        for i in range(len(b) - width + 1):
            if b[i : i + width] in first:
                cover.update(range(i, i + width))
            first.add(b[i : i + width])
        runs = sum(1 for c in cover if c - 1 not in cover)
        out[d] = (len(b), len(cover), runs, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in cover)).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "shard"), [(4000, 2 << 20), (0, 2 << 20), (4000, 500)])
def test_removed_bytes_equal_brute_force(spark, docs, nothing, monkeypatch, crowd, shard):
    monkeypatch.setattr(exact, "SHARD_BYTES", shard)
    whole = exact.covered
    monkeypatch.setattr(exact, "covered", lambda d, w, g: whole(d, w, g, crowd))
    rng = random.Random(9)
    extra = [(400 + i, sentence(rng, 3) + "é" * 90 + sentence(rng, 30)[: rng.randint(5, 80)] + "shared passage " * 9, "x", "s", 1) for i in range(12)]
    rows = [r for r in fixture_rows() if not (r[0] is None and r[1] is None)] + extra
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = brute_repeats([(r[0], r[1]) for r in rows])
    got = exact.without_repeats(df).collect()
    assert len(got) == len(rows)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id] and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert exact.without_repeats(nothing).count() == 0


def test_stretches_of_a_long_text_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact, "STRETCH", 1000)
    rng = random.Random(8)
    long = sentence(rng, 900)
    rows = [(1, long), (2, sentence(rng, 50) + long[700:2600] + sentence(rng, 50)), (3, long[900:1150])]
    got = exact.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)


# 8. Quality.


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    full = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered)


def test_base_figures_and_columns(spark, docs, nothing):
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int"))
    rows = quality.judged(docs, model).collect()
    by_id = {r[0]: r[1] for r in fixture_rows() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(by_id[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= model.threshold)
    assert quality.filtered(docs, model).columns == docs.columns and quality.filtered(docs, model).count() == sum(r.kept for r in rows)
    empty = quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.judged(nothing, empty).count() == 0 and empty.threshold == float("-inf")


def test_ratio_tells_held_out_documents_apart(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit_on, held = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    model = quality.fit(d, fit_on)
    rows = [r for r in quality.judged(d, model).collect() if r.doc_id in held and not r.base_failed]
    right = sum(r.kept == bool(held[r.doc_id]) for r in rows)
    assert right / len(rows) > 0.9


def test_threshold_rule():
    assert quality.fit_threshold(np.array([1.0, 2.0]), np.array([True, True])) == float("-inf")
    assert quality.fit_threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([False, False, True, True])) == 3.0
    assert quality.fit_threshold(np.array([1.0, 1.0]), np.array([False, True])) == float("-inf")


# 9 and 10. Tokens.

PIECES = ["'s", "'re", "'ll", "'", "'v", " ", "  ", "\n", "\t", "a", "Ab", "é", "1", "٣", "!", "<|endoftext|>", "<|endof", "漢字", "😀", "́", "_", "\x1c", "\x85", "\r\n", "the", "ing", "\0"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=5))
def test_machine_counts_as_the_library(library, texts):
    assert tokens.bpe(PATH).count_texts(texts).tolist() == [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)] if texts else True


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_pieces_of_a_text_are_counted_as_a_whole(library, t):
    parts = list(tokens.pieces(t, 5))
    assert "".join(parts) == t and tokens.bpe(PATH).count_texts(parts).sum() == len(library.encode(t, add_special_tokens=False).ids)


def test_chunk_maps_compose():
    rng = np.random.default_rng(1)
    symbol = rng.integers(0, 11, 1000).astype(np.uint8)
    state, starts = tokens.BETWEEN, []
    for i, s in enumerate(symbol):
        go = int(tokens.TRANSITIONS[s, state])
        if go > 7:
            starts.append(i)
        state = go & 7
    assert tokens.word_starts(symbol).tolist() == starts


def test_token_counts(docs, nothing, library):
    by_id = {r[0]: r[1] or "" for r in fixture_rows()}
    for r in tokens.token_counts(docs, PATH).collect():
        if r.doc_id is not None:
            n = len(library.encode(by_id[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(by_id[r.doc_id].encode()), n, n > 512)
    assert tokens.token_counts(nothing, PATH).count() == 0


class Numbered(wordtable.WordTable):
    def learn(self, words):
        self.told = getattr(self, "told", 0) + len(words)
        return np.array([zlib.crc32(w) for w in words], np.int64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=40), max_size=60), max_size=12), st.integers(3, 7))
def test_word_table_tells_all_words_apart(batches, bits):
    table = Numbered(bits)
    for words in batches:
        words = [*words, *words[::2], b"\0" * 5, b"\0" * 6]
        at = np.cumsum([0, *map(len, words)])
        buf = np.frombuffer(b"".join(words) + bytes(wordtable.PADDING), np.uint8)
        assert table.numbers(buf, at[:-1], at[1:]).tolist() == [zlib.crc32(w) for w in words]
    assert len(table.new.long) <= 1 << bits and table.new.n <= 1 << bits


def test_word_table_remembers(library):
    table = Numbered(12)
    words = [b"w%d" % k for k in range(900)]
    at = np.cumsum([0, *map(len, words)])
    buf = np.frombuffer(b"".join(words) + bytes(wordtable.PADDING), np.uint8)
    for _ in range(5):
        table.numbers(buf, at[:-1], at[1:])
    assert table.told == len(words)


def test_encoder_through_several_generations(library):
    e = tokenfile.Encoder(PATH)
    e.known.new, e.known.bits = wordtable.Generation(8), 8
    rng = np.random.default_rng(4)
    for _ in range(12):
        texts = [" ".join(f"{'x' * int(rng.integers(0, 3))}word{int(k)} Donaudampfschiff{int(k) % 7}fahrt" for k in rng.integers(0, 200, 40)) for _ in range(3)]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_transducer_forgets_and_long_words(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 50)
    machine = tokens.Bpe(PATH)
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzéß漢")
    for _ in range(6):
        texts = ["".join(rng.choice(letters, int(n))) for n in (3, 30, 90, 400)] + ["ab" * 200, "<|endoftext|>" * 3]
        assert machine.count_texts(texts).tolist() == [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_encoder_memory_is_small_whatever_the_batch(library):
    rng = random.Random(21)
    words = [sentence(rng, 1) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1000)]
    encoder = tokenfile.Encoder(PATH)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder.encode(texts[:10])
    tracemalloc.start()
    got = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == want
    assert sum(map(len, texts)) > 2_000_000 and peak < 20_000_000


def test_token_files_round_trip(spark, docs, nothing, library):
    rows = sorted(fixture_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfile.written_and_read(docs, PATH)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert tokenfile.written_and_read(nothing, PATH).count() == 0
    shards, index = tokenfile.fresh_path(spark, "s"), tokenfile.fresh_path(spark, "i")
    tokenfile.write_shards(docs, shards, PATH, shard_ids=500)
    n = tokenfile.build_index(tokenfile.directory(spark, shards), index, bucket_keys=7)
    found = tokenfile.read_ids(spark, shards, index, n, [7, 204, 999_999])
    assert set(found) == {7, 204} and found[204].tolist() == [*library.encode("x" * 3000, add_special_tokens=False).ids, 2]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), max_size=300))
def test_perfect_hash_is_minimal(keys):
    k = np.array(sorted(keys), np.int64)
    h = tokenfile.key_hash(k, np.ones(len(k), bool), np.zeros(len(k), np.int64))
    levels = tokenfile.perfect_levels(h)
    sizes, packed = [len(x) for x in levels], tokenfile.packed_levels(levels)
    assert sorted(tokenfile.perfect_slots(h, sizes, *packed).tolist()) == list(range(len(k)))
    assert all(-1 <= x < len(k) for x in tokenfile.perfect_slots(tokenfile.key_hash(k + 1, np.ones(len(k), bool), np.ones(len(k), np.int64)), sizes, *packed))


# Near copies in the pipeline.


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


def test_viable_is_the_hamming_radius(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-(2**63), 2**63 - 1, 400)
    b = a.copy()
    for k in range(400):
        for bit in rng.choice(64, int(rng.integers(0, 40)), replace=False):
            b[k] ^= np.int64(1) << np.int64(bit)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    for radius, n in ((24, 8), (2, 5), (9, 4)):
        got = df.select("a", "b", simhash.viable(F.col("a"), F.col("b"), radius, n).alias("ok")).collect()
        assert all(r.ok == (((r.a ^ r.b) % (1 << 64)).bit_count() <= radius) for r in got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=80))
def test_shared_shingles_are_all_counted(sets):
    at = np.cumsum([0, *map(len, sets)])
    flat = np.array([x for s in sets for x in sorted(s)], np.int64)
    for k, shared in nearcopies.shared_shingles(flat, at, np.arange(0, len(sets), 2)):
        assert shared.tolist() == [len(sets[k] & s) for s in sets]


@pytest.mark.parametrize(("small_bucket", "block"), [(32, 1 << 19), (1, 1 << 19), (1, 2000)])
def test_near_copies_equal_brute_force(spark, small_bucket, block):
    rng = random.Random(11)
    rows = [(1, None), (2, " "), (3, "one two"), (4, "ONE two"), (5, "one two three")]
    for g in range(12):
        words = sentence(rng, rng.randint(8, 150)).split()
        for k in range(8):
            rows.append((10 + 10 * g + k, " ".join(words)))
            for _ in range(max(1, len(words) // 50)):
                words[rng.randrange(len(words))] = sentence(rng, 1)
    docs = spark.createDataFrame(rows + [(None, rows[5][1]), rows[7]], "doc_id long, text string").repartition(3)
    want = brute_groups(rows)
    assert len(set(want.values())) < len(rows) - 30
    got = nearcopies.near_copies(docs, small_bucket=small_bucket, block=block).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [want[10]]
    assert nearcopies.near_copies(docs.where("false")).count() == 0


@pytest.mark.parametrize("most", [1 << 27, 64])
def test_sets_are_made_where_the_texts_are(spark, monkeypatch, most):
    monkeypatch.setattr(nearcopies, "MOST_FILTER_BITS", most, raising=False)
    rng = random.Random(13)
    docs = spark.createDataFrame([(k, sentence(rng, 20)) for k in range(200)] + [(5, "another text"), (None, "x"), (6, None)], "id long, text string")
    made = docs.mapInArrow(nearcopies._sketched(5), "id long, a long, b long, size long, fp long, keys array<long>").where("id IS NOT NULL")
    reps = made.groupBy("a", "b").agg(F.min("id").alias("rep"))
    needed = spark.createDataFrame([(k,) for k in range(0, 200, 3)] + [(5,), (6,), (999,)], "rep long")
    sets = nearcopies._sets_of(needed, reps, docs, 5)
    assert Counter(r.rep for r in sets.collect()) == Counter({5: 2, 6: 2} | {k: 1 + (k == 6) for k in range(0, 200, 3)})
    # Below the step that makes sets nothing is joined, so that texts are read where they lie.
    lines = sets._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "MapInArrow" in line)
    depth = lines[at].index("MapInArrow")
    below = [*itertools.takewhile(lambda line: len(line) - len(line.lstrip(" :+-")) > depth, lines[at + 1 :])]
    assert below and not any("Join" in line for line in below)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_least_rows_of_groups_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (3, "d"), (4, "e"), (4, "f"), (None, "g"), (None, "g")], "doc_id long, text string").withColumn("digest", F.lit("mine"))
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (3, 3), (3, 1), (4, 1), (4, 2), (None, 7), (None, None)], "doc_id long, component_id long")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.least_of_each_group(docs, groups).collect())
    assert got == [(0, "g"), (0, "g"), (1, "a"), (3, "c"), (3, "d")]
    assert simhash.least_of_each_group(docs.where("false"), groups.where("false")).count() == 0


def test_rows_that_share_an_id_and_not_a_text_stay(spark):
    rng = random.Random(12)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    df = spark.createDataFrame([(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, a, "x"), (3, c, "x"), (None, c, "x"), (None, None, "x")], "doc_id long, text string, digest string")
    for keep in (simhash.one_of_each_group, nearcopies.one_of_each_group):
        kept = keep(df)
        assert kept.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (3, c), (None, c), (None, None)], key=repr)


def test_pipeline_drops_copies_with_many_differing_bits(spark):
    import corpus_pipeline as cp

    rng = random.Random(4)
    words = sentence(rng, 200).split()
    other = list(words)
    for k in (20, 80, 140, 190):
        other[k] = "edited"
    a, b = " ".join(words), " ".join(other)
    assert bin(brute_print(a) ^ brute_print(b)).count("1") > 2
    docs = spark.createDataFrame([(1, a), (2, b), (3, sentence(rng, 200))], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, SF).collect()) == [1, 3]


# The pipeline.


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    now = d
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == d.columns, name
        rows = after.collect()
        assert len(rows) <= now.count() and not Counter(map(repr, rows)) - Counter(map(repr, now.collect())), name
        now = after
    left = {r.doc_id: r.text for r in rows}
    out = cp.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(left) and len(out) == len(left)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert not brute_leaks(list(left.items()), items)
    prints = {k: brute_print(t) for k, t in left.items()}
    assert all(bin(a ^ b).count("1") > 2 for i, a in prints.items() for j, b in prints.items() if i < j)

"""Covers by chains against brute force: the matching, the overlap graph, least number and least cost, a large bundle."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import assemble, chains


def gaps(s):
    return [(x[1], y[0]) for x, y in zip(s, s[1:], strict=False)]


def agree(a, b):
    lo, hi = max(a[0][0], b[0][0]), min(a[-1][1], b[-1][1])
    inside = lambda s: [g for g in gaps(s) if g[0] < hi and g[1] > lo]
    return lo < hi and inside(a) == inside(b)


def before(a, b):
    return a != b and a[0][0] <= b[0][0] and a[-1][1] <= b[-1][1] and agree(a, b)


def lies_in(a, b):
    return a != b and b[0][0] <= a[0][0] and a[-1][1] <= b[-1][1] and agree(a, b)


def closed(pairs, n):
    pairs = set(pairs)
    for k in range(n):
        pairs |= {(a, b) for a in range(n) for b in range(n) if (a, k) in pairs and (k, b) in pairs}
    return pairs


def best_matching(n, cost):
    """(-pairs, cost) of the best matching, by trying all."""
    best = (0, 0)

    def go(i, used, pairs, total):
        nonlocal best
        if i == n:
            best = min(best, (-pairs, total))
            return
        go(i + 1, used, pairs, total)
        for (a, b), c in cost.items():
            if a == i and b not in used:
                go(i + 1, used | {b}, pairs + 1, total + c)

    go(0, frozenset(), 0, 0)
    return best


def test_matching_is_largest_and_cheapest():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 6)
        cost = {(a, b): rng.choice([1, 2, 3, 5, 8, 1000, chains.NO_COST]) for a in range(n) for b in range(n) if a != b and rng.random() < rng.choice([0.2, 0.5, 0.9])}
        row = [np.array(sorted(b for a, b in cost if a == i), int) for i in range(n)]
        to = chains.matching(n, row, [np.array([cost[i, b] for b in r], np.int64) for i, r in enumerate(row)])
        used = [j for j in to if j >= 0]
        assert len(used) == len(set(used))
        assert (-len(used), sum(cost[i, j] for i, j in enumerate(to) if j >= 0)) == best_matching(n, cost)


def random_bundle(rng, n):
    """Different structures of a small locus, in order, none of which lies in another that it agrees with."""
    out = set()
    for _ in range(n):
        lo = rng.randint(0, 60)
        out.add(tuple(rng.choice([[(lo, lo + rng.randint(12, 30))], [(lo, 40 + rng.choice([0, 2])), (60, 60 + rng.randint(5, 30))], [(lo, max(lo + 3, 25)), (max(lo + 10, 60), 95)], [(lo, lo + 10), (lo + rng.choice([15, 20]), lo + 30)]])))
    s = [list(x) for x in out if all(a < b for a, b in x) and all(a[1] < b[0] for a, b in zip(x, x[1:], strict=False))]
    s = [x for x in s if not any(lies_in(x, y) for y in s)]
    return sorted(s, key=lambda x: (x[0][0], x[-1][1], x))


def test_sweep_gives_the_transitive_reduction():
    rng = random.Random(2)
    for _ in range(300):
        s = random_bundle(rng, 12)
        n = len(s)
        all_pairs = closed([(i, j) for i in range(n) for j in range(n) if before(s[i], s[j])], n)
        after, above = chains.overlap_graph(chains.Structures(s))
        assert {(i, j) for j in range(n) for i in range(n) if above[j] >> i & 1} == all_pairs
        assert {(i, j) for i in range(n) for j in after[i]} == {(a, b) for a, b in all_pairs if not any((a, k) in all_pairs and (k, b) in all_pairs for k in range(n))}


def plain_shares(nodes, hits, mass):
    density = [sum(m for h, m in zip(hits, mass, strict=True) if x[0][0] <= h[0][0] and h[-1][1] <= x[-1][1] and agree(x, h)) / sum(b - a for a, b in x) for x in nodes]
    over = lambda a, b: a[0][0] < b[-1][1] and b[0][0] < a[-1][1]
    return np.array([sum(d for d, y in zip(density, nodes, strict=True) if agree(x, y)) / sum(d for d, y in zip(density, nodes, strict=True) if over(x, y)) for x in nodes])


def test_cover_has_the_fewest_chains_at_the_least_cost():
    rng = random.Random(3)
    shared = 0
    for _ in range(250):
        s = random_bundle(rng, 8)
        mass = np.array([rng.randint(1, 9) for _ in s], float)
        found, paths = chains.chains(s, mass)
        assert sorted(k for c in found for k in c) == list(range(len(s)))
        after, _ = chains.overlap_graph(chains.Structures(s))
        runs = sorted(chains.contracted(after), key=lambda r: (s[r[0]][0][0], s[r[-1]][-1][1], r[0]))
        node = {k: i for i, r in enumerate(runs) for k in r}
        n = len(runs)
        all_pairs = closed({(node[i], node[j]) for i, row in enumerate(after) for j in row if node[i] != node[j]}, n)
        nodes = [chains.merged([s[k] for k in r]) for r in runs]
        share = plain_shares(nodes, s, mass)
        assert np.allclose(share, chains.spliced_in(chains.Structures(nodes), chains.Structures(s), mass))
        cost = {(a, b): int(chains.costs(chains.Structures(nodes), share, a, np.array([b]))[0]) for a, b in all_pairs}
        in_nodes = [[k for k, _ in itertools.groupby(node[x] for x in c)] for c in found]
        links = [(a, b) for c in in_nodes for a, b in zip(c, c[1:], strict=False)]
        assert (-len(links), sum(cost[x] for x in links)) == best_matching(n, cost)
        # Every chain is part of its path, which goes along edges from a first to a last node; no two paths are alike.
        for c, p in zip(found, paths, strict=True):
            assert set(c) <= set(p) and all(b in after[a] for a, b in zip(p, p[1:], strict=False))
            assert not after[p[-1]] and not any(p[0] in row for row in after)
        assert len({tuple(p) for p in paths}) == len(paths)
        shared += sum(map(len, paths)) > len(s)
    assert shared > 10


def test_models_share_what_they_have_in_common():
    first, middle, last = [(0, 50), (100, 140)], [(120, 150), (200, 240)], [(220, 250), (300, 340)]
    other_first, other_last = [(10, 60), (100, 140)], [(220, 250), (320, 350)]
    blocks = sorted([first, middle, last, other_first, other_last], key=lambda b: (b[0][0], b[-1][1], b))
    weight = {0: 9.0, 10: 3.0}
    got = chains.models(blocks, np.array([weight.get(b[0][0], 6.0) for b in blocks]))
    assert len(got) == 2 and sum(m for _, m in got) == 9 + 3 + 18
    assert {tuple(e[0]) for e, _ in got} == {(0, 50), (10, 60)} and {e[-1] for e, _ in got} == {(300, 340), (320, 350)}
    assert all((100, 150) in e and (200, 250) in e for e, _ in got)


def large_bundle(n, exons=30, isoforms=6):
    rng = random.Random(3)
    ex = [(1000 * k, 1000 * k + 300 + rng.randint(0, 200)) for k in range(exons)]
    forms = [[e for e in ex if rng.random() < 0.8 or e in (ex[0], ex[-1])] for _ in range(isoforms)]
    out = set()
    while len(out) < n:
        form = rng.choice(forms)
        length = sum(b - a for a, b in form)
        lo = rng.randint(0, length - 60)
        hi, at, blocks = min(length, lo + rng.randint(50, 400)), 0, []
        for a, b in form:
            x, y = max(lo, at), min(hi, at + b - a)
            if x < y:
                blocks.append((a + x - at, a + y - at))
            at += b - a
        out.add(tuple(blocks))
    return [list(x) for x in sorted(out, key=lambda b: (b[0][0], b[-1][1], b))], forms


def test_twenty_thousand_structures_in_a_bundle():
    blocks, forms = large_bundle(20_000)
    began = time.process_time()
    got = chains.models(blocks, np.ones(len(blocks)))
    assert time.process_time() - began < 60
    assert len(got) <= len(forms) + 2 and sum(m for _, m in got) == pytest.approx(len(blocks))


def test_fragments_that_say_the_same_are_one(spark):
    rng = random.Random(5)
    rows = [("b", rng.choice("+-"), random_bundle(rng, 1) or [[(0, 5)]]) for _ in range(300)]
    rows = [(b, s, x[0]) for b, s, x in rows] + [("c", "+", [(0, 10)]), ("c", "+", [(10, 20)]), ("c", "+", [(19, 30)]), ("d", "+", None), ("d", "+", [])]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "bundle string, strand string, blocks array<struct<lo:int,hi:int>>, mass double, lo string").repartition(4)
    got = assemble.structures(df, "bundle", "strand", "blocks", "mass").collect()
    want = {}
    for key in {(b, s) for b, s, x in rows if x}:
        mine = [x for b, s, x in rows if (b, s) == key]
        places = sorted({p for x in mine for g in gaps(x) for p in g})
        kinds = {}
        for x in mine:
            kinds.setdefault((sum(p <= x[0][0] for p in places), sum(p < x[-1][1] for p in places), tuple(gaps(x))), []).append((x[0][0], x[-1][1]))
        for (_, _, g), spans in kinds.items():
            island = []
            for lo, hi in sorted(spans):
                if island and lo < island[-1][1]:
                    island[-1] = (island[-1][0], max(hi, island[-1][1]), island[-1][2] + 1)
                else:
                    island.append((lo, hi, 1))
            for lo, hi, n in island:
                want[(*key, lo, hi, g)] = n
    assert {(r.bundle, r.strand, r.lo, r.hi, tuple(map(tuple, r.gaps))): r.n for r in got} == want and len(got) == len(want)
    assert all(r.mass == r.n for r in got)


def test_large_bundle_on_spark_equals_its_structures_alone(spark):
    blocks, _ = large_bundle(1500, exons=12, isoforms=3)
    df = spark.createDataFrame([("b", "+", x, 1.0) for x in blocks], "bundle string, strand string, blocks array<struct<lo:int,hi:int>>, mass double")
    got = assemble.assembled(df.repartition(3), "bundle", "strand", "blocks", "mass", least_fraction=0.0).collect()
    assert sorted(tuple(map(tuple, r.exons)) for r in got) == sorted(tuple(e) for e, _ in chains.models(blocks, np.ones(len(blocks))))
    assert sum(r.mass for r in got) == pytest.approx(len(blocks))
    assert assemble.assembled(df.where(F.lit(False)), "bundle", "strand", "blocks", "mass").count() == 0

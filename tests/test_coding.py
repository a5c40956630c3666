"""Coding sequences and strands against plain Python over whole sequences."""

import random

import pytest

from spanforge.functions import sequence
from spanforge.operators import coding, strands

CODE = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), sequence.AMINO_ACIDS, strict=True))
MODELS = "id string, contig string, strand string, exons array<struct<lo:int,hi:int>>, cds_lo int, cds_hi int, phase int"


def back(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_check(seq, m, full, sites, other_phases):
    """(mrna, phases, first, last, protein, has_stop, verdict) of a model, base by base."""
    _, _, strand, exons, lo, hi, phase = m
    order = [p for a, b in exons for p in range(a, b + 1)]
    if strand == "-":
        order.reverse()
    comp = str.maketrans("ACGT", "TGCA")
    mrna = "".join(seq[p - 1] if strand == "+" else seq[p - 1].translate(comp) for p in order)
    introns = [seq[a:b - 1] for (_, a), (b, _) in zip(exons, exons[1:], strict=False)]
    introns = introns if strand == "+" else [back(x) for x in introns]
    if sites and any(x[:2] + x[-2:] not in ("GTAG", "GCAG", "ATAC") for x in introns):
        bad = "BAD_SITE"
    else:
        bad = None
    if lo is None or not any(a <= lo <= b for a, b in exons) or not any(a <= hi <= b for a, b in exons):
        return mrna, None, None, None, None, None, bad or "NO_CDS"
    inside = [k for k, p in enumerate(order) if lo <= p <= hi]
    # A part's phase: bases before the next codon begins, counted along all coding bases.
    phases = {}
    for n, k in enumerate(inside):
        part = next(e for e in exons if e[0] <= order[k] <= e[1])
        phases.setdefault(part, (-(n - (phase or 0))) % 3)
    found = None
    for shift in (0, 1, 2) if other_phases else (0,):
        skip = ((phase or 0) + shift) % 3
        first, last = inside[0] + skip, inside[-1]
        codons = max(0, (last - first + 1) // 3)
        stretch = mrna[first : last + 1 + (3 if last + 1 + 3 <= len(mrna) else 0)]
        protein = "".join(CODE[stretch[k : k + 3]] for k in range(0, len(stretch) - 2, 3))
        at = protein.find("*")
        stop = at >= 0 and at + 1 >= codons
        now = first + 1, last + 1 + (3 if at == codons and at >= 0 else 0), protein[:at] if at >= 0 else protein[:codons], stop, at < 0 or stop
        if found is None or (now[4] and not found[4]):
            found = now
    first, last, protein, stop, sound = found
    verdict = bad or ("STOP" if not sound else "NOT_FULL" if full and not (stop and protein.startswith("M")) else "OK")
    return mrna, phases, first, last, protein, stop, verdict


def made(rng):
    contigs, models = {}, []
    for c in range(6):
        seq = "".join(rng.choice("ACGT") for _ in range(400))
        contigs[f"c{c}"] = seq
    for k in range(160):
        name = rng.choice(sorted(contigs))
        seq = contigs[name]
        cut = sorted(rng.sample(range(1, 400), rng.choice([2, 4, 6])))
        exons = [(a, b) for a, b in zip(cut[::2], cut[1::2], strict=True)]
        if any(y[0] - x[1] < 8 for x, y in zip(exons, exons[1:], strict=False)):
            continue
        strand = rng.choice("+-")
        if rng.random() < 0.5:
            # Known splice sites, and an open frame in most of these.
            s = list(seq)
            for (_, a), (b, _) in zip(exons, exons[1:], strict=False):
                left, right = rng.choice([("GT", "AG"), ("GC", "AG"), ("AT", "AC")])
                if strand == "-":
                    left, right = back(right), back(left)
                s[a : a + 2], s[b - 3 : b - 1] = left, right
            name = f"own{k}"
            if rng.random() < 0.8:
                order = [p for a, b in exons for p in range(a, b + 1)]
                order = order if strand == "+" else order[::-1]
                body = ["ATG", *(rng.choice(["GCT", "AAA", "CCC", "TTC"]) for _ in range(len(order) // 3 - 2)), "TAA", ""]
                coded = "".join(body)[: len(order)]
                for p, x in zip(order, coded, strict=False):
                    s[p - 1] = x if strand == "+" else back(x)
            contigs[name] = "".join(s)
        places = [p for a, b in exons for p in range(a, b + 1)]
        a, b = sorted((rng.choice(places), rng.choice(places)))
        kind = rng.random()
        lo, hi = (None, None) if kind < 0.1 else (places[0], places[-1]) if kind < 0.5 else (places[0] + (3 if strand == "-" else 0), places[-1] - (3 if strand == "+" else 0)) if kind < 0.7 and len(places) > 9 else (a, b)
        models.append((f"m{k}", name, strand, exons, lo, hi, rng.choice([None, 0, 0, 1, 2])))
    return contigs, [m for m in models if m[4] is None or (any(a <= m[4] <= b for a, b in m[3]) and any(a <= m[5] <= b for a, b in m[3]))]


@pytest.mark.parametrize(("full", "sites", "other"), [(False, False, False), (True, True, False), (False, True, True)])
def test_models_are_judged_as_base_by_base(spark, full, sites, other):
    contigs, models = made(random.Random(4))
    df, seqs = spark.createDataFrame(models, MODELS), spark.createDataFrame(sorted(contigs.items()), "name string, seq string")
    spliced = coding.spliced_sequences(df, seqs, size=37)
    got = {r.id: r for r in coding.checked(spliced, full, sites, other).collect()}
    assert set(got) == {m[0] for m in models}
    seen = set()
    for m in models:
        mrna, _, first, last, protein, stop, verdict = plain_check(contigs[m[1]], m, full, sites, other)
        r = got[m[0]]
        assert r.mrna == mrna and r.verdict == verdict, m
        if first is not None:
            assert (r["first"], r["last"], r.protein, r.has_stop) == (first, last, protein, stop), m
        else:
            assert r.protein is None and r["first"] is None
        seen.add(verdict)
    assert len(seen) >= 3


def test_phases_go_along_the_transcript(spark):
    contigs, models = made(random.Random(7))
    with_cds = [m for m in models if m[4] is not None]
    df = spark.createDataFrame(with_cds, MODELS)
    from pyspark.sql import functions as F

    parts = coding.phases(coding.segments(F.col("exons"), F.col("cds_lo"), F.col("cds_hi")), F.col("strand"), F.col("phase"))
    got = {r.id: [(e.lo, e.hi, e.phase) for e in r.p] for r in df.select("id", parts.alias("p")).collect()}
    for m in with_cds:
        _, want, *_ = plain_check(contigs[m[1]], m, False, False, False)
        exons = sorted(want)
        assert got[m[0]] == [(max(a, m[4]), min(b, m[5]), want[a, b]) for a, b in exons], m


def test_long_introns_and_models_beyond_their_contig(spark):
    seqs = spark.createDataFrame([("c", "ATGAAATAA" * 5)], "name string, seq string")
    models = spark.createDataFrame([("a", "c", "+", [(1, 6), (40, 45)], 1, 45, 0), ("b", "c", "+", [(40, 60)], 40, 60, 0), ("x", "none", "+", [(1, 3)], 1, 3, 0), ("d", "c", "+", [(1, 9)], 1, 6, 0)], MODELS)
    got = {r.id: r for r in coding.checked(coding.spliced_sequences(models, seqs, 8), longest_intron=30).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"a": "LONG_INTRON", "d": "OK"}
    # The stop that follows belongs to it.
    assert (got["d"].protein, got["d"]["last"], got["d"].has_stop) == ("MK", 9, True)


def test_equal_proteins_of_a_locus(spark):
    df = spark.createDataFrame([("a", "l", "MK"), ("b", "l", "MK"), ("c", "l", "MA"), ("d", "k", "MK"), ("e", "l", ""), ("f", "l", None)], "id string, locus string, protein string")
    assert {r.id: r.p_id for r in coding.protein_clusters(df, "locus").collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": None, "f": None}


def test_strands_come_from_reference_neighbours_and_locus(spark):
    rows = [("p", "c", "+", 0, 100), ("m", "c", "-", 80, 200), ("a", "c", ".", 90, 130), ("b", "c", ".", 120, 210), ("x", "c", ".", 205, 260), ("y", "c", ".", 250, 300), ("z", "c", ".", 900, 950), ("t", "d", "+", 0, 10), ("u", "d", "-", 0, 10), ("v", "d", ".", 5, 30)]
    models = spark.createDataFrame(rows, "id string, contig string, strand string, lo int, hi int")
    got = {r.id: (r.strand, r.by) for r in strands.repaired(models, bin=50).collect()}
    assert got == {"p": ("+", None), "m": ("-", None), "a": ("-", "overlap"), "b": ("-", "overlap"), "x": ("-", "locus"), "y": ("-", "locus"), "z": (".", None), "t": ("+", None), "u": ("-", None), "v": ("+", "overlap")}
    reference = spark.createDataFrame([("r", "c", "+", 100, 125), ("n", "c", ".", 0, 999)], models.schema)
    got = {r.id: (r.strand, r.by) for r in strands.repaired(models, reference, bin=50).collect()}
    assert got["a"] == ("+", "reference") and got["b"] == ("+", "reference") and got["x"] == ("+", "locus") and got["z"] == (".", None)


def test_combined_strands_equal_all_pairs(spark):
    """Against all pairs, models of many bins among them; rows that meet are as many as bins of blocks, not of spans."""
    rng = random.Random(8)
    rows = []
    for k in range(150):
        places = sorted(rng.sample(range(0, 40), 2 * rng.randint(1, 3)))
        far = rng.choice([1, 1, 500])
        blocks = [(far * a, far * b) for a, b in zip(places[::2], places[1::2], strict=True)]
        rows.append((f"m{k}", f"c{k % 4}", rng.choice("+-..."), blocks[0][0], blocks[-1][1], blocks, float(rng.randint(1, 3))))

    def agree(a, b):
        def into(x, y):
            return any(p < h and g < q for (_, g), (h, _) in zip(x, x[1:], strict=False) for p, q in y)

        return a[1] == b[1] and a[3] < b[4] and b[3] < a[4] and not into(a[5], b[5]) and not into(b[5], a[5])

    left = [a for a in rows if not (a[2] == "." and any(b[2] != "." and agree(a, b) for b in rows))]
    loose = [a for a in left if a[2] == "."]
    gone = {a[0] for a in loose for b in loose if a[0] != b[0] and b[3] <= a[3] and a[4] <= b[4] and agree(a, b) and (b[3] < a[3] or a[4] < b[4] or (-b[6], b[0]) < (-a[6], a[0]))}
    want = sorted(a[0] for a in left if a[0] not in gone)
    df = spark.createDataFrame(rows, "id string, contig string, strand string, lo int, hi int, blocks array<struct<lo:int,hi:int>>, mass double")
    found = strands.combined(df, bin=16)
    assert gone and len(left) < len(rows) and sorted(r.id for r in found.collect()) == want
    wide = spark.createDataFrame([("w", "c", ".", 0, 3_000_000_000, [(0, 9), (2_999_999_991, 3_000_000_000)], 1.0), ("v", "c", "+", 0, 9, [(0, 9)], 1.0)], "id string, contig string, strand string, lo long, hi long, blocks array<struct<lo:long,hi:long>>, mass double")
    assert {r.id for r in strands.combined(wide, bin=1).collect()} == {"v"}


def test_combined_strands_drop_what_adds_nothing(spark):
    rows = [("p", "+", [(0, 100), (200, 300)]), ("in", ".", [(50, 90)]), ("gap", ".", [(120, 180)]), ("over", ".", [(80, 120)]), ("free", ".", [(400, 500)]), ("free2", ".", [(450, 520)]), ("inner", ".", [(410, 440)]), ("same", ".", [(400, 500)]), ("m", "-", [(600, 700)]), ("split", ".", [(590, 620), (680, 710)])]
    df = spark.createDataFrame([(i, "c", s, b[0][0], b[-1][1], b, 5.0 if i == "free2" else 1.0) for i, s, b in rows], "id string, contig string, strand string, lo int, hi int, blocks array<struct<lo:int,hi:int>>, mass double")
    assert sorted(r.id for r in strands.combined(df, bin=64).collect()) == ["free", "free2", "gap", "m", "over", "p", "split"]


def test_clusters_by_strand(spark):
    rows = [("a", "+", 0, 10), ("b", "+", 8, 20), ("c", "-", 5, 15), ("d", ".", 30, 50), ("e", "+", 40, 60), ("f", "-", 45, 70), ("g", "+", 100, 110)]
    df = spark.createDataFrame([(i, "c", s, lo, hi) for i, s, lo, hi in rows], "id string, contig string, strand string, lo int, hi int")
    assert {r.id: r.cluster for r in strands.clusters_by_strand(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "d", "g": "g"}

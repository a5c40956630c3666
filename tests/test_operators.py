import math
import random
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions import sequence
from spanforge.operators import abundance, cluster, fragments, intervals, stats, structure
from spanforge.sources import gff, sam, tables

# Expected compatibility at tolerance 8: (op, lo, length) twice.
TRUTH = [
    ("MATCH", 0, 50, "MATCH", 42, 50, True), ("MATCH", 0, 50, "MATCH", 34, 50, True), ("MATCH", 0, 50, "UNKNOWN", 42, 50, True), ("MATCH", 0, 50, "UNKNOWN", 34, 50, True),
    ("INTRON", 0, 50, "MATCH", 42, 50, True), ("INTRON", 0, 50, "MATCH", 34, 50, False), ("INTRON", 0, 50, "UNKNOWN", 42, 50, True), ("INTRON", 0, 50, "UNKNOWN", 34, 50, True),
    ("UNKNOWN", 0, 50, "UNKNOWN", 42, 50, True), ("UNKNOWN", 0, 50, "UNKNOWN", 34, 50, True), ("INTRON", 0, 50, "INTRON", 34, 50, False), ("INTRON", 0, 50, "INTRON", 0, 50, True),
]


def test_operation_compatibility(spark):
    df = spark.createDataFrame([(*r[:2], r[1] + r[2], *r[3:5], r[4] + r[5], r[6]) for r in TRUTH], "ao string, al int, ah int, bo string, bl int, bh int, expected boolean")
    c = F.col
    both = df.select(structure.ops_compatible(c("ao"), c("al"), c("ah"), c("bo"), c("bl"), c("bh")).alias("x"), structure.ops_compatible(c("bo"), c("bl"), c("bh"), c("ao"), c("al"), c("ah")).alias("y"), "expected")
    assert all(r.x == r.y == r.expected for r in both.collect())


CODES = [
    # query exons, reference exons, code
    ([(100, 200)], [(100, 205)], "="), ([(100, 150)], [(100, 300)], "c"), ([(280, 400)], [(100, 300)], "o"),
    ([(150, 208)], [(100, 200), (301, 400)], "c"), ([(220, 280)], [(100, 200), (301, 400)], "i"), ([(150, 260)], [(100, 200), (301, 400)], "e"),
    ([(90, 200), (301, 450)], [(100, 200), (301, 400)], "="), ([(110, 200), (301, 390)], [(100, 200), (301, 400), (501, 600)], "c"),
    ([(97, 200), (301, 390)], [(100, 200), (301, 400), (501, 600)], "c"), ([(96, 200), (301, 390)], [(100, 200), (301, 400), (501, 600)], "j"),
    ([(100, 200), (311, 390)], [(100, 200), (301, 400), (501, 600)], "j"), ([(100, 190), (311, 390)], [(100, 200), (301, 400), (501, 600)], "o"),
    ([(210, 230), (250, 290)], [(100, 200), (301, 400)], "i"),
]


@pytest.mark.parametrize(("q", "r", "code"), CODES)
def test_class_codes(spark, q, r, code):
    df = spark.createDataFrame([(q, r)], "q array<struct<lo:int,hi:int>>, r array<struct<lo:int,hi:int>>")
    assert df.select(structure.class_code(F.col("q"), F.col("r"))).first()[0] == code


def test_classified_across_strands_and_run_on(spark):
    schema = "id string, contig string, strand string, exons array<struct<lo:int,hi:int>>"
    reference = spark.createDataFrame([("r1", "c", "+", [(1001, 1100), (1201, 1300)]), ("r2", "d", "-", [(5001, 5100)])], schema)
    query = spark.createDataFrame([("s", "c", "-", [(1050, 1100), (1201, 1250)]), ("x", "c", "-", [(1050, 1090)]), ("p", "c", "+", [(2000, 2100)]), ("far", "c", "+", [(4000, 4100)]), ("m", "d", "-", [(4000, 4100)]), ("u", "d", "+", [(4000, 4100)])], schema)
    assert {r.id: r.code for r in structure.classified(query, reference).collect()} == {"s": "s", "x": "x", "p": "p", "far": "u", "m": "p", "u": "u"}


def test_identifiable_holds_no_matrix_of_fixed_models():
    """Many models that rows of their own fix; and the rank of small matrices, with repeated columns and rows of one model."""
    n = 60_000
    row, model = np.repeat(np.arange(2 * n - 1), [1] * n + [2] * (n - 1)), np.concatenate([np.arange(n), np.stack([np.arange(n - 1), np.arange(1, n)], axis=1).ravel()])
    assert abundance.identifiable(row, model, np.full(len(row), 0.5), 2 * n - 1, n)
    rng = np.random.default_rng(2)
    seen = set()
    for _ in range(200):
        m = rng.integers(0, 3, (int(rng.integers(1, 7)), int(rng.integers(1, 5)))) / 2
        m = m[:, m.any(axis=0)]
        if m.size:
            r, c = np.nonzero(m)
            want = np.linalg.matrix_rank(m) == m.shape[1]
            assert abundance.identifiable(r, c, m[r, c], *m.shape) == want
            seen.add(bool(want))
    assert seen == {True, False}


def test_gtf_lines_come_from_one_reading(spark):
    """Transcripts and exons are laid out together; attributes keep their values, quoted or not, and the first of equal keys."""
    models = spark.createDataFrame([("t1", "g", "c", "+", [(1, 5), (9, 12)], 2.0), ("t2", "g", "c", "-", [(3, 4)], 1.0)], "id string, gene_id string, contig string, strand string, exons array<struct<lo:int,hi:int>>, fpkm double")
    lines = gff.as_gtf(models)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    got = {(r.id, r.number): r.value.split("\t") for r in lines.collect()}
    assert sorted(got) == [("t1", 0), ("t1", 1), ("t1", 2), ("t2", 0), ("t2", 1)] and got["t1", 2][3:6] == ["9", "12", "1000"]
    assert got["t1", 2][8] == 'gene_id "g"; transcript_id "t1"; exon_number "2";' and got["t2", 0][5] == "500" and got["t2", 0][8].endswith(' FPKM "1.0000000000";')
    texts = ['gene_id "a b";  level  2 ; tag "x;y"; tag "z"; empty "";', "ID=a;Parent=b%2Cc;ID=d", "", 'k v "w"']
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", gff.gtf_attributes(F.col("t")).alias("a")).orderBy("k").collect()
    assert [r.a for r in found] == [{"gene_id": "a b", "level": "2 ", "tag": "x;y", "empty": ""}, {"ID": "a", "Parent": "b,c"}, {}, {"k": "v "}]


def test_redundant_models_are_not_laid_into_bins(spark):
    """Models that span many bins: as many rows meet as there are introns, and each row comes once, with its own columns."""
    def exons(at, n):
        return [(at + 100_000 * k, at + 100_000 * k + 50) for k in range(n)]

    rows = [("a", exons(1, 6)), ("b", exons(1, 6)[2:5]), ("c", exons(1, 6)[1:4:2]), ("d", exons(1, 1)), ("e", exons(500, 3)), ("f", [(1, 40), *exons(1, 6)[1:]])]
    df = spark.createDataFrame([(i, "c", "+", e, -7) for i, e in rows], "id string, contig string, strand string, exons array<struct<lo:int,hi:int>>, lo int")
    found = structure.redundant(df, bin=60)
    assert [(r.id, r.lo, len(r.exons)) for r in found.orderBy("id").collect()] == [("b", -7, 3)] and found.columns == df.columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan.replace("sequence(1, greatest", "") and plan.count("Join") == 1


def test_redundant(spark):
    schema = "id string, contig string, strand string, exons array<struct<lo:int,hi:int>>"
    df = spark.createDataFrame([("a", "c", "+", [(1, 100), (201, 300), (401, 500)]), ("b", "c", "+", [(50, 100), (201, 250)]), ("c", "c", "+", [(50, 100), (211, 250)]), ("d", "c", "+", [(1, 100), (201, 300), (401, 500)]), ("e", "c", "-", [(50, 100), (201, 250)])], schema)
    assert sorted(r.id for r in structure.redundant(df).collect()) == ["b", "d"]


spans = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 300), st.integers(0, 90)), max_size=40)


@settings(max_examples=8, deadline=None)
@given(spans, spans)
def test_range_join_equals_nested_loop(spark, a, b):
    a, b = [(i, g, lo, lo + n) for i, (g, lo, n) in enumerate(a)], [(i, g, lo, lo + n) for i, (g, lo, n) in enumerate(b)]
    schema = "id int, g int, lo int, hi int"
    got = intervals.range_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"], bin=32).select("id", "id_r").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])


@settings(max_examples=8, deadline=None)
@given(spans)
def test_coverage_counts_every_position(spark, a):
    rows = [(g, lo, lo + n) for g, lo, n in a]
    got = {(r.g, p): r.depth for r in intervals.coverage(spark.createDataFrame(rows, "g int, lo int, hi int"), ["g"]).collect() for p in range(r.lo, r.hi)}
    expected = {}
    for g, lo, hi in rows:
        for p in range(lo, hi):
            expected[g, p] = expected.get((g, p), 0) + 1
    assert got == expected


def test_islands_and_models(spark):
    df = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 9, 20), ("a", 3, 20, 30), ("a", 4, 31, 40)], "g string, id int, lo int, hi int")
    assert sorted((r.lo, r.hi, r.n) for r in intervals.merged(df, ["g"]).collect()) == [(0, 20, 2), (20, 30, 1), (31, 40, 1)]
    assert intervals.merged(df, ["g"], slack=2).count() == 1
    assert [(r.lo, r.hi) for r in intervals.intersection_model(df.where("id < 3"), ["g"], "id").collect()] == [(9, 10)]


def test_mates_that_begin_at_one_place(spark):
    reads = spark.createDataFrame([("q", "c", 5, 5, 1), ("q", "c", 5, 5, 2), ("q", "c", 5, 5, 3), ("r", "c", 1, 9, 4), ("r", "c", 9, 1, 5), ("s", "c", 1, 9, 6), ("t", "c", 3, None, 7)], "read string, contig string, left int, mate int, n int")
    got = fragments.paired(reads, "read", "contig", "left", "mate", "n").select("read", "n", "mate_n").collect()
    assert sorted(map(tuple, got)) == [("q", 1, 2), ("r", 4, 5)]


def test_fdr_against_definition(spark):
    rng = np.random.default_rng(1)
    p = [*np.round(rng.random(60), 2).tolist(), 0.001, 0.001]
    rows = [(i, "OK" if i % 5 else "NOTEST", x) for i, x in enumerate(p)]
    got = {r.test_id: r.q_value for r in stats.fdr(spark.createDataFrame(rows, "test_id int, status string, p_value double")).collect()}
    ok = sorted((x, i) for i, s, x in rows if s == "OK")
    q, least = {}, 1.0
    for rank in range(len(ok), 0, -1):
        least = min(least, ok[rank - 1][0] * len(ok) / rank)
        q[ok[rank - 1][1]] = least
    assert all((got[i] is None) if s != "OK" else math.isclose(got[i], q[i]) for i, s, _ in rows)
    assert all(q[a] <= q[b] for (_, a), (_, b) in pairwise(ok))


def test_js_distance_bounds(spark):
    df = spark.createDataFrame([("same", "x", 1, 2), ("same", "y", 3, 6), ("far", "x", 1, 0), ("far", "y", 0, 5), ("none", "x", 0, 1)], "g string, k string, a int, b int")
    got = {r.g: r.js for r in stats.js_distance(df, ["g"], "a", "b").collect()}
    assert set(got) == {"same", "far"} and got["same"] == 0 and math.isclose(got["far"], math.sqrt(math.log(2)))


def test_resampling_doesnt_depend_on_partitions(spark):
    df = spark.createDataFrame([("flat", 50.0, 60.0, 50.0, 60.0), ("up", 50.0, 60.0, 500.0, 600.0), ("none", 0.0, 0.0, 0.0, 0.0)], "id string, a double, va double, b double, vb double")
    one = {r.id: r.p_value for r in stats.resampled_p(df.coalesce(1), "id", "a", "va", "b", "vb", 2000).collect()}
    assert one == {r.id: r.p_value for r in stats.resampled_p(df.repartition(3), "id", "a", "va", "b", "vb", 2000).collect()}
    assert one["flat"] == 1.0 and one["up"] == 1 / 2000 and one["none"] == 1.0


def test_em_finds_weights_and_likelihood_grows():
    compat = np.array([[1, 0], [1, 1], [0, 1]], float)
    gamma, _, _, settled = abundance.em(compat, np.array([30.0, 40.0, 10.0]))
    assert settled and np.allclose(gamma, [0.75, 0.25], atol=1e-3)
    likelihoods = [abundance.em(compat, np.array([30.0, 40.0, 10.0]), most=k, tolerance=-1)[1] for k in range(1, 20)]
    assert all(a <= b + 1e-9 for a, b in pairwise(likelihoods))


def test_mixture_shares_what_falls_away(spark):
    rows = [("L", i, "a", 1.0, 1.0) for i in range(90)] + [("L", i, "b", 1.0, 1.0) for i in range(90, 97)] + [("L", i, "c", 1.0, 1.0) for i in range(97, 200)]
    got = {r.model: r.gamma for r in abundance.mixtures(spark.createDataFrame(rows, "locus string, f int, m string, p double, mass double"), "locus", "f", "m", "p", "mass", 0.1).collect()}
    assert got["b"] == 0 and math.isclose(sum(got.values()), 1)


def test_components_and_loci(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(8, 9), (9, 8), (10, 10)], "a int, b int")
    assert {r.id: r.component for r in cluster.label_components(nodes, edges, "id", "a", "b").collect()} == dict(enumerate([0] * 7 + [7, 8, 8, 10, 11]))
    df = spark.createDataFrame([("a", "c", "+", [(1, 10), (50, 60)]), ("b", "c", "+", [(10, 20)]), ("d", "c", "+", [(21, 40)]), ("e", "c", "-", [(1, 60)])], "id string, contig string, strand string, exons array<struct<lo:int,hi:int>>")
    assert {r.id: r.locus for r in cluster.exon_loci(df, "id", "contig", "strand", "exons").collect()} == {"a": "a", "b": "a", "d": "d", "e": "e"}


def test_sequences(spark):
    s = spark.createDataFrame([("ATGGCCTAAN", "GTACGT")], "s string, t string")
    got = s.select(sequence.translate(F.col("s")).alias("p"), sequence.reverse_complement(F.col("s")).alias("r"), sequence.kmer_code(F.col("t")).alias("k"), sequence.kmer_code(F.col("s")).alias("n"), sequence.wrapped(F.lit("x"), F.col("s"), 5).alias("f")).first()
    assert tuple(got) == ("MA*", "NTTAGGCCAT", int("230123", 4), None, ">x\nATGGC\nCTAAN")


SAM = """@HD\tVN:1.0\tSO:coordinate
@SQ\tSN:chr\tLN:650
r1\t0\tchr\t54\t255\t20M100N10M\t*\t0\t0\t*\t*\tNM:i:1\tXS:A:+
r2\t99\tchr\t60\t255\t5S20M2D3I5M\t=\t200\t0\t*\t*\tNH:i:2
r2\t147\tchr\t200\t255\t30M\t=\t60\t0\t*\t*\tNH:i:2
r3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*
r4\t0\tchr\t10\t255\t10M400000N10M\t*\t0\t0\t*\t*
r5\t0\tchr\t10\t255\t10M\tother\t9\t0\t*\t*
"""


def test_sam_text(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    got = {(r.read_id, r.left): r for r in sam.operations(sam.alignments(spark, str(tmp_path / "x.sam"))).collect()}
    assert set(got) == {("r1", 53), ("r2", 59), ("r2", 199)}
    one, two = got["r1", 53], got["r2", 59]
    assert (one.right, one.mass, one.strand, one.nm) == (183, 1.0, "+", 1) and [tuple(o) for o in one.ops] == [("MATCH", 53, 73), ("INTRON", 73, 173), ("MATCH", 173, 183)]
    assert (two.right, two.mass, two.read_len) == (59 + 5 + 20 + 2 + 5, 0.25, 33) and [tuple(o) for o in two.ops] == [("MATCH", 59, 86)]
    assert [r.tags["SN"] for r in sam.header(spark, str(tmp_path / "x.sam")).where("kind = 'SQ'").collect()] == ["chr"]


GTF = """# comment
chr\tx\texon\t401\t500\t.\t+\t.\tgene_id "g"; transcript_id "t1";
chr\tx\texon\t100\t200\t.\t+\t.\tgene_id "g"; transcript_id "t1"; gene_name "a b";
chr\tx\texon\t201\t300\t.\t+\t.\tgene_id "g"; transcript_id "t1";
chr\tx\tCDS\t150\t450\t.\t+\t0\tgene_id "g"; transcript_id "t1";
chr\tx\texon\t900\t800\t5\t-\t.\tParent=t2;Note=a%20b+c
"""


def test_gtf_and_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.gtf").write_text(GTF)
    found = {r.id: r for r in gff.transcripts(gff.features(spark, str(tmp_path / "x.gtf"))).collect()}
    assert [tuple(e) for e in found["t1"].exons] == [(100, 300), (401, 500)] and (found["t1"].cds_lo, found["t1"].cds_hi) == (150, 450)
    assert found["t1"].attributes["gene_name"] == "a b" and found["t2"].attributes["Note"] == "a b+c" and [tuple(e) for e in found["t2"].exons] == [(800, 900)]
    models = gff.transcripts(gff.features(spark, str(tmp_path / "x.gtf"))).withColumn("fpkm", F.lit(2.0))
    gff.as_gtf(models).orderBy("id", "number").select("value").coalesce(1).write.text(str(tmp_path / "out"))
    again = {r.id: r for r in gff.transcripts(gff.features(spark, str(tmp_path / "out"))).collect()}
    assert {k: v.exons for k, v in again.items()} == {k: v.exons for k, v in found.items()}
    assert [r.value.split("\t")[5] for r in sam.as_sam(models).orderBy("value").collect()] == ["201M100N100M", "101M"]
    (tmp_path / "x.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert sorted(map(tuple, gff.fasta(spark, str(tmp_path / "x.fa")).collect())) == [("one", 6, "ACGTAC"), ("two", 2, "GG")]


def test_control_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("condition_1\tcondition_2\tname\n# no\na\tb\t\na\tc\tac\n")
    assert sorted(r.name for r in tables.contrasts(spark, str(tmp_path / "c.tsv")).collect()) == ["a_vs_b", "ac"]
    (tmp_path / "s.tsv").write_text("path\tgroup\n2.bam\tx\n1.bam\tx\n3.bam\ty\n")
    assert {r.group: r.paths for r in tables.sample_sheet(spark, str(tmp_path / "s.tsv")).collect()} == {"x": ["1.bam", "2.bam"], "y": ["3.bam"]}


def test_components_over_all_orders(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    root = {r.p_partkey: r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").collect():
        a, b = find(first.setdefault(r.l_orderkey, r.l_partkey)), find(r.l_partkey)
        root[max(a, b)] = min(a, b)
    got = {r.p_partkey: r.component for r in entry.queries()["cluster_components_all_orders"](spark, sf).collect()}
    assert got == {x: find(x) for x in root}


def test_translation_of_whole_texts(spark):
    import hashlib
    import re

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    amino = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), sequence.AMINO_ACIDS, strict=True))
    table = str.maketrans("BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        seq = re.sub("[^A-Za-z]", "", r.text).upper().translate(table)
        protein = "".join(amino.get(seq[k : k + 3], "X") for k in range(0, len(seq) - 2, 3))
        want[r.doc_id] = len(protein), hashlib.md5(protein.encode()).hexdigest()
    assert max(n for n, _ in want.values()) > 100
    assert {r.doc_id: (r.length, r.digest) for r in entry.queries()["codon_translate_whole"](spark, sf).collect()} == want


def test_ranges_give_what_whole_groups_give(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), k, lo, lo + rng.choice([0, 1, 5, 30, 200]), rng.randint(0, 3)) for k, lo in enumerate(rng.choices(range(-100, 1000), k=300))] + [("c", 1000, None, 4, 1)]
    df = spark.createDataFrame(rows, "g string, k int, lo int, hi int, side int")
    got = {}
    for width in (None, 7, 64, 1 << 20, "by rows", "20 rows", "few cut"):
        monkeypatch.setattr(intervals, "RANGE_ROWS", 20 if width in ("20 rows", "few cut") else 100_000)
        monkeypatch.setattr(intervals, "MOST_CUT", 1 if width == "few cut" else 50_000)
        islands = intervals.islands(df, ["g"], slack=2, order=["hi", "k"], width=width).select("k", "island").collect()
        depth = intervals.coverage(df.where("lo is not null"), ["g"], width=width).collect()
        near = intervals.nearest_preceding(df.where("side = 0"), df.where("side = 1").withColumn("v", F.col("k") * 2).select("g", "lo", "v"), ["g"], "lo", "v", 50, width=width).select("k", "v_before").collect()
        got[width] = [sorted(map(repr, x)) for x in (islands, depth, near)]
    assert all(x == got[None] for x in got.values())


def test_one_large_group_is_ordered_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(intervals, "RANGE_ROWS", 100)
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 7).alias("lo"), (F.col("id") * 7 + 5).alias("hi"))
    whole, cut = intervals._cut(df.unionByName(spark.createDataFrame([("small", 1, 2)], "g string, lo long, hi long")), ["g"], "lo", intervals.BY_ROWS)
    assert whole.count() == 1 and max(r["count"] for r in cut.groupBy("__range").count().collect()) <= 110
    assert intervals.merged(df, ["g"]).count() == 5000 and intervals.merged(df, ["g"], slack=3).count() == 1


def test_sources_with_odd_records(spark, tmp_path):
    (tmp_path / "a.sam").write_text("".join(f"{n}\t0\tc\t11\t255\t{c}\t*\t0\t0\t*\t*\n" for n, c in [("m", "5=1X4="), ("u", "5M2Z3M"), ("e", "*"), ("s", "3=2S")]))
    got = {r.read_id: (r.right, r.read_len) for r in sam.alignments(spark, str(tmp_path / "a.sam")).collect()}
    assert got == {"m": (20, 10), "s": (15, 5)}
    (tmp_path / "a.gtf").write_text('c\ts\texon\t1\t9\t.\t+\t.\tgene_id "a; b"; transcript_id t1 ; note "x ""; level 2;\n')
    (row,) = gff.features(spark, str(tmp_path / "a.gtf")).collect()
    assert row.attributes["gene_id"] == "a; b" and row.attributes["transcript_id"].strip() == "t1" and row.attributes["level"] == "2"
    (tmp_path / "a.fa").write_text(">one a>b\nACG\nT\n>two\nGG\n>\n")
    assert sorted((r.name, r.seq) for r in gff.fasta(spark, str(tmp_path / "a.fa")).collect() if r["name"]) == [("one", "ACGT"), ("two", "GG")]


def test_clusters_by_two_keys(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "c", None), (5, None, None)], "id int, gene string, tss string")
    assert {r.id: r.cluster for r in cluster.annotated_clusters(df, "id", ["gene", "tss"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_table_of_tests(spark):
    rows = [("t", "g", None, "", "a", "b", "OK", 1.0, 2.0, 1.0, None, 0.01, 0.02, True), ("u", None, None, None, "a", "b", "NOTEST", None, None, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "test_id string, gene_id string, gene string, locus string, condition_1 string, condition_2 string, status string, value_1 double, value_2 double, log2_fold_change double, test_stat double, p_value double, q_value double, significant boolean")
    got = tables.as_test_table(df)
    assert len(got.columns) == 14
    assert sorted(map(tuple, got.collect())) == [("t", "g", "-", "-", "a", "b", "OK", 1.0, 2.0, 1.0, 0.0, 0.01, 0.02, "yes"), ("u", "-", "-", "-", "a", "b", "NOTEST", 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, "no")]


def test_groups_without_ids_or_fpkm(spark):
    df = spark.createDataFrame([("g", "", 10.0, 0.0), ("g", None, 20.0, 0.0), ("h", "b", 10.0, 1.0), ("h", "a", 40.0, 2.0)], "g string, name string, len double, fpkm double")
    assert {r.g: r.name for r in fragments.id_sets(df, ["g"], ["name"]).collect()} == {"g": "-", "h": "a,b"}
    assert {r.g: r.effective_length for r in fragments.group_effective_length(df, ["g"], "len", "fpkm").collect()} == {"g": 0.0, "h": 30.0}

import random

from pyspark.sql import functions as F

from spanforge.plans import workflows
from spanforge.sources import sam

EXONS = [(53, 250), (351, 400), (501, 550)]


def write_reads(path, exons, n, seed, contig="chr", strand="+", size=75, tag="r"):
    """Spliced reads of a transcript given by its exons (1-based closed), as SAM text."""
    rng = random.Random(seed)
    bases = [p for lo, hi in exons for p in range(lo, hi + 1)]
    lines = []
    for k in range(n):
        at = k * (len(bases) - size) // max(1, n // 2 - 1) if k < n // 2 else rng.randint(0, len(bases) - size)
        places, cigar, run = bases[at : at + size], "", 1
        for a, b in zip(places, [*places[1:], None], strict=True):
            if b == a + 1:
                run += 1
            else:
                cigar += f"{run}M" + (f"{b - a - 1}N" if b else "")
                run = 1
        lines.append(f"{tag}{k}\t0\t{contig}\t{places[0]}\t255\t{cigar}\t*\t0\t0\t*\t*" + (f"\tXS:A:{strand}" if "N" in cigar else ""))
    path.write_text("@SQ\tSN:chr\tLN:650\n" + "\n".join(lines) + "\n")


def test_assembly_of_three_exons(spark, tmp_path):
    write_reads(tmp_path / "a.sam", EXONS, 200, 1)
    models = workflows.assemble_sample(sam.alignments(spark, str(tmp_path / "a.sam"))).collect()
    assert [(m.contig, m.strand, [tuple(e) for e in m.exons]) for m in models] == [("chr", "+", EXONS)]


def test_quantify_and_test(spark, tmp_path):
    long, short = EXONS, [(53, 250), (501, 550)]
    other = [(2001, 2400)]
    rows = [("t1", "g", "chr", "+", long), ("t2", "g", "chr", "+", short), ("u1", "h", "chr", "+", other)]
    models = spark.createDataFrame(rows, "id string, gene_id string, contig string, strand string, exons array<struct<lo:int,hi:int>>")
    reads = None
    for lib, (a, b, c) in {"x1": (300, 100, 400), "x2": (310, 90, 390), "y1": (30, 10, 400), "y2": (28, 12, 410)}.items():
        for k, (exons, n) in enumerate(((long, a), (short, b), (other, c))):
            write_reads(tmp_path / f"{lib}{k}.sam", exons, n, k, tag=f"{k}r")
            one = sam.alignments(spark, str(tmp_path / f"{lib}{k}.sam")).withColumn("library", F.lit(lib))
            reads = one if reads is None else reads.unionByName(one)
    q = workflows.quantify(reads, models).cache()
    by = {(r.library, r.id): r for r in q.collect()}
    assert abs(by["x1", "t1"]["count"] / 300 - 1) < 0.15 and abs(by["x1", "t2"]["count"] / 100 - 1) < 0.4
    assert abs(by["x1", "t1"]["count"] + by["x1", "t2"]["count"] - 400) < 1e-6
    genes = workflows.gene_level(q)
    assert all(abs(sum(r.kappa.values()) - 1) < 1e-9 and r.fpkm > 0 for r in genes.collect())
    samples = spark.createDataFrame([("x1", "x"), ("x2", "x"), ("y1", "y"), ("y2", "y")], "library string, condition string")
    contrasts = workflows.time_series(spark.createDataFrame([("x", 1), ("y", 2)], "c string, o int"), "c", "o")
    tests = {r.gene_id: r for r in workflows.differential(genes, samples, contrasts, draws=2000).collect()}
    assert tests["g"].significant and tests["g"].log2_fold_change < -2 and not tests["h"].significant


def test_merge_of_assemblies(spark):
    rows = [("a", "1", "chr", "+", [(1, 100), (201, 260)], 5.0), ("b", "1", "chr", "+", [(240, 260), (401, 500)], 5.0), ("b", "2", "chr", "+", [(50, 100), (201, 250)], 5.0)]
    df = spark.createDataFrame(rows, "sample string, id string, contig string, strand string, exons array<struct<lo:int,hi:int>>, mass double")
    assert [[tuple(e) for e in r.exons] for r in workflows.merged_assemblies(df).collect()] == [[(1, 100), (201, 260), (401, 500)]]


def test_bundles_by_annotation(spark):
    reads = spark.createDataFrame([("a", "c", 100, 150, None), ("b", "c", 400, 450, None), ("d", "c", 480, 520, None), ("e", "c", 900, 950, 990)], "read_id string, contig string, left int, right int, mate_left int")
    models = spark.createDataFrame([("m", "c", [(91, 200), (401, 500)])], "id string, contig string, exons array<struct<lo:int,hi:int>>")
    assert sorted(r.read_id for r in workflows.bundled_by(reads, models, "reference").collect()) == ["a", "b"]
    got = {r.read_id: r.bundle for r in workflows.bundled_by(reads, models, "guided").collect()}
    assert got["a"] == got["b"] == got["d"] != got["e"]


def test_splicing(spark):
    rng = random.Random(3)
    rows = []
    for lib, condition in [(f"{c}{k}", c) for c in "xy" for k in range(3)]:
        for gene, shares in {"turned": {"x": (90, 10), "y": (10, 90)}, "same": {"x": (60, 40), "y": (60, 40)}, "one": {"x": (5,), "y": (9,)}, "gone": {"x": (5, 6), "y": (0, 0)}}.items():
            rows += [(lib, gene, f"{gene}{k}", v * rng.uniform(0.9, 1.1), "OK") for k, v in enumerate(shares[condition])]
        rows += [(lib, "low", f"low{k}", 3.0 + (k if condition == "x" else 0), "LOWDATA" if k else "OK") for k in range(2)]
    q = spark.createDataFrame(rows, "library string, gene_id string, id string, fpkm double, status string")
    samples = spark.createDataFrame([(f"{c}{k}", c) for c in "xy" for k in range(3)], "library string, condition string")
    contrasts = spark.createDataFrame([("x", "y")], "condition_1 string, condition_2 string")
    got = {r.gene_id: r for r in workflows.splicing(q, samples, contrasts, draws=2000).collect()}
    assert {k: r.status for k, r in got.items()} == {"turned": "OK", "same": "OK", "one": "NOTEST", "gone": "NOTEST", "low": "LOWDATA"}
    assert got["turned"].significant and got["turned"].js > 0.5 and not got["same"].significant and got["one"].p_value == 1
    again = workflows.splicing(q.repartition(5), samples, contrasts, draws=2000).collect()
    assert {r.gene_id: r.p_value for r in again} == {k: r.p_value for k, r in got.items()}
    assert {r.status for r in workflows.splicing(q, samples, contrasts, least_replicates=4, draws=50).collect()} == {"NOTEST", "LOWDATA"}
    # Its test is no more often significant than it should be where nothing differs.
    null = [(f"{c}{k}", f"g{g}", f"g{g}.{m}", rng.gammavariate(20, 1), "OK") for c in "xy" for k in range(4) for g in range(60) for m in range(3)]
    four = spark.createDataFrame([(f"{c}{k}", c) for c in "xy" for k in range(4)], "library string, condition string")
    tests = workflows.splicing(spark.createDataFrame(null, q.schema), four, contrasts, draws=500).collect()
    assert len(tests) == 60 and sum(r.p_value < 0.05 for r in tests) <= 12


def test_modelled_variances_order_no_gene(spark):
    """All genes are one group of the model: none may wait for a task that orders them all."""
    rng = random.Random(5)
    genes = [(f"g{k}", c, m, m + 0.1 * m * m * rng.uniform(0.5, 1.5)) for k in range(60) for c in "xy" for m in [rng.uniform(5, 5000)]]
    found = workflows.modelled_variances(spark.createDataFrame(genes, "gene_id string, condition string, mean double, variance double"), {"x": 3, "y": 3})
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.gene_id, r.condition): (r["mean"], r.variance) for r in found.collect()}
    assert len(got) == len(genes) and all(got[g, c][0] == m and m <= got[g, c][1] < m + m * m for g, c, m, _ in genes)

import random

from pyspark.sql import functions as F

from spanforge.operators import bias
from spanforge.plans import workflows
from spanforge.sources import sam


def test_bias_is_learned_and_weighed(spark):
    rng = random.Random(1)
    seqs = {f"t{k}": "".join(rng.choice("ACGT") for _ in range(400)) for k in range(5)}
    models = spark.createDataFrame([(k, s, 10.0) for k, s in seqs.items()], "id string, seq string, fpkm double")
    # Starts prefer a G three to one.
    starts = spark.createDataFrame([(k, p, 6 if c == "G" else 2) for k, s in seqs.items() for p, c in enumerate(s)], "id string, at int, n int")
    ratios = bias.learned(models, starts, 2, 3)
    by = {(r.offset, r.base): r.ratio for r in ratios.collect()}
    share = sum(s.count("G") for s in seqs.values()) / 2000
    assert abs(by[0, "G"] - 3 / (1 + 2 * share)) < 1e-9 and all(abs(v - 1) < 0.2 for (o, _), v in by.items() if o)
    even = bias.learned(models, starts.withColumn("n", F.lit(1)), 2, 3)
    assert all(abs(r.ratio - 1) < 1e-9 for r in even.collect())
    weights = bias.position_weights(models, even, 2, 3)
    assert weights.count() == 2000 and abs(bias.effective_length(weights, F.lit(400), 100).first().effective_length - 301) < 1e-6


def test_bias_and_abundance_in_turns(spark):
    """Starts prefer a G four to one, and one of two forms has far more of them: without the bias it looks stronger than it is."""
    rng = random.Random(3)
    contig = "".join(rng.choice("AT") if k < 300 else rng.choice("ACT") if k < 700 else rng.choice("GGGA") for k in range(1400))
    shared, poor, rich = (1, 250), (401, 640), (801, 1040)
    models = spark.createDataFrame([("poor", "g", "c", "+", [shared, poor]), ("rich", "g", "c", "+", [shared, rich])], "id string, gene_id string, contig string, strand string, exons array<struct<lo:int,hi:int>>")
    rows, size = [], 40
    for name, exons in (("poor", (shared, poor)), ("rich", (shared, rich))):
        places = [p for a, b in exons for p in range(a, b + 1)]
        for at in range(len(places) - size + 1):
            for k in range(4 if contig[places[at] - 1] == "G" else 1):
                part = places[at : at + size]
                cut = next((i for i in range(1, size) if part[i] != part[i - 1] + 1), None)
                cigar = [("M", size)] if cut is None else [("M", cut), ("N", part[cut] - part[cut - 1] - 1), ("M", size - cut)]
                rows.append((f"{name}{at}.{k}", "c", part[0] - 1, part[-1], "+" if cut else ".", cigar, 1.0, "l"))
    reads = spark.createDataFrame(rows, "read_id string, contig string, left int, right int, strand string, cigar array<struct<op:string,len:int>>, mass double, library string")
    plain = {r.id: r.fpkm for r in workflows.quantify(reads, models).collect()}
    found, ratios = workflows.quantify_unbiased(reads, models, spark.createDataFrame([("c", contig)], "name string, seq string"), rounds=4, before=0, after=1)
    fixed = {r.id: r.fpkm for r in found.collect()}
    by = {r.base: r.ratio for r in ratios.collect()}
    assert 2.8 < by["G"] / by["A"] < 5, by
    assert plain["rich"] / plain["poor"] > 1.5 and abs(fixed["rich"] / fixed["poor"] - 1) < 0.3, (plain, fixed)


def test_trim_keeps_first_bases(spark, tmp_path):
    (tmp_path / "x.sam").write_text("a\t0\tc\t11\t255\t10M100N10M\t*\t0\t0\t*\t*\nb\t16\tc\t11\t255\t10M100N10M\t*\t0\t0\t*\t*\n")
    got = {r.read_id: (r.left, r.right, r.read_len, [tuple(x) for x in r.cigar]) for r in sam.trimmed(sam.alignments(spark, str(tmp_path / "x.sam")), 10).collect()}
    assert got == {"a": (10, 20, 10, [("M", 10)]), "b": (120, 130, 10, [("M", 10)])}
    got = {r.read_id: (r.left, r.right, [tuple(x) for x in r.cigar]) for r in sam.trimmed(sam.alignments(spark, str(tmp_path / "x.sam")), 12).collect()}
    assert got == {"a": (10, 122, [("M", 10), ("N", 100), ("M", 2)]), "b": (18, 130, [("M", 2), ("N", 100), ("M", 10)])}


def test_strand_by_protocol(spark):
    df = spark.createDataFrame([(f,) for f in (99, 147, 83, 163)], "flag int")
    assert [tuple(r) for r in df.select(sam.strand_by_protocol(F.col("flag"), "first"), sam.strand_by_protocol(F.col("flag"), "second")).collect()] == [("-", "+"), ("-", "+"), ("+", "-"), ("+", "-")]

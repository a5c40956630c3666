import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import assemble, compare, dispersion, filters
from spanforge.streaming import loci


def test_assembly_of_two_isoforms(spark):
    reads = [("b", "+", [(50, 100), (200, 240)]), ("b", "+", [(220, 250), (400, 450)]), ("b", "+", [(60, 100), (200, 230)]), ("b", "+", [(70, 100), (400, 440)]), ("c", "-", [(1, 20)])] * 3 + [("h", "+", [(k, k + 5)]) for k in range(6)]
    df = spark.createDataFrame([(*r, 1.0) for r in reads], "bundle string, strand string, blocks array<struct<lo:int,hi:int>>, mass double")
    got = assemble.assembled(df, "bundle", "strand", "blocks", "mass", most=5).collect()
    models = {(r.bundle, tuple(map(tuple, r.exons))): r.mass for r in got if r.status == "OK"}
    assert models == {("b", ((50, 100), (200, 250), (400, 450))): 9.0, ("b", ((70, 100), (400, 440))): 3.0, ("c", ((1, 20),)): 3.0, ("h", ((0, 10),)): 6.0}
    bounded = assemble.assembled(df, "bundle", "strand", "blocks", "mass", most=2).collect()
    assert [(r.bundle, r.model) for r in bounded if r.status == "HIDATA"] == [("b", None)] and len(bounded) == 3


def test_junction_counts_and_filters(spark):
    ops = "array<struct<op:string,lo:int,hi:int>>"
    reads = spark.createDataFrame([(1, "c", 1, [("MATCH", 0, 20), ("INTRON", 20, 50), ("MATCH", 50, 60)]), (2, "c", 20, [("MATCH", 16, 20), ("INTRON", 20, 50), ("MATCH", 50, 90)]), (3, "c", 1, [("MATCH", 0, 9)])], f"id int, contig string, nh int, ops {ops}")
    j = filters.junctions(reads, "id", "contig", "ops")
    assert [tuple(r) for r in j.collect()] == [("c", 20, 50, 2, 1, 1)]
    assert [r.id for r in filters.without_bad_junctions(reads, j.select("contig", "lo", "hi"), "contig", "ops", "id").collect()] == [3]


def test_pre_mrna_lies_in_weak_introns(spark):
    introns = spark.createDataFrame([("c", "i1", 100, 200), ("c", "i2", 300, 400)], "contig string, intron string, lo int, hi int")
    depth = spark.createDataFrame([("c", 0, 100, 50), ("c", 120, 140, 1), ("c", 200, 300, 50), ("c", 300, 400, 40), ("c", 400, 420, 50)], "contig string, lo int, hi int, depth int")
    ratio = {r.intron: r.ratio for r in filters.flank_ratio(introns, depth, ["contig"], "intron").collect()}
    assert math.isclose(ratio["i1"], 0.2 / 50) and math.isclose(ratio["i2"], 0.8)
    fragments = spark.createDataFrame([("c", 1, 120, 140), ("c", 2, 90, 140), ("c", 3, 310, 320)], "contig string, id int, lo int, hi int")
    assert [r.id for r in filters.pre_mrna(fragments, introns, depth, ["contig"], "id", "intron").collect()] == [1]


def test_projection_and_tiles(spark):
    df = spark.createDataFrame([([(10, 20), (30, 40)], 35), ([(10, 20), (30, 40)], 25)], "exons array<struct<lo:int,hi:int>>, p int")
    assert [r[0] for r in df.select(filters.projected(F.col("exons"), F.col("p"))).collect()] == [15, None]
    tiles = filters.tiled(spark.createDataFrame([("a", 1000), ("b", 100)], "id string, n int"), "n").groupBy("id").agg(F.max("tile_hi").alias("m"), F.count("*").alias("k")).collect()
    assert {r.id: (r.m, r.k) for r in tiles} == {"a": (1000, 41), "b": (100, 1)}


def test_variance_model(spark):
    rng = np.random.default_rng(0)
    rows = [("g", float(m), float(m + 0.2 * m * m)) for m in np.exp(rng.uniform(1, 6, 400))] + [("few", 5.0, 50.0)] * 3
    df = spark.createDataFrame(rows, "grp string, mean double, variance double")
    model = dispersion.fitted(df, "grp", "mean", "variance")
    by = {}
    for r in model.collect():
        by.setdefault(r.grp, []).append((r["mean"], r.variance))
    assert all(v == m for m, v in by["few"]) and all(v >= m for m, v in by["g"])
    assert all(0.5 < v / (m + 0.2 * m * m) < 2 for m, v in by["g"] if 5 < m < 300)
    line = spark.createDataFrame([("g", 10.0, 20.0), ("g", 20.0, 60.0), ("g", 40.0, 100.0)], "grp string, mean double, variance double")
    points = spark.createDataFrame([("g", k, x) for k, x in enumerate([10.0, 15.0, 30.0, 50.0, 8.0, 0.0])], "grp string, id int, m double")
    assert {r.id: r.variance for r in dispersion.looked_up(points, line, ["grp"], "m").collect()} == {0: 20.0, 1: 40.0, 2: 80.0, 3: 120.0, 4: 12.0, 5: 0.0}
    pooled = dispersion.pooled(model.where("grp = 'g'"), spark.createDataFrame([("g", 3)], "grp string, n int"), "grp")
    assert pooled.count() == len(by["g"])


def test_points_are_looked_up_where_they_are(spark):
    """One group of many points is neither ordered nor held in a task: time was the square of its points."""
    rng = np.random.default_rng(1)
    knots = {g: np.sort(rng.uniform(0, 100, n)) for g, n in (("a", 2), ("b", 37), (None, 5))}
    line = spark.createDataFrame([(g, float(x), float(x * x + 1)) for g, at in knots.items() for x in at], "grp string, mean double, variance double")
    rows = [(g, k, float(x)) for g, at in knots.items() for k, x in enumerate([*rng.uniform(-20, 140, 300), *at])] + [("none", 0, 7.0), ("a", 1000, None)]
    found = dispersion.looked_up(spark.createDataFrame(rows, "grp string, id int, m double"), line, ["grp"], "m")
    got = {(r.grp, r.id): r.variance for r in found.collect()}
    assert len(got) == len(rows)
    for g, k, x in rows:
        if x is None or g not in knots:
            assert got[g, k] == x
            continue
        at = knots[g]
        i = min(max(np.searchsorted(at, x, side="right"), 1), len(at) - 1)
        (a, b), (c, d) = at[i - 1 : i + 1], at[i - 1 : i + 1] ** 2 + 1
        assert got[g, k] == pytest.approx(max(x, c + (x - a) * (d - c) / (b - a)), rel=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_count_covariance(spark):
    df = spark.createDataFrame([("L", "a", 0.5, 1000.0, 1000.0), ("L", "b", 0.5, 1000.0, 1000.0), ("M", "c", 1.0, 100.0, 300.0)], "locus string, model string, g double, t double, v double")
    run = lambda d: {(r.model, r.other): r.covariance for r in dispersion.count_covariance(d, "locus", "model", "g", "t", "v", draws=400).collect()}
    got = run(df)
    assert got == run(df.repartition(3)) and got["a", "b"] == got["b", "a"]
    assert 350 < got["a", "a"] < 650 and abs(got["a", "b"]) < 120 and 200 < got["c", "c"] < 400


MODELS = "dataset string, id string, contig string, strand string, exons array<struct<lo:int,hi:int>>"


def test_accuracy_tracking_and_maps(spark):
    q = spark.createDataFrame([("q", "a", "c", "+", [(1, 100), (201, 300)]), ("q", "b", "c", "+", [(500, 599)])], MODELS)
    r = spark.createDataFrame([("r", "x", "c", "+", [(51, 100), (201, 300)]), ("r", "y", "c", "-", [(500, 599)])], MODELS)
    rows = {x.level: (x.query, x.reference, x.matched) for x in compare.accuracy(q, r).collect()}
    assert rows == {"exon": (3, 3, 1), "intron": (1, 1, 1), "intron_chain": (1, 1, 1), "transcript": (2, 2, 0), "base": (300, 250, 150)}
    t = compare.tracked(q.unionByName(r)).collect()
    assert [(x.structure, {k: list(v) for k, v in x.members.items()}) for x in t] == [("101-200", {"q": ["a"], "r": ["x"]})]
    assert {x.id: x.locus for x in compare.superloci(q.unionByName(r)).collect()} == {"a": "a", "x": "a", "b": "b", "y": "y"}
    classified = spark.createDataFrame([("a", "=", "x"), ("d", "c", "x"), ("e", "=", "x"), ("b", "i", "y")], "id string, code string, reference string")
    assert [tuple(m) for m in compare.reference_map(classified).collect()] == [("x", "a,e", "d")]
    assert sorted(m.id for m in compare.meta_assembly(classified).collect()) == ["a", "e"]
    assert compare.missed_introns(q, r).count() == 0


@pytest.fixture()
def stream(spark, tmp_path):
    def feed(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    return feed, drain


def test_streamed_sessions_close_behind_the_watermark(spark, stream):
    feed, drain = stream
    rows = [(1, f"2024-01-01 00:0{m}:00", 1.0) for m in (0, 1, 2, 9)] + [(2, "2024-01-01 05:00:00", 5.0)]
    df = feed([(u, t, v) for u, t, v in rows], "user int, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = drain(loci.sessions(df, "t", "user", "5 minutes", "10 minutes", "v"), "sessions")
    assert sorted((r.user, r.n, r.v) for r in got) == [(1, 1, 1.0), (1, 3, 3.0)]


def test_streamed_mates(spark, stream):
    feed, drain = stream
    rows = [("q", True, "2024-01-01 00:00:00"), ("q", False, "2024-01-01 00:00:30"), ("r", True, "2024-01-01 00:00:00"), ("r", False, "2024-01-01 02:00:00")]
    df = feed(rows, "read string, first boolean, t string").withColumn("t", F.to_timestamp("t"))
    got = drain(loci.mates(df, "t", "read", F.col("first"), "1 minute", "10 minutes"), "mates")
    assert [r.read for r in got] == ["q"]

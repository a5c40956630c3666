"""Models without a strand: what their neighbours say, and the two strands' assemblies of one place brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import intervals
from spanforge.operators.assemble import gaps
from spanforge.operators.cluster import _kept, label_components


def repaired(models: DataFrame, reference: DataFrame | None = None, bin: int = 10_000) -> DataFrame:
    """models(id, contig, strand, lo, hi) with strand and by: how it was found.

    A model without a strand ('.') takes the one of what it overlaps: of reference models first ('reference'), else of models with a
    strand of their own ('overlap'); the longest overlap counts, ties go to '+'. One that overlaps neither takes the strand on which
    its own locus, the island of models without a strand that it lies in, has most repaired bases ('locus'), else it stays.
    Nothing is repaired from what was repaired by a locus. Half-open coordinates.
    """
    loose = models.where(F.col("strand") == ".").select("id", "contig", "lo", "hi")

    def by(known: DataFrame, how: str) -> DataFrame:
        sided = known.where(F.col("strand").isin("+", "-")).select("contig", "strand", "lo", "hi")
        pairs = intervals.range_join(loose, sided, ["contig"], bin=bin)
        shared = pairs.groupBy("id", F.col("strand_r").alias("s")).agg(F.max(intervals.overlap_length(F.col("lo"), F.col("hi"), F.col("lo_r"), F.col("hi_r"))).alias("n"))
        return shared.groupBy("id").agg(F.max_by("s", F.struct("n", (F.col("s") == "+").alias("plus"))).alias("s")).select("id", "s", F.lit(how).alias("how"))

    found = by(models, "overlap")
    if reference is not None:
        first = by(reference, "reference")
        found = first.unionByName(found.join(first.select("id"), "id", "left_anti"))
    placed = intervals.islands(loose, ["contig"], order=["hi", "id"], name="__locus").join(found, "id", "left")
    sides = placed.where("s IS NOT NULL").groupBy("contig", "__locus", "s").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    major = sides.groupBy("contig", "__locus").agg(F.max_by("s", F.struct("n", (F.col("s") == "+").alias("plus"))).alias("__major"))
    settled = placed.join(major, ["contig", "__locus"], "left").select("id", F.coalesce("s", "__major").alias("__s"), F.coalesce("how", F.when(F.col("__major").isNotNull(), "locus")).alias("by"))
    return models.join(settled, "id", "left").withColumn("strand", F.coalesce("__s", "strand")).drop("__s")


def _clash(a: Column, b: Column) -> Column:
    """Whether a gap of either lies where the other has bases."""
    def into(x: Column, y: Column) -> Column:
        return F.exists(gaps(x), lambda g: F.exists(y, lambda e: (e["lo"] < g["hi"]) & (g["lo"] < e["hi"])))

    return into(a, b) | into(b, a)


def combined(models: DataFrame, bin: int = 10_000) -> DataFrame:
    """Models of both strands and of none(id, contig, strand, lo, hi, blocks, mass), those without a strand only where they add something.

    A model without a strand goes where one with a strand overlaps it and no gap of either lies where the other has bases; of those
    that are left one goes where it lies in another that it agrees with in this way (of equal spans the heavier stays, then the
    lesser id). Half-open coordinates; blocks is an array of (lo, hi) in order, from lo to hi. Two models that overlap and agree
    share the base at which the later begins, so that they meet in bins of blocks, not in all bins of their spans.
    """
    sides = models.where("lo < hi").select("id", "contig", "strand", "lo", "hi", "blocks", "mass")

    def binned(df: DataFrame, suffix: str = "") -> DataFrame:
        touched = F.flatten(F.transform(F.filter("blocks", lambda e: e["lo"] < e["hi"]), lambda e: F.sequence(F.floor(e["lo"] / bin), F.floor((e["hi"] - 1) / bin))))
        return df.select(*(F.col(c).alias(c + suffix) for c in ("id", "contig", "lo", "hi", "blocks", "mass")), F.explode(F.array_distinct(touched)).alias("__bin" + suffix))

    def met(df: DataFrame, others: DataFrame, condition: Column) -> DataFrame:
        agree = F.expr("contig = contig_r AND __bin = __bin_r AND lo < hi_r AND lo_r < hi") & ~_clash(F.col("blocks"), F.col("blocks_r"))
        return binned(df).join(binned(others, "_r"), agree & condition, "left_semi").select("id").distinct()

    loose = sides.where("strand = '.'")
    known = _kept(met(loose, sides.where("strand <> '.'"), F.lit(True)))
    left = loose.join(known, "id", "left_anti")
    other = F.expr("id <> id_r AND lo_r <= lo AND hi <= hi_r AND (lo_r < lo OR hi < hi_r OR mass_r > mass OR mass_r = mass AND id_r < id)")
    return models.join(known.union(met(left, left, other)), "id", "left_anti")


def clusters_by_strand(models: DataFrame, slack: int = 0) -> DataFrame:
    """models(id, contig, strand, lo, hi) with cluster: islands of a contig in which models of one strand, or of none, overlap.

    Those without a strand join the islands of both and so may connect them: they are clustered with '+' and '-' alike, and
    clusters that share one are one, named by the least id.
    """
    both = models.withColumn("__side", F.explode(F.when(F.col("strand") == ".", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand"))))
    placed = intervals.islands(both, ["contig", "__side"], slack=slack, order=["hi", "id"], name="__island")
    named = placed.withColumn("__first", F.min("id").over(Window.partitionBy("contig", "__side", "__island")))
    links = named.select("id", "__first")
    found = label_components(models.select("id"), links, "id", "id", "__first")
    return models.join(found.withColumnRenamed("component", "cluster"), "id")

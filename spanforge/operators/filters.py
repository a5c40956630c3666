"""Filters before and after assembly, depth along models, and splice tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.intervals import coverage, range_join

ISOFORM_FRACTION, PRE_MRNA_FRACTION, MULTI_FRACTION, LEAST_FRAGMENTS = 0.1, 0.15, 0.75, 10


def junctions(reads: DataFrame, read_id: str, contig: str, ops: str, anchor: int = 8, many: int = 10) -> DataFrame:
    """(contig, lo, hi, n, small, multi): for each junction its reads, those with a short match beside it, those that map often.

    ops is an array of (op, lo, hi); reads have nh. Coordinates are those of the operations.
    """
    size = lambda x: F.coalesce(x["hi"] - x["lo"], F.lit(0))
    at = F.filter(F.transform(ops, lambda x, i: F.struct(x["op"].alias("op"), x["lo"].alias("lo"), x["hi"].alias("hi"), size(F.get(ops, i - 1)).alias("left"), size(F.get(ops, i + 1)).alias("right"))), lambda x: x["op"] == "INTRON")
    each = reads.select(contig, "nh", F.explode(at).alias("j"))
    return each.groupBy(contig, F.col("j.lo").alias("lo"), F.col("j.hi").alias("hi")).agg(F.count("*").alias("n"), F.count_if(F.least("j.left", "j.right") < anchor).alias("small"), F.count_if(F.col("nh") > many).alias("multi"))


def multimapping_junctions(junctions: DataFrame, n: str = "n", multi: str = "multi", fraction: float = 0.5) -> DataFrame:
    """Junctions of whose reads more than fraction map to many places."""
    return junctions.where((F.col(n) > 0) & (F.col(multi) / F.col(n) > fraction))


def without_bad_junctions(reads: DataFrame, bad: DataFrame, contig: str, ops: str, id: str) -> DataFrame:
    """reads without those that use a junction(contig, lo, hi) of bad."""
    uses = reads.select(id, contig, F.explode(F.filter(ops, lambda x: x["op"] == "INTRON")).alias("j")).select(id, contig, F.col("j.lo").alias("lo"), F.col("j.hi").alias("hi"))
    return reads.join(uses.join(bad, [contig, "lo", "hi"], "left_semi").select(id).distinct(), id, "left_anti")


def weak_introns(introns: DataFrame, bundle: Sequence[str], id: str, count: str, fraction: float = ISOFORM_FRACTION, bin: int = 10_000) -> DataFrame:
    """Introns whose count lies below fraction of their bundle's mean or of an overlapping intron's."""
    mean = F.avg(count).over(Window.partitionBy(*bundle))
    marked = introns.withColumn("__low", F.col(count) < fraction * mean)
    slim = introns.select(*bundle, id, count, "lo", "hi")
    beaten = range_join(slim, slim, bundle, bin=bin).where((F.col(id) != F.col(f"{id}_r")) & (F.col(count) < fraction * F.col(f"{count}_r"))).select(id).distinct().withColumn("__beaten", F.lit(True))
    return marked.join(beaten, id, "left").where("__low OR __beaten").select(*introns.columns)


def flank_ratio(introns: DataFrame, depth: DataFrame, group: Sequence[str], id: str, bin: int = 10_000) -> DataFrame:
    """(id, ratio): mean depth inside an intron over the mean of the positions right beside it; null where neither has any."""
    inside = range_join(introns.select(*group, id, "lo", "hi"), depth.select(*group, "lo", "hi", "depth"), group, bin=bin)
    sums = inside.groupBy(id).agg(F.sum((F.least("hi", "hi_r") - F.greatest("lo", "lo_r")) * F.col("depth_r")).alias("__in"))
    flanks = introns.select(*group, id, F.explode(F.array(F.struct((F.col("lo") - 1).alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("hi").alias("lo"), (F.col("hi") + 1).alias("hi")))).alias("f")).select(*group, id, "f.lo", "f.hi")
    beside = range_join(flanks, depth.select(*group, "lo", "hi", "depth"), group, bin=bin).groupBy(id).agg((F.sum("depth_r") / 2).alias("__out"))
    return introns.join(sums, id, "left").join(beside, id, "left").select(id, F.try_divide(F.coalesce("__in", F.lit(0)) / (F.col("hi") - F.col("lo")), "__out").alias("ratio"))


def pre_mrna(fragments: DataFrame, introns: DataFrame, depth: DataFrame, group: Sequence[str], id: str, intron_id: str, fraction: float = PRE_MRNA_FRACTION, bin: int = 10_000) -> DataFrame:
    """Fragments that lie wholly inside an intron whose own depth is below fraction of that of its flanks."""
    weak = introns.join(flank_ratio(introns, depth, group, intron_id, bin).where((F.col("ratio") < fraction) & (F.col("ratio") > 0)), intron_id, "left_semi")
    pairs = range_join(fragments.select(*group, id, "lo", "hi"), weak.select(*group, "lo", "hi"), group, bin=bin)
    return fragments.join(pairs.where("lo_r <= lo AND hi <= hi_r").select(id).distinct(), id, "left_semi")


def junk_models(models: DataFrame, group: Sequence[str], fpkm: str, multi_share: str | None = None, fragments: str | None = None, fraction: float = ISOFORM_FRACTION) -> DataFrame:
    """Models with less than fraction of their group's largest FPKM, with too many multi-mapping or too few fragments."""
    top = F.max(fpkm).over(Window.partitionBy(*group))
    junk = (F.col(fpkm) < fraction * top) | (F.col(fpkm) == 0)
    if multi_share is not None:
        junk |= F.col(multi_share) > MULTI_FRACTION
    if fragments is not None:
        junk |= F.col(fragments) < LEAST_FRAGMENTS
    return models.withColumn("__junk", junk).where("__junk").drop("__junk")


def depth_along(exons: DataFrame, reads: DataFrame, group: Sequence[str], id: str, weight: Column | None = None, bin: int = 10_000) -> DataFrame:
    """(id, mean_depth, min_depth) of models from exons(group, id, lo, hi) and reads(group, lo, hi); uncovered positions count as 0."""
    runs = coverage(reads, group, weight=weight)
    shared = range_join(exons.select(*group, id, "lo", "hi"), runs, group, bin=bin).withColumn("__n", F.least("hi", "hi_r") - F.greatest("lo", "lo_r"))
    sums = shared.groupBy(id).agg(F.sum(F.col("__n") * F.col("depth_r")).alias("__s"), F.sum("__n").alias("__c"), F.min("depth_r").alias("__m"))
    sizes = exons.groupBy(id).agg(F.sum(F.col("hi") - F.col("lo")).alias("__all"))
    return sizes.join(sums, id, "left").select(id, (F.coalesce("__s", F.lit(0)) / F.col("__all")).alias("mean_depth"), F.when(F.coalesce("__c", F.lit(0)) < F.col("__all"), 0).otherwise(F.col("__m")).alias("min_depth"))


def three_prime_cut(bins: DataFrame, group: Sequence[str], at: str, depth: str) -> DataFrame:
    """(group, cut, drop): where a depth that is split in two by position has the least squared error, and the ratio of its means.

    Every split comes from prefix sums in one ordered pass.
    """
    w = Window.partitionBy(*group)
    run = w.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    y = F.col(depth).cast("double")
    sums = bins.withColumns({"__n": F.count("*").over(run), "__s": F.sum(y).over(run), "__q": F.sum(y * y).over(run), "__n_all": F.count("*").over(w), "__s_all": F.sum(y).over(w), "__q_all": F.sum(y * y).over(w)}).where("__n < __n_all")
    rest = F.col("__n_all") - F.col("__n")
    left, right = F.col("__s") / F.col("__n"), (F.col("__s_all") - F.col("__s")) / rest
    error = F.col("__q_all") - F.col("__s") * left - (F.col("__s_all") - F.col("__s")) * right
    best = sums.groupBy(*group).agg(F.min(F.struct(F.round(error, 9).alias("e"), F.col(at).alias("cut"), F.try_divide(right, left).alias("drop"))).alias("b"))
    return best.select(*group, "b.cut", "b.drop")


def projected(exons: Column, position: Column) -> Column:
    """The place (from 0) of a genomic position in the joined exons (lo, hi), half-open; null in introns and outside."""
    def step(s, e):
        inside = (position >= e["lo"]) & (position < e["hi"])
        return F.struct((s["before"] + e["hi"] - e["lo"]).cast("long").alias("before"), F.when(inside, s["before"] + position - e["lo"]).otherwise(s["at"]).cast("long").alias("at"))

    return F.aggregate(exons, F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("at")), step)["at"]


def tiled(models: DataFrame, length: str, size: int = 405, step: int = 15) -> DataFrame:
    """models with tile_lo and tile_hi: pieces of size every step along the model, the last one at its end; shorter models are one."""
    n = F.greatest(F.lit(0), F.col(length) - size)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), n.cast("long"), F.lit(step).cast("long")), F.array(n.cast("long"))))
    return models.withColumn("tile_lo", F.explode(starts)).withColumn("tile_hi", F.least(F.col("tile_lo") + size, F.col(length).cast("long")))

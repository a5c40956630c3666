"""Scale factors between libraries over a long table (locus, library, count), and counts on the common scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, library: str, value: str, place) -> DataFrame:
    """The value at an index (from 0) of each library's sorted values. Ties don't matter: equal values."""
    w = Window.partitionBy(library)
    ranked = df.withColumns({"__n": F.row_number().over(w.orderBy(value)), "__all": F.count("*").over(w)})
    return ranked.where(F.col("__n") == F.floor(place(F.col("__all"))) + 1).select(library, F.col(value).alias("__at"))


def complete(counts: DataFrame, locus: str, library: str, count: str) -> DataFrame:
    """A row for each locus and library, absent ones 0. The libraries are few and come from the data."""
    libraries = counts.select(library).distinct()
    return counts.select(locus).distinct().crossJoin(F.broadcast(libraries)).join(counts, [locus, library], "left").withColumn(count, F.coalesce(count, F.lit(0)))


def geometric(counts: DataFrame, locus: str, library: str, count: str) -> DataFrame:
    """exp of the upper median of log count minus the locus's mean log count, over loci with counts in every library."""
    n = counts.agg(F.countDistinct(library).alias("__n"))
    w = Window.partitionBy(locus)
    positive = counts.where(F.col(count) > 0).withColumns({"__have": F.count("*").over(w), "__mean": F.avg(F.log(count)).over(w)})
    ratios = positive.crossJoin(F.broadcast(n)).where("__have = __n").withColumn("__r", F.round(F.log(count) - F.col("__mean"), 12))
    return _ranked(ratios, library, "__r", lambda x: x / 2).select(library, F.exp("__at").alias("factor"))


def classic(counts: DataFrame, library: str, count: str) -> DataFrame:
    """A library's total over the mean total."""
    sums = counts.groupBy(library).agg(F.sum(count).alias("__t"))
    return sums.crossJoin(F.broadcast(sums.agg(F.avg("__t").alias("__m")))).select(library, F.try_divide("__t", "__m").alias("factor"))


def quartile(counts: DataFrame, library: str, count: str) -> DataFrame:
    """A library's upper quartile (index three quarters of n, rounded down) over the mean of these."""
    upper = _ranked(counts, library, count, lambda x: x * 0.75)
    return upper.crossJoin(F.broadcast(upper.agg(F.avg("__at").alias("__m")))).select(library, F.try_divide("__at", "__m").alias("factor"))


def standards_only(counts: DataFrame, standards: DataFrame, locus: str) -> DataFrame:
    """Counts of the loci that normalization is restricted to."""
    return counts.join(standards, locus, "left_semi")


def common_scale(counts: DataFrame, factors: DataFrame, library: str, count: str) -> DataFrame:
    """counts with scaled = count / factor. The factors are one row a library."""
    return counts.join(F.broadcast(factors), library).withColumn("scaled", F.try_divide(count, "factor"))


def means_and_variances(counts: DataFrame, locus: str, value: str, as_published: bool = False) -> DataFrame:
    """(locus, mean, variance): sample variance; as_published: population variance times n / (n - 1) in whole numbers."""
    n = F.count(value)
    population = F.var_pop(value)
    return counts.groupBy(locus).agg(F.avg(value).alias("mean"), (population * F.expr(f"coalesce(count({value}) div nullif(count({value}) - 1, 0), 0)") if as_published else F.when(n > 1, F.var_samp(value))).alias("variance"))

"""Variance models of counts: a local regression of variance on log mean, look-ups in it, and assignment uncertainty."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import importable_on_workers

#: Loci that a fit needs, and points that go into one: above these, loci are averaged in bins of log mean first.
LEAST_LOCI, GRID_STEP, BANDWIDTH = 30, 0.2, 0.7


def local_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, share: float = BANDWIDTH) -> np.ndarray:
    """Weighted local-linear fit of log y on x at some places: tricube weights over the nearest share of the points."""
    k = max(2, int(np.ceil(share * len(x))))
    out = np.empty(len(at))
    for i, p in enumerate(at):
        d = np.abs(x - p)
        reach = max(np.sort(d)[min(k, len(d)) - 1], 1e-9)
        w = weight * np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        if w.sum() <= 0:
            w = weight * (d == d.min())
        mx, my = np.average(x, weights=w), np.average(np.log(y), weights=w)
        sxx = (w * (x - mx) ** 2).sum()
        slope = (w * (x - mx) * (np.log(y) - my)).sum() / sxx if sxx > 1e-12 else 0.0
        out[i] = np.exp(my + slope * (p - mx))
    return out


def fitted(moments: DataFrame, group: str, mean: str, variance: str) -> DataFrame:
    """(group, mean, variance): the variance model on a grid of log mean, never below the mean (Poisson).

    Loci are averaged in bins of log mean before they meet (combined in the aggregate), so a group's task holds a few hundred
    bins whatever the number of loci. Groups with fewer than LEAST_LOCI usable loci are Poisson.
    """
    importable_on_workers(moments.sparkSession)
    usable = moments.where((F.col(mean) > 0) & (F.col(variance) > 0)).withColumn("__bin", F.floor(F.log(mean) / (GRID_STEP / 4)))
    bins = usable.groupBy(F.col(group).cast("string").alias("grp"), "__bin").agg(F.avg(F.log(mean)).alias("x"), F.avg(variance).alias("y"), F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        grid = np.arange(np.floor(pdf.x.min() / GRID_STEP), np.ceil(pdf.x.max() / GRID_STEP) + 1) * GRID_STEP
        means = np.exp(grid)
        var = local_linear(pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.n.to_numpy(float), grid) if pdf.n.sum() >= LEAST_LOCI else means
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "mean": means, "variance": np.maximum(var, means)})

    return bins.groupBy("grp").applyInPandas(fit, "grp string, mean double, variance double").withColumnRenamed("grp", group)


def pooled(models: DataFrame, replicates: DataFrame, group: str) -> DataFrame:
    """(mean, variance): the groups' models averaged on their common grid, weighted by replicates(group, n)."""
    w = models.join(F.broadcast(replicates), group)
    return w.groupBy(F.round(F.log("mean"), 6).alias("__x")).agg(F.avg("mean").alias("mean"), (F.sum(F.col("variance") * F.col("n")) / F.sum("n")).alias("variance")).drop("__x")


def looked_up(points: DataFrame, model: DataFrame, group: Sequence[str], mean: str) -> DataFrame:
    """points with variance: piecewise linear in the model(group, mean, variance), carried on beyond its ends, not below the mean.

    A group's model is one array in order, which every task gets; a point finds its place in it by halving and stays where it is.
    """
    keys = {c: f"__key_{i}" for i, c in enumerate(group)}
    knot = F.struct(F.col("mean").cast("double").alias("x"), F.col("variance").cast("double").alias("y"))
    knots = model.where("mean IS NOT NULL").groupBy(*(F.col(c).alias(k) for c, k in keys.items())).agg(F.array_sort(F.collect_list(knot)).alias("__k"))
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()))
    placed = points.withColumn("__x", F.col(mean).cast("double")).join(F.broadcast(knots), same, "left")
    n, x = F.size("__k"), F.col("__x")

    def halve(s: Column, _: Column) -> Column:
        half = F.shiftright(s["lo"] + s["hi"], 1)
        above = F.get("__k", half)["x"] <= x
        # Once lo is hi, the place is found.
        return F.when(s["lo"] == s["hi"], s).when(above, F.struct((half + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half.alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    found = placed.withColumn("__at", F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"])
    # The two knots at either end stand in for brackets beyond them.
    b = F.greatest(F.lit(0), F.least(F.greatest(F.col("__at"), F.lit(1)), n - 1))
    ends = found.withColumns({"__a": F.get("__k", F.greatest(F.lit(0), b - 1)), "__b": F.get("__k", b)})
    width = F.col("__b.x") - F.col("__a.x")
    y = F.when(width > 0, F.col("__a.y") + (x - F.col("__a.x")) * (F.col("__b.y") - F.col("__a.y")) / width).otherwise(F.col("__a.y"))
    return ends.withColumn("variance", F.greatest(x, F.coalesce(y, x))).select(*points.columns, "variance")


def count_covariance(gammas: DataFrame, locus: str, model: str, gamma: str, total: str, variance: str, draws: int = 100, assignments: int = 50, seed: int = 0) -> DataFrame:
    """(locus, model, other, covariance) of models' counts: fragments drawn with the locus's variance, each draw dealt out
    so many times by the gammas. uncertainty.count_covariance is what it tends to.

    Streams depend on the seed and the locus alone.
    """
    importable_on_workers(gammas.sparkSession)
    narrow = gammas.select(F.col(locus).cast("string").alias("locus"), F.col(model).cast("string").alias("model"), F.col(gamma).cast("double").alias("g"), F.col(total).cast("double").alias("t"), F.col(variance).cast("double").alias("v"), F.xxhash64(F.col(locus).cast("string")).alias("h"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("model")
        h = int(pdf.h.iloc[0])
        rng = np.random.default_rng([seed, h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF])
        t, v = float(pdf.t.iloc[0]), float(pdf.v.iloc[0])
        p = pdf.g.to_numpy() / max(pdf.g.sum(), 1e-300)
        rate = rng.gamma(t * t / (v - t), (v - t) / t, draws) if t > 0 and v > t * (1 + 1e-9) else np.full(draws, max(t, 0.0))
        n = np.repeat(rng.poisson(rate), assignments)
        dealt = rng.multinomial(n, p / p.sum()) if p.sum() > 0 else np.zeros((draws, len(p)))
        cov = np.cov(dealt, rowvar=False).reshape(len(p), len(p))
        i, j = np.indices(cov.shape)
        names = pdf.model.to_numpy()
        return pd.DataFrame({"locus": pdf.locus.iloc[0], "model": names[i.ravel()], "other": names[j.ravel()], "covariance": cov.ravel()})

    return narrow.groupBy("locus").applyInPandas(solve, "locus string, model string, other string, covariance double")

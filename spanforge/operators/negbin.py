"""Negative-binomial counts: likelihoods, fits by Newton's method on value counts, and the correction of few replicates' variation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import importable_on_workers

#: Sizes above which a negative binomial is Poisson for all purposes.
MOST_SIZE = 1e8
#: True squared variations that the correction is simulated at: from, to, how many, evenly in logs.
CURVE = (2e-4, 100.0, 72)


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma, for positive x: recurrence up to 8, then its asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132)))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """The derivative of digamma, in the same way."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] += 1 / (x[low] * x[low])
        x[low] += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * (5 / 66)))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive x, in the same way."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + np.log(2 * np.pi) / 2 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680)))) / x


def log_likelihood(value: np.ndarray, mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of counts under a negative binomial of a mean and a size; an infinite size is Poisson."""
    m = np.maximum(mean, 1e-300)
    poisson = value * np.log(m) - mean - log_gamma(value + 1.0)
    r = np.where(np.isfinite(size), size, 1.0)
    other = log_gamma(value + r) - log_gamma(r) - log_gamma(value + 1.0) - r * np.log1p(m / r) + value * (np.log(m) - np.log(r + m))
    return np.where(np.isfinite(size), other, poisson)


def fit_sizes(group: np.ndarray, value: np.ndarray, n: np.ndarray, groups: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(mean, size) of the likeliest negative binomial of each group; value occurs n times in group. Size inf: Poisson.

    All groups go side by side: Newton steps in the log of the size, halved into the bracket of the root where they leave it.
    """
    total = np.bincount(group, weights=n, minlength=groups)
    mean = np.bincount(group, weights=n * value, minlength=groups) / np.maximum(total, 1)
    spread = np.bincount(group, weights=n * (value - mean[group]) ** 2, minlength=groups) / np.maximum(total, 1)
    size = np.full(groups, np.inf)
    live = np.flatnonzero((spread > mean * (1 + 1e-12)) & (mean > 0))
    if not len(live):
        return mean, size
    place = np.full(groups, -1)
    place[live] = np.arange(len(live))
    used = place[group] >= 0
    g, v, w = place[group[used]], value[used].astype(float), n[used].astype(float)
    m, t = mean[live], total[live]
    x = np.log(np.clip(m * m / (spread[live] - m), 1e-6, MOST_SIZE))
    low, high = np.full(len(live), np.log(1e-8)), np.full(len(live), np.log(MOST_SIZE))
    for _ in range(rounds):
        r = np.exp(x)
        slope = np.bincount(g, weights=w * digamma(v + r[g]), minlength=len(live)) - t * (digamma(r) + np.log1p(m / r))
        bend = np.bincount(g, weights=w * trigamma(v + r[g]), minlength=len(live)) - t * (trigamma(r) - m / (r * (r + m)))
        # The likelihood rises with the size as long as its slope is above 0.
        low, high = np.where(slope > 0, x, low), np.where(slope > 0, high, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = x - slope * r / (bend * r * r + slope * r)
        new = np.where(np.isfinite(step) & (step > low) & (step < high), step, (low + high) / 2)
        done = np.abs(new - x) < 1e-12
        x = new
        if done.all():
            break
    r = np.exp(x)
    size[live] = np.where(r < MOST_SIZE / 2, r, np.inf)
    return mean, size


def fits(df: DataFrame, group: Sequence[str], count: str) -> DataFrame:
    """(group, n, mean, size, dispersion, log_likelihood, poisson_log_likelihood) of each group's counts.

    Equal counts of a group are one row before they meet: a task holds a group's different values. Nulls don't count;
    a group whose variance isn't above its mean is Poisson: size null, dispersion 0.
    """
    importable_on_workers(df.sparkSession)
    values = df.where(F.col(count).isNotNull()).groupBy(*group, F.col(count).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    lists = values.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__v", "__n"))).alias("__x"))
    flat = lists.select(*group, F.col("__x.__v").alias("__v"), F.col("__x.__n").alias("__n"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.select(*group).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = len(pdf)
            at = np.repeat(np.arange(k), pdf["__v"].map(len).to_numpy()) if k else np.zeros(0, int)
            v, n = (np.concatenate([np.asarray(x, float) for x in pdf[c]]) if k else np.zeros(0) for c in ("__v", "__n"))
            mean, size = fit_sizes(at, v, n, k)
            sums = [np.bincount(at, weights=n * log_likelihood(v, mean[at], s[at]), minlength=k) for s in (size, np.full(k, np.inf))]
            finite = np.isfinite(size)
            yield pdf[list(group)].assign(n=np.bincount(at, weights=n, minlength=k).astype(np.int64), mean=mean, size=pd.Series(np.where(finite, size, np.nan)).astype(object).where(finite, None).to_numpy(), dispersion=np.where(finite, 1 / size, 0.0), log_likelihood=sums[0], poisson_log_likelihood=sums[1])

    return flat.mapInPandas(run, f"{kinds}, n long, mean double, size double, dispersion double, log_likelihood double, poisson_log_likelihood double")


def scv_curve(spark: SparkSession, replicates: int, genes: int = 10_000, mean: float = 100_000.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(observed, true): what squared variation replicates of a count show on average, and what it is; both rise.

    Simulated in the cluster's tasks, a stretch of genes of one variation each; what comes back is one number for each variation.
    """
    importable_on_workers(spark)
    low, high, n = CURVE
    true = np.geomspace(low, high, n)
    stretch = 1000
    rows = spark.range(0, n * -(-genes // stretch), 1, 8).select((F.col("id") % n).alias("k"), F.floor(F.col("id") / n).alias("part"))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, part in zip(pdf.k.tolist(), pdf.part.tolist(), strict=True):
                rng = np.random.default_rng([seed, replicates, k, part])
                many = min(stretch, genes - part * stretch)
                drawn = rng.poisson(rng.gamma(1 / true[k], mean * true[k], (many, replicates))).astype(float)
                centre = drawn.mean(axis=1)
                some = centre > 0
                out.append((k, int(some.sum()), float((drawn[some].var(axis=1, ddof=1) / centre[some] ** 2).sum())))
            yield pd.DataFrame(out, columns=["k", "n", "s"])

    found = rows.mapInPandas(simulate, "k long, n long, s double").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("scv")).orderBy("k").collect()
    observed = np.maximum.accumulate(np.array([r.scv for r in found]))
    return np.concatenate([[0.0], observed]), np.concatenate([[0.0], true])


def corrected(moments: DataFrame, curve: tuple[np.ndarray, np.ndarray], mean: str = "mean", variance: str = "variance") -> DataFrame:
    """moments with the variance that its excess over the mean stands for: mean + true squared variation * mean ** 2.

    A few replicates show less variation than there is, the less so the more there is: the curve says how much. What is
    above its end stays there; variances that aren't above the mean stay as they are.
    """
    importable_on_workers(moments.sparkSession)
    observed, true = curve

    @F.pandas_udf("double")
    def look_up(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x.to_numpy(float), observed, true))

    m, v = F.col(mean), F.col(variance)
    excess = (m > 0) & (v > m)
    return moments.withColumn(variance, F.when(excess, m + look_up(F.when(excess, (v - m) / (m * m)).otherwise(0.0)) * m * m).otherwise(v))

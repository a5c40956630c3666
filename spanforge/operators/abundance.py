"""Abundance: length distributions, effective lengths, FPKM, within-group shares, mixtures by expectation maximization."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import importable_on_workers

#: Fewer fragments than this give no length distribution of their own; a truncated normal stands in.
LEAST_FRAGMENTS = 10_000
MEAN, SD = 200, 80


def length_distribution(df: DataFrame, library: str, length: str) -> DataFrame:
    """(library, len, pdf, cdf) from the observed lengths. The windows run over distinct lengths, which are few."""
    counts = df.groupBy(library, F.col(length).alias("len")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(library)
    run = F.sum("__n").over(w.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"__all": F.sum("__n").over(w), "__run": run}).select(library, "len", (F.col("__n") / F.col("__all")).alias("pdf"), (F.col("__run") / F.col("__all")).alias("cdf"))


def normal_lengths(mean: float = MEAN, sd: float = SD, most: int | None = None) -> list[tuple[int, float, float]]:
    """(len, pdf, cdf) of a normal cut off at 1 and at mean + 3 sd."""
    most = int(mean + 3 * sd) if most is None else most
    x = np.arange(1, most + 1)
    pdf = np.exp(-((x - mean) ** 2) / (2 * sd * sd))
    pdf /= pdf.sum()
    return list(zip(x.tolist(), pdf.tolist(), np.cumsum(pdf).tolist(), strict=True))


def effective_lengths(models: DataFrame, distribution: DataFrame, id: str, length: str, library: str) -> DataFrame:
    """(id, library, effective_length): the sum over fragment lengths l of pdf(l) * (length - l + 1).

    Distinct model lengths meet the distribution, not models: running sums of pdf and l * pdf give each in one look-up.
    """
    w = Window.partitionBy(library).orderBy("len")
    sums = distribution.select(library, "len", F.sum("pdf").over(w).alias("__p"), F.sum(F.col("len") * F.col("pdf")).over(w).alias("__lp"), F.lead("len").over(w).alias("__next"))
    lengths = models.select(F.col(length).alias("__length")).distinct()
    inside = (F.col("len") <= F.col("__length")) & (F.col("__next").isNull() | (F.col("__length") < F.col("__next")))
    found = lengths.join(F.broadcast(sums), inside).select(library, "__length", ((F.col("__length") + 1) * F.col("__p") - F.col("__lp")).alias("effective_length"))
    return models.join(found, F.col(length) == F.col("__length")).select(id, library, "effective_length")


def fpkm(count: Column, length: Column, mass: Column) -> Column:
    """Fragments per thousand bases of model and million fragments of library; 0 where there is no length or mass."""
    return F.when((length > 0) & (mass > 0), count * 1e9 / (length * mass)).otherwise(0.0)


def confidence(mean: Column, sd: Column) -> tuple[Column, Column]:
    """Two deviations to each side, not below 0."""
    return F.greatest(F.lit(0.0), mean - 2 * sd), mean + 2 * sd


def shares(df: DataFrame, group: Sequence[str], value: str, name: str = "kappa") -> DataFrame:
    """df with each row's share of its group's sum; 0 where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumn(name, F.when(total == 0, 0.0).otherwise(F.col(value) / total))


def em_sparse(row: np.ndarray, model: np.ndarray, p: np.ndarray, mass: np.ndarray, n: int, most: int = 5000, tolerance: float = 1e-5) -> tuple[np.ndarray, float, int, bool]:
    """Weights of a mixture of n models, log likelihood, rounds, whether it settled.

    row, model, p: the entries of the likelihood matrix that aren't 0; mass: of each row. Rows without entries don't count.
    """
    live = np.bincount(row, weights=p, minlength=len(mass)) > 0
    mass = np.where(live, mass, 0.0)
    if not mass.sum() or not n:
        return np.zeros(n), 0.0, 0, True
    gamma, before = np.full(n, 1 / n), -np.inf
    for k in range(1, most + 1):
        part = p * gamma[model]
        total = np.maximum(np.bincount(row, weights=part, minlength=len(mass)), 1e-300)
        likelihood = float((mass * np.log(np.where(live, total, 1.0))).sum())
        gamma = np.bincount(model, weights=part * (mass / total)[row], minlength=n) / mass.sum()
        if k > 3 and abs(likelihood - before) <= tolerance:
            return gamma, likelihood, k, True
        before = likelihood
    return gamma, before, most, False


def em(compat: np.ndarray, mass: np.ndarray, most: int = 5000, tolerance: float = 1e-5) -> tuple[np.ndarray, float, int, bool]:
    """em_sparse of a matrix (rows: fragments with their mass, columns: models)."""
    row, model = np.nonzero(compat > 0)
    return em_sparse(row, model, compat[row, model], mass, compat.shape[1], most, tolerance)


def identifiable(row: np.ndarray, model: np.ndarray, p: np.ndarray, n_rows: int, n: int) -> bool:
    """Whether the columns are independent: the rank of what their products are, summed in stretches of rows.

    A row with one model fixes that model's weight, and then counts for its row's others alone: only models that
    nothing fixes in this way have to be held as a matrix.
    """
    some = p != 0
    row, model, p, free = row[some], model[some], p[some], np.ones(n, bool)
    while len(row):
        fixed = np.unique(model[np.bincount(row, minlength=n_rows)[row] == 1])
        if not len(fixed):
            break
        free[fixed] = False
        left = free[model]
        row, model, p = row[left], model[left], p[left]
    model, n = (np.cumsum(free) - 1)[model], int(free.sum())
    gram = np.zeros((n, n))
    most = np.maximum(np.bincount(model, weights=p * p, minlength=n), 1e-300) ** 0.5
    for first in range(0, n_rows, 4096):
        some = (row >= first) & (row < first + 4096)
        part = np.zeros((min(4096, n_rows - first), n))
        part[row[some] - first, model[some]] = p[some] / most[model[some]]
        gram += part.T @ part
    return bool(np.linalg.eigvalsh(gram)[0] > 1e-11 * n) if n else True


def mixtures(df: DataFrame, locus: str, fragment: str, model: str, probability: str, mass: str, least_fraction: float = 0.0) -> DataFrame:
    """(locus, model, gamma, converged, identifiable) by EM in each locus.

    df has a row for each compatible fragment and model. Fragments with equal probabilities for the same models are one
    before a locus reaches its task, which holds the entries of the distinct rows and no matrix of them. Weights below
    least_fraction become 0, and what they held goes to the rest in equal parts.
    """
    importable_on_workers(df.sparkSession)
    rows = df.groupBy(locus, fragment).agg(F.array_sort(F.collect_list(F.struct(F.col(model).cast("string").alias("m"), F.col(probability).cast("double").alias("p")))).alias("row"), F.max(F.col(mass).cast("double")).alias("mass"))
    # What a fragment of one model says doesn't depend on its probability: there is one such row for a model.
    single = (F.size("row") == 1) & (F.get("row", F.lit(0))["p"] > 0)
    rows = rows.withColumn("row", F.when(single, F.transform("row", lambda x: F.struct(x["m"].alias("m"), F.lit(1.0).alias("p")))).otherwise(F.col("row")))
    classes = rows.groupBy(locus, "row").agg(F.sum("mass").alias("mass"))
    flat = classes.select(F.col(locus).cast("string").alias("locus"), F.transform("row", lambda x: x["m"]).alias("models"), F.transform("row", lambda x: x["p"]).alias("ps"), "mass")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (list(pdf.models.iloc[i]), list(pdf.ps.iloc[i])))
        pdf = pdf.iloc[order]
        names = sorted({m for row in pdf.models for m in row})
        at = {m: k for k, m in enumerate(names)}
        row = np.repeat(np.arange(len(pdf)), pdf.models.map(len).to_numpy())
        which, p = np.array([at[m] for r in pdf.models for m in r], np.int64), np.concatenate([np.asarray(x, float) for x in pdf.ps])
        gamma, _, _, settled = em_sparse(row, which, p, pdf.mass.to_numpy(), len(names))
        low = (gamma < least_fraction) & (gamma > 0)
        if low.any() and (gamma >= least_fraction).any():
            left = gamma >= least_fraction
            gamma = np.where(left, gamma + gamma[low].sum() / left.sum(), 0.0)
        known = identifiable(row, which, p, len(pdf), len(names))
        return pd.DataFrame({"locus": pdf.locus.iloc[0], "model": names, "gamma": gamma, "converged": settled, "identifiable": known})

    return flat.groupBy("locus").applyInPandas(solve, "locus string, model string, gamma double, converged boolean, identifiable boolean")

"""Testing: false-discovery control, fold changes, divergences, resampled nulls, binomial tails."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import importable_on_workers


#: Ranges of p into which a pool is cut for ranking.
FDR_RANGES = 4096


def fdr(df: DataFrame, p: str = "p_value", status: str = "status", id: Sequence[str] = ("test_id",), by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """df with q_value and significant, by Benjamini and Hochberg over the rows with status OK (one pool, or one for each by).

    q is the least p * n / rank of this or any greater p, at most 1. Other rows have no q. Ranks and minima are made inside
    ranges of p and carried over from range to range, so that no task orders a whole pool; only the table of ranges is
    ordered in one place.
    """
    ok = df.where((F.col(status) == "OK") & F.col(p).isNotNull())
    levels = ok.groupBy(*by, p).agg(F.count("*").alias("__n")).withColumn("__range", F.floor(F.col(p) * FDR_RANGES))
    keys = [*by, "__range"]
    along = Window.partitionBy(*by).orderBy("__range") if by else Window.orderBy("__range")
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    sizes = levels.groupBy(*keys).agg(F.sum("__n").alias("__s"))
    sizes = sizes.select(*keys, F.coalesce(F.sum("__s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(whole).alias("__all"))
    inside = Window.partitionBy(*keys).orderBy(p)
    ranked = levels.join(sizes, keys).withColumn("__rank", F.col("__before") + F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("__all") / F.col("__rank"))
    later = ranked.groupBy(*keys).agg(F.min("__raw").alias("__m"))
    later = later.select(*keys, F.min("__m").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    q = F.least(F.lit(1.0), F.min("__raw").over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("__later"))
    found = ok.join(ranked.join(later, keys).withColumn("q_value", q).select(*by, p, "q_value"), [*by, p])
    rest = df.where(~((F.col(status) == "OK") & F.col(p).isNotNull()) | F.col(status).isNull()).withColumn("q_value", F.lit(None).cast("double"))
    return found.select(*df.columns, "q_value").unionByName(rest).withColumn("significant", F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def log2_fold_change(a: Column, b: Column) -> Column:
    """log2(b / a): 0 where both are 0, plus or minus infinity where one is."""
    inf = F.lit(float("inf"))
    return F.when((a == 0) & (b == 0), 0.0).when(a == 0, inf).when(b == 0, -inf).otherwise(F.log2(b / a))


def test_status(a: Column, b: Column, enough: Column) -> Column:
    """Status of a test from those of its two sides: FAIL, HIDATA, LOWDATA, then NOTEST without enough evidence, else OK."""
    def either(x: str) -> Column:
        return (a == x) | (b == x)

    return F.when(either("FAIL"), "FAIL").when(either("HIDATA"), "HIDATA").when(either("LOWDATA"), "LOWDATA").when(~enough, "NOTEST").otherwise("OK")


def _entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def js_distance(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """(group, js): square root of the Jensen-Shannon divergence (natural log) of two non-negative columns, each scaled to sum 1."""
    sums = df.groupBy(*group).agg(F.sum(a).alias("__a"), F.sum(b).alias("__b"))
    pq = df.join(sums, list(group)).where("__a > 0 AND __b > 0").select(*group, (F.col(a) / F.col("__a")).alias("p"), (F.col(b) / F.col("__b")).alias("q"))
    p, q = F.col("p"), F.col("q")
    divergence = F.sum(_entropy_term((p + q) / 2) - (_entropy_term(p) + _entropy_term(q)) / 2)
    return pq.groupBy(*group).agg(F.sqrt(F.greatest(F.lit(0.0), divergence)).alias("js"))


def member_shares(members: DataFrame, group: Sequence[str], member: str, condition: str, value: str) -> DataFrame:
    """(group, condition, member, mean, share, replicates): means over replicates of each member's value, 0 for a member that a
    condition lacks, and its share of the group's (0 where the group has nothing)."""
    replicates = members.groupBy(*group, condition, member).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    every = members.select(*group, member).distinct().join(members.select(*group, condition).distinct(), list(group))
    full = every.join(replicates, [*group, condition, member], "left").withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})
    whole = Window.partitionBy(*group, condition)
    return full.select(*group, condition, member, "mean", F.coalesce(F.try_divide("mean", F.sum("mean").over(whole)), F.lit(0.0)).alias("share"), F.max("n").over(whole).alias("replicates"))


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p and q."""
    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0).sum(axis=-1)

    return np.sqrt(np.maximum(0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))


def _null_tail(js: float, sides: list[tuple[np.ndarray, np.ndarray]], replicates: tuple[int, int], draws: int, rng: np.random.Generator) -> float:
    """Share of null distances above js: both halves of a pair are means of as many draws as there are replicates, from one side."""
    above = 0
    for mean, variance in sides:
        scale = np.divide(variance, mean, out=np.zeros_like(mean), where=mean > 0)
        shape = np.divide(mean, scale, out=np.zeros_like(mean), where=scale > 0)
        # In blocks, so that memory follows the members and not the draws.
        for first in range(0, draws, 1000):
            n = min(1000, draws - first)
            halves = []
            for k in replicates:
                drawn = np.where(shape > 0, rng.gamma(np.where(shape > 0, shape, 1), np.where(shape > 0, scale, 1), (n, max(1, k), len(mean))), mean).mean(axis=1)
                total = drawn.sum(axis=1, keepdims=True)
                halves.append(np.divide(drawn, total, out=np.zeros_like(drawn), where=total > 0))
            above += int((_divergences(*halves) > js).sum())
    return max(1, above) / (len(sides) * draws)


def split_tests(members: DataFrame, contrasts: DataFrame, group: Sequence[str], member: str, condition: str = "condition", value: str = "value", variance: str = "variance", status: str = "status", least_replicates: int = 3, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(group, condition_1, condition_2, js, p_value, status): tests of how a group's value is split among its members.

    With transcripts of a start site as members this is a test of splicing, with the start sites of a gene one of promoter use,
    with its proteins one of coding output. members has a row for each replicate; variance is that of a member's value. The
    statistic is the Jensen-Shannon distance of the two conditions' mean shares. Its null holds pairs of means drawn from
    one condition alone, half from each. Members with a status other than OK make a group FAIL or LOWDATA; groups of one
    member, without value or without a difference are NOTEST, as are those of fewer replicates than least_replicates.
    The draws depend on the seed and the group, not on partitions.
    """
    importable_on_workers(members.sparkSession)
    shares = member_shares(members, group, member, condition, value)
    spread = members.groupBy(*group, condition, member).agg(F.max(variance).alias("spread"), F.max(F.when(F.col(status) == "FAIL", 2).when(F.col(status) != "OK", 1).otherwise(0)).alias("bad"))
    sides = shares.join(spread, [*group, condition, member], "left").groupBy(*group, condition).agg(
        F.array_sort(F.collect_list(F.struct(F.col(member).cast("string").alias("m"), F.col("share").alias("s"), F.col("mean").alias("v"), F.coalesce("spread", F.lit(0.0)).alias("w")))).alias("x"),
        F.max("replicates").alias("n"), F.max("bad").alias("bad"), F.sum("mean").alias("total"),
    )
    side = lambda k: sides.select(*group, F.col(condition).alias(f"condition_{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("x", "n", "bad", "total")))
    pairs = side(1).join(F.broadcast(contrasts.select("condition_1", "condition_2")), "condition_1").join(side(2), [*group, "condition_2"])
    p, q = F.transform("x1", lambda e: e["s"]), F.transform("x2", lambda e: e["s"])
    entropy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x > 0, -x * F.log(x)).otherwise(0.0))
    middle = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    js = F.sqrt(F.greatest(F.lit(0.0), entropy(middle) - (entropy(p) + entropy(q)) / 2))
    worst = F.greatest(F.coalesce("bad1", F.lit(0)), F.coalesce("bad2", F.lit(0)))
    empty = (F.size("x1") < 2) | (F.col("total1") <= 0) | (F.col("total2") <= 0)
    tests = pairs.withColumn("js", F.when(empty, 0.0).otherwise(js))
    verdict = F.when(empty, "NOTEST").when(worst == 2, "FAIL").when(worst == 1, "LOWDATA").when((F.round("js", 12) == 0) | (F.least("n1", "n2") < least_replicates), "NOTEST").otherwise("OK")
    tests = tests.withColumn("status", verdict)

    @F.pandas_udf("double")
    def tail(key: pd.Series, js: pd.Series, v1: pd.Series, w1: pd.Series, n1: pd.Series, v2: pd.Series, w2: pd.Series, n2: pd.Series) -> pd.Series:
        out = []
        for k, d, a, s, m, b, t, n in zip(key, js, v1, w1, n1, v2, w2, n2, strict=True):
            rng = np.random.default_rng([seed, k & 0xFFFFFFFF, (k >> 32) & 0xFFFFFFFF])
            out.append(_null_tail(d, [(np.asarray(a, float), np.asarray(s, float)), (np.asarray(b, float), np.asarray(t, float))], (int(m), int(n)), draws, rng))
        return pd.Series(out, dtype=float)

    pick = lambda c, f: F.transform(c, lambda e: e[f])
    key = F.xxhash64(*(F.col(c).cast("string") for c in group), "condition_1", "condition_2")
    drawn = tests.where("status = 'OK'").repartition(members.sparkSession.sparkContext.defaultParallelism, *group).withColumn("p_value", tail(key, "js", pick("x1", "v"), pick("x1", "w"), "n1", pick("x2", "v"), pick("x2", "w"), "n2"))
    rest = tests.where("status <> 'OK'").withColumn("p_value", F.lit(1.0))
    return drawn.unionByName(rest).select(*group, "condition_1", "condition_2", "js", "p_value", "status")


def specificity(df: DataFrame, item: str, condition: str, value: str) -> DataFrame:
    """(item, condition, specificity): 1 - JS(the item's shares, all in this condition) / JS(two different single conditions)."""
    w = Window.partitionBy(item)
    p = F.col(value) / F.sum(value).over(w)
    shares = df.withColumn("__p", p).withColumn("__h", F.sum(_entropy_term(F.col("__p"))).over(w))
    own = F.col("__p")
    # Entropy of the mean of p and the unit vector: halves of all shares, and (1 + p) / 2 in place of p / 2.
    halves = F.sum(_entropy_term(own / 2)).over(w)
    mean = halves - _entropy_term(own / 2) + _entropy_term((own + 1) / 2)
    js = F.sqrt(F.greatest(F.lit(0.0), mean - F.col("__h") / 2))
    return shares.select(item, condition, (1 - js / np.sqrt(np.log(2))).alias("specificity"))


def binomial_upper_tail(n: pd.Series, k: pd.Series, p: float) -> pd.Series:
    """P(X >= k) for X binomial(n, p), summed in logs from exact log factorials."""
    n, k = n.to_numpy(np.int64), k.to_numpy(np.int64)
    top = int(n.max(initial=0))
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    out = np.empty(len(n))
    for i, (a, b) in enumerate(zip(n, k, strict=True)):
        j = np.arange(max(b, 0), a + 1)
        out[i] = np.exp(log_fact[a] - log_fact[j] - log_fact[a - j] + j * np.log(p) + (a - j) * np.log1p(-p)).sum() if b > 0 else 1.0
    return pd.Series(np.minimum(out, 1.0))


def bad_junctions(df: DataFrame, n: str, small: str, p: float, alpha: float = 0.001) -> DataFrame:
    """Rows in which so many of n reads have a small anchor that chance (p each) is less likely than alpha; with p_value."""
    importable_on_workers(df.sparkSession)
    tail = F.pandas_udf(lambda a, b: binomial_upper_tail(a, b, p), "double")
    return df.withColumn("p_value", tail(n, small)).where(F.col("p_value") < alpha)


def resampled_p(df: DataFrame, id: str, mean_a: str, var_a: str, mean_b: str, var_b: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(id, log2_fold_change, p_value): two-sided, from draws of the ratio under a null in which both sides share their mean.

    Counts are drawn as gamma-Poisson with the given variances (Poisson where these are not above the mean). Each row's stream
    depends on the seed and its id alone, so that partitioning doesn't matter. p is at least one over the number of draws.
    """
    importable_on_workers(df.sparkSession)
    narrow = df.select(F.col(id).cast("string").alias("id"), F.xxhash64(F.col(id).cast("string")).alias("h"), *(F.col(c).cast("double").alias(k) for k, c in (("ma", mean_a), ("va", var_a), ("mb", mean_b), ("vb", var_b))))

    def draw(rng: np.random.Generator, mean: float, var: float) -> np.ndarray:
        if mean <= 0:
            return np.zeros(draws)
        rate = rng.gamma(mean * mean / (var - mean), (var - mean) / mean, draws) if var > mean * (1 + 1e-9) else np.full(draws, mean)
        return rng.poisson(rate).astype(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            folds, ps = [], []
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, r.h & 0xFFFFFFFF, (r.h >> 32) & 0xFFFFFFFF])
                pooled = (r.ma + r.mb) / 2
                a, b = draw(rng, pooled, r.va), draw(rng, pooled, r.vb)
                with np.errstate(divide="ignore", invalid="ignore"):
                    null = np.where((a == 0) & (b == 0), 0.0, np.log2(b) - np.log2(a))
                    seen = 0.0 if r.ma == r.mb == 0 else float(np.log2(r.mb) - np.log2(r.ma))
                folds.append(seen)
                ps.append(max(1 / draws, float((np.abs(null) >= abs(seen)).mean())))
            yield pd.DataFrame({"id": pdf.id, "log2_fold_change": folds, "p_value": ps})

    # Rows are short and their draws long: as many tasks as there are cores, however few bytes they hold.
    dealt = narrow.repartition(df.sparkSession.sparkContext.defaultParallelism, "h")
    return dealt.mapInPandas(run, "id string, log2_fold_change double, p_value double").withColumnRenamed("id", id)

"""How sure counts and FPKM are: covariances as long tables, carried through sums and shares by quadratic forms; weights' posteriors.

A covariance table has rows (locus, model, other, covariance) for all ordered pairs of a locus's models, the diagonal included.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.abundance import em_sparse
from spanforge.session import importable_on_workers

#: Added to the diagonal of a Fisher matrix as a share of its mean, so that weights that can't be told apart have a wide posterior.
RIDGE = 1e-6
#: Share of the draws that come from all weights alike, so that no part of the posterior is out of reach.
EVEN = 0.2


def count_covariance(gammas: DataFrame, locus: str, model: str, gamma: str, total: str, variance: str, posterior: DataFrame | None = None) -> DataFrame:
    """(locus, model, other, covariance) of the counts that a locus's total gives its models.

    A total with this variance is dealt out by the weights as a multinomial; posterior(locus, model, other, covariance) of the
    weights adds what is not known of them. With t, v the total's mean and variance, g the weights and c their covariance:
    [same] t g + (v - t) g g' + (v + t t - t) c.
    """
    side = gammas.select(F.col(locus).alias("locus"), F.col(model).alias("model"), F.col(gamma).cast("double").alias("g"), F.col(total).cast("double").alias("t"), F.col(variance).cast("double").alias("v"))
    pairs = side.join(side.select("locus", F.col("model").alias("other"), F.col("g").alias("h")), "locus")
    c = F.lit(0.0)
    if posterior is not None:
        pairs = pairs.join(posterior.select(F.col(locus).alias("locus"), F.col(model).alias("model"), "other", F.col("covariance").alias("c")), ["locus", "model", "other"], "left")
        c = (F.col("v") + F.col("t") * F.col("t") - F.col("t")) * F.coalesce("c", F.lit(0.0))
    own = F.when(F.col("model") == F.col("other"), F.col("t") * F.col("g")).otherwise(0.0)
    return pairs.select(F.col("locus").alias(locus), F.col("model").alias(model), "other", (own + (F.col("v") - F.col("t")) * F.col("g") * F.col("h") + c).alias("covariance"))


def scaled(covariance: DataFrame, factors: DataFrame, keys: Sequence[str], model: str, factor: str) -> DataFrame:
    """covariance of what each model's count is multiplied by: from counts to FPKM. factors(keys, model, factor); none: 0."""
    mine = factors.select(*keys, model, F.col(factor).cast("double").alias("__a"))
    theirs = factors.select(*keys, F.col(model).alias("other"), F.col(factor).cast("double").alias("__b"))
    both = covariance.join(mine, [*keys, model]).join(theirs, [*keys, "other"])
    return both.select(*keys, model, "other", (F.col("covariance") * F.col("__a") * F.col("__b")).alias("covariance"))


def group_variance(covariance: DataFrame, members: DataFrame, keys: Sequence[str], model: str, group: str) -> DataFrame:
    """(keys, group, variance) of the sum of each group's models: all covariances of two of its members. members(model, group)."""
    mine = members.select(model, F.col(group).alias("__a"))
    theirs = members.select(F.col(model).alias("other"), F.col(group).alias("__b"))
    inside = covariance.join(mine, model).join(theirs, "other").where("__a = __b")
    return inside.groupBy(*keys, F.col("__a").alias(group)).agg(F.greatest(F.lit(0.0), F.sum("covariance")).alias("variance"))


def group_variance_of_counts(gammas: DataFrame, locus: str, gamma: str, total: str, variance: str, factor: str, group: str) -> DataFrame:
    """(locus, group, variance) of the sum of factor times count over each group of a locus's models, without a row for any pair.

    What group_variance makes of scaled(count_covariance(...)) where the weights are known: with t, v the total's mean and variance,
    the sum over a group's models of t g a ** 2, and (v - t) times the square of their sum of g a. Groups lie within a locus.
    """
    side = gammas.select(F.col(locus).alias("locus"), F.col(group).alias("grp"), F.col(gamma).cast("double").alias("g"), F.col(factor).cast("double").alias("a"), F.col(total).cast("double").alias("t"), F.col(variance).cast("double").alias("v"))
    sums = side.groupBy("locus", "grp").agg(F.sum(F.col("t") * F.col("g") * F.col("a") * F.col("a")).alias("own"), F.sum(F.col("g") * F.col("a")).alias("s"), F.first(F.col("v") - F.col("t")).alias("beyond"))
    return sums.select(F.col("locus").alias(locus), F.col("grp").alias(group), F.greatest(F.lit(0.0), F.col("own") + F.col("beyond") * F.col("s") * F.col("s")).alias("variance"))


def samples(values: DataFrame, covariance: DataFrame, keys: Sequence[str], model: str, value: str, draws: int = 100, seed: int = 0) -> DataFrame:
    """(keys, model, draw, value): draws of each locus's values, normal with their covariance and not below 0.

    Streams depend on the seed and the keys alone. A locus's matrix, of as many rows as it has models, is what a task holds.
    """
    importable_on_workers(values.sparkSession)
    names = [*keys, model]
    rows = covariance.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct(F.col("other").cast("string"), "covariance"))).alias("row"))
    flat = values.join(rows, names, "left").select(*names, F.col(value).cast("double").alias("v"), "row", F.xxhash64(*(F.col(c).cast("string") for c in keys)).alias("h"))
    schema = flat.select(*names).schema

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(model)
        h, n = int(pdf.h.iloc[0]), len(pdf)
        rng = np.random.default_rng([seed, h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF])
        at = [str(m) for m in pdf[model]]
        cov = np.array([[(dict(r) if r is not None else {}).get(m, 0.0) for m in at] for r in pdf.row])
        w, q = np.linalg.eigh((cov + cov.T) / 2)
        drawn = pdf.v.to_numpy() + rng.standard_normal((draws, n)) * np.sqrt(np.maximum(w, 0)) @ q.T
        out = pdf[names].loc[pdf.index.repeat(draws)].reset_index(drop=True)
        return out.assign(draw=np.tile(np.arange(1, draws + 1), n), value=np.maximum(drawn, 0).T.ravel())

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return flat.groupBy(*keys).applyInPandas(draw, f"{kinds}, draw long, value double")


def fisher(row: np.ndarray, model: np.ndarray, p: np.ndarray, mass: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """The observed information of a mixture's weights: the sum over fragments of mass * p p' / (p . gamma) ** 2.

    row, model, p: the entries of the likelihood matrix that aren't 0.
    """
    n = len(gamma)
    total = np.bincount(row, weights=p * gamma[model], minlength=len(mass))
    dense = np.zeros((n, n))
    # In stretches of rows, so that only so many are spread out at a time.
    for first in range(0, len(mass), 4096):
        some = (row >= first) & (row < first + 4096)
        part = np.zeros((min(4096, len(mass) - first), n))
        part[row[some] - first, model[some]] = p[some] / np.maximum(total[row[some]], 1e-300)
        dense += part.T @ (part * mass[first : first + len(part), None])
    return dense


def inverse_fisher(information: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The covariance of weights that sum to one: the information's inverse among the directions in which they can move."""
    n = len(information)
    if n < 2:
        return np.zeros((n, n))
    # An orthonormal basis of what sums to zero.
    basis = np.linalg.qr(np.eye(n)[:, : n - 1] - 1 / n)[0]
    inner = basis.T @ information @ basis
    inner += np.eye(n - 1) * max(ridge * np.trace(inner) / (n - 1), 1e-12)
    return basis @ np.linalg.inv(inner) @ basis.T


def _weighted_draws(centre: np.ndarray, scale: np.ndarray, row: np.ndarray, model: np.ndarray, p: np.ndarray, mass: np.ndarray, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(weights of a mixture, what each draw is worth): Student's t around centre, the rest even over all weights.

    A draw's worth is its likelihood over the density of that mixture. Draws outside the simplex are worth nothing.
    """
    n = len(centre)
    basis = np.linalg.qr(np.eye(n)[:, : n - 1] - 1 / n)[0]
    inner = basis.T @ scale @ basis
    root = np.linalg.cholesky((inner + inner.T) / 2 + np.eye(n - 1) * max(1e-14, 1e-9 * np.trace(inner)))
    freedom, d = 5, n - 1
    even = max(1, int(draws * EVEN))
    z = rng.standard_normal((draws - even, d)) / np.sqrt(rng.chisquare(freedom, draws - even) / freedom)[:, None]
    x = np.concatenate([centre + z @ root.T @ basis.T, rng.dirichlet(np.ones(n), even)])
    # Densities over the flat simplex, whose volume is sqrt(n) / (n - 1)!.
    y = np.linalg.solve(root, basis.T @ (x - centre).T)
    log_t = lgamma((freedom + d) / 2) - lgamma(freedom / 2) - d / 2 * np.log(freedom * np.pi) - np.log(np.diag(root)).sum() - (freedom + d) / 2 * np.log1p((y * y).sum(axis=0) / freedom)
    log_even = lgamma(n) - np.log(n) / 2
    log_q = np.logaddexp(np.log1p(-even / draws) + log_t, np.log(even / draws) + log_even)
    log_l = np.full(draws, -np.inf)
    some = np.flatnonzero((x >= 0).all(axis=1))
    for part in np.array_split(some, len(some) * max(len(p), len(mass)) // 20_000_000 + 1):
        if len(part):
            mixed = np.zeros((len(mass), len(part)))
            np.add.at(mixed, row, p[:, None] * x[part][:, model].T)
            log_l[part] = mass @ np.log(np.maximum(mixed, 1e-300))
    w = log_l - log_q
    w = np.exp(w - w.max())
    return x, w / w.sum()


def importance_moments(row: np.ndarray, model: np.ndarray, p: np.ndarray, mass: np.ndarray, gamma: np.ndarray, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, effective draws) of the weights' posterior under an even prior, by importance sampling.

    The first draws are spread around the optimum by the inverse Fisher information, the next by the moments that these
    give: at an edge of the simplex the posterior lies otherwise than around the optimum. The last three fifths count.
    """
    n = len(gamma)
    if n < 2:
        return np.ones(n), np.zeros((n, n)), float(draws)
    mean, cov = gamma, inverse_fisher(fisher(row, model, p, mass, gamma))
    for share in (0.2, 0.2, 0.6):
        x, w = _weighted_draws(mean, 1.3 * cov, row, model, p, mass, max(20, int(draws * share)), rng)
        mean = w @ x
        cov = (x - mean).T @ ((x - mean) * w[:, None])
    return mean, cov, float(1 / (w * w).sum())


def _many_weights(p: np.ndarray, mass: np.ndarray, most: int = 5000, tolerance: float = 1e-5) -> np.ndarray:
    """em_sparse's weights for many loci side by side: p (loci, rows, models), mass (loci, rows), both 0 where a locus has no row."""
    loci, _, n = p.shape
    out, at, gamma, before = np.empty((loci, n)), np.arange(loci), np.full((loci, n), 1 / n), np.full(loci, -np.inf)
    whole, live = mass.sum(axis=1)[:, None], np.ones(loci, bool)
    for k in range(1, most + 1):
        total = np.maximum(np.einsum("lrn,ln->lr", p, gamma), 1e-300)
        likelihood = (mass * np.log(np.where(mass > 0, total, 1.0))).sum(axis=1)
        new = gamma * np.einsum("lrn,lr->ln", p, mass / total) / whole
        gamma = np.where(live[:, None], new, gamma)
        if k > 3:
            live &= np.abs(likelihood - before) > tolerance
        before = likelihood
        if not live.any():
            break
        if live.sum() * 2 < len(at):  # what has settled goes
            out[at] = gamma
            p, mass, whole, at, gamma, before = p[live], mass[live], whole[live], at[live], gamma[live], before[live]
            live = np.ones(len(at), bool)
    out[at] = gamma
    return out


def _log_likelihoods(p: np.ndarray, mass: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of the weights in each column of x (models, draws), under rows p (rows, models) of this mass.

    Logs are what takes time: where masses are whole, rows are multiplied first, for each binary digit of the masses.
    """
    mixed = p @ x
    if (mass == np.floor(mass)).all() and mass.max(initial=0) < 1 << 20:
        left, total = mass.astype(np.int64), np.zeros(x.shape[1])
        for digit in range(int(left.max(initial=0)).bit_length()):
            some = (left >> digit & 1).astype(bool)
            if some.any():
                product = np.multiply.reduce(mixed[some], axis=0)
                if product.min() < 1e-290:
                    break
                total += (1 << digit) * np.log(product)
        else:
            return total
    return mass @ np.log(np.maximum(mixed, 1e-300))


def _many_moments(p: np.ndarray, mass: np.ndarray, draws: int, rngs: list[np.random.Generator]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """importance_moments for many loci of as many models side by side, each with its own stream."""
    loci, _, n = p.shape
    d, freedom = n - 1, 5
    basis = np.linalg.qr(np.eye(n)[:, :d] - 1 / n)[0]
    mean = _many_weights(p, mass)
    slope = p / np.maximum(np.einsum("lrn,ln->lr", p, mean), 1e-300)[:, :, None]
    inner = basis.T @ (np.swapaxes(slope * mass[:, :, None], 1, 2) @ slope) @ basis
    inner += np.eye(d) * np.maximum(RIDGE * np.trace(inner, axis1=1, axis2=2) / d, 1e-12)[:, None, None]
    cov = basis @ np.linalg.inv(inner) @ basis.T
    for share in (0.2, 0.2, 0.6):
        many = max(20, int(draws * share))
        even = max(1, int(many * EVEN))
        z, x = np.empty((loci, d, many - even)), np.empty((loci, n, many))
        for i, rng in enumerate(rngs):
            z[i] = (rng.standard_normal((many - even, d)) / np.sqrt(rng.chisquare(freedom, many - even) / freedom)[:, None]).T
            x[i, :, many - even :] = rng.dirichlet(np.ones(n), even).T
        inner = basis.T @ (1.3 * cov) @ basis
        root = np.linalg.cholesky((inner + np.swapaxes(inner, 1, 2)) / 2 + np.eye(d) * np.maximum(1e-14, 1e-9 * np.trace(inner, axis1=1, axis2=2))[:, None, None])
        x[:, :, : many - even] = mean[:, :, None] + (basis @ root) @ z
        # The first draws are where they are because of z, the others have to be traced back.
        y = np.concatenate([z, np.linalg.solve(root, basis.T @ (x[:, :, many - even :] - mean[:, :, None]))], axis=2)
        log_t = lgamma((freedom + d) / 2) - lgamma(freedom / 2) - d / 2 * np.log(freedom * np.pi) - np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1)[:, None] - (freedom + d) / 2 * np.log1p((y * y).sum(axis=1) / freedom)
        log_q = np.logaddexp(np.log1p(-even / many) + log_t, np.log(even / many) + lgamma(n) - np.log(n) / 2)
        outside = (x < 0).any(axis=1)
        inside = np.where(outside[:, None], 1 / n, x)
        # What one locus's rows make of its draws is made and used up at once.
        log_l = np.stack([_log_likelihoods(q[m > 0], m[m > 0], v) for q, v, m in zip(p, inside, mass, strict=True)])
        w = np.where(outside, -np.inf, log_l - log_q)
        w = np.exp(w - w.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        mean = (x @ w[:, :, None])[:, :, 0]
        off = x - mean[:, :, None]
        cov = (off * w[:, None]) @ np.swapaxes(off, 1, 2)
    return mean, cov, 1 / (w * w).sum(axis=1)


#: Entries (rows by models) and row-by-draw products of a locus up to which it is solved beside others; loci that are solved at once hold so many numbers.
MOST_ENTRIES, MOST_PRODUCTS, AT_ONCE = 20_000, 2_000_000, 100_000


def _solved(locus: np.ndarray, row: np.ndarray, model: np.ndarray, p: np.ndarray, mass: np.ndarray, row_locus: np.ndarray, sizes: np.ndarray, h: np.ndarray, draws: int, seed: int):
    """(locus, mean, covariance, effective) by number of models, for loci of sizes models; locus, row, model, p: of each entry."""
    n_rows = np.bincount(row_locus, minlength=len(sizes))
    first = np.concatenate([[0], np.cumsum(n_rows)])
    sound = np.bincount(locus, weights=~(np.isfinite(p) & (p >= 0)), minlength=len(sizes)) == 0
    full = np.bincount(row, weights=p, minlength=len(mass)) > 0
    alive = np.bincount(row_locus, weights=np.where(full, mass, 0.0), minlength=len(sizes)) > 0
    beside = sound & alive & (sizes > 1) & (n_rows * sizes <= MOST_ENTRIES) & (n_rows * draws <= MOST_PRODUCTS)
    stream = lambda i: np.random.default_rng([seed, int(h[i]) & 0xFFFFFFFF, (int(h[i]) >> 32) & 0xFFFFFFFF])
    starts = np.searchsorted(locus, np.arange(len(sizes) + 1))
    for n in np.unique(sizes[beside]).tolist():
        same = np.flatnonzero(beside & (sizes == n))
        same = same[np.argsort(n_rows[same], kind="stable")]
        step = max(1, AT_ONCE // (max(draws, int(n_rows[same[-1]])) * n))
        for part in np.array_split(same, -(-len(same) // step)):
            place = np.full(len(sizes), -1)
            place[part] = np.arange(len(part))
            of = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
            dense, weight = np.zeros((len(part), int(n_rows[part].max()), n)), np.zeros((len(part), int(n_rows[part].max())))
            np.add.at(dense, (place[locus[of]], row[of] - first[locus[of]], model[of]), p[of])
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            weight[place[row_locus[rows]], rows - first[row_locus[rows]]] = np.where(full[rows], mass[rows], 0.0)
            yield part, *_many_moments(dense, weight, draws, [stream(i) for i in part])
    for i in np.flatnonzero(~beside).tolist():
        of, m = slice(starts[i], starts[i + 1]), mass[first[i] : first[i + 1]]
        r, n = row[of] - first[i], int(sizes[i])
        gamma, _, _, _ = em_sparse(r, model[of], p[of], m, n)
        mean, cov, effective = importance_moments(r, model[of], p[of], m, gamma, draws, stream(i))
        yield np.array([i]), mean[None], cov[None], np.array([effective])


def posteriors(df: DataFrame, locus: str, fragment: str, model: str, probability: str, mass: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(locus, model, other, mean, covariance, effective) of the weights' posterior in each locus, by importance sampling.

    df is as mixtures takes it; mean is that of model, effective the number of even draws that these are worth. Streams depend on
    the seed and the locus alone. A locus's entries are what a task holds: no matrix of all fragments by all models. Small loci
    of as many models are solved side by side.
    """
    importable_on_workers(df.sparkSession)
    rows = df.groupBy(locus, fragment).agg(F.array_sort(F.collect_list(F.struct(F.col(model).cast("string").alias("m"), F.col(probability).cast("double").alias("p")))).alias("row"), F.max(F.col(mass).cast("double")).alias("mass"))
    classes = rows.groupBy(locus, "row").agg(F.sum("mass").alias("mass"))
    name = F.col(locus).cast("string")
    whole = classes.groupBy(name.alias("locus")).agg(F.array_sort(F.collect_list(F.struct("row", "mass"))).alias("rows"))
    flat = whole.select("locus", F.xxhash64("locus").alias("h"), F.transform("rows", lambda x: F.size(x["row"])).alias("n"), F.transform("rows", lambda x: x["mass"]).alias("mass"), F.flatten(F.transform("rows", lambda x: F.transform(x["row"], lambda y: y["m"]))).alias("m"), F.flatten(F.transform("rows", lambda x: F.transform(x["row"], lambda y: y["p"]))).alias("p"))
    schema = "locus string, model string, other string, mean double, covariance double, effective double"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array(batch.column("locus"))
            lists = {c: batch.column(c) for c in ("n", "mass", "m", "p")}
            flats = {c: lists[c].flatten() for c in lists}
            n_entries, n_rows = (lists[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "mass"))
            locus, row_locus = np.repeat(np.arange(len(names)), n_entries), np.repeat(np.arange(len(names)), n_rows)
            row = np.repeat(np.arange(len(row_locus)), flats["n"].to_numpy(zero_copy_only=False))
            coded = flats["m"].dictionary_encode()
            order = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # A locus's models are numbered in order of their names.
            used, at = np.unique(locus * max(1, len(order)) + rank[coded.indices.to_numpy(zero_copy_only=False)], return_inverse=True)
            owner = used // max(1, len(order))
            sizes = np.bincount(owner, minlength=len(names))
            begin = np.concatenate([[0], np.cumsum(sizes)])
            model = at - begin[locus]
            called = coded.dictionary.take(pa.array(order[used % max(1, len(order))]))
            p, m = flats["p"].to_numpy(zero_copy_only=False), flats["mass"].to_numpy(zero_copy_only=False)
            for part, mean, cov, effective in _solved(locus, row, model, p, m, row_locus, sizes, batch.column("h").to_numpy(zero_copy_only=False), draws, seed):
                n = mean.shape[1]
                of = begin[part][:, None] + np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.repeat(part, n * n))), called.take(pa.array(np.repeat(of, n, axis=1).ravel())), called.take(pa.array(np.tile(of, n).ravel())), pa.array(np.repeat(mean, n, axis=1).ravel()), pa.array(cov.ravel()), pa.array(np.repeat(effective, n * n))],
                    names=["locus", "model", "other", "mean", "covariance", "effective"],
                )

    return flat.mapInArrow(solve, schema)


def _gradient(p: Column, q: Column) -> Column:
    """The derivative of the Jensen-Shannon divergence by p, but for what is the same for all members: half the log of p over the mean."""
    return F.when(p > 0, F.log(p / ((p + q) / 2)) / 2).otherwise(0.0)


def js_variance(members: DataFrame, covariances: DataFrame, keys: Sequence[str], member: str, a: str, b: str) -> DataFrame:
    """(keys, js, variance): Jensen-Shannon distance of two sides' shares, and its variance by the delta method.

    members(keys, member, a, b): each member's value on both sides; covariances(keys, side, member, other, covariance) of the values,
    side 1 or 2. The distance is the root of a divergence; its gradient by a side's values is that of the divergence by the
    shares, less its mean under them, over the side's sum, and over twice the distance. Where the distance is 0 there is no
    gradient: the variance is null.
    """
    w = Window.partitionBy(*keys)
    sums = members.withColumns({"__sa": F.sum(a).over(w), "__sb": F.sum(b).over(w)}).where("__sa > 0 AND __sb > 0")
    shares = sums.withColumns({"__p": F.col(a) / F.col("__sa"), "__q": F.col(b) / F.col("__sb")})

    def entropy(x: Column) -> Column:
        return F.when(x > 0, -x * F.log(x)).otherwise(0.0)

    p, q = F.col("__p"), F.col("__q")
    js = F.sqrt(F.greatest(F.lit(0.0), F.sum(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2).over(w)))
    with_js = shares.withColumns({"js": js, "__gp": _gradient(p, q), "__gq": _gradient(q, p)})
    # By values: less the mean of the gradient under the shares, over the sum.
    slopes = with_js.withColumns({"__hp": (F.col("__gp") - F.sum(F.col("__gp") * p).over(w)) / F.col("__sa"), "__hq": (F.col("__gq") - F.sum(F.col("__gq") * q).over(w)) / F.col("__sb")})
    long = slopes.select(*keys, member, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("__hp").alias("h")), F.struct(F.lit(2).alias("side"), F.col("__hq").alias("h")))).alias("s")).select(*keys, member, "s.side", "s.h")
    both = covariances.join(long, [*keys, "side", member]).join(long.select(*keys, "side", F.col(member).alias("other"), F.col("h").alias("__o")), [*keys, "side", "other"])
    forms = both.groupBy(*keys).agg(F.sum(F.col("covariance") * F.col("h") * F.col("__o")).alias("__v"))
    return with_js.groupBy(*keys).agg(F.first("js").alias("js")).join(forms, list(keys), "left").select(*keys, "js", F.when(F.col("js") > 1e-12, F.greatest(F.lit(0.0), F.col("__v")) / (4 * F.col("js") * F.col("js"))).alias("variance"))

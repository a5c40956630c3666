"""Covariances, posteriors and negative-binomial fits against exact sums, integrals, simulation and known functions."""

import math
import time

import numpy as np
import pytest

from spanforge.operators import abundance, dispersion, negbin, uncertainty
from spanforge.plans import workflows


def entries(matrix):
    row, model = np.nonzero(matrix)
    return row, model, matrix[row, model]


def test_count_covariance_is_what_the_drawn_one_tends_to(spark):
    rows = [("a", m, g, 300.0, 900.0) for m, g in (("x", 0.5), ("y", 0.3), ("z", 0.2))] + [("b", "x", 1.0, 40.0, 40.0)]
    df = spark.createDataFrame(rows, "locus string, model string, g double, t double, v double")
    exact = {(r.locus, r.model, r.other): r.covariance for r in uncertainty.count_covariance(df, "locus", "model", "g", "t", "v").collect()}
    drawn = {(r.locus, r.model, r.other): r.covariance for r in dispersion.count_covariance(df, "locus", "model", "g", "t", "v", draws=4000, assignments=10).collect()}
    assert set(exact) == set(drawn) and len(exact) == 10
    assert all(abs(exact[k] - drawn[k]) < 0.08 * max(abs(exact[k]), 60) for k in exact)
    # All models together vary as the total does.
    assert math.isclose(sum(v for k, v in exact.items() if k[0] == "a"), 900) and exact["b", "x", "x"] == 40


def test_posterior_adds_its_part(spark):
    df = spark.createDataFrame([("a", "x", 0.6, 100.0, 150.0), ("a", "y", 0.4, 100.0, 150.0)], "locus string, model string, g double, t double, v double")
    c = 0.01
    posterior = spark.createDataFrame([("a", "x", "x", c), ("a", "y", "y", c), ("a", "x", "y", -c), ("a", "y", "x", -c)], "locus string, model string, other string, covariance double")
    got = {(r.model, r.other): r.covariance for r in uncertainty.count_covariance(df, "locus", "model", "g", "t", "v", posterior).collect()}
    rng = np.random.default_rng(2)
    g = np.clip(0.6 + 0.1 * rng.choice([-1, 1], 400_000), 0, 1)
    n = rng.poisson(rng.gamma(200, 0.5, len(g)))
    x = rng.binomial(n, g)
    cov = np.cov(x, n - x)
    assert np.allclose([got["x", "x"], got["x", "y"], got["y", "y"]], [cov[0, 0], cov[0, 1], cov[1, 1]], rtol=0.03)


def test_group_variances_are_sums(spark):
    rng = np.random.default_rng(4)
    a = rng.random((5, 5))
    cov = a @ a.T
    table = spark.createDataFrame([("l", str(i), str(j), float(cov[i, j])) for i in range(5) for j in range(5)], "locus string, model string, other string, covariance double")
    factor = spark.createDataFrame([("l", str(i), float(i + 1)) for i in range(5)], "locus string, model string, f double")
    members = spark.createDataFrame([(str(i), "even" if i % 2 == 0 else "odd") for i in range(5)], "model string, grp string")
    s = uncertainty.scaled(table, factor, ["locus"], "model", "f")
    got = {r.grp: r.variance for r in uncertainty.group_variance(s, members, ["locus"], "model", "grp").collect()}
    for name, which in (("even", [0, 2, 4]), ("odd", [1, 3])):
        f = np.array([i + 1 if i in which else 0 for i in range(5)], float)
        assert math.isclose(got[name], f @ cov @ f)


def test_samples_have_their_covariance(spark):
    cov = np.array([[4.0, 1.5, 0], [1.5, 2.0, 0], [0, 0, 0]])
    values = spark.createDataFrame([("l", m, v) for m, v in zip("abc", (50.0, 40.0, 7.0), strict=True)], "locus string, model string, v double")
    table = spark.createDataFrame([("l", "abc"[i], "abc"[j], float(cov[i, j])) for i in range(3) for j in range(3)], "locus string, model string, other string, covariance double")
    drawn = uncertainty.samples(values, table, ["locus"], "model", "v", draws=4000).toPandas().pivot(index="draw", columns="model", values="value").to_numpy()
    assert np.allclose(drawn.mean(0), [50, 40, 7], atol=0.15) and np.allclose(np.cov(drawn.T), cov, atol=0.25) and len(drawn) == 4000


def test_fisher_is_the_curvature():
    rng = np.random.default_rng(3)
    m, mass, g = rng.random((12, 3)) * (rng.random((12, 3)) < 0.7) + 0.01, rng.integers(1, 9, 12).astype(float), np.array([0.5, 0.3, 0.2])
    f = lambda x: float((mass * np.log(m @ x)).sum())
    h = 1e-4
    numeric = [[-(f(g + h * (a + b)) - f(g + h * (a - b)) - f(g - h * (a - b)) + f(g - h * (a + b))) / (4 * h * h) for b in np.eye(3)] for a in np.eye(3)]
    assert np.allclose(uncertainty.fisher(*entries(m), mass, g), numeric, rtol=1e-4)
    inverse = uncertainty.inverse_fisher(uncertainty.fisher(*entries(m), mass, g))
    assert np.allclose(inverse.sum(0), 0) and np.all(np.linalg.eigvalsh(inverse) > -1e-12)
    # Two models that can't be told apart have a wide, finite covariance.
    alike = np.array([[0.5, 0.5], [0.2, 0.2]])
    wide = uncertainty.inverse_fisher(uncertainty.fisher(*entries(alike), np.array([9.0, 4.0]), np.array([0.5, 0.5])))
    assert np.isfinite(wide).all() and wide[0, 0] > 1


def exact_moments(m, mass):
    """Mean and covariance of the posterior under an even prior, by sums over a fine grid."""
    n = m.shape[1]
    if n == 2:
        x = (np.arange(40_000) + 0.5) / 40_000
        grid = np.stack([x, 1 - x], 1)
    else:
        k = 900
        i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        # Both triangles of each cell, by their middles.
        low, up = i + j < k, i + j < k - 1
        grid = np.concatenate([np.stack([(i[some] + at) / k, (j[some] + at) / k], 1) for some, at in ((low, 1 / 3), (up, 2 / 3))])
        grid = np.concatenate([grid, 1 - grid.sum(1, keepdims=True)], 1)
    log = np.log(grid @ m.T) @ mass
    w = np.exp(log - log.max())
    w /= w.sum()
    mean = w @ grid
    return mean, (grid - mean).T @ ((grid - mean) * w[:, None])


@pytest.mark.parametrize("models", [2, 3])
@pytest.mark.parametrize("kind", ["inner", "corner", "few", "alike"])
def test_posterior_equals_exact_integration(models, kind):
    rng = np.random.default_rng(models)
    m = rng.random((8, models)) + 0.05
    mass = rng.integers(5, 40, 8).astype(float)
    if kind == "corner":
        m[:, 0] *= 3
    if kind == "few":
        mass = np.full(8, 0.3)
    if kind == "alike":
        m[:, 1] = m[:, 0]
    gamma = abundance.em(m, mass)[0]
    mean, cov, effective = uncertainty.importance_moments(*entries(m), mass, gamma, 60_000, np.random.default_rng(1))
    want_mean, want_cov = exact_moments(m, mass)
    # Five standard errors of as many even draws as these are worth.
    sd = np.sqrt(np.diag(want_cov))
    assert effective > 3000 and np.all(np.abs(mean - want_mean) < 5 * sd / math.sqrt(effective) + 2e-4)
    assert np.all(np.abs(cov - want_cov) < 10 * np.outer(sd, sd) / math.sqrt(effective) + 1e-5)


def test_group_variances_without_pairs(spark):
    """The quadratic form in closed form: equal to that over all pairs of a locus's models, with as many rows as it has models."""
    rng = np.random.default_rng(6)
    rows = [(locus, 100 * locus + k, g / w.sum(), 50.0 * locus, 80.0 * locus * locus, float(rng.uniform(0, 9)), f"g{k % 3}") for locus in range(1, 6) for w in [rng.uniform(0, 1, 7)] for k, g in enumerate(w.tolist())]
    df = spark.createDataFrame([tuple(map(lambda x: x.item() if hasattr(x, "item") else x, r)) for r in rows], "locus int, model int, g double, t double, v double, a double, grp string")
    pairs = uncertainty.scaled(uncertainty.count_covariance(df, "locus", "model", "g", "t", "v"), df, ["locus"], "model", "a")
    want = {(r.locus, r.grp): r.variance for r in uncertainty.group_variance(pairs, df.select("model", "grp"), ["locus"], "model", "grp").collect()}
    found = uncertainty.group_variance_of_counts(df, "locus", "g", "t", "v", "a", "grp")
    got = {(r.locus, r.grp): r.variance for r in found.collect()}
    assert len(want) == 15 and got == pytest.approx(want, rel=1e-9)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_loci_are_solved_side_by_side():
    """Loci of two to four models, rows without a probability and unlike numbers of rows: the same as one by one, in less than half its time."""
    rng = np.random.default_rng(3)
    locus, row, model, p, mass, row_locus, sizes, n_rows = [], [], [], [], [], [], [], 0
    for i in range(400):
        n, many = 2 + i % 3, int(rng.integers(3, 12))
        sizes.append(n)
        for _ in range(many):
            some = [k for k in range(n) if rng.random() < 0.8] or [0]
            locus += [i] * len(some)
            row += [n_rows] * len(some)
            model += some
            p += [0.0 if rng.random() < 0.1 else float(rng.uniform(0.01, 0.9)) for _ in some]
            mass.append(float(rng.integers(1, 9)))
            row_locus.append(i)
            n_rows += 1
    args = [np.array(x) for x in (locus, row, model, p, mass, row_locus, sizes)]
    h = rng.integers(-(1 << 60), 1 << 60, 400)
    began = time.process_time()
    found = {int(i): (m, c, e) for part in uncertainty._solved(*args, h, 500, 7) for i, m, c, e in zip(*part, strict=True)}
    side = time.process_time() - began
    assert len(found) == 400
    locus, row, model, p, mass, row_locus, sizes = args
    began = time.process_time()
    for i in range(400):
        own, rows = locus == i, np.flatnonzero(row_locus == i)
        r, m = row[own] - rows[0], mass[rows]
        gamma = abundance.em_sparse(r, model[own], p[own], m, sizes[i])[0]
        one = uncertainty.importance_moments(r, model[own], p[own], m, gamma, 500, np.random.default_rng([7, int(h[i]) & 0xFFFFFFFF, (int(h[i]) >> 32) & 0xFFFFFFFF]))
        for a, b in zip(found[i], one, strict=True):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-9)
    assert side < (time.process_time() - began) / 2


def test_posteriors_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(f"l{k}", f"f{i}", m, float(p), 1.0) for k in range(3) for i in range(60) for m, p in zip("abc"[: k + 1], rng.random(k + 1) + 0.01, strict=True)]
    df = spark.createDataFrame(rows, "locus string, fragment string, model string, p double, mass double")
    one = sorted(map(tuple, uncertainty.posteriors(df, "locus", "fragment", "model", "p", "mass", 2000).collect()))
    two = sorted(map(tuple, uncertainty.posteriors(df.repartition(7), "locus", "fragment", "model", "p", "mass", 2000).collect()))
    assert one == two and len(one) == 1 + 4 + 9
    assert all(math.isclose(sum(r[3] for r in one if r[0] == k and r[1] == r[2]), 1) for k in ("l0", "l1", "l2"))
    mixed = {(r.locus, r.model): r.gamma for r in abundance.mixtures(df, "locus", "fragment", "model", "p", "mass").collect()}
    assert all(abs(r[3] - mixed[r[0], r[1]]) < 4 * math.sqrt(r[4]) + 0.02 for r in one if r[1] == r[2])


def test_special_functions():
    x = np.array([0.3, 0.5, 1.0, 2.5, 7.0, 30.0, 1e5])
    h = 1e-5
    assert np.allclose(negbin.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)
    assert np.allclose(negbin.digamma(x[:6]), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x[:6]], atol=1e-8)
    assert np.isclose(negbin.digamma(np.array([1.0]))[0], -0.5772156649015329, atol=1e-12)
    assert np.allclose(negbin.trigamma(np.array([1.0, 0.5])), [math.pi**2 / 6, math.pi**2 / 2], atol=1e-11)
    v = np.arange(2000.0)
    assert np.isclose(np.exp(negbin.log_likelihood(v, np.full(2000, 30.0), np.full(2000, 2.5))).sum(), 1)
    assert np.isclose(np.exp(negbin.log_likelihood(v, np.full(2000, 30.0), np.full(2000, np.inf))).sum(), 1)


def test_fits_are_likeliest(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.negative_binomial(3, 3 / 23, 4000), "b": rng.negative_binomial(0.4, 0.4 / 5.4, 4000), "c": rng.poisson(9, 50) * 0 + 9, "d": np.zeros(30, int), "e": np.array([4])}
    rows = [(g, int(v)) for g, x in groups.items() for v in x] + [("a", None)]
    got = {r.g: r for r in negbin.fits(spark.createDataFrame(rows, "g string, v int").repartition(6), ["g"], "v").collect()}
    assert abs(got["a"].size - 3) < 0.4 and abs(got["b"].size - 0.4) < 0.05 and got["a"].n == 4000
    for g in "ab":
        v = groups[g].astype(float)
        at = lambda s, v=v: negbin.log_likelihood(v, np.full(len(v), v.mean()), np.full(len(v), s)).sum()
        assert math.isclose(at(got[g].size), got[g].log_likelihood, rel_tol=1e-9)
        assert all(at(got[g].size) >= at(got[g].size * f) for f in (0.99, 1.01)) and got[g].log_likelihood > got[g].poisson_log_likelihood
    assert all(got[g].size is None and got[g].dispersion == 0 and got[g].log_likelihood == got[g].poisson_log_likelihood for g in "cde")


def test_correction_finds_the_variation_that_few_replicates_hide(spark):
    curve = negbin.scv_curve(spark, 3, genes=4000)
    assert np.all(np.diff(curve[0]) >= 0) and curve[0][-1] <= 3
    rng = np.random.default_rng(6)
    for true in (0.05, 0.5, 2.0):
        x = rng.negative_binomial(1 / true, 1 / (1 + 1000 * true), (6000, 3))
        rows = [(float(r.mean()), float(r.var(ddof=1))) for r in x if r.mean() > 0]
        df = spark.createDataFrame(rows, "mean double, variance double")
        raw = np.mean([v / (m * m) for m, v in rows])
        mean_excess = spark.createDataFrame([(1000.0, 1000.0 + float(raw) * 1e6)], "mean double, variance double")
        fixed = negbin.corrected(mean_excess, curve).first().variance
        assert abs((fixed - 1000) / 1e6 / true - 1) < 0.15 and negbin.corrected(df.limit(5), curve).count() == 5
    same = negbin.corrected(spark.createDataFrame([(5.0, 3.0), (0.0, 0.0), (5.0, None)], "mean double, variance double"), curve).collect()
    assert [tuple(r) for r in same] == [(5.0, 3.0), (0.0, 0.0), (5.0, None)]


def test_delta_variance_of_the_distance_agrees_with_draws(spark):
    rng = np.random.default_rng(7)
    a, b = np.array([50.0, 30, 20]), np.array([20.0, 50, 30])
    ca, cb = np.diag([9.0, 4, 4]) + 0.5, np.diag([4.0, 9, 6]) - 0.3
    members = spark.createDataFrame([("g", "xyz"[k], float(a[k]), float(b[k])) for k in range(3)] + [("zero", "x", 0.0, 1.0), ("same", "x", 1.0, 2.0), ("same", "y", 3.0, 6.0)], "g string, m string, a double, b double")
    cov = spark.createDataFrame([("g", s, "xyz"[i], "xyz"[j], float(c[i, j])) for s, c in ((1, ca), (2, cb)) for i in range(3) for j in range(3)], "g string, side int, m string, other string, covariance double")
    got = {r.g: r for r in uncertainty.js_variance(members, cov, ["g"], "m", "a", "b").collect()}
    xa, xb = rng.multivariate_normal(a, ca, 200_000), rng.multivariate_normal(b, cb, 200_000)
    p, q = xa / xa.sum(1, keepdims=True), xb / xb.sum(1, keepdims=True)
    h = lambda x: -(x * np.log(x)).sum(1)
    d = np.sqrt(h((p + q) / 2) - (h(p) + h(q)) / 2)
    assert abs(got["g"].js - d.mean()) < 0.01 and abs(got["g"].variance / d.var() - 1) < 0.05
    assert set(got) == {"g", "same"} and got["same"].variance is None and got["same"].js < 1e-9


def test_pooled_variances_are_used(spark):
    rng = np.random.default_rng(9)
    libraries = [(f"{c}{k}", c) for c in "xy" for k in range(3)]
    rows = []
    for g in range(300):
        mean = float(np.exp(rng.uniform(4, 8)))
        for lib, c in libraries:
            m = mean * (16 if g < 15 and c == "y" else 1)
            n = rng.negative_binomial(10, 10 / (10 + m))
            rows.append((lib, f"g{g}", float(n), float(n), "OK"))
    genes = spark.createDataFrame(rows, "library string, gene_id string, count double, fpkm double, status string")
    samples = spark.createDataFrame(libraries, "library string, condition string")
    contrasts = spark.createDataFrame([("x", "y")], "condition_1 string, condition_2 string")
    tests = {v: workflows.differential(genes, samples, contrasts, draws=1000, variances=v).collect() for v in ("pooled", "sample")}
    changed = {f"g{k}" for k in range(15)}
    found = {v: {r.gene_id for r in t if r.p_value < 0.05} for v, t in tests.items()}
    # With three replicates a gene's own variance is often far too low; the model's isn't.
    assert found["pooled"] >= changed and len(found["pooled"] - changed) <= 2 < len(found["sample"] - changed)
    with pytest.raises(ValueError, match="other"):
        workflows.differential(genes, samples, contrasts, variances="other")


def test_intervals_of_quantified_models(spark):
    q = spark.createDataFrame([("l", "g", m, g * 100, g * 100 * s, g, 100.0, 250.0, s) for m, g, s in (("a", 0.7, 2.0), ("b", 0.3, 5.0))] + [("l", "h", "c", 50.0, 50.0, 1.0, 50.0, 50.0, 1.0)], "library string, gene_id string, id string, count double, fpkm double, gamma double, total double, variance double, scale double")
    cov = {(r.id, r.other): r.covariance for r in workflows.fpkm_covariance(q).collect()}
    assert math.isclose(cov["a", "b"], 150 * 0.21 * 10) and math.isclose(cov["a", "a"], 4 * (70 + 150 * 0.49)) and len(cov) == 5
    got = {r.grp: r for r in workflows.group_intervals(q, spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("b", "y")], "id string, grp string"), "grp").collect()}
    assert math.isclose(got["x"].variance, cov["a", "a"] + 2 * cov["a", "b"] + cov["b", "b"] + cov["c", "c"]) and math.isclose(got["y"].variance, cov["b", "b"])
    assert math.isclose(got["y"].hi - got["y"].fpkm, 2 * math.sqrt(cov["b", "b"])) and got["x"].fpkm == 140 + 150 + 50



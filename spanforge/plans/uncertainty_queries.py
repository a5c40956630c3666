"""Covariances, posteriors, negative-binomial fits and modelled variances over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators import abundance, negbin, uncertainty
from spanforge.plans import workflows
from spanforge.plans.interval_queries import load
from spanforge.plans.registry import query
from spanforge.plans.statistics_queries import _MIX, _mix

_LINES = """l AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS model, min(l_returnflag) AS l_returnflag, sum(round(l_quantity))::DOUBLE AS q, 1000 / (max(round(l_tax * 100)) + 1) AS scale FROM lineitem GROUP BY l_orderkey, l_linenumber),
g AS (SELECT *, q / sum(q) OVER (PARTITION BY l_orderkey) AS g, sum(q) OVER (PARTITION BY l_orderkey) AS t FROM l),
v AS (SELECT *, t + 0.01 * t * t AS v FROM g),
c AS (SELECT a.l_orderkey, a.model, b.model AS other, a.l_returnflag, b.l_returnflag AS other_flag,
  ((CASE WHEN a.model = b.model THEN a.t * a.g ELSE 0 END) + (a.v - a.t) * a.g * b.g) * a.scale * b.scale AS covariance FROM v a JOIN v b USING (l_orderkey))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as models of their order, which is a locus: shares by quantity, a total that varies more than Poisson."""
    model = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("model")
    lines = load(spark, d, "lineitem").groupBy("l_orderkey", model).agg(F.min("l_returnflag").alias("l_returnflag"), F.sum(F.round("l_quantity")).alias("q"), (1000 / (F.max(F.round(F.col("l_tax") * 100)) + 1)).alias("scale"))
    # Ordered by their order once: totals come from the rows themselves, not from a second reading.
    sums = lines.withColumn("t", F.sum("q").over(Window.partitionBy("l_orderkey")))
    return abundance.shares(sums, ["l_orderkey"], "q", "g").withColumn("v", F.col("t") + 0.01 * F.col("t") * F.col("t"))


def _covariance(lines: DataFrame) -> DataFrame:
    return uncertainty.scaled(uncertainty.count_covariance(lines, "l_orderkey", "model", "g", "t", "v"), lines, ["l_orderkey"], "model", "scale")


@query("fpkm_covariance", f"WITH {_LINES} SELECT l_orderkey, model, other, round(covariance, 3) AS covariance FROM c")
def fpkm_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _covariance(_lines(spark, d)).withColumn("covariance", F.round("covariance", 3))


@query("group_fpkm_intervals", f"""WITH {_LINES}, x AS (SELECT l_orderkey, l_returnflag, greatest(0, sum(covariance)) AS variance FROM c WHERE l_returnflag = other_flag GROUP BY ALL),
f AS (SELECT l_orderkey, l_returnflag, sum(q * scale) AS f FROM v GROUP BY ALL)
SELECT l_orderkey, l_returnflag, round(greatest(0, f - 2 * sqrt(variance)), 4) AS lo, round(f + 2 * sqrt(variance), 4) AS hi FROM f JOIN x USING (l_orderkey, l_returnflag)""")
def group_fpkm_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one return flag as a group of their order's models."""
    lines = _lines(spark, d)
    variance = uncertainty.group_variance_of_counts(lines, "l_orderkey", "g", "t", "v", "scale", "l_returnflag")
    sums = lines.groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("q") * F.col("scale")).alias("f"))
    lo, hi = abundance.confidence(F.col("f"), F.sqrt("variance"))
    return sums.join(variance, ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_returnflag", F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


@query("js_delta_variance", f"""WITH {_MIX}, p AS (SELECT cohort, event_type, a, b, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q, sum(a) OVER w AS sa, sum(b) OVER w AS sb FROM m WINDOW w AS (PARTITION BY cohort)),
h AS (SELECT *, CASE WHEN p > 0 THEN ln(p / ((p + q) / 2)) / 2 ELSE 0 END AS gp, CASE WHEN q > 0 THEN ln(q / ((p + q) / 2)) / 2 ELSE 0 END AS gq FROM p WHERE sa > 0 AND sb > 0),
s AS (SELECT cohort, a, b, p, q, (gp - sum(gp * p) OVER w) / sa AS hp, (gq - sum(gq * q) OVER w) / sb AS hq FROM h WINDOW w AS (PARTITION BY cohort)),
j AS (SELECT cohort, greatest(0, sum(CASE WHEN p + q > 0 THEN -((p + q) / 2) * ln((p + q) / 2) ELSE 0 END) - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END + CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END) / 2) AS d, sum(a * hp * hp + b * hq * hq) AS v FROM s GROUP BY cohort)
SELECT cohort, round(sqrt(d), 7) AS js, CASE WHEN sqrt(d) > 1e-12 THEN round(v / (4 * d), 9) END AS variance FROM j""")
def js_delta_variance(spark: SparkSession, d: str) -> DataFrame:
    """Counts of event types on two sides of a cohort, each with its Poisson variance."""
    m = _mix(spark, d)
    own = m.select("cohort", "event_type", F.col("event_type").alias("other"), F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("covariance")), F.struct(F.lit(2).alias("side"), F.col("b").alias("covariance")))).alias("x")).select("cohort", "x.side", "event_type", "other", "x.covariance")
    return uncertainty.js_variance(m, own, ["cohort"], "event_type", "a", "b").select("cohort", F.round("js", 7).alias("js"), F.round("variance", 9).alias("variance"))


def _fits(spark: SparkSession, d: str) -> DataFrame:
    """Lines a part has from one supplier as counts, the part's brand as their group."""
    counts = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    brands = load(spark, d, "part").select("p_partkey", "p_brand")
    return negbin.fits(counts.join(brands, F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "n")


@query("poisson_likelihood", """WITH c AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_partkey, l_suppkey), m AS (SELECT p_brand, avg(n) AS mean FROM c GROUP BY ALL)
SELECT p_brand, count(*) AS n, round(avg(c.n), 9) AS mean, round(sum(c.n * ln(mean) - mean - lgamma(c.n + 1)), 4) AS log_likelihood FROM c JOIN m USING (p_brand) GROUP BY p_brand""")
def poisson_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).select("p_brand", "n", F.round("mean", 9).alias("mean"), F.round("poisson_log_likelihood", 4).alias("log_likelihood"))


@query("negbin_fits")
def negbin_fits(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d)


@query("weight_posteriors")
def weight_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Return flags as models of a part, its lines as fragments that fit their own flag best: the weights' posterior."""
    lines = load(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_returnflag", F.round("l_quantity").alias("q"))
    each = lines.withColumn("model", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))).withColumn("p", F.when(F.col("model") == F.col("l_returnflag"), 0.8).otherwise(F.round(0.2 / F.col("q"), 2) + 0.01))
    found = uncertainty.posteriors(each.withColumn("mass", F.lit(1.0)), "l_partkey", "line", "model", "p", "mass", draws=2000).where("model = other")
    return found.select(F.col("locus").cast("bigint").alias("l_partkey"), "model", F.round("mean", 6).alias("mean"), F.round(F.sqrt("covariance"), 6).alias("sd"))


@query("modelled_variances")
def modelled_variances(spark: SparkSession, d: str) -> DataFrame:
    """Parts as genes, line status as condition, months as replicates: variances from a model of all parts."""
    lines = load(spark, d, "lineitem").withColumn("month", F.month("l_shipdate"))
    counts = lines.groupBy(F.col("l_partkey").alias("gene_id"), F.col("l_linestatus").alias("condition"), "month").agg(F.sum(F.round("l_quantity")).alias("n"))
    moments = counts.groupBy("gene_id", "condition").agg(F.avg("n").alias("mean"), F.coalesce(F.var_samp("n"), F.avg("n")).alias("variance"))
    found = workflows.modelled_variances(moments, {"F": 12, "O": 12})
    return found.select("gene_id", "condition", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))

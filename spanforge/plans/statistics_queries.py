"""Normalization, abundance, testing and clustering over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import abundance, cluster, filters, fragments, normalize, stats
from spanforge.plans import workflows
from spanforge.plans.interval_queries import load
from spanforge.plans.registry import query


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as loci, return flags as libraries."""
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("locus"), F.col("l_returnflag").alias("library")).agg(F.sum(F.round("l_quantity").cast("bigint")).alias("n"))


_COUNTS = "c AS (SELECT l_partkey AS locus, l_returnflag AS library, sum(round(l_quantity)::BIGINT)::BIGINT AS n FROM lineitem GROUP BY ALL)"
_GEOMETRIC = _COUNTS + """, g AS (SELECT locus, library, n, round(ln(n) - avg(ln(n)) OVER (PARTITION BY locus), 12) AS r, count(*) OVER (PARTITION BY locus) AS have FROM c WHERE n > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY r) AS i, count(*) OVER (PARTITION BY library) AS m FROM g WHERE have = (SELECT count(DISTINCT library) FROM c)),
f AS (SELECT library, exp(r) AS factor FROM k WHERE i = m // 2 + 1)"""


@query("size_factor_geometric", f"WITH {_GEOMETRIC} SELECT library, round(factor, 9) AS factor FROM f")
def size_factor_geometric(spark: SparkSession, d: str) -> DataFrame:
    return normalize.geometric(counts(spark, d), "locus", "library", "n").withColumn("factor", F.round("factor", 9))


@query("size_factor_classic", f"WITH {_COUNTS}, t AS (SELECT library, sum(n)::DOUBLE AS t FROM c GROUP BY ALL) SELECT library, round(t / avg(t) OVER (), 9) AS factor FROM t")
def size_factor_classic(spark: SparkSession, d: str) -> DataFrame:
    return normalize.classic(counts(spark, d), "library", "n").withColumn("factor", F.round("factor", 9))


@query("size_factor_quartile", f"WITH {_COUNTS}, k AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY n) AS i, count(*) OVER (PARTITION BY library) AS m FROM c), u AS (SELECT library, n FROM k WHERE i = floor(0.75 * m) + 1) SELECT library, round(n / avg(n) OVER (), 9) AS factor FROM u")
def size_factor_quartile(spark: SparkSession, d: str) -> DataFrame:
    return normalize.quartile(counts(spark, d), "library", "n").withColumn("factor", F.round("factor", 9))


@query("common_scale_counts", f"WITH {_GEOMETRIC} SELECT locus, library, n, round(n / factor, 6) AS scaled FROM c JOIN f USING (library)")
def common_scale_counts(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    return normalize.common_scale(c, normalize.geometric(c, "locus", "library", "n"), "library", "n").select("locus", "library", "n", F.round("scaled", 6).alias("scaled"))


@query("count_moments", f"WITH {_COUNTS} SELECT locus, round(avg(n), 6) AS mean, CASE WHEN count(*) > 1 THEN round(var_samp(n), 6) END AS variance FROM c GROUP BY locus")
def count_moments(spark: SparkSession, d: str) -> DataFrame:
    return normalize.means_and_variances(counts(spark, d), "locus", "n").select("locus", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("standards_only", f"WITH {_COUNTS} SELECT * FROM c WHERE locus IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def standards_only(spark: SparkSession, d: str) -> DataFrame:
    standards = load(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("locus"))
    return normalize.standards_only(counts(spark, d), standards, "locus")


@query("fpkm", f"WITH {_COUNTS}, t AS (SELECT library, sum(n)::DOUBLE AS mass FROM c GROUP BY ALL) SELECT locus, library, round(CASE WHEN p_size > 0 AND mass > 0 THEN n * 1e9 / (p_size * mass) ELSE 0 END, 4) AS fpkm FROM c JOIN t USING (library) JOIN part ON locus = p_partkey")
def fpkm(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    mass = c.groupBy("library").agg(F.sum("n").cast("double").alias("mass"))
    sizes = load(spark, d, "part").select(F.col("p_partkey").alias("locus"), "p_size")
    return c.join(F.broadcast(mass), "library").join(sizes, "locus").select("locus", "library", F.round(abundance.fpkm(F.col("n"), F.col("p_size"), F.col("mass")), 4).alias("fpkm"))


@query("kappa_share", "SELECT s_suppkey, s_nationkey, round(CASE WHEN sum(c) OVER w = 0 THEN 0 ELSE c / sum(c) OVER w END, 9) AS kappa FROM (SELECT *, abs(round(s_acctbal * 100)::BIGINT) AS c FROM supplier) WINDOW w AS (PARTITION BY s_nationkey)")
def kappa_share(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").withColumn("c", F.abs(F.round(F.col("s_acctbal") * 100).cast("bigint")))
    return abundance.shares(s, ["s_nationkey"], "c").select("s_suppkey", "s_nationkey", F.round("kappa", 9).alias("kappa"))


_TESTS = "t AS (SELECT l_orderkey * 10 + l_linenumber AS test_id, CASE WHEN l_linestatus = 'O' THEN 'OK' ELSE 'LOWDATA' END AS status, (round(l_discount * 100) * 1000003 + (l_orderkey * 7919 + l_linenumber * 104729) % 1000003 + 1) / 12000040.0::DOUBLE AS p_value FROM lineitem)"


@query("bh_fdr", f"WITH {_TESTS}, k AS (SELECT p_value, sum(count(*)) OVER (ORDER BY p_value) AS rank, sum(count(*)) OVER () AS n FROM t WHERE status = 'OK' GROUP BY p_value), q AS (SELECT p_value, least(1.0::DOUBLE, min(p_value * n / rank) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k) SELECT test_id, status, round(q, 10) AS q_value, coalesce(q <= 0.05, false) AS significant FROM t LEFT JOIN q ON t.p_value = q.p_value AND t.status = 'OK'")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("test_id"), F.when(F.col("l_linestatus") == "O", "OK").otherwise("LOWDATA").alias("status"),
        ((F.round(F.col("l_discount") * 100) * 1000003 + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000003 + 1) / 12000040.0).alias("p_value"),
    )
    return stats.fdr(t).select("test_id", "status", F.round("q_value", 10).alias("q_value"), "significant")


_SIDES = "s AS (SELECT l_partkey, coalesce(sum(round(l_quantity)) FILTER (WHERE l_returnflag = 'A'), 0) AS a, coalesce(sum(round(l_quantity)) FILTER (WHERE l_returnflag = 'R'), 0) AS b FROM lineitem GROUP BY ALL)"


@query("log2_fold_change", f"WITH {_SIDES} SELECT l_partkey, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 THEN 'inf'::DOUBLE WHEN b = 0 THEN '-inf'::DOUBLE ELSE round(log2(b / a), 9) END AS log2_fold_change FROM s")
def log2_fold_change(spark: SparkSession, d: str) -> DataFrame:
    side = lambda x: F.coalesce(F.sum(F.when(F.col("l_returnflag") == x, F.round("l_quantity"))), F.lit(0.0))
    s = load(spark, d, "lineitem").groupBy("l_partkey").agg(side("A").alias("a"), side("R").alias("b"))
    f = stats.log2_fold_change(F.col("a"), F.col("b"))
    return s.select("l_partkey", F.when(F.abs(f) == float("inf"), f).otherwise(F.round(f, 9)).alias("log2_fold_change"))


@query("test_status", f"WITH {_SIDES} SELECT l_partkey, CASE WHEN a > 800 OR b > 800 THEN 'HIDATA' WHEN a < 50 OR b < 50 THEN 'LOWDATA' WHEN a + b < 300 THEN 'NOTEST' ELSE 'OK' END AS status FROM s")
def test_status(spark: SparkSession, d: str) -> DataFrame:
    side = lambda x: F.coalesce(F.sum(F.when(F.col("l_returnflag") == x, F.round("l_quantity"))), F.lit(0.0))
    s = load(spark, d, "lineitem").groupBy("l_partkey").agg(side("A").alias("a"), side("R").alias("b"))
    level = lambda c: F.when(c > 800, "HIDATA").when(c < 50, "LOWDATA").otherwise("OK")
    return s.select("l_partkey", stats.test_status(level(F.col("a")), level(F.col("b")), F.col("a") + F.col("b") >= 300).alias("status"))


@query("default_contrasts", "SELECT a.r_name AS condition_1, b.r_name AS condition_2 FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def default_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return workflows.all_contrasts(load(spark, d, "region"), "r_name", "r_regionkey")


@query("time_series_contrasts", "SELECT a.r_name AS condition_1, b.r_name AS condition_2 FROM region a JOIN region b ON b.r_regionkey = (SELECT min(r_regionkey) FROM region c WHERE c.r_regionkey > a.r_regionkey)")
def time_series_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return workflows.time_series(load(spark, d, "region"), "r_name", "r_regionkey")


_MIX = """m AS (SELECT user_id % 50 AS cohort, event_type, count(*) FILTER (WHERE user_id % 2 = event_id % 2) AS a, count(*) FILTER (WHERE user_id % 2 <> event_id % 2) AS b FROM events GROUP BY ALL)"""


def _mix(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("user_id") % 2 == F.col("event_id") % 2
    return load(spark, d, "events").groupBy((F.col("user_id") % 50).alias("cohort"), "event_type").agg(F.count_if(even).alias("a"), F.count_if(~even).alias("b"))


@query("js_distance", f"WITH {_MIX}, p AS (SELECT cohort, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q, sum(a) OVER w AS sa, sum(b) OVER w AS sb FROM m WINDOW w AS (PARTITION BY cohort)), h AS (SELECT cohort, (p + q) / 2 AS m, p, q FROM p WHERE sa > 0 AND sb > 0) SELECT cohort, round(sqrt(greatest(0, sum(CASE WHEN m > 0 THEN -m * ln(m) ELSE 0 END - (CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END + CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END) / 2))), 7) AS js FROM h GROUP BY cohort")
def js_distance(spark: SparkSession, d: str) -> DataFrame:
    return stats.js_distance(_mix(spark, d), ["cohort"], "a", "b").withColumn("js", F.round("js", 7))


@query("split_tests", """WITH v AS (SELECT l_suppkey AS g, l_linenumber AS m, l_returnflag AS c, month(l_shipdate) AS r, sum(round(l_quantity))::DOUBLE AS v FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
a AS (SELECT g, c, m, avg(v) AS mean, count(*) AS n FROM v GROUP BY ALL),
f AS (SELECT g, c, m, coalesce(mean, 0) AS mean, coalesce(n, 0) AS n FROM (SELECT DISTINCT g, m FROM v) JOIN (SELECT DISTINCT g, c FROM v) USING (g) LEFT JOIN a USING (g, c, m)),
s AS (SELECT g, c, m, mean / sum(mean) OVER (PARTITION BY g, c) AS p, max(n) OVER (PARTITION BY g, c) AS n FROM f),
h AS (SELECT x.g, x.p, y.p AS q, (x.p + y.p) / 2 AS k, least(x.n, y.n) AS n FROM s x JOIN s y ON x.g = y.g AND x.m = y.m AND x.c = 'A' AND y.c = 'R'),
j AS (SELECT g, min(n) AS n, count(*) AS members, sqrt(greatest(0, sum(CASE WHEN k > 0 THEN -k * ln(k) ELSE 0 END) - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END + CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END) / 2)) AS js FROM h GROUP BY g)
SELECT g AS l_suppkey, 'A' AS condition_1, 'R' AS condition_2, CASE WHEN members < 2 THEN 0 ELSE round(js, 6) END AS js, CASE WHEN members < 2 OR round(js, 12) = 0 OR n < 3 THEN 'NOTEST' ELSE 'OK' END AS status FROM j""")
def split_tests(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a supplier's orders as members, return flags as conditions, months as replicates. (p-values are drawn: not in SQL.)"""
    flags = load(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    values = flags.groupBy("l_suppkey", F.col("l_linenumber").alias("member"), F.col("l_returnflag").alias("condition"), F.month("l_shipdate").alias("replicate")).agg(F.sum(F.round("l_quantity")).alias("value"))
    contrasts = spark.createDataFrame([("A", "R")], "condition_1 string, condition_2 string")
    found = stats.split_tests(values.withColumns({"variance": F.col("value"), "status": F.lit("OK")}), contrasts, ["l_suppkey"], "member", draws=100)
    return found.select("l_suppkey", "condition_1", "condition_2", F.round("js", 6).alias("js"), "status")


@query("specificity", f"WITH {_MIX}, t AS (SELECT cohort, event_type, (a + b) / sum(a + b) OVER (PARTITION BY cohort) AS p FROM m), x AS (SELECT s.cohort, s.event_type, sum(CASE WHEN z.p > 0 THEN -z.p * ln(z.p) ELSE 0 END) AS h, sum(CASE WHEN z.event_type = s.event_type THEN -((z.p + 1) / 2) * ln((z.p + 1) / 2) WHEN z.p > 0 THEN -(z.p / 2) * ln(z.p / 2) ELSE 0 END) AS hm FROM t s JOIN t z USING (cohort) GROUP BY ALL) SELECT cohort, event_type, round(1 - sqrt(greatest(0, hm - h / 2)) / sqrt(ln(2)), 7) AS specificity FROM x")
def specificity(spark: SparkSession, d: str) -> DataFrame:
    m = _mix(spark, d).withColumn("n", F.col("a") + F.col("b"))
    return stats.specificity(m, "cohort", "event_type", "n").withColumn("specificity", F.round("specificity", 7))


_LENGTHS = "n AS (SELECT lang, (n_chars // 100)::BIGINT AS len, count(*) AS n FROM documents GROUP BY ALL), f AS (SELECT lang, len, n / sum(n) OVER (PARTITION BY lang) AS pdf, sum(n) OVER (PARTITION BY lang ORDER BY len) / sum(n) OVER (PARTITION BY lang) AS cdf FROM n)"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("lang", F.expr("n_chars div 100").alias("l"))
    return abundance.length_distribution(docs, "lang", "l")


@query("fragment_length_pdf_cdf", f"WITH {_LENGTHS} SELECT lang, len, round(pdf, 9) AS pdf, round(cdf, 9) AS cdf FROM f")
def fragment_length_pdf_cdf(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("lang", "len", F.round("pdf", 9).alias("pdf"), F.round("cdf", 9).alias("cdf"))


@query("effective_length", f"WITH {_LENGTHS} SELECT p_partkey, lang, round(sum(pdf * (p_size - len + 1)), 7) AS effective_length FROM part JOIN f ON len <= p_size GROUP BY ALL")
def effective_length(spark: SparkSession, d: str) -> DataFrame:
    models = load(spark, d, "part").select("p_partkey", "p_size")
    return abundance.effective_lengths(models, _lengths(spark, d), "p_partkey", "p_size", "lang").withColumn("effective_length", F.round("effective_length", 7))


@query("conf_interval", "SELECT o_custkey, round(greatest(0, avg(c) - 2 * coalesce(stddev_samp(c), 0)), 4) AS lo, round(avg(c) + 2 * coalesce(stddev_samp(c), 0), 4) AS hi FROM (SELECT o_custkey, round(o_totalprice * 100)::BIGINT AS c FROM orders) GROUP BY ALL")
def conf_interval(spark: SparkSession, d: str) -> DataFrame:
    c = F.round(F.col("o_totalprice") * 100).cast("bigint")
    m = load(spark, d, "orders").groupBy("o_custkey").agg(F.avg(c).alias("m"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("s"))
    lo, hi = abundance.confidence(F.col("m"), F.col("s"))
    return m.select("o_custkey", F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


@query("accuracy_sn_pr", "WITH x AS (SELECT doc_id, contains(text, '$$$') OR contains(text, '!!') AS called, quality = 0 AS truth FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) FILTER (WHERE called AND truth) AS tp, count(*) FILTER (WHERE called AND NOT truth) AS fp, count(*) FILTER (WHERE NOT called AND truth) AS fn, round(count(*) FILTER (WHERE called AND truth) / nullif(count(*) FILTER (WHERE truth), 0), 9) AS sensitivity, round(count(*) FILTER (WHERE called AND truth) / nullif(count(*) FILTER (WHERE called), 0), 9) AS precision FROM x JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang")
def accuracy_sn_pr(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "lang", (F.contains("text", F.lit("$$$")) | F.contains("text", F.lit("!!"))).alias("called"))
    x = docs.join(load(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("truth")), "doc_id")
    tp, fp, fn = F.count_if(F.col("called") & F.col("truth")), F.count_if(F.col("called") & ~F.col("truth")), F.count_if(~F.col("called") & F.col("truth"))
    sums = x.groupBy("lang").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return sums.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 9).alias("sensitivity"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 9).alias("precision"))


@query("start_sites", "WITH i AS (SELECT s_suppkey, s_nationkey, s, CASE WHEN s >= max(s + 1) OVER (PARTITION BY s_nationkey ORDER BY s, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 1 ELSE 0 END AS new FROM (SELECT *, floor(s_acctbal)::BIGINT AS s FROM supplier)) SELECT s_suppkey, (1 + sum(new) OVER (PARTITION BY s_nationkey ORDER BY s, s_suppkey ROWS UNBOUNDED PRECEDING))::BIGINT AS tss FROM i")
def start_sites(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").withColumn("s", F.floor("s_acctbal"))
    return cluster.start_sites(s, ["s_nationkey"], "s", 100, ["s_suppkey"]).select("s_suppkey", "tss")


def _labels_sql() -> str:
    """Least labels of neighbours, then the label's own label, in so many rounds that they settle on the tables."""
    steps = [
        "f AS (SELECT l_orderkey, min(l_partkey) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)",
        "e AS MATERIALIZED (SELECT DISTINCT l_partkey AS x, y FROM lineitem JOIN f USING (l_orderkey) WHERE l_returnflag = 'R' AND l_partkey <> y)",
        "b AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e)",
        "l0 AS (SELECT p_partkey AS n, p_partkey AS l FROM part)",
    ]
    for k in range(8):
        steps.append(f"m{k} AS MATERIALIZED (SELECT n, least(l, coalesce((SELECT min(o.l) FROM b JOIN l{k} o ON b.y = o.n WHERE b.x = l{k}.n), l)) AS l FROM l{k})")
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT a.n, least(a.l, z.l) AS l FROM m{k} a JOIN l{k} z ON a.l = z.n)")
    return "WITH " + ", ".join(steps) + " SELECT n AS p_partkey, l AS component FROM l8"


@query("cluster_components", _labels_sql())
def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    """Parts linked by orders that returned them together; an order links its parts to its least one."""
    lines = load(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    first = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first"))
    parts = load(spark, d, "part").select("p_partkey")
    return cluster.label_components(parts, lines.join(first, "l_orderkey"), "p_partkey", "l_partkey", "first")


@query("cluster_components_all_orders", _labels_sql())
def cluster_components_all_orders(spark: SparkSession, d: str) -> DataFrame:
    """The same, under the name it had while cluster_components took a part of the orders."""
    return cluster_components(spark, d)


@query("group_effective_length", "WITH c AS (SELECT l_partkey, sum(round(l_quantity))::DOUBLE AS q FROM lineitem GROUP BY ALL) SELECT p_brand, round(CASE WHEN sum(q) = 0 THEN 0 ELSE sum(p_size * q) / sum(q) END, 6) AS effective_length FROM part JOIN c ON p_partkey = l_partkey GROUP BY p_brand")
def group_effective_length(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.round("l_quantity")).alias("q"))
    members = load(spark, d, "part").join(q, F.col("p_partkey") == F.col("l_partkey"))
    return fragments.group_effective_length(members, ["p_brand"], "p_size", "q").withColumn("effective_length", F.round("effective_length", 6))


@query("id_sets", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag, coalesce(string_agg(DISTINCT nullif(CASE WHEN l_quantity > 25 THEN l_suppkey::VARCHAR ELSE '' END, ''), ',' ORDER BY nullif(CASE WHEN l_quantity > 25 THEN l_suppkey::VARCHAR ELSE '' END, '')), '-') AS large FROM lineitem GROUP BY ALL")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").withColumn("large", F.when(F.col("l_quantity") > 25, F.col("l_suppkey").cast("string")).otherwise(""))
    return fragments.id_sets(lines, ["l_orderkey"], ["l_returnflag", "large"])


@query("replicate_means", "SELECT l_partkey, round(sum(l_quantity) / 3, 6) AS l_quantity, round(sum(l_discount) / 3, 6) AS l_discount FROM lineitem GROUP BY ALL")
def replicate_means(spark: SparkSession, d: str) -> DataFrame:
    """Return flags as the three replicates of a part."""
    rows = load(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("l_quantity"), F.sum("l_discount").alias("l_discount"))
    means = fragments.replicate_means(rows, ["l_partkey"], ["l_quantity", "l_discount"], 3)
    return means.select("l_partkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query("multimapping_junctions", "SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_tax > 0.04) AS multi FROM lineitem GROUP BY ALL HAVING multi / n > 0.5")
def multimapping_junctions(spark: SparkSession, d: str) -> DataFrame:
    reads = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0.04).alias("multi"))
    return filters.multimapping_junctions(reads)


@query("annotated_clusters", "SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS cluster FROM supplier")
def annotated_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.annotated_clusters(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", ["s_nationkey"]).select("s_suppkey", "cluster")


@query("em_mixture")
def em_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Orders as fragments, suppliers as models, the nation's suppliers as a locus; closer parts are likelier."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(F.broadcast(load(spark, d, "supplier").select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    compat = lines.groupBy("s_nationkey", "l_orderkey", "s_suppkey").agg((1 / F.round(F.max("l_quantity"))).alias("p")).withColumn("mass", F.lit(1.0))
    return abundance.mixtures(compat, "s_nationkey", "l_orderkey", "s_suppkey", "p", "mass").withColumn("gamma", F.round("gamma", 6))


@query("resampling_test")
def resampling_test(spark: SparkSession, d: str) -> DataFrame:
    side = lambda x: F.coalesce(F.sum(F.when(F.col("l_returnflag") == x, F.round("l_quantity"))), F.lit(0.0))
    s = load(spark, d, "lineitem").groupBy("l_partkey").agg(side("A").alias("a"), side("R").alias("b"))
    s = s.withColumns({"va": F.col("a") * 1.5, "vb": F.col("b") * 1.5})
    return stats.resampled_p(s, "l_partkey", "a", "va", "b", "vb")


@query("bad_splices", """WITH r AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_quantity <= 5) AS small FROM lineitem GROUP BY ALL),
t AS (SELECT l_partkey, n, small, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.1) + (n - j) * ln(0.9))) AS p FROM (SELECT *, unnest(range(small, n + 1)) AS j FROM r WHERE small > 0) GROUP BY ALL)
SELECT l_partkey, n, small, round(p, 9) AS p_value FROM t WHERE p < 0.05""")
def bad_splices(spark: SparkSession, d: str) -> DataFrame:
    """Parts as junctions, lines as reads; a small quantity is a small anchor."""
    reads = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") <= 5).alias("small"))
    return stats.bad_junctions(reads, "n", "small", 0.1, 0.05).withColumn("p_value", F.round("p_value", 9))


@query("kmeans_assign")
def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    m = _mix(spark, d)
    every = m.select("cohort").distinct().crossJoin(F.broadcast(m.select("event_type").distinct())).join(m, ["cohort", "event_type"], "left").withColumn("n", F.coalesce(F.col("a") + F.col("b"), F.lit(0)))
    return cluster.js_kmeans(abundance.shares(every, ["cohort"], "n", "p"), 4, "cohort", "event_type", "p")

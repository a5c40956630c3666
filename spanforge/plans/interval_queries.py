"""Interval and fragment operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators import fragments, intervals
from spanforge.plans.registry import query


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(column: str, micros: int):
    """A timestamp without zone as whole units since 1970, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column}) div {micros}")


def event_spans(spark: SparkSession, d: str) -> DataFrame:
    """events as intervals of an hour, in seconds."""
    e = load(spark, d, "events")
    lo = units("ts", 1000000)
    return e.select("event_id", "user_id", "event_type", lo.alias("lo"), (lo + 3600).alias("hi"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


_EVENTS = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 3600 AS hi, round(value * 100)::BIGINT AS cents FROM events)"
_ISLANDS = _EVENTS + """,
i AS (SELECT *, CASE WHEN lo >= max(hi) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 1 ELSE 0 END AS new FROM e),
j AS (SELECT *, 1 + sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS UNBOUNDED PRECEDING) AS island FROM i)"""


@query("bundle_mass", f"WITH {_ISLANDS} SELECT user_id, island::BIGINT AS island, min(lo) AS lo, max(hi) AS hi, count(*) AS n, sum(cents)::BIGINT AS cents FROM j GROUP BY user_id, island")
def bundle_mass(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(event_spans(spark, d), ["user_id"], slack=50, order=["event_id"], aggregates=[F.sum("cents").alias("cents")])


@query("interval_merge", f"WITH {_ISLANDS} SELECT event_id, user_id, island::BIGINT AS island FROM j")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return intervals.islands(event_spans(spark, d), ["user_id"], slack=50, order=["event_id"]).select("event_id", "user_id", "island")


def order_spans(spark: SparkSession, d: str) -> DataFrame:
    """orders as 30-day spans, in days."""
    day = units("o_orderdate", 86400000000)
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", day.alias("lo"), (day + 30).alias("hi"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderpriority, epoch_us(o_orderdate) // 86400000000 AS lo, epoch_us(o_orderdate) // 86400000000 + 30 AS hi, round(o_totalprice * 100)::BIGINT AS cents FROM orders)"


@query("interval_overlap_join", f"WITH {_ORDERS} SELECT a.o_orderkey AS a, b.o_orderkey AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS shared FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.lo < b.hi AND b.lo < a.hi AND a.o_orderkey < b.o_orderkey")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    o = order_spans(spark, d).select("o_orderkey", "o_custkey", "lo", "hi")
    pairs = intervals.range_join(o, o, ["o_custkey"], bin=60).where("o_orderkey < o_orderkey_r")
    return pairs.select(F.col("o_orderkey").alias("a"), F.col("o_orderkey_r").alias("b"), intervals.overlap_length(F.col("lo"), F.col("hi"), F.col("lo_r"), F.col("hi_r")).cast("bigint").alias("shared"))


@query("interval_containment_join", f"WITH {_ORDERS} SELECT a.o_orderkey AS model, b.o_orderkey AS hit FROM (SELECT *, lo - 10 AS mlo, hi + 10 AS mhi FROM o WHERE o_orderpriority LIKE '1%') a JOIN o b ON a.o_custkey = b.o_custkey AND a.mlo <= b.lo AND b.hi <= a.mhi AND a.o_orderkey <> b.o_orderkey")
def interval_containment_join(spark: SparkSession, d: str) -> DataFrame:
    o = order_spans(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority", "lo", "hi")
    models = o.where(F.col("o_orderpriority").startswith("1")).withColumns({"lo": F.col("lo") - 10, "hi": F.col("hi") + 10})
    pairs = intervals.range_join(models, o, ["o_custkey"], bin=60)
    inside = intervals.contains(F.col("lo"), F.col("hi"), F.col("lo_r"), F.col("hi_r"))
    return pairs.where(inside & (F.col("o_orderkey") != F.col("o_orderkey_r"))).select(F.col("o_orderkey").alias("model"), F.col("o_orderkey_r").alias("hit"))


_STEPS = "s AS (SELECT {g}, pos, sum(d) AS d FROM (SELECT {g}, lo AS pos, 1 AS d FROM {t} UNION ALL SELECT {g}, hi, -1 FROM {t}) GROUP BY {g}, pos HAVING sum(d) <> 0), c AS (SELECT {g}, pos AS lo, lead(pos) OVER w AS hi, sum(d) OVER (PARTITION BY {g} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM s WINDOW w AS (PARTITION BY {g} ORDER BY pos))"


@query("interval_coverage", f"WITH {_EVENTS}, {_STEPS.format(g='user_id', t='e')} SELECT user_id, lo, hi, depth::BIGINT AS depth FROM c WHERE hi IS NOT NULL AND depth <> 0")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coverage(event_spans(spark, d), ["user_id"])


@query("nearest_preceding", f"WITH {_EVENTS}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, lo, max(event_id) AS view FROM e WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, CASE WHEN v.lo >= p.lo - 86400 THEN v.view END AS view_before FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.lo >= v.lo")
def nearest_preceding(spark: SparkSession, d: str) -> DataFrame:
    e = event_spans(spark, d)
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "lo")
    seen = e.where("event_type = 'view'").select("user_id", "lo", F.col("event_id").alias("view"))
    return intervals.nearest_preceding(bought, seen, ["user_id"], "lo", "view", 86400).select("event_id", "view_before")


@query("union_model", f"WITH {_ORDERS}, i AS (SELECT *, CASE WHEN lo >= max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM o), j AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM i) SELECT o_custkey, min(lo) AS lo, max(hi) AS hi FROM j GROUP BY o_custkey, k")
def union_model(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_model(order_spans(spark, d), ["o_custkey"])


_LINES = "l AS (SELECT DISTINCT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 86400000000 AS lo, epoch_us(l_shipdate) // 86400000000 + 20 AS hi FROM lineitem)"


@query("intersection_model", f"WITH {_LINES}, {_STEPS.format(g='l_orderkey', t='l')}, n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM l GROUP BY ALL) SELECT l_orderkey, lo, hi FROM c JOIN n USING (l_orderkey) WHERE depth = n AND hi IS NOT NULL")
def intersection_model(spark: SparkSession, d: str) -> DataFrame:
    day = units("l_shipdate", 86400000000)
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day.alias("lo"), (day + 20).alias("hi")).distinct()
    return intervals.intersection_model(lines, ["l_orderkey"], "l_linenumber").select("l_orderkey", "lo", "hi")


_PARTS = "c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT p_partkey, p_brand, p_partkey AS lo, p_partkey + p_size AS hi, n FROM part JOIN c ON p_partkey = l_partkey)"


@query("junction_filter_minor", f"WITH {_PARTS} SELECT p_partkey, n FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND a.lo < b.hi AND b.lo < a.hi AND a.n < b.n * 0.6)")
def junction_filter_minor(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    spans = load(spark, d, "part").join(counts, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_brand", "n", F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    return intervals.minor(spans, ["p_brand"], "p_partkey", "n", 0.6, bin=50).select("p_partkey", "n")


@query("masked_out", f"WITH {_ORDERS}, m AS (SELECT o_custkey, lo - 5 AS lo, hi + 5 AS hi FROM o WHERE o_orderpriority LIKE '5%') SELECT o_orderkey FROM o a WHERE o_orderpriority NOT LIKE '5%' AND NOT EXISTS (SELECT 1 FROM m WHERE m.o_custkey = a.o_custkey AND m.lo <= a.lo AND a.hi <= m.hi)")
def masked_out(spark: SparkSession, d: str) -> DataFrame:
    """Hits that lie fully inside a mask go, whatever the order of either."""
    o = order_spans(spark, d)
    mask = o.where(F.col("o_orderpriority").startswith("5")).select("o_custkey", (F.col("lo") - 5).alias("lo"), (F.col("hi") + 5).alias("hi"))
    hits = o.where(~F.col("o_orderpriority").startswith("5")).select("o_orderkey", "o_custkey", "lo", "hi")
    inside = intervals.range_join(hits, mask, ["o_custkey"], bin=60).where(intervals.contains(F.col("lo_r"), F.col("hi_r"), F.col("lo"), F.col("hi")))
    return hits.join(inside.select("o_orderkey").distinct(), "o_orderkey", "left_anti").select("o_orderkey")


@query("mate_pairing", """WITH r AS (SELECT l_orderkey, l_partkey % 2 AS contig, l_linenumber, l_linenumber AS left_, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber + 1 ELSE l_linenumber - 1 END AS mate, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2, l_linenumber) AS k FROM lineitem)
SELECT a.l_orderkey, a.contig, a.left_ AS "left", b.left_ AS mate_left, a.l_linenumber, b.l_linenumber AS mate_l_linenumber FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.contig = b.contig AND a.mate = b.left_ AND b.mate = a.left_ AND a.left_ < b.left_ AND a.k = b.k""")
def mate_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as alignments: an odd line's mate is the next one, if it lies on the same contig."""
    n = F.col("l_linenumber")
    reads = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 2).alias("contig"), "l_linenumber", n.alias("left"), F.when(n % 2 == 1, n + 1).otherwise(n - 1).alias("mate_left"))
    return fragments.paired(reads, "l_orderkey", "contig", "left", "mate_left", "l_linenumber")


@query("fragment_collapse", "SELECT l_partkey, l_returnflag, l_linestatus, sum(round(l_quantity)::BIGINT)::BIGINT AS mass, count(*) AS copies FROM lineitem GROUP BY ALL")
def fragment_collapse(spark: SparkSession, d: str) -> DataFrame:
    return fragments.collapsed(load(spark, d, "lineitem"), ["l_partkey", "l_returnflag", "l_linestatus"], F.round("l_quantity").cast("bigint"))


_MULTI = "u AS (SELECT l_suppkey, l_orderkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)), m AS (SELECT l_suppkey, round(sum(weight), 6) AS mass FROM u GROUP BY ALL)"


@query("multiread_uniform", f"WITH {_MULTI} SELECT * FROM m")
def multiread_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reads that map to all their suppliers."""
    places = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return fragments.uniform_shares(places, "l_orderkey").groupBy("l_suppkey").agg(F.round(F.sum("weight"), 6).alias("mass"))


@query("multiread_rescue", f"WITH {_MULTI}, w AS (SELECT l_suppkey, mass / sum(mass) OVER (PARTITION BY l_orderkey) AS weight FROM u JOIN m USING (l_suppkey)) SELECT l_suppkey, round(sum(weight), 4) AS mass FROM w GROUP BY ALL")
def multiread_rescue(spark: SparkSession, d: str) -> DataFrame:
    places = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    first = multiread_uniform(spark, d)
    return fragments.rescued_shares(places.join(first, "l_suppkey"), "l_orderkey", "mass").groupBy("l_suppkey").agg(F.round(F.sum("weight"), 4).alias("mass"))


@query("fragment_cap", "SELECT l_orderkey, l_linenumber, CASE WHEN n > 3 THEN 'HIDATA' ELSE 'OK' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE k <= 3")
def fragment_cap(spark: SparkSession, d: str) -> DataFrame:
    return fragments.capped(load(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], 3).select("l_orderkey", "l_linenumber", "status")


@query("status_policy", "WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_partkey, CASE WHEN n > 5 THEN 'HIDATA' WHEN n = 1 THEN 'LOWDATA' ELSE 'OK' END AS status FROM c) SELECT l_partkey, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'HIDATA') THEN 'HIDATA' WHEN bool_or(status = 'OK') THEN 'OK' ELSE 'LOWDATA' END AS status FROM s GROUP BY ALL")
def status_policy(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    status = counts.withColumn("status", F.when(F.col("n") > 5, "HIDATA").when(F.col("n") == 1, "LOWDATA").otherwise("OK"))
    return status.groupBy("l_partkey").agg(fragments.group_status(F.col("status")).alias("status"))


@query("level_rollup", """WITH s AS (SELECT p_partkey, p_type, p_brand, round(l_quantity)::BIGINT AS q FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'isoform' AS level, p_brand || '|' || p_type || '|' || p_partkey AS key, sum(q)::BIGINT AS q FROM s GROUP BY ALL
UNION ALL SELECT 'tss_group', p_brand || '|' || p_type, sum(q)::BIGINT FROM s GROUP BY ALL UNION ALL SELECT 'gene', p_brand, sum(q)::BIGINT FROM s GROUP BY ALL""")
def level_rollup(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    s = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("q")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return fragments.rolled_up(s, {"isoform": ["p_brand", "p_type", "p_partkey"], "tss_group": ["p_brand", "p_type"], "gene": ["p_brand"]}, ["q"])


@query("best_overlap", f"WITH {_ORDERS} SELECT a, b, shared FROM (SELECT a.o_orderkey AS a, b.o_orderkey AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS shared, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY least(a.hi, b.hi) - greatest(a.lo, b.lo) DESC, b.cents DESC, b.o_orderkey) AS k FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.lo < b.hi AND b.lo < a.hi AND a.o_orderkey <> b.o_orderkey) WHERE k = 1")
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = order_spans(spark, d).select("o_orderkey", "o_custkey", "lo", "hi", "cents")
    pairs = intervals.range_join(o, o, ["o_custkey"], bin=60).where("o_orderkey <> o_orderkey_r").withColumn("shared", intervals.overlap_length(F.col("lo"), F.col("hi"), F.col("lo_r"), F.col("hi_r")).cast("bigint"))
    w = Window.partitionBy("o_orderkey").orderBy(F.desc("shared"), F.desc("cents_r"), "o_orderkey_r")
    return pairs.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("o_orderkey").alias("a"), F.col("o_orderkey_r").alias("b"), "shared")


@query("class_code", f"""WITH {_ORDERS}, r AS (SELECT * FROM o WHERE o_orderpriority LIKE '1%'), q AS (SELECT o_orderkey, o_custkey, lo + o_orderkey % 7 AS lo, hi - o_orderkey % 5 AS hi FROM o WHERE o_orderpriority NOT LIKE '1%'),
p AS (SELECT q.o_orderkey, r.o_orderkey AS ref, least(q.hi, r.hi) - greatest(q.lo, r.lo) AS shared, q.hi - q.lo AS ql, r.hi - r.lo AS rl FROM q JOIN r ON q.o_custkey = r.o_custkey AND q.lo < r.hi AND r.lo < q.hi),
c AS (SELECT *, CASE WHEN shared >= 0.8 * greatest(ql, rl) OR shared >= 0.9 * rl THEN '=' WHEN ql < rl AND shared >= 0.8 * ql THEN 'c' ELSE 'o' END AS code FROM p
  UNION ALL SELECT q.o_orderkey, r.o_orderkey, 0, q.hi - q.lo, r.hi - r.lo, 'p' FROM q JOIN r ON q.o_custkey = r.o_custkey AND q.lo < r.hi + 2000 AND r.hi < q.hi),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE code WHEN '=' THEN 0 WHEN 'c' THEN 2 WHEN 'o' THEN 8 ELSE 90 END, shared DESC, rl DESC, ref) AS n FROM c)
SELECT q.o_orderkey, coalesce(k.code, 'u') AS code, k.ref AS reference FROM q LEFT JOIN k ON q.o_orderkey = k.o_orderkey AND k.n = 1""")
def class_code(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a customer's orders as single-exon models against those of urgent orders."""
    from spanforge.operators.structure import classified

    o = order_spans(spark, d)

    def model(df: DataFrame, lo, hi) -> DataFrame:
        return df.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contig"), F.lit("+").alias("strand"), F.array(F.struct((lo + 1).cast("int").alias("lo"), hi.cast("int").alias("hi"))).alias("exons"))

    urgent = F.col("o_orderpriority").startswith("1")
    reference = model(o.where(urgent), F.col("lo"), F.col("hi"))
    asked = model(o.where(~urgent), F.col("lo") + F.col("o_orderkey") % 7, F.col("hi") - F.col("o_orderkey") % 5)
    return classified(asked, reference, bin=60).select(F.col("id").alias("o_orderkey"), "code", "reference")

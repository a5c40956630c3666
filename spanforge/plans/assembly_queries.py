"""Assembly, filters, depth, comparison and dispersion over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import assemble, compare, dispersion, filters, intervals, normalize, structure
from spanforge.plans.interval_queries import load, order_spans, units
from spanforge.plans.registry import query
from spanforge.plans.statistics_queries import counts
from spanforge.session import shared_dir
from spanforge.sources import gff, sam

_LINE_EXONS = """l AS (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS dataset, epoch_us(l_shipdate) // 86400000000 AS d FROM lineitem),
s AS (SELECT *, CASE WHEN d > max(d) OVER (PARTITION BY l_orderkey, dataset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 1 ELSE 0 END AS new FROM l),
k AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY l_orderkey, dataset ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM s),
x AS (SELECT l_orderkey, dataset, min(d)::INT AS lo, (max(d) + 9)::INT AS hi FROM k GROUP BY l_orderkey, dataset, k)"""


def order_models(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, id, contig, strand, exons): the ship days of an order's lines as exons of ten days, by supplier modulo three."""
    day = units("l_shipdate", 86400000000)
    lines = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("dataset"), day.alias("lo"), (day + 10).alias("hi"))
    # An order has few lines: there is nothing to cut into ranges.
    exons = intervals.merged(lines, ["l_orderkey", "dataset"], slack=1, width=None)
    grouped = exons.groupBy("l_orderkey", "dataset").agg(F.array_sort(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), (F.col("hi") - 1).cast("int").alias("hi")))).alias("exons"))
    return grouped.select("dataset", F.concat_ws(".", "l_orderkey", "dataset").alias("id"), F.col("l_orderkey").alias("contig"), F.lit("+").alias("strand"), "exons")


@query("model_exons", f"WITH {_LINE_EXONS} SELECT l_orderkey AS contig, dataset, lo, hi FROM x")
def model_exons(spark: SparkSession, d: str) -> DataFrame:
    return order_models(spark, d).select("contig", "dataset", F.explode("exons").alias("e")).select("contig", "dataset", "e.lo", "e.hi")


def _accuracy_sql() -> str:
    keys = {
        "exon": "SELECT DISTINCT l_orderkey, lo || '-' || hi AS key FROM x WHERE dataset = {n}",
        "intron": "SELECT DISTINCT l_orderkey, unnest([(b[i] + 1) || '-' || (a[i + 1] - 1) FOR i IN range(1, len(a))]) AS key FROM g WHERE dataset = {n}",
        "intron_chain": "SELECT DISTINCT l_orderkey, array_to_string([(b[i] + 1) || '-' || (a[i + 1] - 1) FOR i IN range(1, len(a))], ',') AS key FROM g WHERE dataset = {n} AND len(a) > 1",
        "transcript": "SELECT DISTINCT l_orderkey, a::VARCHAR || b::VARCHAR AS key FROM g WHERE dataset = {n}",
    }
    levels = [
        f"SELECT '{k}' AS level, (SELECT count(*) FROM ({v.format(n=0)})) AS q, (SELECT count(*) FROM ({v.format(n=1)})) AS r, (SELECT count(*) FROM ({v.format(n=0)}) JOIN ({v.format(n=1)}) USING (l_orderkey, key)) AS m"
        for k, v in keys.items()
    ]
    span = "(SELECT sum(hi - lo + 1) FROM x WHERE dataset = {n})::BIGINT"
    shared = "(SELECT sum(least(q.hi, r.hi) - greatest(q.lo, r.lo) + 1) FROM x q JOIN x r ON q.l_orderkey = r.l_orderkey AND q.lo <= r.hi AND r.lo <= q.hi WHERE q.dataset = 0 AND r.dataset = 1)::BIGINT"
    levels.append(f"SELECT 'base', {span.format(n=0)}, {span.format(n=1)}, {shared}")
    return f"""WITH {_LINE_EXONS}, g AS (SELECT l_orderkey, dataset, list(lo ORDER BY lo) AS a, list(hi ORDER BY lo) AS b FROM x GROUP BY ALL), v AS ({" UNION ALL ".join(levels)})
SELECT level, q AS query, r AS reference, m AS matched, m / r AS sensitivity, m / q AS precision FROM v"""


@query("annotation_accuracy", _accuracy_sql())
def annotation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    m = order_models(spark, d)
    return compare.accuracy(m.where("dataset = 0"), m.where("dataset = 1"), bin=60)


@query("tracked_structures", f"""WITH {_LINE_EXONS}, g AS (SELECT l_orderkey, dataset, list(lo ORDER BY lo) AS a, list(hi ORDER BY lo) AS b FROM x GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT l_orderkey, dataset, array_to_string([(b[i] + 1)::VARCHAR || '-' || (a[i + 1] - 1)::VARCHAR FOR i IN range(1, len(a))], ',') AS structure FROM g)
SELECT l_orderkey AS contig, structure, string_agg(dataset::VARCHAR, ',' ORDER BY dataset) AS datasets FROM c GROUP BY ALL""")
def tracked_structures(spark: SparkSession, d: str) -> DataFrame:
    t = compare.tracked(order_models(spark, d))
    return t.select("contig", "structure", F.array_join(F.array_sort(F.transform(F.map_keys("members"), lambda k: k.cast("string"))), ",").alias("datasets"))


@query("three_prime_cut", """WITH b AS (SELECT user_id % 40 AS g, hour(ts) AS h, count(*)::DOUBLE AS y FROM events GROUP BY ALL),
s AS (SELECT *, count(*) OVER r AS n, sum(y) OVER r AS s, count(*) OVER w AS nn, sum(y) OVER w AS ss, sum(y * y) OVER w AS q FROM b WINDOW r AS (PARTITION BY g ORDER BY h ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY g)),
e AS (SELECT g, h, (ss - s) / (nn - n) / (s / n) AS drop_, round(q - s * s / n - (ss - s) * ((ss - s) / (nn - n)), 9) AS e FROM s WHERE n < nn)
SELECT g, h AS cut, round(drop_, 9) AS drop FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY e, h) AS k FROM e) WHERE k = 1""")
def three_prime_cut(spark: SparkSession, d: str) -> DataFrame:
    hour = (units("ts", 3600000000) % 24).alias("h")
    b = load(spark, d, "events").groupBy((F.col("user_id") % 40).alias("g"), hour).agg(F.count("*").alias("y"))
    return filters.three_prime_cut(b, ["g"], "h", "y").select("g", F.col("cut").cast("bigint").alias("cut"), F.round("drop", 9).alias("drop"))


_DEPTH = "o AS (SELECT o_orderkey, o_custkey, o_orderpriority, epoch_us(o_orderdate) // 86400000000 AS lo, epoch_us(o_orderdate) // 86400000000 + 30 AS hi FROM orders)"


@query("depth_along_models", f"""WITH {_DEPTH}, m AS (SELECT o_orderkey, o_custkey, unnest(range(lo, hi)) AS p FROM o WHERE o_orderpriority LIKE '1%'), r AS (SELECT o_custkey, lo, hi FROM o WHERE o_orderpriority NOT LIKE '1%'),
c AS (SELECT m.o_orderkey, m.p, count(r.lo) AS depth FROM m LEFT JOIN r ON m.o_custkey = r.o_custkey AND r.lo <= m.p AND m.p < r.hi GROUP BY ALL)
SELECT o_orderkey, round(avg(depth), 9) AS mean_depth, min(depth) AS min_depth FROM c GROUP BY ALL""")
def depth_along_models(spark: SparkSession, d: str) -> DataFrame:
    o = order_spans(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority", "lo", "hi")
    urgent = F.col("o_orderpriority").startswith("1")
    found = filters.depth_along(o.where(urgent), o.where(~urgent).select("o_custkey", "lo", "hi"), ["o_custkey"], "o_orderkey", bin=60)
    return found.select("o_orderkey", F.round("mean_depth", 9).alias("mean_depth"), F.col("min_depth").cast("bigint").alias("min_depth"))


@query("junk_models", "WITH c AS (SELECT l_partkey, l_suppkey, sum(round(l_quantity)::BIGINT)::BIGINT AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, l_suppkey, n FROM (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS top FROM c) WHERE n < 0.1 * top OR n = 0")
def junk_models(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("n"))
    return filters.junk_models(c, ["l_suppkey"], "n")


@query("tiled_models", "SELECT p_partkey, lo AS tile_lo, least(lo + 12, p_size) AS tile_hi FROM (SELECT DISTINCT p_partkey, p_size, unnest(list_append(range(0, greatest(0, p_size - 12) + 1, 5), greatest(0, p_size - 12))) AS lo FROM part)")
def tiled_models(spark: SparkSession, d: str) -> DataFrame:
    return filters.tiled(load(spark, d, "part").select("p_partkey", "p_size"), "p_size", 12, 5).select("p_partkey", "tile_lo", "tile_hi")


@query("projected_positions", f"WITH {_LINE_EXONS}, f AS (SELECT l_orderkey, dataset, lo, hi, sum(hi - lo + 1) OVER (PARTITION BY l_orderkey, dataset ORDER BY lo) - (hi - lo + 1) AS before, min(lo) OVER (PARTITION BY l_orderkey, dataset) + 15 AS p FROM x) SELECT l_orderkey AS contig, dataset, (max(before + p - lo) FILTER (WHERE p BETWEEN lo AND hi))::BIGINT AS place FROM f GROUP BY ALL")
def projected_positions(spark: SparkSession, d: str) -> DataFrame:
    m = order_models(spark, d).withColumn("half", F.transform("exons", lambda e: F.struct(e["lo"].alias("lo"), (e["hi"] + 1).alias("hi"))))
    return m.select("contig", "dataset", filters.projected(F.col("half"), F.get("half", F.lit(0))["lo"] + 15).alias("place"))


@query("weak_introns", "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT p_partkey, p_brand, p_partkey AS lo, p_partkey + p_size AS hi, n, avg(n) OVER (PARTITION BY p_brand) AS mean FROM part JOIN c ON p_partkey = l_partkey) SELECT p_partkey, n FROM p a WHERE n < 0.7 * mean OR EXISTS (SELECT 1 FROM p b WHERE a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND a.lo < b.hi AND b.lo < a.hi AND a.n < 0.7 * b.n)")
def weak_introns(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = load(spark, d, "part").join(c, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_brand", "n", F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    return filters.weak_introns(p, ["p_brand"], "p_partkey", "n", 0.7, 50).select("p_partkey", "n")


@query("redundant_models", f"""WITH {_LINE_EXONS}, g AS (SELECT l_orderkey, l_orderkey || '.' || dataset AS id, list(lo ORDER BY lo) AS a, list(hi ORDER BY lo) AS b FROM x GROUP BY l_orderkey, dataset),
m AS (SELECT * FROM g UNION ALL SELECT l_orderkey, id || '.t', a[1:len(a) - 1], b[1:len(b) - 1] FROM g WHERE len(a) > 1),
c AS (SELECT *, list_sum([b[i] - a[i] + 1 FOR i IN range(1, len(a) + 1)]) AS bases, ',' || array_to_string([(b[i] + 1) || '-' || (a[i + 1] - 1) FOR i IN range(1, len(a))], ',') || ',' AS chain FROM m WHERE len(a) > 1)
SELECT DISTINCT u.id, u.l_orderkey AS contig FROM c u JOIN c v ON u.l_orderkey = v.l_orderkey AND u.id <> v.id AND v.a[1] <= u.a[1] AND u.b[-1] <= v.b[-1] AND contains(v.chain, u.chain)
WHERE len(u.a) < len(v.a) OR len(u.a) = len(v.a) AND (u.bases < v.bases OR u.bases = v.bases AND u.id > v.id)""")
def redundant_models(spark: SparkSession, d: str) -> DataFrame:
    """The models of each order, and with each one that lacks its last exon."""
    m = order_models(spark, d)
    whole = F.struct("id", "exons")
    shorter = F.struct(F.concat("id", F.lit(".t")).alias("id"), F.slice("exons", F.lit(1), F.size("exons") - 1).alias("exons"))
    both = m.select("contig", "strand", F.explode(F.when(F.size("exons") > 1, F.array(whole, shorter)).otherwise(F.array(whole))).alias("m"))
    return structure.redundant(both.select("contig", "strand", "m.*"), bin=60).select("id", "contig")


@query("assembly")
def assembly(spark: SparkSession, d: str) -> DataFrame:
    """Models of each order from its lines' spans, weighted by quantity."""
    m = order_models(spark, d)
    blocks = F.transform("exons", lambda e: F.struct(e["lo"].alias("lo"), (e["hi"] + 1).alias("hi")))
    return assemble.assembled(m.select("contig", "strand", blocks.alias("blocks"), F.lit(1.0).alias("mass")), "contig", "strand", "blocks", "mass")


@query("assembly_counts", f"""WITH {_LINE_EXONS}, z AS (SELECT l_orderkey, dataset, list(lo ORDER BY lo) AS a, list(hi + 1 ORDER BY lo) AS b FROM x GROUP BY ALL),
u AS (SELECT l_orderkey, a, b, min(dataset) AS id, [{{'g': b[i], 'h': a[i + 1]}} FOR i IN range(1, len(a))] AS gaps FROM z GROUP BY ALL),
p AS (SELECT l_orderkey, p.id AS i, q.id AS j, p.a[1] AS lo, p.b[-1] AS hi, q.a[1] AS qlo, q.b[-1] AS qhi,
  [g FOR g IN p.gaps IF g.g < least(p.b[-1], q.b[-1]) AND g.h > greatest(p.a[1], q.a[1])] = [g FOR g IN q.gaps IF g.g < least(p.b[-1], q.b[-1]) AND g.h > greatest(p.a[1], q.a[1])] AS same
  FROM u p JOIN u q USING (l_orderkey) WHERE p.id <> q.id AND p.a[1] < q.b[-1] AND q.a[1] < p.b[-1]),
kept AS (SELECT l_orderkey, id FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l_orderkey = u.l_orderkey AND p.i = u.id AND same AND qlo <= lo AND hi <= qhi)),
e AS (SELECT l_orderkey, i, j FROM p WHERE same AND lo <= qlo AND hi <= qhi AND EXISTS (SELECT 1 FROM kept WHERE kept.l_orderkey = p.l_orderkey AND kept.id = p.i) AND EXISTS (SELECT 1 FROM kept WHERE kept.l_orderkey = p.l_orderkey AND kept.id = p.j)),
c AS (SELECT l_orderkey, i, j FROM e UNION SELECT e.l_orderkey, e.i, f.j FROM e JOIN e f ON e.l_orderkey = f.l_orderkey AND e.j = f.i),
n AS (SELECT l_orderkey, count(*) AS kept FROM kept GROUP BY ALL), m AS (SELECT l_orderkey, count(*) AS pairs FROM c GROUP BY ALL)
SELECT l_orderkey AS contig, CASE WHEN coalesce(pairs, 0) = 0 THEN kept WHEN pairs = kept * (kept - 1) // 2 THEN 1 ELSE 2 END AS models FROM n LEFT JOIN m USING (l_orderkey)""")
def assembly_counts(spark: SparkSession, d: str) -> DataFrame:
    """The least number of chains that cover the structures of each order (three at most, whose widest antichain SQL can tell)."""
    m = order_models(spark, d)
    blocks = F.transform("exons", lambda e: F.struct(e["lo"].alias("lo"), (e["hi"] + 1).alias("hi")))
    found = assemble.assembled(m.select("contig", "strand", blocks.alias("blocks"), F.lit(1.0).alias("mass")), "contig", "strand", "blocks", "mass", least_fraction=0.0)
    return found.groupBy(F.col("bundle").cast("bigint").alias("contig")).agg(F.count("*").alias("models"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("gtf_round_trip", f"WITH {_LINE_EXONS} SELECT l_orderkey || '.' || dataset AS id, 'g' || l_orderkey AS gene_id, l_orderkey::VARCHAR AS contig, lo, hi FROM x")
def gtf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The models written as GTF and read again."""
    path = _fresh(spark, "models-gtf")
    m = order_models(spark, d).withColumns({"gene_id": F.concat(F.lit("g"), "contig"), "fpkm": F.lit(1.0)})
    gff.as_gtf(m).select("value").write.text(path)
    back = gff.transcripts(gff.features(spark, path))
    return back.select("id", "gene_id", "contig", F.explode("exons").alias("e")).select("id", "gene_id", "contig", "e.lo", "e.hi")


@query("sam_round_trip", f"WITH {_LINE_EXONS} SELECT l_orderkey || '.' || dataset AS id, l_orderkey::VARCHAR AS contig, lo, hi FROM x")
def sam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The models written as spliced alignments and read again: their matches."""
    path = _fresh(spark, "models-sam")
    sam.as_sam(order_models(spark, d).withColumn("fpkm", F.lit(1.0))).write.text(path)
    matches = F.filter("ops", lambda x: x["op"] == "MATCH")
    back = sam.operations(sam.alignments(spark, path)).select(F.col("read_id").alias("id"), "contig", F.explode(matches).alias("e"))
    return back.select("id", "contig", (F.col("e.lo") + 1).alias("lo"), F.col("e.hi").alias("hi"))


@query("dispersion_fit")
def dispersion_fit(spark: SparkSession, d: str) -> DataFrame:
    """Variance over libraries of each part's counts against its mean, and the model's value at each part."""
    moments = normalize.means_and_variances(counts(spark, d), "locus", "n").withColumn("grp", F.lit("all"))
    model = dispersion.fitted(moments, "grp", "mean", "variance")
    points = moments.select("grp", "locus", "mean")
    return dispersion.looked_up(points, model, ["grp"], "mean").select("locus", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))

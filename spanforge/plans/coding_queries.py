"""Coding sequences, proteins and strands over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import sequence
from spanforge.operators import bias, coding, strands
from spanforge.plans.assembly_queries import _LINE_EXONS, order_models
from spanforge.plans.interval_queries import _ORDERS, load, order_spans
from spanforge.plans.registry import query
from spanforge.plans.sequence_queries import _BASES, _PROTEINS, bases

_CODING = f"""{_LINE_EXONS}, m AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_orderkey % 3 AS phase, min(lo) OVER w + 3 AS clo, max(hi) OVER w - 2 AS chi FROM x WINDOW w AS (PARTITION BY l_orderkey, dataset)),
parts AS (SELECT *, greatest(lo, clo) AS a, least(hi, chi) AS b FROM m)"""


def _coding_models(spark: SparkSession, d: str) -> DataFrame:
    m = order_models(spark, d)
    return m.withColumns({
        "strand": F.when(F.col("contig") % 2 == 0, "+").otherwise("-"), "phase": (F.col("contig") % 3).cast("int"),
        "cds_lo": F.get("exons", F.lit(0))["lo"] + 3, "cds_hi": F.get("exons", F.size("exons") - 1)["hi"] - 2,
    })


@query("coding_phases", f"""WITH {_CODING}, along AS (SELECT *, coalesce(sum(b - a + 1) OVER (PARTITION BY l_orderkey, dataset ORDER BY CASE strand WHEN '+' THEN lo ELSE -lo END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts)
SELECT l_orderkey AS contig, dataset, a AS lo, b AS hi, ((3 - (before + (3 - phase) % 3) % 3) % 3)::INT AS phase FROM along""")
def coding_phases(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each order's model between three bases from its start and two from its end, with their phases."""
    m = _coding_models(spark, d)
    parts = coding.phases(coding.segments(F.col("exons"), F.col("cds_lo"), F.col("cds_hi")), F.col("strand"), F.col("phase"))
    return m.select("contig", "dataset", F.explode(parts).alias("e")).select("contig", "dataset", "e.lo", "e.hi", "e.phase")


@query("coding_spans", f"""WITH {_CODING} SELECT l_orderkey AS contig, dataset, (CASE WHEN any_value(strand) = '+' THEN 4 ELSE 3 END + any_value(phase))::INT AS first, (sum(hi - lo + 1) - CASE WHEN any_value(strand) = '+' THEN 2 ELSE 3 END)::INT AS last FROM parts GROUP BY ALL""")
def coding_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the same parts lie on the spliced transcript."""
    m = _coding_models(spark, d)
    first, last = coding.transcript_span(F.col("exons"), F.col("strand"), F.col("cds_lo"), F.col("cds_hi"), F.col("phase"))
    return m.select("contig", "dataset", first.cast("int").alias("first"), last.cast("int").alias("last"))


@query("coding_checks", f"""WITH b AS (SELECT doc_id, {_BASES} AS seq FROM documents), n AS (SELECT *, length(seq) AS n FROM b WHERE length(seq) >= 90),
m AS (SELECT doc_id, n, doc_id % 3 AS phase, doc_id % 2 = 1 AS back, substr(seq, 1, n // 3) || substr(seq, n // 3 + 11, n - 5 - (n // 3 + 10)) AS s FROM n),
t AS (SELECT doc_id, CASE WHEN back THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS mrna, CASE WHEN back THEN 5 ELSE 4 + doc_id % 3 END + phase AS first, length(s) - CASE WHEN back THEN 3 + doc_id % 3 ELSE 4 END AS last FROM m),
c AS (SELECT *, (last - first + 1) // 3 AS codons, substr(mrna, first, last - first + 4) AS cds FROM t),
k AS (SELECT doc_id, i, substr(cds, i * 3 - 2, 3) AS codon FROM (SELECT doc_id, cds, unnest(range(1, length(cds) // 3 + 1)) AS i FROM c)),
a AS (SELECT doc_id, string_agg(CASE WHEN regexp_full_match(codon, '[ACGT]{{3}}') THEN substr('{sequence.AMINO_ACIDS}', ((instr('TCAG', codon[1]) - 1) * 16 + (instr('TCAG', codon[2]) - 1) * 4 + instr('TCAG', codon[3]))::BIGINT, 1) ELSE 'X' END, '' ORDER BY i) AS protein FROM k GROUP BY ALL),
r AS (SELECT c.*, protein, instr(protein, '*') AS stop_at FROM c JOIN a USING (doc_id))
SELECT doc_id, first::INT AS first, (last + CASE WHEN stop_at = codons + 1 THEN 3 ELSE 0 END)::INT AS last, stop_at > 0 AND stop_at >= codons AS has_stop, CASE WHEN stop_at = 0 OR stop_at >= codons THEN 'OK' ELSE 'STOP' END AS verdict, md5(CASE WHEN stop_at > 0 THEN substr(protein, 1, stop_at - 1) ELSE substr(protein, 1, codons) END) AS digest FROM r""")
def coding_checks(spark: SparkSession, d: str) -> DataFrame:
    """The letters of each text as a contig with a model of two exons: its transcript, made from pieces, translated and judged."""
    contigs = bases(spark, d).withColumn("n", F.length("seq")).where("n >= 90")
    n, third = F.col("n"), F.expr("n div 3").cast("int")
    exon = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    models = contigs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("contig"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.array(exon(F.lit(1), third), exon(third + 11, n - 5)).alias("exons"),
        (F.lit(4) + F.col("doc_id") % 3).cast("int").alias("cds_lo"), (n - 9).alias("cds_hi"), (F.col("doc_id") % 3).cast("int").alias("phase"),
    )
    found = coding.checked(coding.spliced_sequences(models, contigs.select(F.col("doc_id").alias("name"), "seq")))
    return found.select(F.col("id").alias("doc_id"), "first", "last", "has_stop", "verdict", F.md5(F.col("protein").cast("binary")).alias("digest"))


@query("start_bias", f"""WITH b AS (SELECT doc_id, {_BASES} AS seq FROM documents), n AS (SELECT doc_id, seq, length(seq) AS n, 1 + doc_id % 5 AS f, (doc_id * 7919) % length(seq) AS a FROM b WHERE length(seq) > 0),
s AS (SELECT *, unnest([a, (a * 31 + 7) % n]) AS p FROM n),
o AS (SELECT o AS "offset", substr(seq, (p + o + 1)::BIGINT, 1) AS base, count(*)::DOUBLE AS c FROM s, (SELECT unnest(range(-2, 3)) AS o) WHERE p + o >= 0 AND p + o < n GROUP BY ALL),
e AS (SELECT o AS "offset", base, sum(f * (length(part) - length(replace(part, base, ''))))::DOUBLE AS c FROM (SELECT f, o, substr(seq, greatest(0, o) + 1, greatest(0, n - abs(o))) AS part FROM n, (SELECT unnest(range(-2, 3)) AS o)), (SELECT unnest(['A', 'C', 'G', 'T']) AS base) GROUP BY ALL)
SELECT e."offset"::INT AS "offset", e.base, round(coalesce((coalesce(o.c, 0) / sum(coalesce(o.c, 0)) OVER w) / nullif(e.c / sum(e.c) OVER w, 0), 1), 9) AS ratio FROM e LEFT JOIN o ON o."offset" = e."offset" AND o.base = e.base WINDOW w AS (PARTITION BY e."offset")""")
def start_bias(spark: SparkSession, d: str) -> DataFrame:
    """Bases around two places of each text's letters over those around any place."""
    models = bases(spark, d).where(F.length("seq") > 0).select(F.col("doc_id").alias("id"), "seq", (1.0 + F.col("doc_id") % 5).alias("fpkm"))
    n = F.length("seq")
    first = (F.col("id") * 7919) % n
    starts = models.select("id", F.explode(F.array(first, (first * 31 + 7) % n)).alias("at"), F.lit(1).alias("n"))
    return bias.learned(models, starts, 2, 3).select("offset", "base", F.round("ratio", 9).alias("ratio"))


@query("protein_clusters", f"WITH {_PROTEINS} SELECT doc_id, CASE WHEN length(protein) > 0 THEN min(doc_id) OVER (PARTITION BY lang, protein) END AS p_id FROM p JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def protein_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Texts of one language whose letters translate to the same."""
    langs = load(spark, d, "documents").select("doc_id", "lang")
    proteins = bases(spark, d).select("doc_id", sequence.translate(F.col("seq")).alias("protein"))
    return coding.protein_clusters(proteins.join(langs, "doc_id"), "lang", "doc_id").select("doc_id", "p_id")


@query("repaired_strands", f"""WITH {_ORDERS}, m AS (SELECT o_orderkey AS id, o_custkey, lo, hi, CASE WHEN o_orderpriority LIKE '1%' THEN '+' WHEN o_orderpriority LIKE '2%' THEN '-' ELSE '.' END AS strand FROM o),
s AS (SELECT a.id, b.strand AS s, max(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS n FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND a.lo < b.hi AND b.lo < a.hi WHERE a.strand = '.' AND b.strand <> '.' GROUP BY ALL),
f AS (SELECT id, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, s) AS k FROM s) WHERE k = 1),
i AS (SELECT *, CASE WHEN lo >= max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM m WHERE strand = '.'),
j AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS k FROM i),
g AS (SELECT o_custkey, k, s, sum(hi - lo) AS n FROM j JOIN f USING (id) GROUP BY ALL), h AS (SELECT o_custkey, k, s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, k ORDER BY n DESC, s) AS r FROM g) WHERE r = 1)
SELECT m.id AS o_orderkey, coalesce(f.s, h.s, m.strand) AS strand, CASE WHEN f.s IS NOT NULL THEN 'overlap' WHEN h.s IS NOT NULL THEN 'locus' END AS "by" FROM m LEFT JOIN f ON m.id = f.id LEFT JOIN j ON m.id = j.id LEFT JOIN h ON j.o_custkey = h.o_custkey AND j.k = h.k""")
def repaired_strands(spark: SparkSession, d: str) -> DataFrame:
    """Orders as models of their customer: urgent ones on one strand, high ones on the other, the rest without."""
    p = F.col("o_orderpriority")
    m = order_spans(spark, d).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contig"), F.when(F.startswith(p, F.lit("1")), "+").when(F.startswith(p, F.lit("2")), "-").otherwise(".").alias("strand"), "lo", "hi")
    return strands.repaired(m, bin=60).select(F.col("id").alias("o_orderkey"), "strand", "by")


@query("combined_strands", f"""WITH {_LINE_EXONS}, g AS (SELECT l_orderkey, dataset, min(lo) AS lo, max(hi) + 1 AS hi, count(*) AS mass, list({{'a': lo, 'b': hi + 1}} ORDER BY lo) AS e FROM x GROUP BY ALL),
m AS (SELECT *, [{{'a': e[i].b, 'b': e[i + 1].a}} FOR i IN range(1, len(e))] AS gaps FROM g)
SELECT l_orderkey AS contig, dataset FROM m q WHERE NOT (dataset = 2 AND EXISTS (SELECT 1 FROM m r WHERE r.l_orderkey = q.l_orderkey AND r.dataset <> 2 AND q.lo < r.hi AND r.lo < q.hi
  AND len([1 FOR x IN q.gaps IF len([1 FOR y IN r.e IF y.a < x.b AND x.a < y.b]) > 0]) = 0 AND len([1 FOR x IN r.gaps IF len([1 FOR y IN q.e IF y.a < x.b AND x.a < y.b]) > 0]) = 0))""")
def combined_strands(spark: SparkSession, d: str) -> DataFrame:
    """An order's models: those of two datasets on one strand each, those of the third without and only where they add something."""
    m = order_models(spark, d)
    blocks = F.transform("exons", lambda e: F.struct(e["lo"].alias("lo"), (e["hi"] + 1).alias("hi")))
    sided = m.withColumns({"strand": F.get(F.array(F.lit("+"), F.lit("-"), F.lit(".")), F.col("dataset").cast("int")), "blocks": blocks, "mass": F.size("exons")})
    spans = sided.withColumns({"lo": F.get("blocks", F.lit(0))["lo"], "hi": F.get("blocks", F.size("blocks") - 1)["hi"]})
    return strands.combined(spans, bin=60).select("contig", "dataset")

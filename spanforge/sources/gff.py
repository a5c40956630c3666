"""Annotations (GTF, GFF3), FASTA and side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gtf_attributes(text: Column) -> Column:
    """Column 9 as a map: key "value"; pairs, or key=value; pairs with percent escapes."""
    pair = F.lit(r'[A-Za-z_][A-Za-z0-9_.]* +(?:"[^"]*"|[^";\s][^";]*)')

    def once(value: Column, f) -> Column:
        """f(value), where value is worked out once however often f names it."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def entry(k: Column, v: Column) -> Column:
        return F.struct(k.alias("k"), v.alias("v"))

    # A key has no space; what follows it is quoted whole or not at all.
    def quoted(x: Column) -> Column:
        return once(F.ltrim(F.substr(x, F.instr(x, F.lit(" ")))), lambda rest: entry(F.substring_index(x, " ", 1), F.when(F.startswith(rest, F.lit('"')), F.replace(rest, F.lit('"'))).otherwise(rest)))

    def escaped(x: Column) -> Column:
        v = F.substr(x, F.instr(x, F.lit("=")) + 1)
        return entry(F.trim(F.substring_index(x, "=", 1)), F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v))

    def mapped(pairs: Column) -> Column:
        def unlike(keys: Column) -> Column:
            # The first of equal keys counts.
            return F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1))

        return F.map_from_entries(once(F.transform(pairs, lambda x: x["k"]), unlike))

    gff = F.transform(F.regexp_extract_all(text, F.lit(r"[^=;]+=[^;]*"), F.lit(0)), escaped)
    gtf = F.transform(F.regexp_extract_all(text, pair, F.lit(0)), quoted)
    return once(F.when(text.rlike(r"^\s*[^ \"=;]+="), gff).otherwise(gtf), mapped)


def features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: contig, source, feature, start, end (1-based closed, in order), score, strand, phase, attributes."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 8)
    f = lambda k: F.get(F.col("f"), F.lit(k))
    a, b = f(3).cast("int"), f(4).cast("int")
    return rows.select(
        f(0).alias("contig"), f(1).alias("source"), f(2).alias("feature"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"),
        F.when(f(5) == ".", 0.0).otherwise(f(5).try_cast("double")).alias("score"), F.when(f(6).isin("+", "-"), f(6)).otherwise(".").alias("strand"), f(7).alias("phase"), gtf_attributes(F.coalesce(f(8), F.lit(""))).alias("attributes"),
    )


def joined_exons(exons: Column, gap: int = 0) -> Column:
    """A sorted array of (lo, hi) with those joined that overlap, touch, or lie within gap."""
    def step(s, e):
        last = F.try_element_at(s, F.lit(-1))
        wider = F.concat(F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1)), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], e["hi"]).alias("hi"))))
        return F.when((F.size(s) > 0) & (e["lo"] <= last["hi"] + gap + 1), wider).otherwise(F.concat(s, F.array(e)))

    return F.aggregate(exons, F.array().cast("array<struct<lo:int,hi:int>>"), step)


def transcripts(found: DataFrame, gap: int = 0) -> DataFrame:
    """Models from features: id, gene_id, contig, strand, exons (joined, sorted), cds_lo, cds_hi, attributes of the first exon."""
    parent = F.coalesce(F.col("attributes")["transcript_id"], F.col("attributes")["Parent"])
    parts = found.where(F.col("feature").isin("exon", "CDS")).withColumn("id", parent).where("id IS NOT NULL")
    exon = F.col("feature") == "exon"
    cds = F.col("feature") == "CDS"
    grouped = parts.groupBy("id", "contig", "strand").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start").alias("lo"), F.col("end").alias("hi")))).alias("all"),
        F.array_sort(F.collect_list(F.when(exon, F.struct(F.col("start").alias("lo"), F.col("end").alias("hi"))))).alias("exons"),
        F.min(F.when(cds, F.col("start"))).alias("cds_lo"), F.max(F.when(cds, F.col("end"))).alias("cds_hi"), F.min_by("attributes", "start").alias("attributes"),
    )
    return grouped.select("id", F.coalesce(F.col("attributes")["gene_id"], "id").alias("gene_id"), "contig", "strand", joined_exons(F.when(F.size("exons") > 0, F.col("exons")).otherwise(F.col("all")), gap).alias("exons"), "cds_lo", "cds_hi", "attributes")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, seq): one row for each record. Whole records are read, so one must fit a task."""
    # A record begins with ">" at the start of a line; in a header it is a character like any other.
    whole = F.regexp_replace("value", r"^>", "")
    records = spark.read.option("lineSep", "\n>").text(path).select(whole.alias("value")).where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.substr("value", F.length(head) + 1), r"\s", "")
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.length(seq).alias("length"), seq.alias("seq"))


def as_gtf(models: DataFrame, source: str = "spanforge") -> DataFrame:
    """Lines of GTF: a transcript and its exons for each model(id, gene_id, contig, strand, exons, fpkm); score 1 to 1000 by share of the gene's largest FPKM."""
    from pyspark.sql import Window

    top = F.max("fpkm").over(Window.partitionBy("gene_id"))
    score = F.greatest(F.lit(1), F.least(F.lit(1000), F.when(top > 0, F.floor(F.col("fpkm") / top * 1000)).otherwise(1).cast("int")))
    scored = models.withColumn("score", score)
    names = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "id", F.lit('";'))
    line = lambda kind, lo, hi, extra: F.concat_ws("\t", "contig", F.lit(source), F.lit(kind), lo.cast("string"), hi.cast("string"), F.col("score").cast("string"), "strand", F.lit("."), F.concat(names, extra))
    # A model's lines are laid out from its row: nothing is read twice.
    whole = F.struct(F.lit(0).alias("number"), line("transcript", F.get("exons", F.lit(0))["lo"], F.get("exons", F.size("exons") - 1)["hi"], F.format_string(' FPKM "%.10f";', "fpkm")).alias("value"))
    exon = lambda e, k: F.struct((k + 1).alias("number"), line("exon", e["lo"], e["hi"], F.concat(F.lit(' exon_number "'), (k + 1).cast("string"), F.lit('";'))).alias("value"))
    return scored.select("id", F.explode(F.concat(F.array(whole), F.coalesce(F.transform("exons", exon), F.array().cast("array<struct<number:int,value:string>>")))).alias("l")).select("id", "l.number", "l.value")

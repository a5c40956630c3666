"""Annotations compared: accuracy at each level, structures tracked across datasets, superloci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.cluster import exon_loci
from spanforge.operators.intervals import merged, range_join
from spanforge.operators.structure import chain_key, code_rank, introns


def _pieces(df: DataFrame, kind: str) -> DataFrame:
    place = ["contig", "strand"]
    if kind == "exon":
        return df.select(*place, F.explode("exons").alias("e")).select(*place, F.concat_ws("-", "e.lo", "e.hi").alias("key")).distinct()
    if kind == "intron":
        return df.select(*place, F.explode(introns(F.col("exons"))).alias("e")).select(*place, F.concat_ws("-", "e.lo", "e.hi").alias("key")).distinct()
    if kind == "intron_chain":
        return df.where(F.size("exons") > 1).select(*place, chain_key(F.col("exons")).alias("key")).distinct()
    return df.select(*place, F.to_json("exons").alias("key")).distinct()


def accuracy(query: DataFrame, reference: DataFrame, bin: int = 10_000) -> DataFrame:
    """(level, query, reference, matched, sensitivity, precision) of base, exon, intron, intron_chain and transcript.

    Both sides have contig, strand and exons (sorted (lo, hi), 1-based closed).
    """
    rows = None
    for kind in ("exon", "intron", "intron_chain", "transcript"):
        q, r = _pieces(query, kind), _pieces(reference, kind)
        both = q.withColumn("__q", F.lit(1)).join(r.withColumn("__r", F.lit(1)), ["contig", "strand", "key"], "full")
        row = both.agg(F.count("__q").alias("query"), F.count("__r").alias("reference"), F.count_if(F.col("__q").isNotNull() & F.col("__r").isNotNull()).alias("matched")).withColumn("level", F.lit(kind))
        rows = row if rows is None else rows.unionByName(row)

    def bases(df: DataFrame) -> DataFrame:
        flat = df.select("contig", "strand", F.explode("exons").alias("e")).select("contig", "strand", (F.col("e.lo") - 1).alias("lo"), F.col("e.hi").alias("hi"))
        return merged(flat, ["contig", "strand"]).select("contig", "strand", "lo", "hi")

    q, r = bases(query), bases(reference)
    total = lambda df, name: df.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).alias(name))
    shared = range_join(q, r, ["contig", "strand"], bin=bin).agg(F.coalesce(F.sum(F.least("hi", "hi_r") - F.greatest("lo", "lo_r")), F.lit(0)).alias("matched"))
    base = total(q, "query").crossJoin(total(r, "reference")).crossJoin(shared).withColumn("level", F.lit("base"))
    rows = rows.unionByName(base)
    return rows.select("level", "query", "reference", "matched", F.try_divide("matched", "reference").alias("sensitivity"), F.try_divide("matched", "query").alias("precision"))


def tracked(models: DataFrame) -> DataFrame:
    """(contig, strand, structure, members): multi-exon models(dataset, id, contig, strand, exons) of one intron chain, by dataset."""
    keyed = models.where(F.size("exons") > 1).withColumn("structure", chain_key(F.col("exons")))
    lists = keyed.groupBy("contig", "strand", "structure", "dataset").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.groupBy("contig", "strand", "structure").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "ids")))).alias("members"))


def superloci(models: DataFrame) -> DataFrame:
    """models with locus over all datasets together."""
    return exon_loci(models, "id", "contig", "strand", "exons")


def reference_map(classified: DataFrame) -> DataFrame:
    """(reference, matched, contained): for each reference the ids of its = and its c queries."""
    pick = lambda code: F.array_join(F.array_sort(F.collect_list(F.when(F.col("code") == code, F.col("id")))), ",")
    return classified.where(F.col("code").isin("=", "c")).groupBy("reference").agg(pick("=").alias("matched"), pick("c").alias("contained"))


def best_of_each(overlaps: DataFrame, id: str = "id", code: str = "code") -> DataFrame:
    """(id, code): the best code of each query."""
    ranked = overlaps.groupBy(id).agg(F.min(F.struct(code_rank(F.col(code)).alias("r"), F.col(code).alias("c"))).alias("b"))
    return ranked.select(id, F.col("b.c").alias(code))


def meta_assembly(classified: DataFrame) -> DataFrame:
    """Models that a merge keeps: not contained, intronic, repeats, run-on or pre-mRNA."""
    return classified.where(~F.col("code").isin("c", "i", "r", "p", "e"))


def missed_introns(query: DataFrame, reference: DataFrame) -> DataFrame:
    """Introns of the reference that no query has."""
    return _pieces(reference, "intron").join(_pieces(query, "intron"), ["contig", "strand", "key"], "left_anti")

"""Attribute and sequence functions over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import sequence
from spanforge.plans.interval_queries import load
from spanforge.plans.registry import query
from spanforge.session import shared_dir
from spanforge.sources.gff import fasta

_BASES = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC')"


def bases(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seq): the letters of each text as nucleotides."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return load(spark, d, "documents").select("doc_id", F.translate(letters, "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC").alias("seq"))


@query("reverse_complement", f"SELECT doc_id, md5(reverse(translate({_BASES}, 'ACGTacgt', 'TGCAtgca'))) AS digest FROM documents")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return bases(spark, d).select("doc_id", F.md5(sequence.reverse_complement(F.col("seq")).cast("binary")).alias("digest"))


@query("gc_share", f"WITH s AS (SELECT doc_id, {_BASES} AS seq FROM documents) SELECT doc_id, round((length(seq) - length(translate(seq, 'GCgc', ''))) / nullif(length(seq), 0), 9) AS gc FROM s")
def gc_share(spark: SparkSession, d: str) -> DataFrame:
    return bases(spark, d).select("doc_id", F.round(sequence.gc_share(F.col("seq")), 9).alias("gc"))


@query("softmask_share", "SELECT doc_id, round((length(text) - length(regexp_replace(text, '[a-z]', '', 'g'))) / nullif(length(text), 0), 9) AS masked FROM documents")
def softmask_share(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(sequence.soft_masked(F.col("text")), 9).alias("masked"))


_PROTEINS = f"""s AS (SELECT doc_id, {_BASES} AS seq FROM documents), k AS (SELECT doc_id, i, substr(seq, i * 3 - 2, 3) AS codon FROM (SELECT doc_id, seq, unnest(range(1, length(seq) // 3 + 1)) AS i FROM s)),
a AS (SELECT doc_id, string_agg(CASE WHEN regexp_full_match(codon, '[ACGT]{{3}}') THEN substr('{sequence.AMINO_ACIDS}', ((instr('TCAG', codon[1]) - 1) * 16 + (instr('TCAG', codon[2]) - 1) * 4 + instr('TCAG', codon[3]))::BIGINT, 1) ELSE 'X' END, '' ORDER BY i) AS protein FROM k GROUP BY ALL),
p AS (SELECT doc_id, CASE WHEN seq IS NOT NULL THEN coalesce(protein, '') END AS protein FROM s LEFT JOIN a USING (doc_id))"""


@query("codon_translate", f"WITH {_PROTEINS} SELECT doc_id, protein FROM p")
def codon_translate(spark: SparkSession, d: str) -> DataFrame:
    """All codons of each text's letters."""
    return bases(spark, d).select("doc_id", sequence.translate(F.col("seq")).alias("protein"))


@query("codon_translate_whole", f"WITH {_PROTEINS} SELECT doc_id, length(protein)::BIGINT AS length, md5(protein) AS digest FROM p")
def codon_translate_whole(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of the translation of all of each text's letters."""
    proteins = codon_translate(spark, d)
    return proteins.select("doc_id", F.length("protein").cast("long").alias("length"), F.md5(F.col("protein").cast("binary")).alias("digest"))


@query("fasta_round_trip", f"WITH s AS (SELECT doc_id, {_BASES} AS seq FROM documents) SELECT doc_id::VARCHAR AS name, length(seq) AS length, md5(seq) AS digest FROM s WHERE length(seq) > 0")
def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each text's letters written as a wrapped FASTA record and read again."""
    path = f"{shared_dir(spark)}/bases-{uuid.uuid4().hex}"
    records = bases(spark, d).where(F.length("seq") > 0)
    records.select(sequence.wrapped(F.col("doc_id").cast("string"), F.col("seq")).alias("value")).write.text(path)
    return fasta(spark, path).select("name", F.col("length").cast("bigint").alias("length"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("gff_attributes", r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def gff_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The query string of each page's address as key=value attributes."""
    from spanforge.sources.gff import gtf_attributes

    text = F.regexp_replace(F.regexp_extract("url", r"\?([^#]*)", 1), "&", ";")
    attributes = load(spark, d, "pages").select("page_id", gtf_attributes(text).alias("a"))
    return attributes.select("page_id", F.nullif(F.col("a")["page"], F.lit("")).alias("page"), F.nullif(F.col("a")["ref"], F.lit("")).alias("ref"))


@query("tracking_pivot", "SELECT l_partkey, coalesce(sum(round(l_quantity)::BIGINT) FILTER (WHERE l_returnflag = 'A'), 0)::BIGINT AS A, coalesce(sum(round(l_quantity)::BIGINT) FILTER (WHERE l_returnflag = 'N'), 0)::BIGINT AS N, coalesce(sum(round(l_quantity)::BIGINT) FILTER (WHERE l_returnflag = 'R'), 0)::BIGINT AS R FROM lineitem GROUP BY ALL")
def tracking_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Wide tracking table: one column a condition."""
    from spanforge.sources.tables import tracking

    long = load(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("n"))
    return tracking(long, ["l_partkey"], "l_returnflag", "n", ["A", "N", "R"]).na.fill(0)

"""Alignment text (SAM) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.fragments import is_single, raw_mass

LONGEST_INTRON = 300_000


def cigar(text: Column) -> Column:
    """CIGAR text as an array of (op, len)."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.left(p, F.length(p) - 1).cast("int").alias("len")))


def cigar_sum(ops: Column, letters: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, x: s + F.when(F.instr(F.lit(letters), x["op"]) > 0, x["len"]).otherwise(0))


def tag(fields: Column, name: str) -> Column:
    """The value of an optional field, null if it isn't there."""
    return F.get(F.transform(F.filter(fields, lambda f: F.startswith(f, F.lit(f"{name}:"))), lambda f: F.substring(f, 6, 1_000_000)), F.lit(0))


def header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tags, number) of the header's lines, tags being a map; the number keeps contigs' order."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("@")))
    fields = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.slice(fields, 2, 1_000), lambda f: F.struct(F.substring(f, 1, 2).alias("k"), F.substring(f, 4, 1_000_000).alias("v"))))
    return lines.where(~F.startswith("value", F.lit("@CO"))).select(F.substring(F.get(fields, F.lit(0)), 2, 2).alias("kind"), tags.alias("tags"), F.monotonically_increasing_id().alias("number"))


def alignments(spark: SparkSession, path: str, soft_clip: str = "reference", longest_intron: int = LONGEST_INTRON) -> DataFrame:
    """Mapped records: read_id, flag, contig, left (0-based), right, read_len, cigar, mate_left, strand, nm, nh, mass.

    Records that are unmapped, have an unknown operation or one without length, an intron over the limit or a mate on another contig are
    left out. soft_clip='reference' lets clipped bases take up reference, 'standard' doesn't.
    """
    return from_lines(spark.read.text(path), soft_clip, longest_intron)


def from_lines(lines: DataFrame, soft_clip: str = "reference", longest_intron: int = LONGEST_INTRON) -> DataFrame:
    """alignments of lines(value) of SAM text, wherever they come from."""
    rows = lines.where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    f = lambda k: F.get(F.col("f"), F.lit(k))
    # A record with an operation that isn't known goes as a whole.
    parsed = rows.where(f(5).rlike(r"^([0-9]+[MIDNSHP=X])+$")).select(
        f(0).alias("read_id"), f(1).cast("int").alias("flag"), f(2).alias("contig"), (f(3).cast("int") - 1).alias("left"),
        F.filter(cigar(f(5)), lambda x: x["op"] != "H").alias("cigar"), f(6).alias("mate_contig"),
        F.when(f(6) == "*", None).otherwise(f(7).cast("int") - 1).alias("mate_left"), F.slice("f", 12, 1_000).alias("tags"),
    )
    mapped = (F.col("flag").bitwiseAND(4) == 0) & (F.col("contig") != "*") & (F.size("cigar") > 0)
    kept = parsed.where(mapped & (F.col("mate_contig").isin("=", "*") | (F.col("mate_contig") == F.col("contig"))))
    kept = kept.where(F.forall("cigar", lambda x: (x["len"] > 0) & ((x["op"] != "N") | (x["len"] <= longest_intron))))
    takes = "MNDS=X" if soft_clip == "reference" else "MND=X"
    ops, tags = F.col("cigar"), F.col("tags")
    nh = F.coalesce(tag(tags, "NH").cast("int"), F.lit(1))
    single = is_single(F.col("left"), F.col("mate_left"), F.lit(True))
    return kept.select(
        "read_id", "flag", "contig", "left", (F.col("left") + cigar_sum(ops, takes)).alias("right"), cigar_sum(ops, "MIS=X").alias("read_len"), "cigar", "mate_left",
        F.coalesce(tag(tags, "XS"), F.lit(".")).alias("strand"), F.coalesce(tag(tags, "NM").cast("int"), F.lit(0)).alias("nm"), nh.alias("nh"), raw_mass(nh.cast("double"), single).alias("mass"),
    )


def operations(df: DataFrame) -> DataFrame:
    """df with ops: array of (op MATCH or INTRON, lo, hi) on the reference, insertions and clips left out, neighbours of a kind joined."""
    def step(s, x):
        end = s["at"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(0)
        kind = F.when(x["op"] == "N", "INTRON").when(x["op"].isin("M", "=", "X", "D"), "MATCH")
        last = F.try_element_at(s["out"], F.lit(-1))
        one = F.struct(kind.alias("op"), s["at"].alias("lo"), end.alias("hi"))
        joined = F.concat(F.slice(s["out"], 1, F.greatest(F.lit(0), F.size(s["out"]) - 1)), F.array(F.struct(kind.alias("op"), last["lo"].alias("lo"), end.alias("hi"))))
        out = F.when(kind.isNull(), s["out"]).when(last["op"] == kind, joined).otherwise(F.concat(s["out"], F.array(one)))
        return F.struct(end.alias("at"), out.alias("out"))

    start = F.struct(F.col("left").alias("at"), F.array().cast("array<struct<op:string,lo:int,hi:int>>").alias("out"))
    return df.withColumn("ops", F.aggregate("cigar", start, step)["out"])


def as_sam(models: DataFrame) -> DataFrame:
    """One line of SAM text for each model(id, contig, strand, exons (1-based closed), fpkm)."""
    pieces = F.transform(F.sequence(F.lit(1), F.size("exons")), lambda k: F.concat(
        F.when(k > 1, F.concat((F.get("exons", k - 1)["lo"] - F.get("exons", k - 2)["hi"] - 1).cast("string"), F.lit("N"))).otherwise(""),
        (F.get("exons", k - 1)["hi"] - F.get("exons", k - 1)["lo"] + 1).cast("string"), F.lit("M")))
    return models.select(F.concat_ws("\t", "id", F.lit("0"), "contig", F.get("exons", F.lit(0))["lo"].cast("string"), F.lit("255"), F.array_join(pieces, ""), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("XS:A:"), "strand"), F.concat(F.lit("ZF:f:"), F.format_string("%.6f", "fpkm"))).alias("value"))


def trimmed(df: DataFrame, keep: int) -> DataFrame:
    """Alignments cut to the first keep bases of the read: cigar, left, right and read_len change with the side that goes.

    On the reverse strand (flag 16) the read's first bases are the rightmost. Introns and deletions at the cut go as well.
    """
    reverse = F.col("flag").bitwiseAND(16) != 0
    ops = F.when(reverse, F.reverse("cigar")).otherwise(F.col("cigar"))

    def step(s, x):
        reads = x["op"].isin("M", "I", "S", "=", "X")
        take = F.when(reads, F.least(x["len"], s["left"])).otherwise(F.when(s["left"] > 0, x["len"]).otherwise(0)).cast("int")
        out = F.when(take > 0, F.concat(s["out"], F.array(F.struct(x["op"].alias("op"), take.alias("len"))))).otherwise(s["out"])
        return F.struct((s["left"] - F.when(reads, take).otherwise(0)).cast("int").alias("left"), out.alias("out"))

    start = F.struct(F.lit(keep).cast("int").alias("left"), F.array().cast("array<struct<op:string,len:int>>").alias("out"))
    cut = F.aggregate(ops, start, step)["out"]
    ends = F.col("__cut")
    # Whatever is left hanging behind the last read base.
    size = F.aggregate(F.transform(ends, lambda x, i: F.when(x["op"].isin("M", "I", "S", "=", "X"), i + 1).otherwise(0)), F.lit(0), lambda s, x: F.greatest(s, x))
    kept = F.slice(ends, 1, F.greatest(F.lit(0), size))
    found = df.withColumn("__cut", cut).withColumn("__cut", kept)
    takes = cigar_sum(F.col("__cut"), "MNDS=X")
    return found.withColumns({"left": F.when(reverse, F.col("right") - takes).otherwise(F.col("left")), "right": F.when(reverse, F.col("right")).otherwise(F.col("left") + takes), "cigar": F.when(reverse, F.reverse("__cut")).otherwise(F.col("__cut")), "read_len": cigar_sum(F.col("__cut"), "MIS=X")}).drop("__cut")


def strand_by_protocol(flag: Column, protocol: str) -> Column:
    """The strand that a stranded library gives a read: 'first' (first mates run against the transcript) or 'second'."""
    second_mate = flag.bitwiseAND(128) != 0
    forward = (flag.bitwiseAND(16) == 0) != second_mate
    sense = forward if protocol == "second" else ~forward
    return F.when(sense, "+").otherwise("-")

"""Structures: operation compatibility, intron chains, class codes, redundancy.

Operations are structs (op, lo, hi) with op MATCH, INTRON or UNKNOWN on half-open coordinates. Annotations are 1-based closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.intervals import overlap_length, range_join

#: Bases of a match that may reach into an intron; length beyond which no fragment goes.
OVERHANG, LONGEST_FRAGMENT = 8, 800
#: Class codes from best to worst (fixed values).
CODE_RANK = {"=": 0, "c": 2, "j": 4, "e": 6, "o": 8, "s": 16, "x": 18, "i": 20, "p": 90, "r": 92, "u": 94}
SINGLE_OF_LONGER, SINGLE_OF_REFERENCE, RUN_ON = 0.8, 0.9, 2000


def ops_compatible(a_op, a_lo, a_hi, b_op, b_lo, b_hi, overhang: int = OVERHANG, longest: int = LONGEST_FRAGMENT) -> Column:
    """Whether two operations that overlap can come from one molecule."""
    shared = overlap_length(a_lo, a_hi, b_lo, b_hi)

    def ops(x: str, y: str) -> Column:
        return (a_op == x) & (b_op == y) | (a_op == y) & (b_op == x)

    return (
        F.when(ops("INTRON", "INTRON"), (a_lo == b_lo) & (a_hi == b_hi))
        .when(ops("INTRON", "MATCH"), shared <= overhang)
        .when(ops("UNKNOWN", "MATCH"), shared <= longest)
        .otherwise(True)
    )


def structures_compatible(pairs: DataFrame, a: str, b: str, a_strand: str, b_strand: str, overhang: int = OVERHANG) -> Column:
    """Whether the operation arrays of a row agree: strands do, and no overlapping pair of operations contradicts."""
    agree = (F.col(a_strand) == F.col(b_strand)) | (F.col(a_strand) == ".") | (F.col(b_strand) == ".")
    clash = F.exists(a, lambda x: F.exists(b, lambda y: (x["lo"] < y["hi"]) & (y["lo"] < x["hi"]) & ~ops_compatible(x["op"], x["lo"], x["hi"], y["op"], y["lo"], y["hi"], overhang)))
    return agree & ~clash


def introns(exons: Column) -> Column:
    """Introns (lo, hi) between consecutive exons (lo, hi) of a sorted array, 1-based closed."""
    n = F.size(exons)
    return F.when(n < 2, F.array().cast("array<struct<lo:int,hi:int>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda k: F.struct((F.get(exons, k - 1)["hi"] + 1).cast("int").alias("lo"), (F.get(exons, k)["lo"] - 1).cast("int").alias("hi")))
    )


def chain_key(exons: Column) -> Column:
    """A string that two multi-exon structures share if their introns are the same; terminal ends are free."""
    return F.array_join(F.transform(introns(exons), lambda x: F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string"))), ",")


def exonic_overlap(a: Column, b: Column) -> Column:
    """Bases that the exon arrays share."""
    one = lambda x, y: F.greatest(F.lit(0), F.least(x["hi"], y["hi"]) - F.greatest(x["lo"], y["lo"]) + 1)
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.aggregate(b, F.lit(0), lambda t, y: t + one(x, y)))


def exonic_length(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x["hi"] - x["lo"] + 1)


def class_code(q: Column, r: Column) -> Column:
    """The relation of a query's exons to a reference's that it overlaps on the same strand: one of = c j e i o.

    q, r: sorted arrays of (lo, hi), 1-based closed.
    """
    nq, nr = F.size(q), F.size(r)
    q_lo, q_hi = F.get(q, F.lit(0))["lo"], F.get(q, nq - 1)["hi"]
    len_q, len_r, shared = exonic_length(q), exonic_length(r), exonic_overlap(q, r)
    r_in, q_in = introns(r), introns(q)
    inside_intron = F.exists(r_in, lambda x: (q_lo >= x["lo"]) & (q_hi <= x["hi"]))
    same_single = (shared >= SINGLE_OF_LONGER * F.greatest(len_q, len_r)) | (shared >= SINGLE_OF_REFERENCE * len_r)
    single_single = F.when(same_single, "=").when((len_q < len_r) & (shared >= SINGLE_OF_LONGER * len_q), "c").otherwise("o")
    inside_exon = F.exists(r, lambda x: (q_lo >= x["lo"] - OVERHANG) & (q_hi <= x["hi"] + OVERHANG))
    into_intron = F.exists(r_in, lambda x: F.least(q_hi, x["hi"]) - F.greatest(q_lo, x["lo"]) + 1 >= 10)
    single_multi = F.when(inside_exon, "c").when(inside_intron, "i").when(into_intron & (len_q > shared + 10), "e").otherwise("o")
    chain_q, chain_r = chain_key(q), chain_key(r)
    # A contiguous part of the reference's introns, with ends that hang over its neighbouring exons by less than four bases.
    at = F.array_position(r_in, F.get(q_in, F.lit(0)))
    part = F.when((at > 0) & (at + F.size(q_in) - 1 <= F.size(r_in)), F.slice(r_in, F.greatest(F.lit(1), at.cast("int")), F.size(q_in)) == q_in).otherwise(False)
    left, right = F.get(r, F.greatest(F.lit(1), at).cast("int") - 1)["lo"], F.get(r, (F.greatest(F.lit(1), at) + F.size(q_in)).cast("int") - 1)["hi"]
    contained = part & (q_lo > left - 4) & (q_hi < right + 4)
    shared_junction = F.arrays_overlap(F.flatten(F.array(F.transform(q_in, lambda x: F.struct(F.lit("l").alias("e"), x["lo"].alias("p"))), F.transform(q_in, lambda x: F.struct(F.lit("r").alias("e"), x["hi"].alias("p"))))), F.flatten(F.array(F.transform(r_in, lambda x: F.struct(F.lit("l").alias("e"), x["lo"].alias("p"))), F.transform(r_in, lambda x: F.struct(F.lit("r").alias("e"), x["hi"].alias("p"))))))
    multi = F.when(inside_intron, "i").when((nr > 1) & (chain_q == chain_r), "=").when((nr > 1) & contained, "c").when((nr > 1) & shared_junction, "j").otherwise("o")
    return F.when((nq == 1) & (nr == 1), single_single).when(nq == 1, single_multi).otherwise(multi)


def code_rank(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CODE_RANK.items() for x in pair)), code)


def classified(query: DataFrame, reference: DataFrame, bin: int = 10_000) -> DataFrame:
    """query(id, contig, strand, exons) with the code and id of its best reference of the same columns.

    Overlaps on the same strand come first by rank of the code, then shared bases, then the reference's exons and length; then
    overlap on the other strand (s if introns agree, x if exons overlap), then a single exon that follows a reference's 3' end
    (p), soft-masked sequence apart; u if nothing is near.
    """
    from pyspark.sql import Window

    def spans(df: DataFrame) -> DataFrame:
        return df.withColumns({"lo": F.get("exons", F.lit(0))["lo"] - 1, "hi": F.get("exons", F.size("exons") - 1)["hi"]})

    q, r = spans(query), spans(reference)
    pairs = range_join(q, r, ["contig"], bin=bin)
    same = (F.col("strand") == F.col("strand_r")) | (F.col("strand") == ".") | (F.col("strand_r") == ".")
    across = F.when(F.size(F.array_intersect(introns(F.col("exons")), introns(F.col("exons_r")))) > 0, "s").when(exonic_overlap(F.col("exons"), F.col("exons_r")) > 0, "x")
    coded = pairs.withColumns({"code": F.when(same, class_code(F.col("exons"), F.col("exons_r"))).otherwise(across), "shared": exonic_overlap(F.col("exons"), F.col("exons_r"))}).where("code IS NOT NULL")
    near = q.where(F.size("exons") == 1)
    after = r.withColumns({"__lo": F.when(F.col("strand") == "-", F.col("lo") - RUN_ON).otherwise(F.col("hi")), "__hi": F.when(F.col("strand") == "-", F.col("lo")).otherwise(F.col("hi") + RUN_ON)}).drop("lo", "hi").withColumnsRenamed({"__lo": "lo", "__hi": "hi"}).where("strand <> '.'")
    run_on = range_join(near, after, ["contig"], bin=bin).where((F.col("strand") == F.col("strand_r")) | (F.col("strand") == ".")).withColumns({"code": F.lit("p"), "shared": F.lit(0)})
    both = coded.select("id", "code", "shared", "id_r", "exons_r").unionByName(run_on.select("id", "code", "shared", "id_r", "exons_r"))
    best = Window.partitionBy("id").orderBy(code_rank(F.col("code")), F.desc("shared"), F.desc(F.size("exons_r")), F.desc(exonic_length(F.col("exons_r"))), "id_r")
    top = both.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("id", "code", F.col("id_r").alias("reference"))
    return query.join(top, "id", "left").withColumn("code", F.coalesce("code", F.lit("u")))


def repeats(classified: DataFrame, sequences: DataFrame) -> DataFrame:
    """classified with code r for models without a relation (u) whose sequence(id, seq) is mostly lower case."""
    masked = sequences.select("id", (F.length(F.regexp_replace("seq", "[^a-z]", "")) > F.length("seq") / 2).alias("__masked"))
    found = classified.join(masked, "id", "left")
    return found.withColumn("code", F.when((F.col("code") == "u") & F.coalesce("__masked", F.lit(False)), "r").otherwise(F.col("code"))).drop("__masked")


def redundant(df: DataFrame, bin: int = 10_000) -> DataFrame:
    """Rows of df(id, contig, strand, exons) whose introns are those of another, or a run of them, and whose span it holds.

    Of equals, the longer stays, then the lesser id. A row meets those that have its first intron: bin has no effect any more.
    """
    def spans(d: DataFrame) -> DataFrame:
        e = F.col("exons")
        return d.where(F.size(e) > 1).select(
            "*", introns(e).alias("__introns"), F.concat(F.lit(","), chain_key(e), F.lit(",")).alias("__chain"), F.size(e).alias("__n"), exonic_length(e).alias("__bases"),
            F.get(e, F.lit(0))["lo"].alias("__lo"), F.get(e, F.size(e) - 1)["hi"].alias("__hi"),
        )

    own = ["__chain", "__n", "__bases", "__lo", "__hi"]
    rows = spans(df).withColumn("__intron", F.get("__introns", F.lit(0))).drop("__introns")
    others = spans(df).select(F.col("id").alias("__id_r"), F.col("contig").alias("__contig_r"), F.col("strand").alias("__strand_r"), F.explode("__introns").alias("__intron_r"), *(F.col(c).alias(f"{c}_r") for c in own))
    worse = F.expr("__n < __n_r OR __n = __n_r AND (__bases < __bases_r OR __bases = __bases_r AND id > __id_r)")
    inside = F.expr("contig = __contig_r AND strand = __strand_r AND __intron = __intron_r AND id <> __id_r AND __lo_r <= __lo AND __hi <= __hi_r") & F.contains("__chain_r", "__chain")
    return rows.join(others, inside & worse, "left_semi").select(*df.columns)

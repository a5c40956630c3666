"""Coding sequence along exons: where it lies on the spliced transcript, the phase of each part, what it translates to, and which models are sound.

Models have id, contig, strand, exons (sorted, 1-based closed), cds_lo, cds_hi and phase: the bases to skip before the first whole
codon, 0 to 2 or null for 0. Models without cds_lo have no coding sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.sequence import consensus_site, reverse_complement, translate

#: Bases of a contig that models' exons are cut from at once, and the longest intron of a sound model.
PIECE, LONGEST_INTRON = 10_000, 999_000_000


def segments(exons: Column, lo: Column, hi: Column) -> Column:
    """The parts of exons that lie within [lo, hi]."""
    parts = F.transform(exons, lambda e: F.struct(F.greatest(e["lo"], lo).cast("int").alias("lo"), F.least(e["hi"], hi).cast("int").alias("hi")))
    return F.filter(parts, lambda e: e["lo"] <= e["hi"])


def bases(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, e: n + e["hi"] - e["lo"] + 1)


def phases(parts: Column, strand: Column, phase: Column) -> Column:
    """Parts of a coding sequence, in genome order, each with its phase: the bases of it that end a codon of the part before.

    The phase is carried along in the direction of transcription: from the last part back on '-'.
    """
    back = strand == "-"
    along = F.when(back, F.reverse(parts)).otherwise(parts)
    start = F.struct(F.pmod(F.lit(3) - F.coalesce(phase.cast("int"), F.lit(0)), F.lit(3)).alias("n"), F.array().cast("array<struct<lo:int,hi:int,phase:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        own = F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), F.pmod(F.lit(3) - s["n"], F.lit(3)).cast("int").alias("phase"))
        return F.struct(F.pmod(s["n"] + e["hi"] - e["lo"] + 1, F.lit(3)).alias("n"), F.concat(s["out"], F.array(own)).alias("out"))

    found = F.aggregate(along, start, step)["out"]
    return F.when(back, F.reverse(found)).otherwise(found)


def transcript_span(exons: Column, strand: Column, lo: Column, hi: Column, phase: Column) -> tuple[Column, Column]:
    """First and last base of the coding sequence on the spliced transcript, from 1; the phase's bases are skipped. Null outside the exons."""
    skip = F.coalesce(phase.cast("int"), F.lit(0))
    inside = F.exists(exons, lambda e: (e["lo"] <= lo) & (lo <= e["hi"])) & F.exists(exons, lambda e: (e["lo"] <= hi) & (hi <= e["hi"]))
    before, after = bases(segments(exons, F.lit(1), lo - 1)), bases(segments(exons, hi + 1, F.lit(2**31 - 1)))
    length = bases(exons)
    first, last = F.when(strand == "-", after).otherwise(before) + 1 + skip, length - F.when(strand == "-", before).otherwise(after)
    return F.when(inside, first), F.when(inside, last)


def pieces(contigs: DataFrame, size: int = PIECE) -> DataFrame:
    """(contig, piece, seq): stretches of each contig(name, seq), numbered from 0."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return contigs.select(F.col("name").alias("contig"), F.posexplode(cut).alias("piece", "seq"))


def spliced_sequences(models: DataFrame, contigs: DataFrame, size: int = PIECE) -> DataFrame:
    """models(id, contig, strand, exons) with mrna, the spliced transcript in its own direction, and sites, the first and last two bases
    of each intron in genome order. Models that reach beyond their contig, or have none, are left out.

    No contig is joined to a model: exons and splice sites meet the pieces of the contig that they lie in.
    """
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("exons") - 1)), lambda k: F.struct(F.get("exons", k - 1)["hi"].alias("a"), F.get("exons", k)["lo"].alias("b")))
    gaps = F.when(F.size("exons") > 1, gaps).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    ends = F.flatten(F.transform(gaps, lambda g: F.array(F.struct((g["a"] + 1).alias("lo"), (g["a"] + 2).alias("hi")), F.struct((g["b"] - 2).alias("lo"), (g["b"] - 1).alias("hi")))))
    wanted = lambda kind, parts: F.transform(parts, lambda e, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), e["lo"].cast("int").alias("lo"), e["hi"].cast("int").alias("hi")))
    each = models.select("id", "contig", F.explode(F.concat(wanted(0, F.col("exons")), wanted(1, ends))).alias("w")).select("id", "contig", "w.*")
    binned = each.withColumn("piece", F.explode(F.sequence(F.floor((F.col("lo") - 1) / size), F.floor((F.col("hi") - 1) / size)))).withColumn("piece", F.col("piece").cast("int"))
    met = binned.join(pieces(contigs, size), ["contig", "piece"])
    from_, to = F.greatest(F.col("lo") - F.col("piece") * size, F.lit(1)), F.least(F.col("hi") - F.col("piece") * size, F.lit(size))
    parts = met.withColumn("s", F.substring("seq", from_, F.greatest(F.lit(0), to - from_ + 1)))
    joined = parts.groupBy("id", "kind", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "s"))), lambda p: p["s"]), "").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = joined.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.struct("k", "s")))), lambda p: p["s"]), "").alias("__seq"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("k", "s")))), lambda p: p["s"]).alias("__sites"),
    )
    found = models.join(whole, "id").where(F.length("__seq") == bases(F.col("exons")))
    sites = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("__sites") - 2), F.lit(2)), lambda k: F.struct(F.get("__sites", k).alias("first"), F.get("__sites", k + 1).alias("last")))
    sites = F.when(F.size("__sites") > 1, sites).otherwise(F.array().cast("array<struct<first:string,last:string>>"))
    return found.withColumn("mrna", F.when(F.col("strand") == "-", reverse_complement(F.col("__seq"))).otherwise(F.col("__seq"))).withColumn("sites", sites).drop("__seq", "__sites")


def _sound_sites(sites: Column, strand: Column) -> Column:
    """Whether every intron begins and ends as known ones do, read in the transcript's direction."""
    forward = F.forall(sites, lambda s: consensus_site(s["first"], s["last"]))
    back = F.forall(sites, lambda s: consensus_site(reverse_complement(s["last"]), reverse_complement(s["first"])))
    return F.when(strand == "-", back).otherwise(forward)


def checked(models: DataFrame, full: bool = False, splice_sites: bool = False, other_phases: bool = False, longest_intron: int = LONGEST_INTRON) -> DataFrame:
    """models(..., mrna, sites) with first, last, protein, has_stop and verdict: OK, LONG_INTRON, BAD_SITE, NO_CDS, STOP or NOT_FULL.

    The coding sequence is read on the transcript from its first whole codon. One codon more is read than it has, if the
    transcript goes on: a stop there belongs to it, and last moves by three; a stop as its own last codon ends it. A stop
    before rejects the model, unless other_phases finds a phase, in order from its own, without one. full asks for ATG and a stop.
    protein is without its stop; it is null where there is no coding sequence.
    """
    long = F.exists(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("exons") - 1)), lambda k: F.get("exons", k)["lo"] - F.get("exons", k - 1)["hi"] - 1), lambda n: n > longest_intron)
    first, last = transcript_span(F.col("exons"), F.col("strand"), F.col("cds_lo"), F.col("cds_hi"), F.col("phase"))
    spans = models.withColumns({"__first": first, "__last": last})
    room = F.col("__last") + 3 <= F.length("mrna")

    def read(shift: int) -> Column:
        """(first, last, protein, stop, sound) of the reading that begins so many bases later, as phases go round."""
        own = F.coalesce(F.col("phase").cast("int"), F.lit(0))
        begin = F.col("__first") - own + F.pmod(own + shift, F.lit(3))
        codons = F.greatest(F.lit(0), F.floor((F.col("__last") - begin + 1) / 3)).cast("int")
        protein = translate(F.substring(F.col("mrna"), begin, F.greatest(F.lit(0), F.col("__last") - begin + 1 + F.when(room, 3).otherwise(0))))
        at = F.instr(protein, "*")
        more = (at == codons + 1) & (at > 0)
        stop = (at > 0) & (at >= codons)
        return F.struct(
            begin.alias("first"), (F.col("__last") + F.when(more, 3).otherwise(0)).alias("last"), F.when(at > 0, F.substring(protein, F.lit(1), at - 1)).otherwise(F.substring(protein, F.lit(1), codons)).alias("protein"),
            stop.alias("stop"), ((at == 0) | stop).alias("sound"),
        )

    readings = F.array(*(read(k) for k in ((0, 1, 2) if other_phases else (0,))))
    chosen = spans.withColumn("__all", readings).withColumn("__r", F.coalesce(F.get(F.filter("__all", lambda r: r["sound"]), F.lit(0)), F.get("__all", F.lit(0))))
    r = F.col("__r")
    no_cds = F.col("__first").isNull()
    verdict = F.when(long & (F.size("exons") > 1), "LONG_INTRON")
    if splice_sites:
        verdict = verdict.when(~_sound_sites(F.col("sites"), F.col("strand")), "BAD_SITE")
    verdict = verdict.when(no_cds, "NO_CDS").when(~r["sound"], "STOP")
    if full:
        verdict = verdict.when(~r["stop"] | ~F.startswith(r["protein"], F.lit("M")), "NOT_FULL")
    out = chosen.withColumns({"first": F.when(~no_cds, r["first"]).cast("int"), "last": F.when(~no_cds, r["last"]).cast("int"), "protein": F.when(~no_cds, r["protein"]), "has_stop": F.when(~no_cds, r["stop"]), "verdict": verdict.otherwise("OK")})
    return out.drop("__first", "__last", "__all", "__r")


def protein_clusters(models: DataFrame, locus: str, id: str = "id", protein: str = "protein") -> DataFrame:
    """models with p_id: the least id of those of its locus that translate to the same; null without a translation.

    Translations meet by a digest, so that a long one is not a key.
    """
    key = F.when(F.length(protein) > 0, F.sha2(F.col(protein), 256))
    keyed = models.withColumn("__key", key)
    return keyed.withColumn("p_id", F.when(F.col("__key").isNotNull(), F.min(id).over(Window.partitionBy(locus, "__key")))).drop("__key")

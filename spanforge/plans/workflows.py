"""Whole analyses from the operators: assemble a sample, quantify models in libraries, test conditions against each other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import abundance, assemble, bias, cluster, coding, dispersion, fragments, intervals, negbin, normalize, stats, uncertainty
from spanforge.session import shared_dir
from spanforge.sources import sam

SLACK, LEAST_PER_KB = 50, 10.0


def _kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/analysis-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_of(alignments: DataFrame) -> DataFrame:
    """alignments with ops and blocks: their MATCH stretches, half-open."""
    with_ops = sam.operations(alignments)
    return with_ops.withColumn("blocks", F.transform(F.filter("ops", lambda x: x["op"] == "MATCH"), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))))


def bundled(alignments: DataFrame, slack: int = SLACK) -> DataFrame:
    """alignments with bundle: islands of a contig, in order of position; mates keep a bundle open up to their partner."""
    reach = alignments.withColumns({"__lo": F.col("left"), "__hi": F.greatest("right", F.coalesce(F.col("mate_left") + 1, "right"))})
    found = intervals.islands(reach, ["contig"], "__lo", "__hi", slack, ["__hi", "read_id"], "__island")
    return found.withColumn("bundle", F.concat_ws(":", "contig", "__island")).drop("__lo", "__hi", "__island")


def bundled_by(alignments: DataFrame, annotation: DataFrame, mode: str, slack: int = SLACK, bin: int = 10_000) -> DataFrame:
    """alignments with bundle, with the help of an annotation(id, contig, exons).

    'reference': bundles are islands of the annotation, and only alignments that lie wholly in one are kept. 'guided': bundles
    are islands of alignments and annotation together, so that a model joins what it spans.
    """
    spans = annotation.select("contig", "id", (F.get("exons", F.lit(0))["lo"] - 1).alias("lo"), F.get("exons", F.size("exons") - 1)["hi"].alias("hi"))
    if mode == "reference":
        loci = intervals.merged(spans, ["contig"], slack=slack, order=["id"]).select("contig", "lo", "hi", F.concat_ws(":", "contig", "island").alias("bundle"))
        placed = alignments.withColumns({"lo": F.col("left"), "hi": F.col("right")})
        pairs = intervals.range_join(placed, loci, ["contig"], bin=bin).where("lo_r <= lo AND hi <= hi_r")
        return pairs.select(*alignments.columns, F.col("bundle_r").alias("bundle"))
    if mode != "guided":
        raise ValueError(mode)
    reach = alignments.withColumns({"lo": F.col("left"), "hi": F.greatest("right", F.coalesce(F.col("mate_left") + 1, "right")), "__read": F.lit(True)})
    both = reach.unionByName(spans.select("contig", "lo", "hi", F.col("id").alias("read_id")), allowMissingColumns=True)
    found = intervals.islands(both, ["contig"], slack=slack, order=["hi", "read_id"]).where("__read")
    return found.withColumn("bundle", F.concat_ws(":", "contig", "island")).select(*alignments.columns, "bundle")


def assemble_sample(alignments: DataFrame, least_fraction: float = 0.1, min_mass: float = 0.0) -> DataFrame:
    """(id, gene_id, contig, strand, exons (1-based closed), mass, status): models of one sample.

    Alignments are the evidence one by one (a mate's gap is no intron); those without a strand support either one: they go
    with the strand of their bundle's spliced ones, '.' where there are none.
    """
    reads = bundled(blocks_of(alignments))
    sides = reads.where("strand <> '.'").groupBy("bundle").agg(F.max_by("strand", F.struct("mass", "strand")).alias("__major"))
    stranded = reads.join(sides, "bundle", "left").withColumn("strand", F.when(F.col("strand") != ".", F.col("strand")).otherwise(F.coalesce("__major", F.lit("."))))
    places = stranded.groupBy("bundle").agg(F.first("contig").alias("contig"))
    models = assemble.assembled(stranded, "bundle", "strand", "blocks", "mass", least_fraction).where(F.coalesce("mass", F.lit(0.0)) >= min_mass)
    exons = F.transform("exons", lambda e: F.struct((e[0] + 1).cast("int").alias("lo"), e[1].cast("int").alias("hi")))
    return models.join(places, "bundle").select(F.concat_ws(".", "bundle", "strand", "model").alias("id"), F.concat_ws(".", "bundle", "strand").alias("gene_id"), "contig", "strand", exons.alias("exons"), "mass", "status")


def compatible_reads(alignments: DataFrame, models: DataFrame, library: str, bin: int = 10_000) -> DataFrame:
    """(library, read_id, left, id, gene_id, length, at, mass) for each alignment and model that it lies in: all its blocks in exons, all introns shared.

    models have id, gene_id, contig, strand, exons (1-based closed). at is the place on the transcript, from 0, of the alignment's
    first base in the transcript's direction: its last on '-'.
    """
    spans = models.withColumns({"lo": F.get("exons", F.lit(0))["lo"] - 1, "hi": F.get("exons", F.size("exons") - 1)["hi"]})
    length = F.aggregate("exons_r", F.lit(0), lambda s, e: s + e["hi"] - e["lo"] + 1)
    reads = blocks_of(alignments).select(library, "read_id", "contig", "strand", "mass", "blocks", "left", F.col("left").alias("lo"), F.col("right").alias("hi"))
    pairs = intervals.range_join(reads, spans.select("id", "gene_id", "contig", "strand", "exons", "lo", "hi"), ["contig"], bin=bin)
    inside = F.forall("blocks", lambda b: F.exists("exons_r", lambda e: (e["lo"] - 1 <= b["lo"]) & (b["hi"] <= e["hi"])))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("blocks") - 1)), lambda k: F.concat_ws("-", F.get("blocks", k - 1)["hi"], F.get("blocks", k)["lo"]))
    junctions = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("exons_r") - 1)), lambda k: F.concat_ws("-", F.get("exons_r", k - 1)["hi"], F.get("exons_r", k)["lo"] - 1))
    spliced = (F.size("blocks") < 2) | ((F.size("exons_r") > 1) & (F.size(F.array_except(gaps, junctions)) == 0))
    strands = intervals.strand_agree(F.col("strand"), F.col("strand_r"))
    ahead = F.when(F.col("strand_r") == "-", coding.bases(coding.segments(F.col("exons_r"), F.col("hi") + 1, F.lit(2**31 - 1)))).otherwise(coding.bases(coding.segments(F.col("exons_r"), F.lit(1), F.col("lo"))))
    at = ahead.cast("int")
    return pairs.where(inside & spliced & strands).select(library, "read_id", "left", F.col("id_r").alias("id"), F.col("gene_id_r").alias("gene_id"), length.alias("length"), at.alias("at"), "mass")


def _likely(reads: DataFrame, library: str, weights: DataFrame | None) -> DataFrame:
    """reads with their locus and fragment, and p: how likely it is that the model gives one that begins there."""
    p = 1.0 / F.col("length")
    if weights is not None:
        reads = reads.join(weights, ["id", "at"], "left")
        p = F.coalesce(F.try_divide("weight", "effective"), p)
    return reads.withColumns({"locus": F.to_json(F.struct(library, "gene_id")), "fragment": F.concat_ws(":", "read_id", "left"), "p": p}).drop("weight", "effective")


def quantify(alignments: DataFrame, models: DataFrame, library: str = "library", norm: str = "classic", variances: DataFrame | None = None, draws: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """(library, gene_id, id, length, count, fpkm, lo, hi, status, gamma, total, variance, scale): EM in each gene and library.

    A fragment is as likely to begin at each place of a model, or as weights(id, at, weight, effective) says: by the weight of
    its place over the sum of them, which is then the model's effective length.

    Masses are brought to a scale that is common to all libraries. total is the gene's mass in the library and variance its
    variance: Poisson, or what variances(mean, variance) has at it. gamma is the model's share, scale what makes FPKM of its count. lo
    and hi are two deviations away; with draws the posterior of the shares counts in them, from so many importance draws.
    """
    keyed = _likely(compatible_reads(alignments, models, library), library, weights)
    mixed = abundance.mixtures(keyed, "locus", "fragment", "id", "p", "mass")
    masses = keyed.dropDuplicates(["locus", "fragment"]).groupBy("locus", library, "gene_id").agg(F.sum("mass").alias("total"))
    counts = masses.select(F.col("gene_id").alias("locus"), F.col(library).alias("library"), F.col("total").alias("n"))
    factors = normalize.geometric(counts, "locus", "library", "n") if norm == "geometric" else normalize.quartile(counts, "library", "n") if norm == "quartile" else normalize.classic(counts, "library", "n")
    scaled = masses.join(F.broadcast(factors.withColumnRenamed("library", library)), library, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    if variances is None:
        scaled = scaled.withColumn("variance", F.col("total"))
    else:
        one = variances.select(F.lit(0).alias("__g"), "mean", "variance")
        scaled = dispersion.looked_up(scaled.withColumn("__g", F.lit(0)), one, ["__g"], "total").drop("__g")
    common = scaled.groupBy(library).agg(F.sum(F.col("total") / F.col("factor")).alias("__t")).agg(F.avg("__t").alias("__total"))
    lengths = models.select(F.col("id").alias("model"), F.aggregate("exons", F.lit(0), lambda s, e: s + e["hi"] - e["lo"] + 1).alias("length"))
    if weights is not None:
        lengths = lengths.join(weights.groupBy(F.col("id").alias("model")).agg(F.first("effective").alias("effective")), "model", "left").select("model", F.coalesce("effective", "length").alias("length"))
    found = mixed.join(scaled, "locus").join(lengths, "model").crossJoin(F.broadcast(common))
    g, t, v = F.col("gamma"), F.col("total"), F.col("variance")
    unsure = F.lit(0.0)
    if draws:
        posterior = uncertainty.posteriors(keyed, "locus", "fragment", "id", "p", "mass", draws).where("model = other").select("locus", "model", F.col("covariance").alias("__c"))
        found = found.join(posterior, ["locus", "model"], "left")
        unsure = (v + t * t - t) * F.coalesce("__c", F.lit(0.0))
    scale = abundance.fpkm(1 / F.col("factor"), F.col("length"), F.col("__total"))
    lo, hi = abundance.confidence(g * t * scale, F.sqrt(F.greatest(F.lit(0.0), t * g + (v - t) * g * g + unsure)) * scale)
    return found.select(
        library, "gene_id", F.col("model").alias("id"), "length", (g * t).alias("count"), (g * t * scale).alias("fpkm"), lo.alias("lo"), hi.alias("hi"), F.when(F.col("converged"), "OK").otherwise("FAIL").alias("status"),
        "gamma", "total", "variance", scale.alias("scale"),
    )


def quantify_unbiased(alignments: DataFrame, models: DataFrame, contigs: DataFrame, library: str = "library", rounds: int = 2, before: int = bias.BEFORE, after: int = bias.AFTER, **options) -> tuple[DataFrame, DataFrame]:
    """(quantified, ratios): quantify with the bias of fragment starts that its own results show, in turns.

    Abundances say how many starts each place should have, these against those that are seen give the ratios of bases around
    starts, a table of a few dozen rows, and the ratios new probabilities of all places. contigs(name, seq). What a
    round makes is written to the shared folder.
    """
    sequences = _kept(coding.spliced_sequences(models, contigs).select("id", F.col("mrna").alias("seq")))
    reads = _kept(compatible_reads(alignments, models, library))
    found, weights, ratios = _kept(quantify(alignments, models, library, **options)), None, None
    for _ in range(rounds):
        # A fragment counts where each of its models has it, by what the mixture says.
        likely = _likely(reads, library, weights).join(found.select(library, "id", "gamma"), [library, "id"])
        total = F.sum(F.col("p") * F.col("gamma")).over(Window.partitionBy("locus", "fragment"))
        starts = likely.withColumn("n", F.coalesce(F.try_divide(F.col("mass") * F.col("p") * F.col("gamma"), total), F.lit(0.0))).groupBy("id", "at").agg(F.sum("n").alias("n"))
        levels = found.groupBy("id").agg(F.avg("fpkm").alias("fpkm"))
        ratios = _kept(bias.learned(sequences.join(levels, "id"), starts, before, after))
        places = bias.position_weights(sequences, ratios, before, after)
        weights = _kept(places.withColumn("effective", F.sum("weight").over(Window.partitionBy("id"))))
        found = _kept(quantify(alignments, models, library, weights=weights, **options))
    return found, ratios


def fpkm_covariance(quantified: DataFrame, library: str = "library") -> DataFrame:
    """(library, gene_id, id, other, covariance) of the FPKM of each gene's models in each library."""
    keyed = quantified.withColumn("locus", F.to_json(F.struct(library, "gene_id")))
    counts = uncertainty.count_covariance(keyed, "locus", "id", "gamma", "total", "variance")
    places = keyed.select("locus", library, "gene_id").distinct()
    return uncertainty.scaled(counts, keyed, ["locus"], "id", "scale").join(places, "locus").select(library, "gene_id", "id", "other", "covariance")


def group_intervals(quantified: DataFrame, members: DataFrame, group: str, library: str = "library") -> DataFrame:
    """(library, group, fpkm, variance, lo, hi): sums over groups of models, as members(id, group) says, with their intervals.

    Models of different genes don't vary together, so that a group's variance is the sum of its parts in each gene.
    """
    variance = uncertainty.group_variance(fpkm_covariance(quantified, library), members, [library], "id", group)
    sums = quantified.join(members, "id").groupBy(library, group).agg(F.sum("fpkm").alias("fpkm"))
    lo, hi = abundance.confidence(F.col("fpkm"), F.sqrt("variance"))
    return sums.join(variance, [library, group], "left").withColumn("variance", F.coalesce("variance", F.lit(0.0))).select(library, group, "fpkm", "variance", lo.alias("lo"), hi.alias("hi"))


def gene_level(quantified: DataFrame, library: str = "library") -> DataFrame:
    """Sums of a gene's models, with its status and each model's share (kappa)."""
    shares = abundance.shares(quantified, [library, "gene_id"], "fpkm")
    return shares.groupBy(library, "gene_id").agg(F.sum("count").alias("count"), F.sum("fpkm").alias("fpkm"), fragments.group_status(F.col("status")).alias("status"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "kappa")))).alias("kappa"))


def modelled_variances(moments: DataFrame, replicates: dict[str, int], seed: int = 0) -> DataFrame:
    """moments(gene_id, condition, mean, variance) with variance from a model of all genes, pooled over conditions.

    Sample variances are corrected for what so few replicates hide, a smooth model of them is fitted in each condition, and
    the models are averaged by replicates. With fewer usable genes than a fit needs, each keeps its corrected sample variance.
    """
    parts = [negbin.corrected(moments.where(F.col("condition").isin([c for c, m in replicates.items() if m == n])), negbin.scv_curve(moments.sparkSession, n, seed=seed)) for n in sorted({n for n in replicates.values() if n > 1})]
    single = moments.where(F.col("condition").isin([c for c, n in replicates.items() if n < 2]))
    every = single
    for part in parts:
        every = every.unionByName(part)
    # Asked for its size, fitted and looked up.
    every = _kept(every)
    usable = every.where(F.col("condition").isin([c for c, n in replicates.items() if n > 1]) & (F.col("mean") > 0) & (F.col("variance") > 0))
    if usable.limit(dispersion.LEAST_LOCI * len(replicates)).count() < dispersion.LEAST_LOCI * len(replicates):
        return every
    weights = moments.sparkSession.createDataFrame(list(replicates.items()), "condition string, n int")
    model = dispersion.pooled(dispersion.fitted(usable, "condition", "mean", "variance"), weights, "condition").select(F.lit(0).alias("__g"), "mean", "variance")
    return dispersion.looked_up(every.drop("variance").withColumn("__g", F.lit(0)), model, ["__g"], "mean").drop("__g")


def differential(genes: DataFrame, samples: DataFrame, contrasts: DataFrame, library: str = "library", draws: int = 10_000, alpha: float = 0.05, variances: str = "pooled") -> DataFrame:
    """(gene_id, condition_1, condition_2, value_1, value_2, status, log2_fold_change, p_value, q_value, significant).

    samples(library, condition) and contrasts(condition_1, condition_2) are short lists. Variances come from a model of all
    genes ('pooled', as modelled_variances says) or from each gene's own replicates ('sample'). q-values are over all tests together.
    """
    by = genes.join(F.broadcast(samples), library).groupBy("gene_id", "condition").agg(F.avg("count").alias("mean"), F.coalesce(F.var_samp("count"), F.avg("count")).alias("variance"), F.avg("fpkm").alias("value"), fragments.group_status(F.col("status")).alias("side"))
    if variances == "pooled":
        # One number for each condition.
        replicates = {r["condition"]: r["n"] for r in samples.groupBy("condition").agg(F.countDistinct(library).alias("n")).collect()}
        by = modelled_variances(by, replicates)
    elif variances != "sample":
        raise ValueError(variances)
    side = lambda k: by.select("gene_id", F.col("condition").alias(f"condition_{k}"), F.col("mean").alias(f"m{k}"), F.col("variance").alias(f"v{k}"), F.col("value").alias(f"value_{k}"), F.col("side").alias(f"s{k}"))
    pairs = side(1).join(F.broadcast(contrasts.select("condition_1", "condition_2")), "condition_1").join(side(2), ["gene_id", "condition_2"])
    tests = pairs.withColumns({"test_id": F.concat_ws("|", "gene_id", "condition_1", "condition_2"), "status": stats.test_status(F.col("s1"), F.col("s2"), F.greatest("m1", "m2") >= LEAST_PER_KB)})
    p = stats.resampled_p(tests, "test_id", "m1", "v1", "m2", "v2", draws)
    judged = stats.fdr(tests.join(p, "test_id"), alpha=alpha)
    return judged.select("gene_id", "condition_1", "condition_2", "value_1", "value_2", "status", stats.log2_fold_change(F.col("value_1"), F.col("value_2")).alias("log2_fold_change"), "p_value", "q_value", "significant")


def splicing(quantified: DataFrame, samples: DataFrame, contrasts: DataFrame, group: str = "gene_id", member: str = "id", library: str = "library", least_replicates: int = 3, draws: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """(group, condition_1, condition_2, js, p_value, status, q_value, significant): whether a group's members share its FPKM otherwise.

    quantified has a row for each library and model. Models of a start site as members test splicing, start sites of a gene
    promoter use, proteins of a gene coding output: sum quantified to the member first. q-values are over all tests together.
    """
    rows = quantified.join(F.broadcast(samples), library).select(group, member, "condition", F.col("fpkm").alias("value"), "status")
    spread = rows.groupBy(group, member, "condition").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))
    tests = stats.split_tests(rows.join(spread, [group, member, "condition"]), contrasts, [group], member, least_replicates=least_replicates, draws=draws)
    return stats.fdr(tests, id=[group, "condition_1", "condition_2"], alpha=alpha)


def time_series(conditions: DataFrame, condition: str, order: str) -> DataFrame:
    """Contrasts of consecutive conditions. There are few: they are ordered in one task."""
    w = Window.orderBy(order)
    return conditions.select(F.lag(condition).over(w).alias("condition_1"), F.col(condition).alias("condition_2")).where("condition_1 IS NOT NULL")


def all_contrasts(conditions: DataFrame, condition: str, order: str) -> DataFrame:
    """Contrasts of each condition with every later one. There are few: each lists the later ones from one sorted array."""
    every = conditions.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(condition).alias("c")))).alias("all"))
    first = every.select("all", F.posexplode("all").alias("at", "a"))
    return first.select(F.col("a.c").alias("condition_1"), F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b")).select("condition_1", F.col("b.c").alias("condition_2"))


def merged_assemblies(assemblies: DataFrame) -> DataFrame:
    """Models of several samples(sample, id, contig, strand, exons, mass) assembled again as evidence, weighted by their mass."""
    loci = cluster.exon_loci(assemblies.withColumn("id", F.concat_ws("/", "sample", "id")), "id", "contig", "strand", "exons")
    again = assemble.assembled(loci.withColumns({"bundle": F.concat_ws("|", "contig", "locus"), "blocks": F.transform("exons", lambda e: F.struct((e["lo"] - 1).alias("lo"), e["hi"].alias("hi")))}), "bundle", "strand", "blocks", "mass")
    exons = F.transform("exons", lambda e: F.struct((e[0] + 1).cast("int").alias("lo"), e[1].cast("int").alias("hi")))
    return again.select(F.concat_ws(".", "bundle", "model").alias("id"), F.substring_index("bundle", "|", 1).alias("contig"), "strand", exons.alias("exons"), "mass")

"""Sequence bias of fragment starts: observed over expected bases around starts, and the weight of every position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases before a start and from it on that count; models of less FPKM teach nothing.
BEFORE, AFTER, LEAST_FPKM = 8, 13, 1.0


def _windows(df: DataFrame, at: str, weight: Column, before: int, after: int) -> DataFrame:
    """(offset, base, w): bases around positions at (from 0) of df's seq, one row each; places outside the sequence are left out."""
    offsets = F.explode(F.transform(F.sequence(F.lit(-before), F.lit(after - 1)), lambda o: F.struct(o.alias("offset"), (F.col(at) + o).alias("p"))))
    each = df.select("seq", weight.alias("w"), offsets.alias("o")).where((F.col("o.p") >= 0) & (F.col("o.p") < F.length("seq")))
    return each.select("o.offset", F.upper(F.substring("seq", F.col("o.p") + 1, F.lit(1))).alias("base"), "w").where(F.col("base").isin("A", "C", "G", "T"))


def _base_counts(before: int, after: int) -> Column:
    """(offset, base, n): how often a base stands at an offset from any position of seq. No position gets a row of its own."""
    seq, n = F.upper("seq"), F.length("seq")
    counts = []
    for o in range(-before, after):
        # The places at this offset from some position are all but the first or the last few.
        part = F.substring(seq, F.lit(max(0, o) + 1), F.greatest(F.lit(0), n - abs(o)))
        counts += [F.struct(F.lit(o).alias("offset"), F.lit(x).alias("base"), (F.length(part) - F.length(F.translate(part, x, ""))).alias("n")) for x in "ACGT"]
    return F.array(*counts)


def learned(models: DataFrame, starts: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """(offset, base, ratio): share of a base at an offset from observed starts over its share where any position may be a start.

    models(id, seq, fpkm), starts(id, at, n). Each model counts by its FPKM in what is expected, so that a strong one does not
    look like a bias. Sums are combined before the shuffle: what moves is 4 rows an offset and task.
    """
    used = models.where((F.col("fpkm") >= LEAST_FPKM) & (F.length("seq") > 0))
    observed = _windows(starts.join(used, "id"), "at", F.col("n").cast("double"), before, after).groupBy("offset", "base").agg(F.sum("w").alias("o"))
    expected = used.select(F.col("fpkm").cast("double").alias("f"), F.explode(_base_counts(before, after)).alias("c")).groupBy("c.offset", "c.base").agg(F.sum(F.col("f") * F.col("c.n")).alias("e"))
    w = Window.partitionBy("offset")
    both = expected.join(observed, ["offset", "base"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    return both.select("offset", "base", F.coalesce(F.try_divide(F.col("o") / F.sum("o").over(w), F.col("e") / F.sum("e").over(w)), F.lit(1.0)).alias("ratio"))


def position_weights(models: DataFrame, ratios: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """(id, at, weight): the product of the ratios around each position. The table of ratios is a few dozen rows and is broadcast."""
    places = models.select("id", "seq", F.posexplode(F.split("seq", "")).alias("at", "b")).where("b <> ''").select("id", "seq", "at")
    offsets = F.explode(F.transform(F.sequence(F.lit(-before), F.lit(after - 1)), lambda o: F.struct(o.alias("offset"), F.upper(F.substring("seq", F.greatest(F.lit(1), F.col("at") + o + 1), F.lit(1))).alias("base"), (F.col("at") + o).alias("p"))))
    each = places.select("id", "at", F.length("seq").alias("n"), offsets.alias("o")).select("id", "at", "o.offset", F.when((F.col("o.p") >= 0) & (F.col("o.p") < F.col("n")), F.col("o.base")).alias("base"))
    found = each.join(F.broadcast(ratios), ["offset", "base"], "left")
    return found.groupBy("id", "at").agg(F.exp(F.sum(F.log(F.greatest(F.coalesce("ratio", F.lit(1.0)), F.lit(1e-6))))).alias("weight"))


def effective_length(weights: DataFrame, length: Column, longest: int) -> DataFrame:
    """(id, effective_length): the weights of the positions from which a fragment of a length still fits."""
    return weights.withColumn("__fits", F.col("at") <= length - longest).groupBy("id").agg(F.coalesce(F.sum(F.when(F.col("__fits"), F.col("weight"))), F.lit(0.0)).alias("effective_length"))

"""Assembly: fragments of a bundle to models. Spark brings like fragments together, one grouped function a bundle finds the chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import chains
from spanforge.session import importable_on_workers


def gaps(blocks: Column) -> Column:
    """The gaps (lo, hi) between consecutive blocks."""
    n = F.size(blocks)
    return F.when(n < 2, F.array().cast("array<struct<lo:bigint,hi:bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda k: F.struct(F.get(blocks, k - 1)["hi"].alias("lo"), F.get(blocks, k)["lo"].alias("hi")))
    )


def structures(fragments: DataFrame, bundle: str, strand: str, blocks: str, mass: str) -> DataFrame:
    """(bundle, strand, lo, hi, gaps, mass, n): fragments that say the same of a bundle's structure as one, over what they cover together.

    Two fragments say the same if they have the same gaps, begin between the same two places where any gap of the bundle
    begins or ends, end between the same two, and are connected by overlaps of such fragments. No other fragment can contradict one of
    them and not the other. Null and empty blocks are left out. Fragments of a bundle are ordered in windows, which spill; nothing is collected.
    """
    flat = F.transform(blocks, lambda b: F.struct(b["lo"].cast("long").alias("lo"), b["hi"].cast("long").alias("hi")))
    named = fragments.select(F.col(bundle).cast("string").alias("bundle"), F.col(strand).alias("strand"), flat.alias("b"), F.col(mass).cast("double").alias("mass")).where("size(b) > 0")
    ends = named.select("bundle", "strand", F.get("b", F.lit(0))["lo"].alias("lo"), F.get("b", F.size("b") - 1)["hi"].alias("hi"), gaps(F.col("b")).alias("gaps"), "mass")
    same = ["bundle", "strand", "lo", "hi", "gaps"]
    distinct = ends.groupBy(*same).agg(F.sum("mass").alias("mass"), F.count("*").alias("n"))
    # A place is counted as often as it occurs: only between which places a fragment lies is asked.
    place = lambda p: F.struct(p.alias("lo"), p.alias("hi"), F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("gaps"), F.lit(None).cast("double").alias("mass"), F.lit(None).cast("bigint").alias("n"))
    places = F.flatten(F.transform("gaps", lambda g: F.array(place(g["lo"]), place(g["hi"]))))
    rows = distinct.select("bundle", "strand", F.explode(F.concat(F.array(F.struct("lo", "hi", "gaps", "mass", "n")), places)).alias("r")).select("bundle", "strand", "r.*")
    is_place = F.col("gaps").isNull().cast("int")
    before = Window.partitionBy("bundle", "strand").rowsBetween(Window.unboundedPreceding, 0)
    # A place at the start of a fragment lies before it, one at its end behind it.
    counted = rows.withColumn("first", F.sum(is_place).over(before.orderBy("lo", F.col("gaps").isNotNull()))).withColumn("last", F.sum(is_place).over(before.orderBy("hi", F.col("gaps").isNull())))
    kinds = ["bundle", "strand", "first", "last", "gaps"]
    line = Window.partitionBy(*kinds).orderBy("lo", "hi")
    apart = F.col("lo") >= F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = counted.where("gaps IS NOT NULL").withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("island", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    found = islands.groupBy(*kinds, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("mass").alias("mass"), F.sum("n").alias("n"))
    return found.select(*same, "mass", "n")


def assembled(fragments: DataFrame, bundle: str, strand: str, blocks: str, mass: str, least_fraction: float = 0.1, most: int | None = None) -> DataFrame:
    """(bundle, strand, model, exons, mass, status): models of each bundle and strand.

    blocks is an array of (lo, hi) match blocks. Fragments that say the same of the structure are one, and those that lie in an
    agreeing longer one support it, before chains are sought: a least cover of least cost, each chain a path from end to end.
    Models with less than least_fraction of the strand's largest mass go. Only where most is given, a bundle with more
    structures than that isn't assembled: one row without a model, status HIDATA.
    """
    importable_on_workers(fragments.sparkSession)
    rows = structures(fragments, bundle, strand, blocks, mass).groupBy("bundle", "strand").agg(F.collect_list(F.struct("lo", "hi", "gaps", "mass")).alias("r"))
    heavy = F.lit(False) if most is None else F.size("r") > most
    light = rows.where(~heavy).select("bundle", "strand", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), F.col("r.gaps").alias("gaps"), F.col("r.mass").alias("mass"))

    def models(lo: list[int], hi: list[int], between: list, masses: list[float]) -> list[tuple[chains.Blocks, float]]:
        blocks = [list(zip([a, *(g["hi"] for g in row)], [*(g["lo"] for g in row), b], strict=True)) for a, b, row in zip(lo, hi, between, strict=True)]
        order = sorted(range(len(blocks)), key=lambda k: (blocks[k][0][0], blocks[k][-1][1], blocks[k]))
        found = chains.models([blocks[k] for k in order], np.array([masses[k] for k in order]))
        top = max(m for _, m in found)
        return sorted((e, m) for e, m in found if m >= least_fraction * top)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            out = [(b, s, k, [list(x) for x in e], m, "OK") for b, s, *row in zip(*columns, strict=True) for k, (e, m) in enumerate(models(*row), 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["bundle", "strand", "model", "exons", "mass", "status"])

    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.int64())), pa.float64(), pa.string()]
    # A bundle is one row, so that small ones cost no group of their own.
    found = light.mapInArrow(solve, "bundle string, strand string, model int, exons array<array<bigint>>, mass double, status string")
    if most is None:
        return found
    return found.unionByName(rows.where(heavy).select("bundle", "strand", F.lit(None).cast("int").alias("model"), F.lit(None).cast("array<array<bigint>>").alias("exons"), F.lit(None).cast("double").alias("mass"), F.lit("HIDATA").alias("status")))

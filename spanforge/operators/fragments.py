"""Fragments: mate pairing, evidence weights, collapse of equal structures, levels and statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mates farther apart count as single reads.
MOST_MATE_DISTANCE = 50_000
#: Fragments of a bundle beyond which its status is HIDATA.
MOST_FRAGMENTS = 1_000_000


def raw_mass(nh: Column, single: Column) -> Column:
    """Mass of one alignment: a share of its 1/NH, half of it where the other half comes with the mate."""
    return F.when(single, 1.0).otherwise(0.5) / nh


def is_single(left: Column, mate_left: Column, same_contig: Column) -> Column:
    """Whether an alignment counts by itself: no mate, one on another contig, or one too far away."""
    return mate_left.isNull() | ~F.coalesce(same_contig, F.lit(False)) | (F.abs(mate_left - left) > MOST_MATE_DISTANCE)


def paired(reads: DataFrame, read: str, contig: str, left: str, mate_left: str, order: str) -> DataFrame:
    """(read, contig, left, right_left, order, mate_order): the two alignments of a fragment.

    A read at left whose mate is at mate_left meets one at mate_left whose mate is at left. Of several, the k-th of the one
    side takes the k-th of the other (by order). Reads without a partner are left out.
    """
    side = [read, contig, "__lo", "__hi"]
    placed = reads.where(F.col(mate_left).isNotNull()).withColumns({"__lo": F.least(left, mate_left), "__hi": F.greatest(left, mate_left), "__first": F.col(left) <= F.col(mate_left)})
    same = F.col("__lo") == F.col("__hi")
    number = F.row_number().over(Window.partitionBy(*side, F.when(same, F.lit(True)).otherwise(F.col("__first"))).orderBy(order))
    ranked = placed.withColumn("__n", number)
    # Mates that begin at one place: odd ones are first, even ones second.
    ranked = ranked.withColumns({"__first": F.when(same, F.col("__n") % 2 == 1).otherwise(F.col("__first")), "__n": F.when(same, F.floor((F.col("__n") + 1) / 2)).otherwise(F.col("__n"))})
    a = ranked.where("__first").select(*side, "__n", F.col(order).alias(order))
    b = ranked.where("NOT __first").select(*side, "__n", F.col(order).alias(f"mate_{order}"))
    return a.join(b, [*side, "__n"]).select(read, contig, F.col("__lo").alias("left"), F.col("__hi").alias("mate_left"), order, f"mate_{order}")


def collapsed(df: DataFrame, key: Sequence[str], mass: Column, multi: Column | None = None, read: str | None = None) -> DataFrame:
    """One row for each structure with the sum of mass and number of copies. Multi-mapping reads are equal only to themselves."""
    keys = [F.col(k) for k in key]
    if multi is not None and read is not None:
        keys.append(F.when(multi, F.col(read)).alias("__read"))
    return df.groupBy(*keys).agg(F.sum(mass).alias("mass"), F.count("*").alias("copies")).drop("__read")


def uniform_shares(df: DataFrame, read: str) -> DataFrame:
    """df with weight: one over the number of places of the read."""
    return df.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(read)))


def rescued_shares(df: DataFrame, read: str, expression: str) -> DataFrame:
    """df with weight: the place's expression as a share of that of all places of the read; 0 where that sum is 0."""
    total = F.sum(expression).over(Window.partitionBy(read))
    return df.withColumn("weight", F.when(total == 0, 0.0).otherwise(F.col(expression) / total))


def capped(df: DataFrame, bundle: Sequence[str], order: Sequence[str], most: int = MOST_FRAGMENTS) -> DataFrame:
    """The first most fragments of each bundle, with status HIDATA where there were more."""
    w = Window.partitionBy(*bundle)
    ranked = df.withColumns({"__n": F.row_number().over(w.orderBy(*order)), "__all": F.count("*").over(w)})
    return ranked.where(F.col("__n") <= most).withColumn("status", F.when(F.col("__all") > most, "HIDATA").otherwise("OK")).drop("__n", "__all")


def group_status(status: Column) -> Column:
    """Status of a group as an aggregate: FAIL, then HIDATA, then OK where any member is, else LOWDATA."""
    def any_is(x: str) -> Column:
        return F.max(F.when(status == x, 1).otherwise(0)) == 1

    return F.when(any_is("FAIL"), "FAIL").when(any_is("HIDATA"), "HIDATA").when(any_is("OK"), "OK").otherwise("LOWDATA")


def rolled_up(df: DataFrame, levels: dict[str, Sequence[str]], sums: Sequence[str]) -> DataFrame:
    """Sums at each level of a fixed hierarchy: (level, key, sums). One pass: the levels are grouping sets."""
    columns = list(dict.fromkeys(c for keys in levels.values() for c in keys))
    sets = [[F.col(c) for c in keys] for keys in levels.values()]
    found = df.groupingSets(sets, *(F.col(c) for c in columns)).agg(F.grouping_id().alias("__g"), *(F.sum(s).alias(s) for s in sums))
    level = key = F.lit(None).cast("string")
    for name, keys in levels.items():
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        level = F.when(F.col("__g") == bits, name).otherwise(level)
        key = F.when(F.col("__g") == bits, F.concat_ws("|", *(F.col(c).cast("string") for c in keys))).otherwise(key)
    return found.select(level.alias("level"), key.alias("key"), *sums)


def group_effective_length(members: DataFrame, group: Sequence[str], length: str, fpkm: str) -> DataFrame:
    """(group, effective_length): its members' effective lengths, each weighted by its share of the group's FPKM; 0 without any."""
    total, weighted = F.sum(fpkm), F.sum(F.col(length) * F.col(fpkm))
    return members.groupBy(*group).agg(F.when(total == 0, 0.0).otherwise(weighted / total).alias("effective_length"))


def id_sets(members: DataFrame, group: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(group, ids): for each group the different ids of its members in order, joined by ','; '-' where it has none."""
    known = lambda c: F.collect_set(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")))
    sets = members.groupBy(*group).agg(*(F.array_sort(known(c)).alias(c) for c in ids))
    return sets.select(*group, *(F.when(F.size(c) == 0, "-").otherwise(F.array_join(c, ",")).alias(c) for c in ids))


def replicate_means(rows: DataFrame, id: Sequence[str], values: Sequence[str], replicates: int) -> DataFrame:
    """(id, values): means over a condition's replicates; one in which the id isn't there counts as 0."""
    return rows.groupBy(*id).agg(*((F.sum(v) / replicates).alias(v) for v in values))

"""Interval algebra on half-open [lo, hi) columns: predicates, range joins, islands, coverage, nearest, models.

Every operator takes column names, so that it runs on alignments, annotations or any table with a group, a start and an end.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_lo, a_hi, b_lo, b_hi, slack: int = 0) -> Column:
    """Whether two half-open intervals share a position, or come within slack of it."""
    return (a_lo < b_hi + slack) & (b_lo < a_hi + slack)


def contains(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Whether the first interval holds the whole second one."""
    return (a_lo <= b_lo) & (b_hi <= a_hi)


def properly_contains(a_lo, a_hi, b_lo, b_hi) -> Column:
    return (a_lo < b_lo) & (b_hi < a_hi)


def contains_with_overhang(a_lo, a_hi, b_lo, b_hi, strand, five: int = 0, three: int = 0) -> Column:
    """Containment that lets the second interval hang over the 5' and 3' ends of the first, by strand ('.' allows neither)."""
    left = F.when(strand == "+", five).when(strand == "-", three).otherwise(0)
    right = F.when(strand == "+", three).when(strand == "-", five).otherwise(0)
    return (a_lo - left <= b_lo) & (b_hi <= a_hi + right)


def overlap_length(a_lo, a_hi, b_lo, b_hi) -> Column:
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def strand_agree(a, b) -> Column:
    """Equal strands, or either one unknown ('.')."""
    return (a == b) | (a == ".") | (b == ".")


def range_join(left: DataFrame, right: DataFrame, on: Sequence[str], lo: str = "lo", hi: str = "hi", bin: int = 10_000, suffix: str = "_r") -> DataFrame:
    """Pairs of rows of one group whose intervals overlap: an equality join on (group, bin), no nested loop.

    Each interval is laid into the bins that it touches; a pair that meets in several is kept in the first bin that both
    touch. Empty intervals match nothing. The right side's columns get the suffix. Choose bin near the usual length:
    smaller bins repeat rows, larger ones compare more of them.
    """
    def binned(df: DataFrame) -> DataFrame:
        return df.where(F.col(lo) < F.col(hi)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / bin), F.floor((F.col(hi) - 1) / bin))))

    renamed = right.select(*(F.col(c).alias(c + suffix) for c in right.columns))
    r = renamed.where(F.col(lo + suffix) < F.col(hi + suffix)).withColumn("__bin_r", F.explode(F.sequence(F.floor(F.col(lo + suffix) / bin), F.floor((F.col(hi + suffix) - 1) / bin))))
    match = F.col("__bin") == F.col("__bin_r")
    for c in on:
        match &= F.col(c) == F.col(c + suffix)
    both = binned(left).join(r, match)
    first = F.floor(F.greatest(F.col(lo), F.col(lo + suffix)) / bin)
    return both.where(overlaps(F.col(lo), F.col(hi), F.col(lo + suffix), F.col(hi + suffix)) & (F.col("__bin") == first)).drop("__bin", "__bin_r")


#: Rows of a group beyond which it is cut into ranges of about so many rows, and groups that are cut at most: of N rows the
#: next largest has fewer than N / MOST_CUT, so that all others can be ordered whole.
RANGE_ROWS, MOST_CUT = 100_000, 50_000
#: The default of width: groups of many rows are cut, by their own span and size.
BY_ROWS = "by rows"


def _same(df: DataFrame, keys: dict[str, str]) -> Column:
    return functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()))


def _cut(df: DataFrame, group: Sequence[str], at: str, width: int | str | None, source: tuple[DataFrame, str] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of groups that are ordered whole, rows of the others with __range); either is None where there are none.

    source: the rows that are counted and their column of places, where df is made from others that are less work to count.

    Windows order a group's rows inside ranges, and carry running values over from range to range, so that no task orders a
    large group whole. What is asked first is only which groups are large: one row for each of these comes to the driver.
    """
    if width is None:
        return df, None
    if isinstance(width, int):
        return None, df.withColumn("__range", F.coalesce(F.floor(F.col(at) / width), F.lit(-(1 << 62))))
    keys = {c: f"__key_{i}" for i, c in enumerate(group)}
    rows, place = source or (df, at)
    sizes = rows.groupBy(*(F.col(c).alias(k) for c, k in keys.items())).agg(F.count("*").alias("__n"), F.min(place).alias("__first"), F.max(place).alias("__last")).where(F.col("__n") > RANGE_ROWS)
    large = sizes.orderBy(F.desc("__n")).limit(MOST_CUT).withColumn("__width", F.greatest(F.lit(1), F.ceil((F.col("__last") - F.col("__first") + 1) / F.ceil(F.col("__n") / RANGE_ROWS)))).drop("__n", "__last")
    found = large.collect()
    if not found:
        return df, None
    listed = F.broadcast(df.sparkSession.createDataFrame(found, large.schema))
    marked = df.join(listed, _same(df, keys), "left").drop(*keys.values())
    rest = ["__first", "__width"]
    number = F.coalesce(F.floor((F.col(at) - F.col("__first")) / F.col("__width")), F.lit(-(1 << 62)))
    return marked.where("__width IS NULL").drop(*rest), marked.where("__width IS NOT NULL").withColumn("__range", number).drop(*rest)


def _both(whole: DataFrame | None, cut: DataFrame | None, run: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """run on the rows of either kind, together."""
    parts = [run(x, i == 1) for i, x in enumerate((whole, cut)) if x is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _with_carried(df: DataFrame, group: Sequence[str], place: str, summary: Column, carried: Column, name: str, after: bool = False) -> DataFrame:
    """df with name: carried(values of summary in the group's earlier ranges, or in its later ones), null where there are none.

    summary is an aggregate of one range; carried is an aggregate of the column __value, in order of the ranges.
    """
    along = Window.partitionBy(*group).orderBy(place)
    frame = along.rowsBetween(1, Window.unboundedFollowing) if after else along.rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: f"__key_{i}" for i, c in enumerate([*group, place])}
    ranges = df.groupBy(*keys).agg(summary.alias("__value")).withColumn(name, carried.over(frame)).select(*(F.col(c).alias(k) for c, k in keys.items()), name)
    return df.join(ranges, _same(df, keys)).drop(*keys.values())


def islands(df: DataFrame, group: Sequence[str], lo: str = "lo", hi: str = "hi", slack: int = 0, order: Sequence[str] = (), name: str = "island", width: int | str | None = BY_ROWS) -> DataFrame:
    """df with the number, from 1, of the island in its group: rows join one that begins before the running end + slack.

    width: positions of a range in which rows are ordered; by rows, groups beyond RANGE_ROWS rows are cut into ranges of about as
    many; None orders each group in one task.
    """
    def run(part: DataFrame, ranged: bool) -> DataFrame:
        w = Window.partitionBy(*group, *(["__range"] if ranged else [])).orderBy(lo, *order)
        end = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
        if ranged:
            part = _with_carried(part, group, "__range", F.max(hi), F.max("__value"), "__end")
            end = F.greatest(end, "__end")
        new = part.withColumn("__new", F.when(end.isNull() | (F.col(lo) >= end + slack), 1).otherwise(0))
        number = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
        if ranged:
            new = _with_carried(new, group, "__range", F.sum("__new"), F.sum("__value"), "__before")
            number = number + F.coalesce("__before", F.lit(0))
        return new.withColumn(name, number).drop("__new", "__range", "__end", "__before")

    return _both(*_cut(df, group, lo, width), run)


def merged(df: DataFrame, group: Sequence[str], lo: str = "lo", hi: str = "hi", slack: int = 0, order: Sequence[str] = (), aggregates: Sequence[Column] = (), width: int | str | None = BY_ROWS) -> DataFrame:
    """One row for each island: its bounds, its number of rows and any aggregates."""
    found = islands(df, group, lo, hi, slack, order, "island", width)
    return found.groupBy(*group, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n"), *aggregates)


def coverage(df: DataFrame, group: Sequence[str], lo: str = "lo", hi: str = "hi", weight: Column | None = None, width: int | str | None = BY_ROWS) -> DataFrame:
    """Maximal stretches of constant depth (lo, hi, depth), depth not 0: ends are summed by place before they are ordered."""
    w = F.lit(1) if weight is None else weight
    ends = df.select(*group, F.explode(F.array(F.struct(F.col(lo).alias("at"), w.alias("d")), F.struct(F.col(hi).alias("at"), (-w).alias("d")))).alias("e"))
    steps = ends.groupBy(*group, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")

    def run(part: DataFrame, ranged: bool) -> DataFrame:
        along = Window.partitionBy(*group, *(["__range"] if ranged else [])).orderBy("at")
        depth, end = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lead("at").over(along)
        if ranged:
            part = _with_carried(part, group, "__range", F.sum("d"), F.sum("__value"), "__before")
            part = _with_carried(part, group, "__range", F.min("at"), F.first("__value"), "__after", after=True)
            depth, end = depth + F.coalesce("__before", F.lit(0)), F.coalesce(end, "__after")
        found = part.withColumn("depth", depth).withColumn("hi", end)
        return found.where("hi IS NOT NULL AND depth <> 0").select(*group, F.col("at").alias("lo"), "hi", "depth")

    return _both(*_cut(steps, group, "at", width, (df, lo)), run)


def nearest_preceding(left: DataFrame, right: DataFrame, group: Sequence[str], at: str, value: str, within: int, width: int | str | None = BY_ROWS) -> DataFrame:
    """left with {value}_before: the latest value of right at the same or an earlier place, no more than within away.

    An as-of join in one ordered pass over the union: no pair of rows is made.
    """
    marked = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__at", F.lit(None).cast(right.schema[at].dataType))
    other = right.select(*group, at, F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(at).alias("__at"))
    all_rows = marked.unionByName(other, allowMissingColumns=True)
    seen = F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"), F.col("__at").alias("a")))

    def run(part: DataFrame, ranged: bool) -> DataFrame:
        w = Window.partitionBy(*group, *(["__range"] if ranged else []))
        last = F.last(seen, ignorenulls=True).over(w.orderBy(F.col(at), "__side", F.col("__v")).rowsBetween(Window.unboundedPreceding, 0))
        if ranged:
            latest = F.max_by(seen, F.when(F.col("__side") == 0, F.struct(F.col(at).alias("a"), F.col("__v").alias("v"))))
            part = _with_carried(part, group, "__range", latest, F.last("__value", ignorenulls=True), "__carried")
            last = F.coalesce(last, "__carried")
        found = part.withColumn("__last", last)
        near = F.col("__last.a") >= F.col(at) - within
        return found.where("__side = 1").withColumn(f"{value}_before", F.when(near, F.col("__last.v"))).select(*left.columns, f"{value}_before")

    return _both(*_cut(all_rows, group, at, width), run)


def union_model(df: DataFrame, group: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The positions that any interval of the group has, as disjoint intervals."""
    return merged(df, group, lo, hi).select(*group, lo, hi)


def intersection_model(df: DataFrame, group: Sequence[str], member: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The positions that every member of the group has (a member's own intervals must be disjoint)."""
    members = df.groupBy(*group).agg(F.countDistinct(member).alias("__all"))
    return coverage(df, group, lo, hi).join(members, list(group)).where("depth = __all").select(*group, "lo", "hi")


def minor(df: DataFrame, group: Sequence[str], id: str, count: str, fraction: float, lo: str = "lo", hi: str = "hi", bin: int = 10_000) -> DataFrame:
    """Rows whose count lies below fraction of that of some other overlapping row of the group."""
    pairs = range_join(df.select(*group, id, count, lo, hi), df.select(*group, id, count, lo, hi), group, lo, hi, bin)
    beaten = pairs.where((F.col(id) != F.col(f"{id}_r")) & (F.col(count) < F.col(f"{count}_r") * fraction)).select(id).distinct()
    return df.join(beaten, id, "left_semi")

"""Clusters: components of links, exon-overlap loci, start-site groups, Jensen-Shannon k-means."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.intervals import islands, range_join
from spanforge.session import shared_dir


def _kept(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/cluster-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_components(nodes: DataFrame, edges: DataFrame, id: str, a: str, b: str, most: int = 50) -> DataFrame:
    """(id, component) for every node: the least node that links reach.

    Each round a node takes the least label of its neighbours, then the label of its label, so that distances halve. Rounds
    are tables in the shared folder.
    """
    both = _kept(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct())
    labels = _kept(nodes.select(F.col(id).alias("node"), F.col(id).alias("label")).distinct())
    for _ in range(most):
        least = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("seen"))
        near = labels.join(least, F.col("node") == F.col("x"), "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        nxt = _kept(near.join(jump, F.col("label") == F.col("__n"), "left").select("node", "was", F.least("label", F.coalesce("__l", "label")).alias("label")))
        changed = nxt.where("was <> label").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels.select(F.col("node").alias(id), F.col("label").alias("component"))
    raise RuntimeError(f"labels did not settle in {most} rounds")


def exon_loci(df: DataFrame, id: str, contig: str, strand: str, exons: str, bin: int = 10_000) -> DataFrame:
    """df with locus: the least id of the rows linked by exons that share bases on one strand. exons: array of (lo, hi), closed."""
    flat = df.select(F.col(id).alias("__id"), F.col(contig).alias("__c"), F.col(strand).alias("__s"), F.explode(exons).alias("e")).select("__id", "__c", "__s", (F.col("e.lo") - 1).alias("lo"), F.col("e.hi").alias("hi"))
    # Exons of one island overlap in a chain: each is linked to the island's first, not to every other.
    chained = islands(flat, ["__c", "__s"], order=["hi", "__id"])
    first = chained.groupBy("__c", "__s", "island").agg(F.min("__id").alias("__first"))
    edges = chained.join(first, ["__c", "__s", "island"]).where("__id <> __first").select("__id", "__first").distinct()
    found = label_components(df, edges, id, "__id", "__first")
    return df.join(found.withColumnRenamed("component", "locus"), id)


def annotated_clusters(df: DataFrame, id: str, keys: Sequence[str]) -> DataFrame:
    """df with cluster: the least id of the rows linked by equal values of any of the keys (gene, start site or protein ids).

    Each value links its rows to the least of them, so that there are as many links as rows. Nulls link nothing.
    """
    edges = None
    for k in keys:
        rows = df.where(F.col(k).isNotNull()).select(F.col(k).alias("__k"), F.col(id).alias("__id"))
        pairs = rows.join(rows.groupBy("__k").agg(F.min("__id").alias("__first")), "__k").where("__id <> __first").select("__id", "__first")
        edges = pairs if edges is None else edges.union(pairs)
    found = label_components(df, edges.distinct(), id, "__id", "__first").withColumnRenamed("component", "cluster")
    return df.join(found, id)


def overlap_loci(df: DataFrame, id: str, group: Sequence[str], bin: int = 10_000) -> DataFrame:
    """df(id, group, lo, hi) with locus, from the pairs of a range join; for links that are not chains of islands."""
    pairs = range_join(df.select(id, *group, "lo", "hi"), df.select(id, *group, "lo", "hi"), group, bin=bin).where(F.col(id) < F.col(f"{id}_r"))
    return df.join(label_components(df, pairs, id, id, f"{id}_r").withColumnRenamed("component", "locus"), id)


def start_sites(df: DataFrame, group: Sequence[str], start: str, within: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """df with tss: rows whose starts follow each other by at most within. In order of start, so input order doesn't matter."""
    points = df.withColumns({"__lo": F.col(start), "__hi": F.col(start) + 1})
    return islands(points, group, "__lo", "__hi", within, order, "tss").drop("__lo", "__hi")


def js_kmeans_step(points: DataFrame, centres: DataFrame, id: str, item: str, p: str) -> DataFrame:
    """(id, centre, distance): the nearest centre of each point by Jensen-Shannon distance, ties to the lesser centre.

    points(id, item, p) and centres(centre, item, q) hold shares; the centres are k short rows and are broadcast.
    """
    term = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    pairs = points.select(id, F.col(item).alias("__item"), F.col(p).alias("__p")).join(F.broadcast(centres.select("centre", F.col(item).alias("__item"), F.col("q").alias("__q"))), "__item")
    a, b = F.col("__p"), F.col("__q")
    distance = pairs.groupBy(id, "centre").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(term((a + b) / 2) - (term(a) + term(b)) / 2))).alias("distance"))
    best = distance.groupBy(id).agg(F.min(F.struct(F.round("distance", 12).alias("d"), "centre")).alias("m"))
    return best.select(id, F.col("m.centre").alias("centre"), F.col("m.d").alias("distance"))


def js_kmeans(points: DataFrame, k: int, id: str, item: str, p: str, rounds: int = 10) -> DataFrame:
    """(id, centre, distance) after rounds of assignment and means, from the k points of least hash. Items absent from a row must be there as 0."""
    seeds = [r[0] for r in points.select(id).distinct().orderBy(F.xxhash64(F.col(id).cast("string")), id).limit(k).collect()]
    number = F.create_map(*(F.lit(x) for pair in zip(seeds, range(len(seeds)), strict=True) for x in pair))
    centres = points.where(F.col(id).isin(seeds)).select(number[F.col(id)].alias("centre"), item, F.col(p).alias("q"))
    for _ in range(rounds):
        centres = _kept(centres)
        near = js_kmeans_step(points, centres, id, item, p)
        centres = points.join(near.select(id, "centre"), id).groupBy("centre", item).agg(F.avg(p).alias("q"))
    return js_kmeans_step(points, _kept(centres), id, item, p)

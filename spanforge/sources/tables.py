"""Control tables in, result tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return rows


def contrasts(spark: SparkSession, path: str) -> DataFrame:
    """(condition_1, condition_2, name): a header row, '#' comments; the name falls back on the conditions."""
    rows = _tsv(spark, path, ["condition_1", "condition_2", "name"])
    return rows.withColumn("name", F.coalesce("name", F.concat_ws("_vs_", "condition_1", "condition_2")))


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(group, paths): files of each condition in order."""
    rows = _tsv(spark, path, ["path", "group"])
    return rows.groupBy("group").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def standards(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, ["locus"]).select("locus").distinct()


def renamed_contigs(df: DataFrame, names: DataFrame, contig: str = "contig") -> DataFrame:
    """df with contigs renamed by names(old, new); rows of others go. The table of names is joined, small or not."""
    return df.join(names.select(F.col("old").alias(contig), F.col("new").alias("__new")), contig).withColumn(contig, F.col("__new")).drop("__new")


def tracking(long: DataFrame, id: Sequence[str], condition: str, value: str, conditions: Sequence[str] | None = None) -> DataFrame:
    """Wide table with a column for each condition. Naming the conditions saves a pass."""
    return long.groupBy(*id).pivot(condition, list(conditions) if conditions else None).agg(F.first(value))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def as_gct(wide: DataFrame, name: str, description: str, conditions: Sequence[str]) -> DataFrame:
    """The rows of a GCT matrix (without its two counts of header): name, description, values."""
    return wide.select(F.col(name).cast("string").alias("Name"), F.coalesce(F.col(description).cast("string"), F.lit("na")).alias("Description"), *conditions)


def as_test_table(tests: DataFrame) -> DataFrame:
    """The fourteen columns of a table of tests, from test_id, gene_id, gene, locus, condition_1, condition_2, status, value_1,
    value_2, log2_fold_change, test_stat, p_value, q_value and significant; '-' for names that aren't there."""
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")).alias(c)
    number = lambda c, missing: F.coalesce(F.col(c).cast("double"), F.lit(missing))
    return tests.select(
        "test_id", name("gene_id"), name("gene"), name("locus"), F.col("condition_1").alias("sample_1"), F.col("condition_2").alias("sample_2"), "status",
        number("value_1", 0.0).alias("value_1"), number("value_2", 0.0).alias("value_2"), number("log2_fold_change", 0.0).alias("log2(fold_change)"), number("test_stat", 0.0).alias("test_stat"),
        number("p_value", 1.0).alias("p_value"), number("q_value", 1.0).alias("q_value"), F.when(F.col("significant"), "yes").otherwise("no").alias("significant"),
    )

"""Session helpers: the cluster's shared folder and tables written to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanforge.session import importable_on_workers, shared_dir

#: Rows in an Arrow batch that a Python task is given; bounds a task's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a job's shuffle files are deleted when it ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read again. What was shuffled on the way is deleted: the table stands for it."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_SHUFFLES_GO) if before is None else conf.set(_SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    return _stored(df, fresh_path(df.sparkSession, name))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_path named and nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that are written on the way to a result and deleted when it is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return _stored(df, self.paths[-1])

    def forget(self, keep: int = 0) -> None:
        """Delete all tables but the last keep ones."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            removed(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that stays, after which the others go."""
        out = written(df, name)
        self.forget()
        return out


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores after it, so that no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    importable_on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Raw files through Spark's own writers and readers, so that they reach any store Spark can and survive lost tasks.

A row becomes one file: its bytes, followed by a fixed trailer. The text writer ends each row with its line separator;
the separator is the trailer, and each row stands in a folder of its own name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(bodies: DataFrame, path: str, trailer: bytes) -> None:
    """bodies(name string, body binary), names distinct: writes {path}/name={name}/part-*.txt holding body + trailer."""
    rows = bodies.select("name", F.col("body").cast("string").alias("value"))
    rows.write.partitionBy("name").option("lineSep", trailer.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def read_files(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, body) of the files, trailer included; only those of names if given (other folders aren't opened)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").schema("path string, modificationTime timestamp, length long, content binary, name string").load(path)
    if names is not None:
        files = files.where(F.col("name").isin(names))
    return files.select("name", F.col("content").alias("body"))


def read_stretches(spark: SparkSession, path: str, name: str, stretches: list[tuple[int, int]]) -> list[bytes]:
    """(start, length) stretches of one file, and nothing else of it, through the file system that Spark has for the path.

    A start below 0 counts from the end.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/name={name}/part-*.txt")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = files.globStatus(where)[0]
    stream = files.open(status.getPath())
    try:
        out = []
        for start, length in stretches:
            stream.seek(start + status.getLen() if start < 0 else start)
            out.append(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(length))))
        return out
    finally:
        stream.close()

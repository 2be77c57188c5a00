"""File listings, and changes between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Regular files below ``path``: rel_path, length and mtime. The content
    column is pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    root = F.lit(path.rstrip("/").removeprefix("file:"))
    local = F.regexp_replace("path", r"^file:/+", "/")
    relative = F.when(local.startswith(F.concat(root, F.lit("/"))), F.substr(local, F.length(root) + 2)).otherwise(
        F.regexp_extract(local, r"[^/]+$", 0)
    )
    return files.select(root.alias("root"), relative.alias("rel_path"), "length", F.col("modificationTime").alias("mtime"))


def file_changes(previous: DataFrame, current: DataFrame, path: str = "path") -> DataFrame:
    """WRITE and REMOVE between two listings (path, length, mtime).

    Only the files of the first listing are watched: new ones are not reported.
    """
    now = current.select(path, F.struct("length", "mtime").alias("__now"))
    joined = previous.join(now, path, "left")
    op = F.when(F.col("__now").isNull(), "REMOVE").when(~F.col("__now").eqNullSafe(F.struct("length", "mtime")), "WRITE")
    return joined.withColumn("op", op).filter(F.col("op").isNotNull()).select(path, "op")

"""Running streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def run_once(writer: DataStreamWriter) -> None:
    """Run a stream once over all that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_table(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write into the folder was committed; a crash leaves it without mark."""
    path, files = _hadoop_path(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the folders that match a pattern, written to completion or not."""
    path, files = _hadoop_path(spark, pattern)
    return [str(status.getPath()) for status in files.globStatus(path) or []]


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that a stream wrote, if it is there."""
    path, files = _hadoop_path(spark, folder)
    files.delete(path, True)


def to_files(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once parquet sink."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")

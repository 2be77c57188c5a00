"""What several operators need to read texts inside tasks.

Texts reach Python as UTF-8 bytes in Arrow batches; ``bytes.split`` and
``bytes.lower`` work on ASCII only, which is what the operators define.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.ordered import bounded_broadcast
from tidewatch.session import send_by_value, shared_folder

send_by_value(__name__)

LEAST_TASK_BYTES = 8 << 20

_STATE = "_tidewatch_worker_state"


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts of a batch as bytes; null is the empty text."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D."""
    return text.split()


def worker_state(kind: str, make: Callable[[], Any], key: Any = None) -> Any:
    """An object kept by a Python worker between its tasks (a cache, a model): the last
    one of its kind, so that a worker never holds the tables of two jobs."""
    kept = sys.modules.setdefault(_STATE, ModuleType(_STATE)).__dict__
    if kind not in kept or kept[kind][0] != key:
        kept.pop(kind, None)
        kept[kind] = (key, make())
    return kept[kind][1]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name meets those an operator adds."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def columns_of(struct: str, names: list[str]) -> list[Column]:
    return [F.col(f"{struct}.{quoted(name)}").alias(name) for name in names]


def id_remainder(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def packed(df: DataFrame) -> DataFrame:
    """A scan of many small files in tasks of at least ``LEAST_TASK_BYTES``, two to a core
    at least. Scans in larger tasks stay as they are."""
    n_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // LEAST_TASK_BYTES)))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage like a checkpoint,
    and takes less room."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return packed(df.sparkSession.read.schema(df.schema).parquet(path))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``kept``, in buckets by ``key``: a join by that column shuffles only the
    other side. The table's files lie in the shared folder. Rows that come from an
    aggregation by the key are written without another shuffle."""
    spark = df.sparkSession
    buckets = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions")
    path = shared_folder(spark, name)
    table = "tidewatch_" + path.rsplit("-", 1)[-1]
    df.write.bucketBy(int(buckets), key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def join_copies(left: DataFrame, right: DataFrame, keys: list[str], copies: str, limit: int) -> DataFrame:
    """Inner join with a side of unique keys that says how many rows the left side has
    of each. Keys with more than ``limit`` rows (at most rows / limit of them, counted
    first) are broadcast, so that their rows stay where they are; the rest is shuffled."""
    n_heavy = right.filter(F.col(copies) > limit).count()
    if n_heavy == 0:
        return left.join(right, keys)
    heavy = bounded_broadcast(right.filter(F.col(copies) > limit), n_heavy)
    light = left.join(bounded_broadcast(right.filter(F.col(copies) > limit).select(*keys), n_heavy), keys, "left_anti")
    return light.join(right.filter(F.col(copies) <= limit), keys).unionByName(left.join(heavy, keys))

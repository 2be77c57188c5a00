"""Training order: every sequence gets a slot by a keyed permutation and is written
to fixed-stride shards.

Documents are cut into sequences of at most ``STRIDE_TOKENS`` ids, numbered from 0 in
the order in which the table is read. A balanced Feistel network permutes the
smallest domain of an even number of bits that holds all numbers; a result outside
the numbers is sent through the network again (cycle walking), so slots are a
permutation of the numbers that only depends on the key and their count.

A shard is a folder ``shard=N`` with ``SHARD_SLOTS`` consecutive slots (the last may
have fewer), each record a binary of exactly ``STRIDE_TOKENS`` little-endian unsigned
16-bit ids, padded with ``PAD``. A reader that stopped at a slot opens the shard
``slot // SHARD_SLOTS`` and goes on from there. Files go through Spark's writer, which
commits whole tasks only, so a lost executor leaves no partial shard.

Defined results: a null text is an empty one, and an empty document is its end token
alone. Repeated rows and equal ids are sequences of their own. Other columns are not
read. An empty table writes no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.tokens import ID_BYTES, default_files, document_pieces
from tidewatch.session import send_by_value, shared_folder

send_by_value(__name__)

STRIDE_TOKENS = 1024
SHARD_SLOTS = 4096
ROUNDS = 6
KEY = 0x5EED_0F_7E57
#: Fills a record behind its ids; no id of the vocabulary.
PAD = 65535

_RECORD = "array<struct<piece:int,length:bigint,ids_crc32:bigint,ids:binary>>"


def _mixed(half: np.ndarray, key: int, turn: int) -> np.ndarray:
    """A keyed hash of 64-bit numbers (two multiply-and-shift steps)."""
    start = (key + (turn + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = half.astype(np.uint64) ^ np.uint64(start)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        x ^= x >> np.uint64(27)
    return x


def feistel(numbers: np.ndarray, half_bits: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Permutation of the numbers below 2 ** (2 * half_bits)."""
    mask = np.uint64((1 << half_bits) - 1)
    left, right = numbers.astype(np.uint64) >> np.uint64(half_bits), numbers.astype(np.uint64) & mask
    for turn in range(rounds):
        left, right = right, left ^ (_mixed(right, key, turn) & mask)
    return left << np.uint64(half_bits) | right


def slots_of(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of numbers below n: a permutation of 0 .. n - 1."""
    half_bits = max(1, -(-(n - 1).bit_length() // 2))
    out = feistel(numbers, half_bits, key)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = feistel(out[outside], half_bits, key)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def slot(number: Column, n: int, key: int = KEY) -> Column:
    def permute(numbers: pa.Array) -> pa.Array:
        return pa.array(slots_of(numbers.to_numpy(zero_copy_only=False), n, key))

    return F.arrow_udf(permute, "bigint")(number)


def sequences(docs: DataFrame, stride: int = STRIDE_TOKENS, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, length, ids_crc32 (of 32-bit ids) and ids (16-bit) of every sequence."""
    files = files or default_files()

    def encode(texts: pa.Array) -> pa.Array:
        rows = []
        for text in (scalar.as_py() for scalar in texts):
            row = []
            for number, ids in enumerate(document_pieces(text, files, stride)):
                short = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                row.append({"piece": number, "length": len(ids) // ID_BYTES, "ids_crc32": zlib.crc32(ids), "ids": short})
            rows.append(row)
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))
        return pa.array(rows, kind)

    found = F.arrow_udf(encode, _RECORD)(F.col("text"))
    return docs.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Add ``number``, from 0, to rows that hold their writer's ``part`` and their
    ``place`` in it; and the count of all rows."""
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one row per task of the scan
    return rows.join(F.broadcast(starts), "part").withColumn("number", F.col("before") + F.col("place")).drop("part", "place", "before"), n


def padded(ids: Column, stride: int) -> Column:
    size = 2 * stride
    return F.substring(F.concat(ids, F.lit(int(PAD).to_bytes(2, "little") * stride)), F.lit(1), F.lit(size))


def materialise(docs: DataFrame, out: str, key: int = KEY, stride: int = STRIDE_TOKENS, shard_slots: int = SHARD_SLOTS, files: tuple[str, str] | None = None) -> DataFrame:
    """Write the shards below ``out`` and return them as a table, in slot order
    within each shard: slot, doc_id, piece, length, ids_crc32, ids, shard."""
    spark = docs.sparkSession
    kept = shared_folder(spark, "sequences")
    # numbers follow the tasks of this scan, so they are written down once, with the ids
    place = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    sequences(docs, stride, files).select("*", F.spark_partition_id().alias("part"), place).write.option("compression", "zstd").parquet(kept)
    rows, n = numbered(spark.read.parquet(kept))
    shard = F.floor(F.col("slot") / shard_slots).cast("int").alias("shard")
    ordered = (
        rows.withColumn("slot", slot(F.col("number"), max(n, 1), key))
        .select("slot", "doc_id", "piece", "length", "ids_crc32", padded(F.col("ids"), stride).alias("ids"), shard)
        .repartitionByRange(max(1, -(-n // shard_slots)), "shard")
        .sortWithinPartitions("shard", "slot")
    )
    ordered.write.option("compression", "zstd").partitionBy("shard").mode("overwrite").parquet(out)
    return spark.read.schema(ordered.schema).parquet(out)


def read_from(spark: SparkSession, out: str, first_slot: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The records from a slot on; only the shards that hold them are opened."""
    return spark.read.parquet(out).filter((F.col("shard") >= first_slot // shard_slots) & (F.col("slot") >= first_slot)).orderBy("slot")

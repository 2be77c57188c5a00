"""Bloom filters over 64-bit hashes, filled by Spark and of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import send_by_value

send_by_value(__name__)

KEY_BITS, LEAST_BITS = 16, 1 << 20
PROBES = 3
#: Bits of one row of ``bitmap_construct_agg``.
BITMAP = 4096 * 8

_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64)) for i in range(PROBES)]


def _places(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit of each hash; ``size`` is a power of two."""
    return hashes * _FACTORS[probe] >> np.uint64(65 - size.bit_length())


class BitFilter:
    def __init__(self, bits: bytes, size: int):
        self.bits, self.size = np.frombuffer(bits, np.uint8), size

    def parts(self) -> tuple[bytes, int]:
        """What to broadcast: no class of this library, so workers need not have it."""
        return self.bits.tobytes(), self.size

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for probe in range(PROBES):
            place = _places(hashes, probe, self.size)
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def bits_of(hashes: DataFrame, most_bits: int) -> BitFilter | None:
    """The filter of the column ``hash``; none if it would have more than ``most_bits``."""
    size = max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, KEY_BITS * hashes.count()))))
    if size > most_bits:
        return None

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([_places(keys, p, size) for p in range(PROBES)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["place"])

    maps = (
        hashes.select("hash")
        .mapInArrow(probe, "place bigint")
        .groupBy(F.floor(F.col("place") / BITMAP).alias("number"))
        .agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bits"))
    )
    bits = bytearray(size // 8)
    for row in maps.toLocalIterator():  # at most ``most_bits`` in all
        bits[row["number"] * (BITMAP // 8) : (row["number"] + 1) * (BITMAP // 8)] = row["bits"]
    return BitFilter(bytes(bits), size)

"""Best-fit packing of documents into sequences, in bulk-synchronous steps.

Documents become pieces of at most ``CAPACITY`` tokens; only longer documents are
cut. Pieces are sorted by length. Pieces of one length are alike, and so are the
sequences with one and the same gap that were filled alike: each such run is a row
``(gap, number of sequences)``. In one superstep all pieces of the greatest length
not yet placed look for their successor gap, the smallest that holds them; where
more pieces than gaps meet, their rank decides who gets it, and the others go on to
the next gap or open new sequences; then the gaps are updated, and the next length
follows. This is best fit decreasing for any number of documents, with at most
``CAPACITY`` supersteps over as many runs.

What a superstep decides is an interval of ranks, so it needs the count of pieces
per length (at most ``CAPACITY`` numbers) and nothing else. The pieces stay in Spark:
they are ranked within their length by counts per task, and each looks up its place
in the table of intervals.

Defined results: a null text is an empty one, and an empty document is its end token
alone. Repeated rows and equal ids are packed as often as they come. Other columns
are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tokens import ID_BYTES, default_files, document_pieces
from tidewatch.session import cut, send_by_value

send_by_value(__name__)

CAPACITY = 1024
_PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    files = files or default_files()

    def measure(texts: pa.Array) -> pa.Array:
        rows = []
        for text in (scalar.as_py() for scalar in texts):
            row, start = [], 0
            for number, ids in enumerate(document_pieces(text, files, capacity)):
                length = len(ids) // ID_BYTES
                row.append({"piece": number, "start": start, "length": length, "ids_crc32": zlib.crc32(ids)})
                start += length
            rows.append(row)
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return pa.array(rows, kind)

    found = F.arrow_udf(measure, _PIECE)(F.col("text"))
    return docs.select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.*")


@dataclass(frozen=True)
class Interval:
    """Pieces of one length with ranks from ``first`` on go into the sequences from
    ``sequence`` on, ``each`` to a sequence, from ``offset`` on."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> list[Interval]:
    """Intervals for all pieces, given the number of pieces of each length."""
    out: list[Interval] = []
    runs: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), sorted
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(runs, (length, -1, -1))
            if at < len(runs):
                gap, sequence, n = runs.pop(at)
            else:
                gap, sequence = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            if full:
                out.append(Interval(length, rank, sequence, each, capacity - gap))
                rank, left = rank + full * each, left - full * each
                if gap - full_size(each, length):
                    insort(runs, (gap - full_size(each, length), sequence, full))
            if full < n and left:  # the last pieces, fewer than fit into one sequence
                out.append(Interval(length, rank, sequence + full, each, capacity - gap))
                insort(runs, (gap - full_size(left, length), sequence + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                insort(runs, (gap, sequence + full, n - full))
    return out


def full_size(each: int, length: int) -> int:
    return each * length


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, within each length. Rows are numbered within the task
    that wrote them, and start after the rows of earlier tasks; ``rows`` must hold
    the number of that task in ``part``."""
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("within", F.row_number().over(within) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))


def placed(length: Column, rank: Column, plan: list[Interval]) -> Column:
    """struct(sequence_id, offset) of a piece by its interval."""
    table = np.array([[i.length, i.first, i.sequence, i.each, i.offset] for i in sorted(plan, key=lambda i: (i.length, i.first))], np.int64).reshape(-1, 5)
    of_length = {int(n): (int(a), int(a + c)) for n, a, c in zip(*np.unique(table[:, 0], return_index=True, return_counts=True), strict=True)}

    def look(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        lengths, ranks = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        row = np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            low, high = of_length[int(n)]
            here = lengths == n
            row[here] = low + np.searchsorted(table[low:high, 1], ranks[here], side="right") - 1
        nth = ranks - table[row, 1]
        sequence, slot = table[row, 2] + nth // table[row, 3], nth % table[row, 3]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(table[row, 4] + slot * lengths)], names=["sequence_id", "offset"])

    return F.arrow_udf(look, "struct<sequence_id:bigint,offset:bigint>")(length, rank)


def pack(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, capacity, files).withColumn("part", F.spark_partition_id()))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    place = placed(F.col("length"), F.col("rank"), supersteps(counts, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked(rows).select(*names, place.alias("place")).select(*names, "place.*")

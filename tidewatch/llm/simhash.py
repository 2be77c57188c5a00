"""Near duplicates by SimHash: pigeonhole blocks, join on blocks, Hamming check.

A fingerprint of 64 bits is cut into ``BLOCKS`` blocks. Two fingerprints that differ
in at most two bits agree in all blocks but two, so each fingerprint is filed under
every choice of ``BLOCKS - 2`` blocks, and only fingerprints filed together are
compared. Copies share a fingerprint and count once.

A file with many members is not compared pair by pair: its members are filed again
under themselves and each of their one-bit neighbours outside the shared blocks.
Two fingerprints differ in at most two bits exactly if they share such a neighbour,
so linking each neighbour's file to its smallest member loses no link and makes as
many rows as there are members times free bits.

Defined results: a null or empty text has fingerprint 0, linked like any other. A
null id never names a component; a component with null ids only has a null
component_id. Repeated rows are returned as often as they come. Other columns are
not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.text import columns_of, quoted, utf8, whole_row, words
from tidewatch.session import cut, send_by_value

send_by_value(__name__)

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
BLOCKS = 5
HASH_SEED = 42
#: Members of a file that are still compared pair by pair.
PAIR_FILE = 32


def fingerprint_of(text: bytes, size: int = SHINGLE_WORDS) -> int:
    found = words(text.lower())
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= size:
        return xxhash.xxh64_intdigest(line, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed 64-bit number."""

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t, size) for t in utf8(texts)], np.uint64).view(np.int64))

    return F.arrow_udf(prints, "bigint")(text)


def _cuts(blocks: int) -> list[int]:
    """Bit masks of consecutive blocks of nearly equal width, as signed numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << high) - (1 << low)) for low, high in zip(edges, edges[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, pair_file: int = PAIR_FILE) -> DataFrame:
    """Edges (u, v) among distinct fingerprints ``fp``; their components are those
    of all pairs within ``max_bits`` (at most 2)."""
    if not 0 < max_bits <= 2 or blocks <= max_bits:
        raise ValueError("one or two differing bits, and more blocks than those")
    masks = [sum(chosen) for chosen in combinations(_cuts(blocks), blocks - max_bits)]
    filed = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shared")) for i, m in enumerate(masks)])).alias("f"),
    ).select("fp", "f.choice", "f.shared")
    sizes = filed.groupBy("choice", "shared").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(filed.join(sizes, ["choice", "shared"]))

    few = members.filter(F.col("n") <= pair_file).select("choice", "shared", "fp")
    other = few.withColumnRenamed("fp", "other")
    pairs = (
        few.join(other, ["choice", "shared"])
        .filter((F.col("fp") > F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits))
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )

    by_choice = F.create_map(*[x for i, m in enumerate(masks) for x in (F.lit(i), F.array(F.lit(0).cast("bigint"), *_free_bits(m)))])
    near = (
        members.filter(F.col("n") > pair_file)
        .select("fp", "choice", F.explode(by_choice[F.col("choice")]).alias("flip"))
        .select("fp", "choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), F.col("flip"))
    )
    if max_bits == 1:  # one of the two is its own variant
        roots = near.filter("flip = 0").select("choice", "variant", F.col("fp").alias("low"))
    else:
        roots = near.groupBy("choice", "variant").agg(F.min("fp").alias("low"))
    stars = near.join(roots, ["choice", "variant"]).select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return pairs.union(stars).filter("u <> v").distinct()


def _free_bits(mask: int) -> list[Column]:
    return [F.lit(_signed(1 << b)).cast("bigint") for b in range(BITS) if not mask >> b & 1]


def _fingerprinted(docs: DataFrame, size: int, *more: Column) -> DataFrame:
    return cut(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp"), *more))


def _rooted(classes: DataFrame, max_bits: int) -> DataFrame:
    """``classes``, one row per fingerprint, with the root of each one's component."""
    found = components(links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    return classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed) and component_id, the least id reachable, per document."""
    printed = _fingerprinted(docs, size)
    classes = _rooted(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), max_bits)
    named = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = classes.join(named, "root").select("fp", "component_id")
    return printed.join(names, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, whole: the one with the least id (null comes last),
    then the least hash of all columns."""
    row = F.xxhash64(*[F.col(quoted(c)) for c in docs.columns])
    printed = _fingerprinted(docs, size, row.alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    classes = _rooted(printed.groupBy("fp").agg(first), max_bits)
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.row")
    whole = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").alias("id"), row.alias("hash"))
    same = F.col("id").eqNullSafe(kept["doc_id"]) & (F.col("hash") == kept["row"])
    # rows that are equal in every column meet in one task, as the join has dealt them
    return whole.join(kept, same, "left_semi").dropDuplicates(["id", "hash"]).select(*columns_of("doc", docs.columns))

"""Substring dedup: words that repeat a passage of an earlier document.

A window is ``WINDOW`` consecutive words; a word is removed if it lies in a window
whose words also start in a document with a smaller id.

The method asked for, suffix automata of reference shards sent to all documents,
reads every document once per shard, and the reference is the corpus itself; the
README has the figures. Here windows are matched by hash instead, in three passes
over the texts that each cost the same per word at any size:

1. Of the ``GRAM``-word grams of a window, the one with the least hash is its anchor.
   Equal windows have equal anchors, and neighbouring windows mostly share theirs, so
   there is about one anchor to five words. Anchors are counted over the corpus, and
   those of at least two documents are put into a Bloom filter of bounded size. A
   full filter would let more windows through, never fewer.
2. Windows whose anchor passes are reduced, before the shuffle, to the least id per
   window, and then gathered per document: the windows that start there first.
3. A document's windows that pass the filter and do not start there first are
   repeated.

Windows are compared by 64-bit hashes: of n windows, about n^2 / 2^65 pairs agree by
chance (0.00004 pairs for 40 million).

Defined results: a null text has no words. A document without an id neither removes
from others nor loses words. Rows with equal ids do not remove from each other.
Texts below ``WINDOW`` words are kept whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import kept, utf8, words, worker_state
from tidewatch.session import send_by_value

send_by_value(__name__)

WINDOW = 13
GRAM = 6
#: Bits of the filter per anchor of several documents, and its bounds.
ANCHOR_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
PROBES = 3
#: Bits of one row of ``bitmap_construct_agg``.
BITMAP = 4096 * 8
#: Words whose hash a worker keeps.
KEPT_WORDS = 400_000

_KIND = "struct<n_words:bigint,n_removed:bigint,kept:binary,kept_sha256:string>"
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(64)], np.uint64)


class WordHashes:
    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        out = list(map(self.kept.get, found))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    out[i] = xxhash.xxh3_64_intdigest(found[i])
                    if len(self.kept) < KEPT_WORDS:
                        self.kept[found[i]] = out[i]
        return np.array(out, np.uint64)


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += hashes[i : i + n] * _FACTORS[i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def windows_and_anchors(found: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of a text and the hash of its anchor."""
    if len(found) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = worker_state("word hashes", WordHashes)(found)
    grams = _rolled(hashes, gram)
    n = len(found) - window + 1
    anchors = grams[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(anchors, grams[i : i + n], out=anchors)
    return _rolled(hashes, window), anchors


class AnchorFilter:
    """Bloom filter over 64-bit hashes: bits in little-endian order."""

    def __init__(self, bits: bytes, size: int):
        self.bits, self.size = np.frombuffer(bits, np.uint8), size

    def holds(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for probe in range(PROBES):
            place = places(anchors, probe, self.size)
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def places(anchors: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit of each anchor; ``size`` is a power of two."""
    return (anchors * _FACTORS[probe + 1] >> np.uint64(64 - size.bit_length() + 1)) & np.uint64(size - 1)


def _shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(windows_and_anchors(words(t), window, gram)[1]) for t in utf8(batch.column(0))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["anchor"])

    once = docs.select("text").mapInArrow(emit, "anchor bigint")
    return once.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")


def anchor_filter(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> AnchorFilter:
    """The filter of all anchors that at least two documents have."""
    shared = kept(_shared_anchors(docs, window, gram), "anchors")
    n = shared.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, ANCHOR_BITS * n)))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([places(anchors, p, size) for p in range(PROBES)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["place"])

    maps = (
        shared.mapInArrow(probe, "place bigint")
        .groupBy(F.floor(F.col("place") / BITMAP).alias("number"))
        .agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bits"))
    )
    bits = bytearray(size // 8)
    for row in maps.toLocalIterator():  # at most MOST_BITS in all
        bits[row["number"] * (BITMAP // 8) : (row["number"] + 1) * (BITMAP // 8)] = row["bits"]
    return AnchorFilter(bytes(bits), size)


def _first_windows(docs: DataFrame, shared, key: str, window: int, gram: int) -> DataFrame:
    """(doc_id, firsts): the windows that pass the filter and start in no document
    with a smaller id."""
    id_kind = docs.schema["doc_id"].dataType

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = worker_state("anchors", lambda: AnchorFilter(*shared.value), key)
        for batch in batches:
            found, owners = [], []
            for i, text in enumerate(utf8(batch.column(1))):
                hashes, anchors = windows_and_anchors(words(text), window, gram)
                hashes = np.unique(hashes[passing.holds(anchors)])
                found.append(hashes)
                owners.append(np.full(len(hashes), i))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(owners)))],
                    names=["window", "doc_id"],
                )

    rows = docs.select("doc_id", "text").mapInArrow(emit, f"window bigint, doc_id {id_kind.simpleString()}")
    least = rows.groupBy("window").agg(F.min("doc_id").alias("doc_id"))
    return least.groupBy("doc_id").agg(F.collect_list("window").alias("firsts"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (words joined by a space, as
    bytes) and kept_sha256."""
    named = docs.select("doc_id", "text").filter("doc_id is not null")
    passing = anchor_filter(named, window, gram)
    shared, key = docs.sparkSession.sparkContext.broadcast((passing.bits.tobytes(), passing.size)), uuid.uuid4().hex
    firsts = _first_windows(named, shared, key, window, gram)

    def remove(texts: pa.Array, owned: pa.Array, has_id: pa.Array) -> pa.Array:
        passing = worker_state("anchors", lambda: AnchorFilter(*shared.value), key)
        rows = []
        for text, first, named in zip(utf8(texts), owned, has_id.to_pylist(), strict=True):
            found = words(text)
            hashes, anchors = windows_and_anchors(found, window, gram)
            repeated = passing.holds(anchors) if named else np.zeros(len(hashes), bool)
            if repeated.any() and first.is_valid:
                repeated &= ~np.isin(hashes, first.values.to_numpy().view(np.uint64))
            n_removed, left = 0, found
            starts = np.flatnonzero(repeated)
            if len(starts):
                edges = np.zeros(len(found) + 1, np.int64)
                edges[starts] += 1
                np.add.at(edges, starts + window, -1)
                stays = np.cumsum(edges[:-1]) == 0
                left = [found[i] for i in np.flatnonzero(stays).tolist()]
                n_removed = len(found) - len(left)
            kept = b" ".join(left)
            rows.append((len(found), n_removed, kept, hashlib.sha256(kept).hexdigest()))
        columns = zip(pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.binary()), ("d", pa.string())]).types, range(4), strict=True)
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for kind, i in columns], names=["n_words", "n_removed", "kept", "kept_sha256"])

    done = F.arrow_udf(remove, _KIND)(F.col("text"), F.col("firsts"), F.col("doc_id").isNotNull())
    return docs.select("doc_id", "text").join(firsts, "doc_id", "left").select("doc_id", done.alias("d")).select("doc_id", "d.*")

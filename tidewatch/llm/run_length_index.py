"""Repeated byte strings by run-length indexes over what the corpus shares.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere else too, in
the same or another text. What is unique cannot match, so only stretches that may repeat
are indexed:

1. Equal texts are one text with a number of copies. Distinct texts are written once,
   in buckets by key, so that later joins shuffle the other side only.
2. The least hash among the ``GRAM``-byte grams of a ``LENGTH``-byte window is its anchor.
   Consecutive windows with one place of the anchor are a unit: about one to 70 bytes. Equal windows have
   equal anchors, so they meet where anchors meet. Anchors of one unit in all are dropped
   (by a Bloom filter, where the anchors to keep fit one of bounded size; else all units
   go the same way, so that only cost differs).
3. Units with equal bytes are one: all their windows repeat, and one of them stands for
   all in what follows. Anchors with several different units are dealt to shards of about
   ``SHARD_BYTES``. Each shard builds the run-compressed Burrows-Wheeler transform of its
   units. Matches are sampled at the run ends only: inside a run, the longest match of
   a suffix with its neighbour is one less than that of the suffix before it, so the
   matching statistics of every position follow from the samples, streamed in text order.
   Positions whose longest match has ``LENGTH`` bytes or more are marked.
4. An anchor whose different units exceed ``HOT_BYTES`` would make a shard without bound.
   Its windows are counted one by one instead, by 128-bit hash, combined before the shuffle.

Windows are disjoint over units, so no position meets itself in an index, and the marks
are those of the whole corpus. Texts and units are told apart by 128-bit hashes.

Defined results: a null text is empty. Rows are judged one by one: a repeated row makes all
its windows repeat, whatever its id; ids may be null or equal. Texts below ``LENGTH``
bytes are kept whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bloom import BitFilter, bits_of
from tidewatch.llm.suffixes import suffix_order
from tidewatch.llm.text import bucketed, join_copies, kept, utf8, worker_state
from tidewatch.session import send_by_value

send_by_value(__name__)

LENGTH = 200
GRAM = 64
SHARD_BYTES = 1 << 20
HOT_BYTES = 1 << 20
#: Copies of one text beyond which its rows are joined without a shuffle.
HOT_COPIES = 100_000
MOST_BITS = 1 << 28

_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
_SPAN = "array<struct<start:bigint,stop:bigint>>"


# ---- units


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive bytes, by doubling."""
    out, size, factor, done = _MIX[text], 1, 0x9E3779B97F4A7C15, None
    wanted, taken = gram, 0
    while wanted:
        if wanted & 1:  # append the next ``size`` bytes to what is done
            done = out if done is None else done[: len(out) - taken] * np.uint64(factor) + out[taken:]
            taken += size
        wanted >>= 1
        if wanted:
            out = out[:-size] * np.uint64(factor) + out[size:]
            size, factor = 2 * size, factor * factor % 2**64
    n = len(text) - gram + 1
    done = done[:n]
    done ^= done >> np.uint64(29)
    done *= np.uint64(0xBF58476D1CE4E5B9)
    done ^= done >> np.uint64(32)
    return done


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def units(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each unit of a text."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = _gram_hashes(np.frombuffer(text, np.uint8), gram)
    least = _least(grams, length - gram + 1)
    new = np.empty(len(least), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    # where an equal gram takes over, so that a unit has one place of its anchor
    new[1:] |= grams[: len(least) - 1] == least[:-1]
    starts = np.flatnonzero(new)
    return least[starts], starts, np.diff(np.append(starts, len(least)))


def united(hashes: np.ndarray, anchors: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive units with equal bytes (texts with a period): the first, and how
    many there are."""
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + sizes[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(hashes)))


# ---- the index of one shard


@dataclass(frozen=True)
class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform with the longest match at run ends.

    ``symbols`` and ``lengths`` are the runs. ``heads`` are the text positions of the
    first suffix of each run, in text order, with the length it shares with the suffix
    before it; ``tails`` those of the last, with the suffix after it.
    """

    size: int
    symbols: np.ndarray
    lengths: np.ndarray
    heads: tuple[np.ndarray, np.ndarray]
    tails: tuple[np.ndarray, np.ndarray]

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest string that starts there and
        elsewhere too."""
        here = np.arange(self.size)
        best = np.zeros(self.size, np.int64)
        for places, matched in (self.heads, self.tails):
            last = np.zeros(self.size, np.int64)
            last[places] = np.arange(len(places))
            last = np.maximum.accumulate(last)
            np.maximum(best, matched[last] - (here - places[last]), out=best)
        return best


def _shared(words: np.ndarray, text: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``one`` and ``two`` share. ``words`` holds eight
    bytes from each position on; separators differ, so matches end before them."""
    n = len(text)
    out = np.zeros(len(one), np.int64)
    alive = np.arange(len(one))
    at = 0
    while len(alive):
        a, b = one[alive] + at, two[alive] + at
        fits = np.maximum(a, b) + 8 <= n
        same = np.zeros(len(alive), bool)
        same[fits] = words[a[fits]] == words[b[fits]]
        ended = alive[~same]
        for step in range(8):  # the symbols of the last, unequal word one by one
            a, b = one[ended] + at + step, two[ended] + at + step
            inside = np.maximum(a, b) < n
            ended, a, b = ended[inside], a[inside], b[inside]
            ended = ended[text[a] == text[b]]
            out[ended] += 1
        alive = alive[same]
        out[alive] += 8
        at += 8
    return out


def run_length_index(strings: list[bytes]) -> tuple[RunLengthIndex, np.ndarray]:
    """The index over ``strings``, each followed by a separator of its own, and the
    position of each string."""
    k = len(strings)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    starts = sizes.cumsum() - sizes
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + k
    text[starts + sizes - 1] = np.arange(k)
    order = suffix_order(text, k + 256)
    before = text[order - 1]  # the symbol before each suffix; the first one follows the last
    new = np.empty(len(text), bool)
    new[0] = True
    np.not_equal(before[1:], before[:-1], out=new[1:])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(text)) - 1
    # eight symbols as one word; a separator spoils the words it is in, so use a hash
    words, size = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), 1
    factor = 0xD6E8FEB86659FD93
    while size < 8 and len(words) > size:
        words = words[:-size] * np.uint64(factor) + words[size:]
        size, factor = 2 * size, factor * factor % 2**64

    def sampled(rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        matched = np.zeros(len(rows), np.int64)
        inside = (rows + step >= 0) & (rows + step < len(order))
        matched[inside] = _shared(words, text, order[rows[inside]], order[rows[inside] + step])
        by = np.argsort(order[rows])
        return order[rows][by], matched[by]

    return RunLengthIndex(len(text), before[head], tail - head + 1, sampled(head, -1), sampled(tail, 1)), starts


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


# ---- the corpus


def text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256; a null text is empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies), written in buckets by key."""
    text = F.coalesce("text", F.lit(""))
    once = docs.select(text_key(F.col("text")).alias("key"), text.alias("text"))
    return bucketed(once.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "key", "texts")


def _anchors(texts: DataFrame, length: int, gram: int, most_bits: int) -> BitFilter | None:
    """The filter of all anchors of at least two units; none if it would be too large."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units(t, length, gram)[0] for t in utf8(batch.column(0))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["hash"])

    every = texts.select("text").mapInArrow(emit, "hash bigint")
    return bits_of(kept(every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "anchors"), most_bits)


def _units(texts: DataFrame, passing: BitFilter | None, length: int, gram: int) -> DataFrame:
    """(anchor, bytes_hash, key, first, windows, times) of the units whose anchor passes:
    ``times`` consecutive equal units, of ``windows`` windows each."""
    shared = None if passing is None else texts.sparkSession.sparkContext.broadcast(passing.parts())
    name = uuid.uuid4().hex

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if shared is None else worker_state("bits", lambda: BitFilter(*shared.value), name)
        for batch in batches:
            of, columns = [], []
            for i, text in enumerate(utf8(batch.column(1))):
                anchors, starts, sizes = units(text, length, gram)
                if held is not None:
                    passes = held.holds(anchors)
                    anchors, starts, sizes = anchors[passes], starts[passes], sizes[passes]
                ends = starts + sizes + length - 1
                hashes = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
                row, times = united(hashes, anchors, starts, sizes)
                of.append(np.full(len(row), i))
                columns.append((anchors[row].view(np.int64), hashes[row].view(np.int64), starts[row], sizes[row], times))
            if not of:
                continue
            keys = batch.column(0).take(pa.array(np.concatenate(of)))
            arrays = [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=["key", "anchor", "bytes_hash", "first", "windows", "times"])

    kind = "key binary, anchor bigint, bytes_hash bigint, first bigint, windows bigint, times bigint"
    return texts.select("key", "text").mapInArrow(emit, kind)


def _contexts(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(shard, key, first, bytes) of the chosen units; ``shard`` null for hot anchors."""
    lists = chosen.groupBy("key").agg(F.collect_list(F.struct("first", "windows", "shard")).alias("units"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [])
            for key, text, wanted in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for unit in wanted:
                    first = unit["first"]
                    for column, value in zip(rows, (unit["shard"], key, first, text[first : first + unit["windows"] + length - 1]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["shard", "key", "first", "bytes"])

    return texts.select("key", "text").join(lists, "key").mapInArrow(emit, "shard bigint, key binary, first bigint, bytes binary")


def _indexed(contexts: DataFrame, length: int) -> DataFrame:
    """(key, start, stop) of the bytes that repeat within each shard."""

    def search(table: pa.Table) -> pa.Table:
        strings = table.column("bytes").to_pylist()
        index, starts = run_length_index(strings)
        marked = index.matching_statistics() >= length
        rows = ([], [], [])
        for key, first, string, at in zip(table.column("key").to_pylist(), table.column("first").to_pylist(), strings, starts.tolist(), strict=True):
            for start, stop in runs_of(marked[at : at + len(string)]):
                for column, value in zip(rows, (key, first + start, first + stop + length - 1), strict=True):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], names=["key", "start", "stop"])

    return contexts.groupBy("shard").applyInArrow(search, "key binary, start bigint, stop bigint")


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """(key, start, stop) of the windows that repeat, each compared by its hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [])
            for key, first, string in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for at in range(len(string) - length + 1):
                    high, low = divmod(xxhash.xxh3_128_intdigest(string[at : at + length]), 1 << 64)
                    for column, value in zip(rows, (high, low, key, first + at), strict=True):
                        column.append(value)
            hashes = [pa.array(np.array(rows[i], np.uint64).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.int64())], names=["high", "low", "key", "start"])

    rows = kept(contexts.select("key", "first", "bytes").mapInArrow(emit, "high bigint, low bigint, key binary, start bigint"), "windows")
    several = rows.groupBy("high", "low").agg(F.count("*").alias("n")).filter("n > 1")
    found = join_copies(rows, several, ["high", "low"], "n", HOT_COPIES)
    return found.select("key", "start", (F.col("start") + length).alias("stop"))


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES, most_bits: int = MOST_BITS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, start, stop): stretches of ``texts`` (key, text) that repeat in another one
    or elsewhere in the same. They may overlap."""
    found = kept(_units(texts, _anchors(texts, length, gram, most_bits), length, gram), "units")
    size = F.col("windows") + F.lit(length - 1)
    # a struct of the place, so that the row that stands for all is one of them
    place = F.struct("key", "first", "windows")
    different = kept(found.groupBy("anchor", "bytes_hash").agg(F.sum("times").alias("n"), F.min(place).alias("place")), "units-once")
    whole = join_copies(found, different.filter("n > 1").select("anchor", "bytes_hash", "n"), ["anchor", "bytes_hash"], "n", HOT_COPIES)
    whole = whole.select("key", F.col("first").alias("start"), (F.col("first") + F.col("windows") * F.col("times") + F.lit(length - 1)).alias("stop"))

    once = different.select("anchor", "place.*")
    several = kept(once.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(size).alias("n_bytes")).filter("n > 1"), "anchors-several")
    n_bytes, n_hot = several.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count_if(F.col("n_bytes") > hot_bytes)).first()
    if n_bytes == 0:
        return whole
    shard = F.when(F.col("n_bytes") <= hot_bytes, F.pmod(F.xxhash64("anchor"), F.lit(-(-n_bytes // shard_bytes))))
    chosen = join_copies(once, several, ["anchor"], "n", HOT_COPIES).select("key", "first", "windows", shard.alias("shard"))
    contexts = _contexts(texts, chosen, length)
    if n_hot == 0:
        return whole.unionByName(_indexed(contexts, length))
    contexts = kept(contexts, "contexts")
    hot = _windows(contexts.filter("shard is null"), length)
    return whole.unionByName(_indexed(contexts.filter("shard is not null"), length)).unionByName(hot)


def _merged(found: list[dict] | None) -> list[list[int]]:
    """Overlapping and touching stretches joined, in order."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in found or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def without(text: bytes, spans: list[list[int]]) -> bytes:
    kept_from, parts = 0, []
    for start, stop in spans:
        parts.append(text[kept_from:start])
        kept_from = stop
    return b"".join([*parts, text[kept_from:]])


def marked_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """Per distinct text: key, copies, n_bytes, n_removed, kept_sha256 and the removed
    ``spans`` in bytes."""
    texts = distinct_texts(docs)
    found = repeated(texts, length, gram, **limits).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    def judge(texts: pa.Array, copies: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for text, n, spans in zip(utf8(texts), copies.to_pylist(), found.to_pylist(), strict=True):
            spans = [[0, len(text)]] if n > 1 and len(text) >= length else _merged(spans)
            left = without(text, spans)
            rows.append((len(text), len(text) - len(left), hashlib.sha256(left).hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["n_bytes", "n_removed", "kept_sha256", "spans"]
        )

    judged = F.arrow_udf(judge, f"struct<n_bytes:bigint,n_removed:bigint,kept_sha256:string,spans:{_SPAN}>")
    return texts.join(found, "key", "left").select("key", "copies", judged(F.col("text"), F.col("copies"), F.col("found")).alias("d")).select("key", "copies", "d.*")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed
    ``spans``, each (start, stop) in bytes of the text."""
    marked = kept(marked_texts(docs, length, gram, **limits), "marked")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    found = join_copies(rows, marked, ["key"], "copies", HOT_COPIES)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "spans")

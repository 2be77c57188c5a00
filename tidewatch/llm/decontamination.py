"""Benchmark decontamination by Wu-Manber search over words.

Every window of 13 consecutive words of a benchmark item (the whole item if it is
shorter) is a pattern. Patterns of one length share a set of tables: the shift
table says, for the last two words under the search window, how far it may move;
where it says zero, a bucket keyed by the suffix and checked by the first word
gives the few patterns that are then compared word by word.

The tables of one block of benchmark items (at most ``BLOCK_BYTES`` of text, or a
single longer item) are sent to the tasks; a larger benchmark is searched block by
block over the same documents, each block adding to the marks of those before.

Defined results: null and empty texts have no words and are never contaminated.
Items without an id or without words are no patterns; equal ids count once.
Repeated documents are judged row by row; other columns are carried unread.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import columns_of, utf8, whole_row, worker_state
from tidewatch.session import cut, send_by_value

send_by_value(__name__)

WINDOW = 13
BLOCK_BYTES = 32 << 20
#: A document is contaminated if one word in SHARE lies inside a found window.
SHARE = 20

KIND = "struct<n_words:bigint,hits:binary,n_hit:bigint,items:array<string>>"
#: A-Z to lower case, and every other ASCII character but 0-9 and a-z to a space.
_PLAIN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Tables:
    """Wu-Manber tables for patterns of one length, over word numbers."""

    def __init__(self, patterns: dict[tuple[int, ...], list[int]], length: int, base: int):
        self.length, self.base = length, base
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, tuple[int, ...], list[int]]]] = defaultdict(list)
        for words, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(words, end - 1)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[self.key(words, length - 1)].append((words[0], words, owners))

    def key(self, words, end: int) -> int:
        return words[end] if self.block == 1 else words[end - 1] * self.base + words[end]

    def search(self, words: list[int], found) -> None:
        """Call ``found(start, owners)`` for each occurrence."""
        length, far, shift, base, single = self.length, self.far, self.shift, self.base, self.block == 1
        at, n = length - 1, len(words)
        while at < n:
            key = words[at] if single else words[at - 1] * base + words[at]
            move = shift.get(key, far)
            if move:
                at += move
                continue
            start = at - length + 1
            first, under = words[start], None
            for head, pattern, owners in self.bucket[key]:
                if head == first:
                    under = under or tuple(words[start : at + 1])
                    if under == pattern:
                        found(start, owners)
            at += 1


class Searcher:
    """All tables of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        patterns: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for owner, (_, text) in enumerate(items):
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in plain_words(text)]
            length = min(window, len(words))
            for start in range(len(words) - length + 1 if words else 0):
                owners = patterns[length][tuple(words[start : start + length])]
                if not owners or owners[-1] != owner:
                    owners.append(owner)
        base = len(self.numbers) + 2
        self.tables = [Tables(p, length, base) for length, p in sorted(patterns.items())]

    def search(self, text: bytes, before: bytes | None, known: list[str] | None) -> tuple[int, bytes | None, int, list[str]]:
        """Number of words, the marks of hit words (one bit each), their number, and the items."""
        words = list(map(self.numbers.get, found := plain_words(text), [0] * len(found)))
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        for tables in self.tables:

            def note(start: int, of: list[int], length: int = tables.length) -> None:
                spans.append((start, start + length))
                owners.update(of)

            tables.search(words, note)
        if not spans and before is None:
            return len(words), None, 0, known or []
        marks = np.zeros(len(words), bool) if before is None else np.unpackbits(np.frombuffer(before, np.uint8), count=len(words)).astype(bool)
        for start, end in spans:
            marks[start:end] = True
        items = sorted({self.names[o] for o in owners}.union(known or []))
        return len(words), np.packbits(marks).tobytes(), int(marks.sum()), items


def search_column(text: Column, hits: Column, items: Column, block: list[tuple[str, bytes]], spark) -> Column:
    shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def search(texts: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        searcher = worker_state("searcher", lambda: Searcher(shared.value), key)
        rows = [searcher.search(*row) for row in zip(utf8(texts), hits.to_pylist(), items.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.list_(pa.string())),
            ],
            names=["n_words", "hits", "n_hit", "items"],
        )

    return F.arrow_udf(search, KIND)(text, hits, items)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time."""
    items = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / block_bytes))
    for number in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == number)
        yield [(r["name"], bytes(r["text"])) for r in part.orderBy("name", "text").collect()]


def searched(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` packed into ``doc``, beside ``found``: n_words, hits, n_hit and items."""
    nothing = F.struct(F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    rows = docs.select(whole_row(docs).alias("doc"), nothing.alias("found"))
    for number, block in enumerate(blocks(benchmark, block_bytes)):
        if number:  # the tables of one block only are in a worker's memory
            rows = cut(rows)
        found = search_column(F.col("doc.text"), F.col("found.hits"), F.col("found.items"), block, docs.sparkSession)
        rows = rows.select("doc", found.alias("found"))
    return rows


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids) and contaminated."""
    rows = searched(docs, benchmark).select("doc.doc_id", "found.n_words", "found.n_hit", "found.items")
    return rows.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, whole and unchanged."""
    return searched(docs, benchmark).filter(~is_contaminated(F.col("found.n_hit"), F.col("found.n_words"))).select(*columns_of("doc", docs.columns))

"""Ranked lexical search by NRA: impact-sorted lists, read in order, never probed.

Every query item is ranked against every document. A document's impact for a term is

    w * ((10^9 * tf) div (1000 * tf + 20 * m)),   w = floor(1000 * ln((2N + 2) / (2df + 1))),
    m = 50 + (50 * n * N) div L

(N documents with a term, L terms in all, n terms of the document, df documents with the
term, tf its occurrences in the document); its score is the sum over the item's terms.

Documents are dealt to chunks of at most ``CHUNK_DOCS`` documents and ``CHUNK_POSTINGS``
postings. A chunk holds one list per term, sorted by impact. An item's lists are read from
the top in stretches that grow fourfold. What was read of a document is its lower bound;
that plus the next unread impact of each list it was not seen in is its upper bound. Reading
ends when no unread document and no open one can reach the best ``k``, and every
document that can, ties included, has equal bounds. A task carries each item's best ``k``
from chunk to chunk, so that later chunks stop earlier; what the tasks found is ranked in a
tree. No list, and no document set of a frequent term, is ever whole in one place.

Counts are over all documents. The texts are read once per block of items (``BLOCK_BYTES`` of
item text); a block's terms and weights are broadcast, so their size is bounded.

Defined results: a null or empty text has no terms; neither has it a place in any ranking.
Rows are ranked one by one, repeated ones too, with equal scores by ascending doc_id, null ids
last. Each item row has a ranking of its own, whatever its id. Items without terms, or without
a document that has one, have no rows. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.text import kept, utf8, worker_state
from tidewatch.plans.ordered import first_in_group
from tidewatch.session import send_by_value

send_by_value(__name__)

K = 50
BLOCK_BYTES = 4 << 20
CHUNK_DOCS, CHUNK_POSTINGS = 1 << 14, 1 << 22
#: Entries of each list in the first stretch.
FIRST_READ = 64

#: Bytes of terms, A-Z lowered; all others separate terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split(b" ")


def term_counts(text: bytes) -> Counter[bytes]:
    counted = Counter(terms(text))
    counted.pop(b"", None)
    return counted


# ---- counts


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, codes, counts) of every document with a term; ``codes`` are places in
    ``vocabulary`` as little-endian 32-bit numbers, with ``counts`` beside them."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = worker_state("search terms", lambda: {term: i for i, term in enumerate(shared.value)}, key)
        for batch in batches:
            of, sizes, codes, counts = [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                counted = term_counts(text)
                if counted:
                    found = sorted((numbers[t], counted[t]) for t in counted.keys() & numbers.keys())
                    of.append(i)
                    sizes.append(counted.total())
                    codes.append(np.array([c for c, _ in found], np.int32).tobytes())
                    counts.append(np.array([n for _, n in found], np.int32).tobytes())
            ids = batch.column(0).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "codes", "counts"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, codes binary, counts binary"
    return docs.select("doc_id", "text").mapInArrow(emit, kind)


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; summed up per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(codes, minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["code", "df"])

    out = np.zeros(n_terms, np.int64)
    for row in rows.select("codes").mapInArrow(count, "code int, df bigint").groupBy("code").agg(F.sum("df").alias("df")).collect():
        out[row["code"]] = row["df"]  # one row per term of the block
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---- one chunk


class Lists:
    """The postings of a chunk as one impact-sorted list per term."""

    def __init__(self, sizes: np.ndarray, codes: list[bytes], counts: list[bytes], weights: np.ndarray, n_docs: int, n_all: int):
        of = np.repeat(np.arange(len(sizes)), [len(c) // 4 for c in codes])
        code = np.frombuffer(b"".join(codes), np.int32).astype(np.int64)
        tf = np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
        m = 50 + (50 * sizes * n_docs) // n_all
        impact = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
        order = np.lexsort((-impact, code))
        self.size = len(sizes)
        self.document, self.impact = of[order], impact[order]
        self.start = np.searchsorted(code[order], np.arange(len(weights) + 1))

    def best(self, item: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of all that reach ``least`` and may be among the
        best ``k``, ties included. ``least`` is 1 or more."""
        starts, ends = self.start[item], self.start[item + 1]
        starts, ends = starts[ends > starts], ends[ends > starts]
        lower = np.zeros(self.size)  # sums of integers below 2^53, so exact
        read = np.zeros(len(starts), np.int64)  # entries read of each list
        seen_lists, seen_documents = [], []
        stretch = FIRST_READ
        while len(starts):
            until = np.minimum(read + stretch, ends - starts)
            sizes = until - read
            lists = np.repeat(np.arange(len(starts)), sizes)
            places = np.arange(len(lists)) - np.repeat(sizes.cumsum() - sizes, sizes) + np.repeat(starts + read, sizes)
            documents = self.document[places]
            lower += np.bincount(documents, self.impact[places], self.size)
            seen_lists.append(lists)
            seen_documents.append(documents)
            read, stretch = until, stretch * 4
            more = starts + read < ends
            frontier = np.zeros(len(starts))
            frontier[more] = self.impact[(starts + read)[more]]
            unread = frontier.sum()
            threshold = least
            if self.size >= k:
                threshold = max(threshold, np.partition(lower, self.size - k)[self.size - k])
            if unread == 0:
                break
            if unread >= threshold:
                continue  # a document not met yet might still get in
            known = np.bincount(np.concatenate(seen_documents), frontier[np.concatenate(seen_lists)], self.size)
            open_ = unread - known  # what a document may still gain
            if not (open_[lower + open_ >= threshold] > 0).any():
                break
        else:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.flatnonzero(lower >= threshold)
        return found, lower[found].astype(np.int64)


def _best_of_tasks(rows: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_all: int, k: int, chunk: tuple[int, int]) -> DataFrame:
    """(item, doc_id, score): the best ``k`` of each item within each task."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weights))
    id_kind = rows.schema["doc_id"].dataType

    def ranked(best: list[tuple], k: int) -> list[tuple]:
        # a stable order also without ids
        return sorted(best, key=lambda row: (-row[0], row[1] is None, 0 if row[1] is None else row[1]))[:k]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        held: list[list] = [[], [], [], []]
        n_postings, id_type = 0, None

        def flush() -> None:
            ids = held[0]
            lists = Lists(np.array(held[1], np.int64), held[2], held[3], weights, n_docs, n_all)
            for number, item in enumerate(items):
                least = best[number][-1][0] if len(best[number]) == k else 1
                documents, scores = lists.best(item, k, least)
                if len(documents):
                    new = [(score, ids[i]) for i, score in zip(documents.tolist(), scores.tolist(), strict=True)]
                    best[number] = ranked(best[number] + new, k)
            for column in held:
                column.clear()

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held[0] and (len(held[0]) >= chunk[0] or n_postings + len(row[2]) // 4 > chunk[1]):
                    flush()
                    n_postings = 0
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                n_postings += len(row[2]) // 4
        if held[0]:
            flush()
        found = [(number, doc_id, score) for number, of in enumerate(best) for score, doc_id in of]
        if found:
            kinds = (pa.int32(), id_type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(search, f"item int, doc_id {id_kind.simpleString()}, score bigint")


# ---- all items


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """(item_id, text) rows, in blocks of about ``block_bytes`` of text."""
    rows = items.filter("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / block_bytes))
    for number in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number)
        yield [(row["item_id"], bytes(row["text"])) for row in part.collect()]


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, chunk: tuple[int, int] = (CHUNK_DOCS, CHUNK_POSTINGS)) -> DataFrame:
    """Per item (item_id, text) its best ``k`` documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    id_kinds = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_kinds[0])])
    out: DataFrame | None = None
    for block in blocks(items, block_bytes):
        counted = [sorted(term_counts(text)) for _, text in block]
        vocabulary = sorted(set().union(*counted))
        number = {term: i for i, term in enumerate(vocabulary)}
        rows = kept(postings(docs, vocabulary), "postings")
        n_docs, n_all = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([weight(n_docs, int(df)) for df in document_frequencies(rows, len(vocabulary))], np.int64)
        codes = [np.array([number[t] for t in of], np.int64) for of in counted]
        found = _best_of_tasks(rows, codes, weights, n_docs, n_all, k, chunk)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = first_in_group(found, ["item"], order, k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], kind)
        part = best.join(F.broadcast(names), "item").select("item_id", F.col("position").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out

"""Hidden Markov language model, trained by Baum-Welch over the whole corpus.

At most ``HEAD`` frequent words of the training texts, the end of a text and "any
other word" are the symbols that the hidden states emit. Another word w then has a
probability of its own, (c + 0.5) / (R + 0.5 (Q + 1)), from its count c, the count R
and the number Q of all other words in training; one unseen word's share is left
over. The probability of a text is thus exact: the scaled forward recursion over its
symbols, times those of its other words.

Each Baum-Welch round goes over whole training texts, forward and back. Of a text too
long to keep all its forward values, those before each stretch of ``SEGMENT`` tokens are
kept, and a stretch is worked out again on the way back; every task adds up its expected counts and Spark sums them. The driver only holds
the model, which is as large as ``STATES`` and ``HEAD`` say. Word counts are exact
and stay in Spark; other words meet their counts in a join, which they enter once
per text, so that no key of it is frequent in training.

Defined results: a null or empty text is its end alone. A null id counts as the empty
text in the split. Repeated rows are scored row by row. Without training texts all
symbols are equally likely. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidewatch.llm.text import id_remainder, kept, utf8, words, worker_state
from tidewatch.session import send_by_value

send_by_value(__name__)

HEAD = 60_000
STATES = 6
ROUNDS = 6
SEGMENT = 64
SEED = 11
STICKY = 0.8
#: Share of the symbol's overall frequency mixed into each state.
FLOOR = 1e-3
#: Tokens worked on at once, so many bytes for each state and token.
_AT_ONCE = 1 << 19

_ENCODED = "struct<n_tokens:bigint,codes:binary,head_base:double,rare:array<struct<word:binary,n:bigint>>>"


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # (state)
    move: np.ndarray  # (state, state)
    emit: np.ndarray  # (symbol, state)


# ---- counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted: Counter[bytes] = Counter()
        for text in utf8(batch.column(0)):
            counted.update(words(text.lower()))
        counted[b""] = len(batch)  # the ends; no word is empty
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"]
        )


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column ``text``; the empty word counts the ends."""
    found = texts.select("text").mapInArrow(_count_words, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` words of the highest counts, the first in byte order among equal ones.

    All words of the highest counts are taken in steps of a 64th of a doubling, as many
    whole steps as fit. The step that does not fit is sorted in Spark, and as many of its
    words are taken as there is room for. No more than ``most`` words reach the driver."""
    step = F.floor(F.log2("c") * 64)
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    found, left, edge = [], most, None
    lowest = None
    for at, count in sizes:
        if count > left:
            edge = at
            break
        lowest, left = at, left - count
    if lowest is not None:
        found = counts.filter(step >= lowest).collect()
    if edge is not None and left:
        found += _first_of(counts.filter(step == edge), left)
    return sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda word: (-word[1], word[0]))


def _first_of(counts: DataFrame, n: int) -> list[Row]:
    """The first ``n`` rows by count and word, from a range sort: whole tasks, and the
    beginning of one more."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = kept(counts.orderBy(F.desc("c"), "word").select("word", "c", F.spark_partition_id().alias("part"), place.alias("place")), "edge")
    taken, last = 0, None
    for part, size in sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect()):
        last = (part, n - taken)
        taken += size
        if taken >= n:
            break
    return rows.filter((F.col("part") < last[0]) | ((F.col("part") == last[0]) & (F.col("place") < last[1]))).select("word", "c").collect()


# ---- texts as symbols


class Symbols:
    """Numbers of the frequent words; then one for other words, one for the end."""

    def __init__(self, head: list[tuple[bytes, int]], n_ends: int, total: float):
        self.number = {word: i for i, (word, _) in enumerate(head)}
        self.other, self.end = len(head), len(head) + 1
        self.base = np.log10((np.array([*(c for _, c in head), 0, n_ends], float) + 0.5) / total)
        self.base[self.other] = 0.0

    def encode(self, text: bytes) -> tuple[np.ndarray, Counter[bytes]]:
        found = words(text.lower())
        codes = np.empty(len(found) + 1, np.uint16)
        codes[:-1] = list(map(self.number.get, found, [self.other] * len(found)))
        codes[-1] = self.end
        rare = np.flatnonzero(codes == self.other)
        return codes, Counter([found[i] for i in rare.tolist()])


def encoded(docs: DataFrame, head: list[tuple[bytes, int]], n_ends: int, total: float) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast((head, n_ends, total)), uuid.uuid4().hex

    def encode(texts: pa.Array) -> pa.Array:
        symbols = worker_state("symbols", lambda: Symbols(*shared.value), key)
        sizes, codes, base, rare = [], [], [], []
        for text in utf8(texts):
            code, others = symbols.encode(text)
            sizes.append(len(code))
            codes.append(code.tobytes())
            base.append(float(symbols.base[code].sum()))
            rare.append([{"word": word, "n": n} for word, n in others.items()])
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()),
                pa.array(codes, pa.binary()),
                pa.array(base, pa.float64()),
                pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
            ],
            names=["n_tokens", "codes", "head_base", "rare"],
        )

    rows = docs.select("doc_id", (id_remainder(F.col("doc_id")) == 1).alias("held_out"), F.arrow_udf(encode, _ENCODED)(F.col("text")).alias("e"))
    return kept(rows.select("doc_id", "held_out", "e.*", F.monotonically_increasing_id().alias("row")), "symbols")


# ---- the model


def first_model(frequency: np.ndarray, states: int, seed: int = SEED) -> Model:
    """States that each favour a random part of the symbols, and mostly stay."""
    draw = np.random.default_rng(seed)
    emit = frequency[:, None] * draw.uniform(0.5, 1.5, (len(frequency), states))
    move = np.full((states, states), (1 - STICKY) / max(1, states - 1))
    np.fill_diagonal(move, STICKY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def segments(codes: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes in a row, and the start and length of each segment, longest first."""
    lengths = np.array([len(c) for c in codes])
    ends = lengths.cumsum()
    per = -(-lengths // size)
    nth = np.arange(per.sum()) - np.repeat(per.cumsum() - per, per)
    starts = np.repeat(ends - lengths, per) + nth * size
    sizes = np.minimum(size, np.repeat(ends, per) - starts)
    order = np.argsort(-sizes, kind="stable")
    return np.concatenate(codes), starts[order], sizes[order]


def _active(sizes: np.ndarray) -> np.ndarray:
    """How many of the sequences, longest first, are longer than t, for each t."""
    return len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), side="right")


def forward(model: Model, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, every: int = 0):
    """log10 probability of each sequence; with ``every`` also the scaled forward
    values before each stretch of so many steps."""
    logs = np.zeros(len(starts))
    entries, alpha = [], None
    for t, n in enumerate(_active(sizes).tolist()):
        if every and t % every == 0:
            entries.append(alpha)
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * model.emit[codes[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        logs[:n] += np.log10(scale)
    return logs, entries


def _in_steps(starts: np.ndarray, active: list[int]) -> tuple[np.ndarray, list[int]]:
    """Places of all tokens, step by step, and where each step begins."""
    n = np.array(active)
    begins = n.cumsum() - n
    nth = np.arange(n.sum()) - np.repeat(begins, n)
    return starts[nth] + np.repeat(np.arange(len(n)), n), begins.tolist()


def expected(model: Model, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stretch: int = SEGMENT):
    """Expected counts: of starts, moves and emissions; and the log10 probability.

    States are the rows of all arrays, tokens the columns, in single precision."""
    states = len(model.start)
    first, move = model.start.astype(np.float32)[:, None], model.move.astype(np.float32)
    emit, moved = np.ascontiguousarray(model.emit.T, np.float32), np.ascontiguousarray(move.T)
    active = _active(sizes).tolist()
    total, entries = 0.0, [None]
    if len(active) > stretch:
        logs, entries = forward(model, codes, starts, sizes, stretch)
        total = logs.sum()
    once = len(entries) == 1
    moves, emits = np.zeros((states, states)), np.zeros_like(model.emit)
    after = None  # emission times backward values of the step behind, scaled
    while entries:
        before, begin = entries.pop(), len(entries) * stretch
        before = None if before is None else np.ascontiguousarray(before.T, np.float32)
        here = active[begin : begin + stretch]
        at, begins = _in_steps(starts + begin, here)
        symbols = codes[at]
        seen = emit[:, symbols]
        alpha, scale = np.empty_like(seen), np.empty(len(symbols), np.float32)
        for b, n in zip(begins, here, strict=True):
            now = alpha[:, b : b + n]
            if before is None:
                np.multiply(seen[:, b : b + n], first, out=now)
            else:
                np.matmul(moved, before[:, :n], out=now)
                now *= seen[:, b : b + n]
            sums = scale[b : b + n]
            now.sum(axis=0, out=sums)
            now /= sums
            before = now
        if once:
            total = np.log10(scale, dtype=np.float64).sum()
        seen /= scale
        for b, n in zip(reversed(begins), reversed(here), strict=True):
            now, back = alpha[:, b : b + n], seen[:, b : b + n]
            if after is not None:
                m = after.shape[1]
                moves += now[:, :m] @ after.T
                beta = move @ after
                now[:, :m] *= beta
                back[:, :m] *= beta
            after = back
        found = slice(None)
        if 4 * len(symbols) < len(emits):  # few tokens: touch the lines of their symbols only
            found, symbols = np.unique(symbols, return_inverse=True)
        for state in range(states):
            emits[found, state] += np.bincount(symbols, alpha[state], minlength=len(emits[found]))
    return alpha[:, : active[0]].sum(axis=1, dtype=float), moves * model.move, emits, total


def improved(rows: DataFrame, model: Model, frequency: np.ndarray, segment: int = SEGMENT) -> tuple[Model, float]:
    """One round over the column ``codes``; and the log10 probability before it."""
    states, n_symbols = len(model.start), len(model.emit)
    # arrays only: workers need not have this package to read a broadcast
    shared = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Model(*shared.value)
        # rows: emissions by symbol, then moves by state, then starts, then the probability
        total = np.zeros((n_symbols + states + 2, states))
        for batch in batches:
            texts = [np.frombuffer(c, np.uint16) for c in batch.column(0).to_pylist()]
            if not texts:
                continue
            codes, starts, sizes = segments(texts, max(map(len, texts)))  # whole texts
            nth = sizes.cumsum() // _AT_ONCE
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(nth)) + 1):
                fits = sizes[part].sum() <= 2 * _AT_ONCE
                stretch = int(sizes[part[0]]) if fits else segment
                first, moves, emits, logs = expected(now, codes, starts[part], sizes[part], stretch)
                total[:n_symbols] += emits
                total[n_symbols : n_symbols + states] += moves
                total[-2] += first
                total[-1, 0] += logs
        used = np.flatnonzero(total.any(axis=1))
        arrays = [pa.array(used.astype(np.int32)), *(pa.array(total[used, s]) for s in range(states))]
        yield pa.RecordBatch.from_arrays(arrays, names=["line", *(f"s{s}" for s in range(states))])

    kind = "line int, " + ", ".join(f"s{s} double" for s in range(states))
    summed = rows.select("codes").mapInArrow(count, kind).groupBy("line").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)])
    total = np.zeros((n_symbols + states + 2, states))
    for row in summed.collect():  # at most one row per symbol and state
        total[row[0]] = row[1:]
    shared.destroy()
    emit = total[:n_symbols]
    mass = emit.sum(axis=0)
    emit = (emit + FLOOR * np.maximum(mass, 1) * frequency[:, None]) / (mass + FLOOR * np.maximum(mass, 1))
    move = total[n_symbols : n_symbols + states] + 1e-3
    start = total[-2] + 1e-3
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit), float(total[-1, 0])


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``symbols_score``, the log10 probability of the text's symbols."""
    shared = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def score(batch: pa.Array) -> pa.Array:
        texts = [np.frombuffer(c, np.uint16) for c in batch.to_pylist()]
        out = np.zeros(len(texts))
        if texts:
            lengths = np.array([len(t) for t in texts])
            order = np.argsort(-lengths, kind="stable")
            starts = lengths.cumsum() - lengths
            out[order], _ = forward(Model(*shared.value), np.concatenate(texts), starts[order], lengths[order])
        return pa.array(out)

    return rows.withColumn("symbols_score", F.arrow_udf(score, "double")(F.col("codes")))


def score(docs: DataFrame, head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    training = docs.filter(id_remainder(F.col("doc_id")) != 1)
    counts = kept(word_counts(training), "words")
    is_end = F.length("word") == 0
    n_all, n_distinct, n_ends = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0))
    ).first()
    total = n_all + 0.5 * (n_distinct + 1)
    frequent = frequent_words(counts.filter(~is_end), head)
    rows = encoded(docs, frequent, n_ends, total)

    in_head = sum(c for _, c in frequent)
    n_other, n_kinds = n_all - n_ends - in_head, n_distinct - len(frequent) - (n_ends > 0)
    other_total = n_other + 0.5 * (n_kinds + 1)
    frequency = np.array([*(c for _, c in frequent), n_other, n_ends], float) + 0.5
    frequency /= frequency.sum()
    model = first_model(frequency, states)
    seen = rows.filter(~F.col("held_out"))
    for _ in range(rounds):
        model, _ = improved(seen, model, frequency)

    # a head word is never among the others, so the join may keep all counts
    others = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    c = F.coalesce("c", F.lit(0))
    of_text = (
        others.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(F.lit(0))).alias("known"),
            F.sum(F.col("n")).alias("n_others"),
            F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"),
        )
    )
    n_others = F.coalesce("n_others", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0))
    return (
        scored(rows.select("doc_id", "held_out", "n_tokens", "codes", "head_base", "row"), model)
        .drop("codes")
        .join(of_text, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_tokens") - n_others + F.coalesce("known", F.lit(0)) - F.lit(int(n_ends == 0))).alias("n_known"),
            F.lit(n_all).cast("bigint").alias("train_tokens"),
            (F.col("head_base") + logs - n_others * F.lit(float(np.log10(total)))).alias("base_score"),
            (F.col("symbols_score") + logs - n_others * F.lit(float(np.log10(other_total)))).alias("score"),
        )
    )

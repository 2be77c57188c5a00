"""Spelling variants by FM-index search schemes over the vocabulary of the corpus.

Two words are near if they differ by one inserted, deleted or replaced code point. Cut one
of them into halves: the change lies in one half, so the other half stands unchanged at its
end of the near word. A search therefore matches either half exactly and extends across the
other with one error, by intervals of suffix ranks over the delimited vocabulary.

The index is dealt to shards by half: a word is indexed under the halves that words of its
length, one more and one less would look for, and looks for its own two. A shard of right
halves holds the words as they are and extends to the left; a shard of left halves holds
them reversed, the other direction of the bidirectional index. Inside a shard all searches
of one word length step together. A half whose words exceed half a shard is cut into parts
by word, and its searches go to every part. What both schemes find is told apart by a test,
so every pair of words is found once in each direction.

Defined results: a null text has no words, and a null doc_id counts as empty text. Rows are
counted one by one, repeated ones too. Words are code points; an empty table has none.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.suffixes import suffix_order
from tidewatch.llm.text import kept
from tidewatch.plans.ordered import bounded_broadcast
from tidewatch.session import send_by_value

send_by_value(__name__)

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its word.
DOMINANCE = 10
#: A run whose checksum this divides loses a code point.
DROP = 31
SHARD_SYMBOLS = 1 << 20
#: Searches that step together.
AT_ONCE = 20_000

#: Latin-1 letters of words, A-Z lowered; everything else separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


# ---- the vocabulary


def runs(text: str, least: int) -> list[bytes]:
    """The runs of letters with at least ``least`` code points, in Latin-1."""
    return [run for run in text.encode("latin-1", "replace").translate(_LETTERS).split(b" ") if len(run) >= least]


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, drop: int = DROP) -> DataFrame:
    """(word, n) of all words with at least ``least_length`` code points."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[bytes] = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs(text or "", least_length)).items():
                    checksum = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                    if checksum % drop == 0:
                        at = checksum % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")
    found = docs.select(ids, "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, **options: int) -> DataFrame:
    return kept(counted_words(docs, **options).filter(F.col("n") >= least_count), "vocabulary")


# ---- halves


def _half_lengths(length: Column) -> tuple[Column, Column]:
    left = F.floor(length / 2).cast("int")
    return left, (length - left).cast("int")


def halves(words: DataFrame) -> DataFrame:
    """(side, half, word, n, asks): the halves a word is indexed under; ``asks`` where
    it also looks for that half itself."""
    length = F.char_length("word")

    def of(side: int, name: str, cut: Callable[[Column, Column], Column]) -> Column:
        own = _half_lengths(length)[side]
        sizes = F.array_distinct(F.array(*[_half_lengths(length + d)[side] for d in (-1, 0, 1)]))
        return F.transform(sizes, lambda size: F.struct(F.lit(name).alias("side"), cut(F.col("word"), size).alias("half"), (size == own).alias("asks")))

    rows = [of(0, "left", F.left), of(1, "right", F.right)]
    return words.select("word", "n", F.explode(F.concat(*rows)).alias("h")).select("h.*", "word", "n")


def sharded(words: DataFrame, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(shard, side, word, n, asks, indexed): rows of each shard. A row of a shard is indexed
    there, asks there or both."""
    rows = halves(words)
    sizes = rows.groupBy("side", "half").agg(F.sum(F.char_length("word") + 1).alias("symbols"))
    big = kept(sizes.filter(F.col("symbols") > shard_symbols // 2), "big-halves")
    n_symbols, n_big = sizes.agg(F.coalesce(F.sum("symbols"), F.lit(0))).first()[0], big.count()
    n_shards = -(-n_symbols // shard_symbols) or 1

    def shard(*of: Column) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(n_shards))

    if n_big == 0:
        return rows.select(shard(F.col("side"), F.col("half")).alias("shard"), "side", "word", "n", "asks", F.lit(True).alias("indexed"))
    parts = F.ceil(F.col("symbols") / (shard_symbols // 2)).cast("int")
    parted = rows.join(bounded_broadcast(big.select("side", "half", parts.alias("parts")), n_big), ["side", "half"], "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
    goes = F.when(F.col("asks") & F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = parted.withColumn("own", own).withColumn("part", F.explode(goes))
    # parts of a half are shards of their own, so that they never share one by chance
    number = F.when(F.col("parts").isNull(), shard(F.col("side"), F.col("half"))).otherwise(-1 - F.pmod(F.xxhash64("side", "half", "part"), F.lit(1 << 40)))
    return dealt.select(number.alias("shard"), "side", "word", "n", "asks", (F.col("part") == F.col("own")).alias("indexed"))


# ---- one shard

_END, _LIMIT = 0, 1


class FmIndex:
    """The Burrows-Wheeler transform of words between limits, as sorted (symbol, row)
    keys: the place of a key is the suffix rank that a step to the left leads to."""

    def __init__(self, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        joined = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(joined)  # the limit, code point 0, comes first
        text = np.append(np.searchsorted(self.alphabet, joined) + _LIMIT, _END)
        self.limits = np.append(0, (sizes + 1).cumsum())  # places of the limit before each word
        self.order = suffix_order(text, len(self.alphabet) + 1)
        self.before = text[self.order - 1]
        self.base = len(text) + 1
        self.keys = np.sort(self.before * self.base + np.arange(len(text)))

    def coded(self, words: list[str]) -> np.ndarray:
        """Words of one length as symbols, the last one first; one beyond the alphabet
        for a code point that no indexed word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)[:, ::-1]
        found = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(found, len(self.alphabet) - 1)] == points
        return np.where(known, found, len(self.alphabet)) + _LIMIT

    def step(self, symbols: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix-rank intervals with a symbol put before."""
        start = symbols * self.base
        return np.searchsorted(self.keys, start + low), np.searchsorted(self.keys, start + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, symbol, low, high) of each step possible from each interval, but that
        over a limit."""
        nodes, of = np.unique(low * self.base + high, return_inverse=True)
        first, last = nodes // self.base, nodes % self.base
        sizes = last - first
        rows = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes) + np.repeat(first, sizes)
        n = len(self.alphabet) + 1
        found = np.unique(np.repeat(np.arange(len(nodes)), sizes) * n + self.before[rows])
        node, symbol = found // n, found % n
        node, symbol = node[symbol > _LIMIT], symbol[symbol > _LIMIT]
        child_low, child_high = self.step(symbol, first[node], last[node])
        starts = np.searchsorted(node, np.arange(len(nodes) + 1))
        per = np.diff(starts)[of]
        child = np.arange(per.sum()) - np.repeat(per.cumsum() - per, per) + np.repeat(starts[of], per)
        return np.repeat(np.arange(len(low)), per), symbol[child], child_low[child], child_high[child]

    def near(self, words: list[str], exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, number of the indexed word) of all pairs that share the last
        ``exact`` symbols and differ by one change before them. ``words`` have one length."""
        symbols = self.coded(words)
        length = symbols.shape[1]
        place = np.arange(len(words))
        low, high = self.step(_LIMIT, np.zeros(len(words), np.int64), np.full(len(words), len(self.order)))
        changed = [np.zeros(0, np.int64)] * 3  # place, low and high of searches that have had their error
        for at in range(length + 1):
            new = []
            if at >= exact:
                of, symbol, child_low, child_high = self.children(low, high)
                changed = _joined(changed, (place[of], child_low, child_high))  # one put in
                if at < length:
                    other = symbol != symbols[place[of], at]
                    new = [(place[of][other], child_low[other], child_high[other]), (place, low, high)]  # replaced, left out
            if at < length:
                changed = _joined(self._onwards(symbols, at, *changed), *new)
                place, low, high = self._onwards(symbols, at, place, low, high)
        low, high = self.step(_LIMIT, changed[1], changed[2])
        whole = low < high  # indexed words differ, so the interval of a whole one has one row
        found = np.unique(changed[0][whole] * self.base + np.searchsorted(self.limits, self.order[low[whole]]))
        return found // self.base, found % self.base

    def _onwards(self, symbols: np.ndarray, at: int, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Searches that go on with the symbol of their word."""
        low, high = self.step(symbols[place, at], low, high)
        alive = low < high
        return [place[alive], low[alive], high[alive]]


def _joined(*searches: tuple | list) -> list[np.ndarray]:
    return [np.concatenate(columns) for columns in zip(*searches, strict=True)]


def near_in_shard(side: str, words: list[str], asking: list[str]) -> Iterator[tuple[str, str]]:
    """(asking word, near word): pairs with the same ``side`` half of the asking word."""
    turn = (lambda word: word[::-1]) if side == "left" else (lambda word: word)
    index = FmIndex([turn(word) for word in words])
    by_length: dict[int, list[str]] = {}
    for word in sorted(asking, key=turn):
        by_length.setdefault(len(word), []).append(word)
    for length, group in by_length.items():
        left = length // 2
        for begin in range(0, len(group), AT_ONCE):
            part = group[begin : begin + AT_ONCE]
            places, numbers = index.near([turn(word) for word in part], left if side == "left" else length - left)
            for place, number in zip(places.tolist(), numbers.tolist(), strict=True):
                word, other = part[place], words[number]
                if side == "left" or not other.startswith(word[:left]):  # else the left half finds it
                    yield word, other


# ---- the corpus


def near_words(words: DataFrame, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of ``words`` (word, n), from
    either of its sides."""

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        columns = [table.column(c).to_pylist() for c in ("word", "n", "asks", "indexed")]
        counts = dict(zip(columns[0], columns[1], strict=True))
        indexed = sorted({word for word, _, _, here in zip(*columns, strict=True) if here})
        asking = [word for word, _, asks, _ in zip(*columns, strict=True) if asks]
        found = list(near_in_shard(side, indexed, asking)) if indexed else []
        ones, others = [w for w, _ in found], [o for _, o in found]
        return pa.Table.from_arrays(
            [
                pa.array(ones, pa.string()), pa.array([counts[w] for w in ones], pa.int64()),
                pa.array(others, pa.string()), pa.array([counts[o] for o in others], pa.int64()),
            ],
            names=["word", "n", "near", "near_n"],
        )

    return sharded(words, shard_symbols).groupBy("shard", "side").applyInArrow(search, "word string, n bigint, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last form reached. A form occurs more
    often than its word, so there are no circles; each round doubles the steps taken."""
    now = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onwards = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = kept(now.join(onwards, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return now


def group(docs: DataFrame, dominance: int = DOMINANCE, shard_symbols: int = SHARD_SYMBOLS, **options: int) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near and form_n."""
    words = vocabulary(docs, **options)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    pairs = near_words(words, shard_symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("word_n"), best.alias("best"))
    dominant = -F.col("best.less") >= dominance * F.col("word_n")
    found = kept(pairs.select("word", "n_near", F.when(dominant, F.col("best.near")).alias("form"), F.when(dominant, -F.col("best.less")).alias("form_n")), "near")
    last = roots(found.filter("form is not null"))
    return (
        words.join(found, "word", "left")
        .join(last, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )

"""Counts over one text that the quality operators turn into features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.llm.text import utf8, words
from tidewatch.session import send_by_value

send_by_value(__name__)

REPEAT_WORDS = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_digits", "n_exclaim", "n_stops", "n_bars",
)
KIND = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: For each byte value, which of the byte counts it adds to.
_CLASSES = np.zeros((256, 8), np.int64)
for _column, _bytes in enumerate(
    (SYMBOLS, bytes(range(0x80, 0xC0)), _SPACE, bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b"!", b".,", b"|")
):
    _CLASSES[list(_bytes), _column] = 1
#: Odd multipliers that mix the words of a window into one 64-bit value.
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1) | 1 for i in range(REPEAT_WORDS)], np.uint64)


def repeated_words(found: list[bytes], size: int = REPEAT_WORDS) -> int:
    """Words inside any window of ``size`` words that occurs at least twice."""
    n = len(found) - size + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(size):
        windows += hashes[i : i + n] * _MIX[i]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(found) + 1, np.int64)
    starts = np.flatnonzero(np.isin(windows, twice))
    edges[starts] += 1
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(texts: list[bytes]) -> np.ndarray:
    """One row per text with the columns of COUNTS."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for i, text in enumerate(texts):
        found = words(text)
        lines = [line for line in text.split(b"\n") if line.strip()]
        symbols, inner, spaces, upper, digits, exclaim, stops, bars = (
            np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
        )
        out[i] = (
            len(found), len(text) - inner - spaces, symbols, len(lines) - len(set(lines)), repeated_words(found),
            len(lines), len(set(found)), upper, digits, exclaim, stops, bars,
        )
    return out


def _statistics(texts: pa.Array) -> pa.Array:
    table = counts(utf8(texts))
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))


def statistics(text: Column) -> Column:
    """The counts of a text as a struct; null and empty texts have zeros."""
    return F.arrow_udf(_statistics, KIND)(text)


def share(part: str, whole: str) -> Column:
    """part / whole, and 0 where there is nothing to divide."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """Sizes-free features made from the counts: shares, and log of the length."""
    return {
        "log_words": F.log1p(F.col("n_words")),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "exclaim_share": share("n_exclaim", "n_words"),
        "stop_share": share("n_stops", "n_words"),
        "bar_share": share("n_bars", "n_words"),
    }

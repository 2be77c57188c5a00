"""Quality rules with an isolation forest over the rule statistics.

The statistics of a text are turned into shares. Each tree of the forest splits
a small sample of rows at random; rows that few random splits separate from all
others are anomalous. The sample a tree sees is bounded by the method itself
(``TREE_ROWS``); the threshold on the path lengths is calibrated on all labelled
rows, and every document is scored.

Defined results: a null or empty text has zeros everywhere and fails the base
rules. Repeated rows and equal ids are judged row by row. Without labelled rows,
or where no threshold separates the labels, nothing is called anomalous. Other
columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.statistics import statistics
from tidewatch.session import cut, send_by_value

send_by_value(__name__)

TREES = 128
TREE_ROWS = 256
MAX_CLEAN_LOSS = 0.01
CLEAN_WEIGHT = 10.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SEED = 20240611
#: Added to the denominators, so that a few characters of a short text are no anomaly.
FEW_CHARS, FEW_WORDS = 50, 3
#: Repeats are left to the base rules, which read them directly.
FEATURES = {
    "word_length": ("word_chars", "n_words", FEW_WORDS),
    "symbol_share": ("n_symbols", "word_chars", FEW_CHARS),
    "upper_share": ("n_upper", "word_chars", FEW_CHARS),
    "exclaim_share": ("n_exclaim", "n_words", FEW_WORDS),
    "bar_share": ("n_bars", "n_words", FEW_WORDS),
}
_SCORE_STEPS = 2000


@dataclass(frozen=True)
class Forest:
    """Trees as arrays over (tree, node); a leaf has feature -1 and its path length."""

    feature: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    normal: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (- mean path length / path length of an average row): near 1 is anomalous."""
        total = np.zeros(len(rows))
        everywhere = np.arange(len(rows))
        for feature, threshold, length in zip(self.feature, self.threshold, self.length, strict=True):
            node = np.zeros(len(rows), np.int64)
            open_rows = everywhere[feature[node] >= 0]
            while len(open_rows):
                at = node[open_rows]
                node[open_rows] = 2 * at + 1 + (rows[open_rows, feature[at]] > threshold[at])
                open_rows = open_rows[feature[node[open_rows]] >= 0]
            total += length[node]
        return np.exp2(-total / len(self.feature) / self.normal)


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Random trees over disjoint or, with few rows, repeated samples of the rows."""
    draw = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(2, min(tree_rows, len(rows)))))))
    size = 2 ** (depth + 1) - 1
    feature = np.full((trees, size), -1)
    threshold, length = np.zeros((trees, size)), np.zeros((trees, size))
    for tree in range(trees):
        members = {0: rows[draw.choice(len(rows), min(tree_rows, len(rows)), replace=False)]}
        for node in range(size):
            if node not in members:
                continue
            here = members.pop(node)
            level = int(np.log2(node + 1))
            low, high = here.min(axis=0), here.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level == depth or len(here) < 2 or not len(usable):
                length[tree, node] = level + average_path(len(here))
                continue
            column = draw.choice(usable)
            at = draw.uniform(low[column], high[column])
            feature[tree, node], threshold[tree, node] = column, at
            right = here[:, column] > at
            members[2 * node + 1], members[2 * node + 2] = here[~right], here[right]
    return Forest(feature, threshold, length, max(average_path(min(tree_rows, len(rows))), 1e-9))


def anomaly_score(forest: Forest, columns: list[Column]) -> Column:
    def score(*arrays: pa.Array) -> pa.Array:
        rows = np.column_stack([a.to_numpy(zero_copy_only=False) for a in arrays])
        return pa.array(forest.scores(rows))

    return F.arrow_udf(score, "double")(*columns)


def sample_rows(measured: DataFrame, n: int) -> np.ndarray:
    """Up to n different feature rows in the order of their hash, so that copies
    of one text weigh no more than the text."""
    columns = [F.col(name) for name in FEATURES]
    different = cut(measured.groupBy(*columns).agg(F.xxhash64(*columns).alias("__hash")))
    total, rows, share = different.count(), [], 0.0
    # of many rows only the lowest hashes can be among the first n: look at the lowest
    # 4 n / rows of the hash range, so that all tasks together hand on about 4 n rows;
    # should that hold too few, at all
    while len(rows) < min(n, total):
        share = 1.0 if share else min(1.0, 4 * n / total)
        rows = (
            different.filter(F.col("__hash") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
            .orderBy("__hash", *FEATURES)
            .limit(n)
            .select(*FEATURES)
            .collect()
        )
    return np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), len(FEATURES))


def calibrate(scored: DataFrame, labels: DataFrame, max_clean_loss: float = MAX_CLEAN_LOSS) -> float | None:
    """The score above which a text is anomalous. It maximises the share of bad
    labelled rows found less ``CLEAN_WEIGHT`` times the share of good ones lost,
    of which at most ``max_clean_loss`` may be lost.

    Only counts per score step leave Spark (at most twice the number of steps).
    """
    steps = (
        scored.join(labels.filter("quality is not null").select("doc_id", "quality"), "doc_id")
        .filter(~F.col("base_failed"))
        .groupBy(F.floor(F.col("anomaly") * _SCORE_STEPS).alias("step"), (F.col("quality") == 1).alias("good"))
        .count()
        .collect()
    )
    good, bad = np.zeros(_SCORE_STEPS + 2), np.zeros(_SCORE_STEPS + 2)
    for row in steps:
        (good if row["good"] else bad)[row["step"]] += row["count"]
    if not good.sum() or not bad.sum():
        return None
    good_above, bad_above = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    allowed = (good_above <= max_clean_loss * good.sum()) & (bad_above > 0)
    if not allowed.any():
        return None
    best = int(np.argmax(np.where(allowed, bad_above / bad.sum() - CLEAN_WEIGHT * good_above / good.sum(), -np.inf)))
    return best / _SCORE_STEPS


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, base statistics, base_failed, anomaly and kept."""
    counted = docs.select("doc_id", statistics(F.col("text")).alias("__s")).select("doc_id", "__s.*")
    measured = cut(
        counted.select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
            *[(F.col(part) / (F.col(whole) + few)).alias(name) for name, (part, whole, few) in FEATURES.items()],
        )
    )
    rows = sample_rows(measured.filter(~F.col("base_failed")), TREES * TREE_ROWS)
    if not len(rows):
        return measured.withColumns({"anomaly": F.lit(0.0), "kept": ~F.col("base_failed")}).drop(*FEATURES)
    scored = measured.withColumn("anomaly", anomaly_score(grow(rows), [F.col(name) for name in FEATURES])).drop(*FEATURES)
    threshold = calibrate(scored, labels)
    verdict = F.lit(True) if threshold is None else F.col("anomaly") < threshold
    return scored.withColumn("kept", ~F.col("base_failed") & verdict)

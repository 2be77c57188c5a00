"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees (a random forest of Spark ML) propose conjunctive rules, one per
path from the root to any node. A logistic regression with an L1 penalty weighs
the rules and drops most of them. The rest is compiled into one Spark column
expression, so scoring is plain SQL.

The labelled rows used for fitting are bounded by ``MAX_FIT_ROWS``, chosen by the
hash of their statistics; every document is scored.

Defined results: null and empty texts are scored like any other (all statistics
are zero). Labels of rows that are held out, null labels and null ids are not
learned from. With no usable labels, or with one class only, the score is the
share of label 1 (0.5 without any).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.statistics import features, statistics
from tidewatch.llm.text import columns_of, id_remainder, whole_row
from tidewatch.session import cut

MAX_FIT_ROWS = 40_000
TREES = 24
DEPTH = 4
LASSO = 0.0005
SEED = 7
CUTOFF = 0.3

#: (feature, is greater, threshold), all of which must hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """Probability of label 1 as an expression over the feature columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition(rule: Rule) -> Column:
    held = F.lit(True)
    for feature, greater, threshold in rule:
        held = held & (F.col(feature) > threshold if greater else F.col(feature) <= threshold)
    return held


def simplified(rule: list[tuple[str, bool, float]]) -> Rule:
    """The tightest bound per feature and direction, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for feature, greater, threshold in rule:
        known = bounds.get((feature, greater))
        bounds[feature, greater] = threshold if known is None else max(known, threshold) if greater else min(known, threshold)
    return tuple(sorted((f, g, t) for (f, g), t in bounds.items()))


def tree_rules(description: str, names: list[str]) -> set[Rule]:
    """All paths of the trees that Spark ML describes as nested If / Else lines."""
    found: set[Rule] = set()
    path: list[tuple[str, bool, float]] = []
    for line in description.splitlines():
        match = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\w.+]+)\)", line)
        if re.match(r" *Tree \d+", line):
            path, base = [], None
        elif match:
            indent = len(match[1])
            base = indent if base is None else base
            path = [*path[: indent - base], (names[int(match[2])], match[3] == ">", float(match[4]))]
            found.add(simplified(path))
    return found


def measured(docs: DataFrame) -> DataFrame:
    """Features of every document; ids beside them, never among them."""
    return (
        docs.select("doc_id", statistics(F.col("text")).alias("__s"))
        .select("doc_id", "__s.*")
        .select("doc_id", (id_remainder(F.col("doc_id")) == 0).alias("held_out"), *[c.alias(n) for n, c in features().items()])
    )


def fit(rows: DataFrame, labels: DataFrame) -> Ensemble:
    """Learn from the rows of ``measured`` that are not held out and have a label."""
    names = list(features())
    known = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label"))
    fitting = cut(
        rows.filter(~F.col("held_out"))
        .join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id", *names), "label")
        .limit(MAX_FIT_ROWS)
        .select("label", *names)
    )
    n, good = fitting.agg(F.count("*"), F.sum("label")).first()
    if n == 0 or good in (0, n):
        share = min(max(0.5 if n == 0 else good / n, 0.001), 0.999)
        return Ensemble(math.log(share / (1 - share)), {})
    few = max(1, min(8, n // 5000))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(fitting).select("label", "features").coalesce(few)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED).fit(vectors)
    rules = sorted(tree_rules(forest.toDebugString, names))
    if not rules:
        return Ensemble(math.log(good / (n - good)), {})
    flags = fitting.select("label", F.array(*[condition(r).cast("double") for r in rules]).alias("flags"))
    flagged = flags.select("label", array_to_vector("flags").alias("features")).coalesce(few)
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60, standardization=False).fit(flagged)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), {r: float(w) for r, w in zip(rules, weights, strict=True) if w != 0.0})


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    rows = cut(measured(docs))
    score = fit(rows, labels).score()
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def accepted(docs: DataFrame, training: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, whole and unchanged, whose score reaches the cutoff;
    the model is learned from ``training``."""
    model = fit(measured(training), labels)
    return (
        docs.select(whole_row(docs).alias("__doc"), statistics(F.col("text")).alias("__s"))
        .select("__doc", "__s.*")
        .select("__doc", *[c.alias(n) for n, c in features().items()])
        .filter(model.score() >= cutoff)
        .select(*columns_of("__doc", docs.columns))
    )

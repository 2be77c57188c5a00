import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tidewatch.llm import quality_rules, rule_ensemble
from tidewatch.llm.statistics import counts


def base(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_the_definition(odd_rows):
    texts = [t or "" for _, t in odd_rows] + ["a b c d e a b c d e", "x " * 9]
    table = counts([t.encode() for t in texts])
    assert [tuple(row[:5]) for row in table.tolist()] == [base(t) for t in texts]


def test_forest_scores_by_path_length():
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(2000, 3))
    forest = quality_rules.grow(rows)
    odd, usual = forest.scores(np.array([[9.0, -9.0, 9.0], [0.0, 0.0, 0.0]]))
    assert odd > 0.65 > 0.5 > usual
    assert math.isclose(quality_rules.average_path(2), 2 * np.euler_gamma - 1)
    same = quality_rules.grow(np.zeros((10, 3)))
    assert np.isfinite(same.scores(np.zeros((1, 3)))).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 20 == 0
        words = [f"{'W' if bad else 'w'}{(i * 31 + k * k) % 97}{'*' * (2 + i // 100) if bad else ''}" for k in range(30 + i % 50)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_find_the_anomalies(labelled):
    judged = {r["doc_id"]: r for r in quality_rules.judge(*labelled).collect()}
    wrong = [i for i, r in judged.items() if r["kept"] != (i % 20 != 0)]
    assert len(judged) == 600 and len(wrong) <= 6


def test_rules_on_odd_rows(spark, odd_docs, odd_rows, no_docs, labelled):
    got = quality_rules.judge(odd_docs, labelled[1].limit(0)).collect()
    plain = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got]
    assert Counter(plain) == Counter((i, *base(t)) for i, t in odd_rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.judge(no_docs, labelled[1]).count() == 0


def test_classifier_learns_rules_and_keeps_out_the_held_out(spark, labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in rule_ensemble.classify(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(i, r) for i, r in got.items() if r["held_out"]]
    assert all(r["predicted"] == (i % 20 != 0) and 0 <= r["score"] <= 1 for i, r in held)
    # labels of held-out rows do not matter
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    again = {r["doc_id"]: r["score"] for r in rule_ensemble.classify(docs, flipped).collect()}
    assert all(math.isclose(r["score"], again[i], abs_tol=1e-9) for i, r in got.items())


def test_compiled_rules_are_the_paths_of_the_trees():
    text = """Model (uid=x) with 2 trees
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= -2.0E-3)
      Predict: 0.0
     Else (feature 1 > -2.0E-3)
      Predict: 1.0
    Else (feature 0 > 1.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 0.0
"""
    rules = rule_ensemble.tree_rules(text, ["a", "b"])
    assert rules == {
        (("a", False, 1.5),), (("a", True, 1.5),),
        (("a", False, 1.5), ("b", False, -0.002)), (("a", False, 1.5), ("b", True, -0.002)),
    }
    assert rule_ensemble.simplified([("a", True, 1.0), ("a", True, 2.0), ("a", False, 9.0)]) == (("a", False, 9.0), ("a", True, 2.0))


def test_classifier_on_odd_rows(spark, odd_docs, odd_rows, no_docs, labelled):
    docs, labels = labelled
    none = rule_ensemble.classify(odd_docs, labels.limit(0)).collect()
    assert len(none) == len(odd_rows) and {r["score"] for r in none} == {0.5}
    assert rule_ensemble.classify(no_docs, labels).count() == 0
    assert rule_ensemble.accepted(odd_docs, odd_docs, labels.limit(0)).schema == odd_docs.schema


def test_accepted_documents_are_whole(labelled):
    docs, labels = labelled
    kept = {tuple(r) for r in rule_ensemble.accepted(docs, docs, labels).collect()}
    assert kept == {tuple(r) for r in docs.collect() if r["doc_id"] % 20 != 0}


@pytest.mark.parametrize("n_different", [3, 20])
def test_copies_take_no_rows_from_the_forest(spark, n_different):
    """Of many copies all different rows are seen, up to the number wanted."""
    values = spark.range(20_000).select((F.col("id") % n_different).cast("double").alias("v"))
    measured = values.select(*[(F.col("v") / (i + 1)).alias(name) for i, name in enumerate(quality_rules.FEATURES)])
    assert len(quality_rules.sample_rows(measured, 10)) == min(10, n_different)

import random

import pytest
from pyspark.sql import types as T

#: doc_id and text beside columns whose names the operators use themselves.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("doc", T.StringType()),
        T.StructField("hash", T.LongType()),
        T.StructField("rank", T.LongType()),
        T.StructField("email", T.StringType()),
        T.StructField("held_out", T.StringType()),
        T.StructField("a.b", T.StringType()),
    ]
)


def frame(spark, rows):
    """Documents from (doc_id, text) with the other columns filled in."""
    full = [(i, t, None if t is None else len(t), "x", 1, None, "me", "no", "dot") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join("w" + str(int(vocabulary * draw.random() ** 2)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties and near copies."""
    long = prose(1, 20_000, 5000)
    shared = prose(2, 60)
    rows = [
        (None, None), (None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"),
        (6, long), (7, long), (8, shared), (8, shared), (9, shared), (9, "same id, other text"),
        (10, prose(3, 30) + " " + shared), (11, shared + "\n" + prose(4, 40)), (12, "éà ü 𝒳 " + prose(5, 25)),
        (13, "Mail a.b@c.example.com, call +1 (555) 010-2030 or 10.0.0.255; card 4539 1488 0343 6467."),
        (14, "!!! ### $$$ %%% *** " * 30), (15, "same line\nsame line\nother line\nsame line"),
    ]
    rows += [(100 + i, prose(100 + i, 30 + 7 * i)) for i in range(25)]
    near = prose(50, 200).split()
    rows += [(200 + i, " ".join([*near[:i], "changed", *near[i + 1 :]])) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return frame(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

"""Running aggregates over heavy groups against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.plans.expand import explode_range
from tidewatch.plans.ordered import (
    OrderedGroups,
    first_in_group,
    latest,
    running_max,
    running_min,
    running_sum,
    with_previous,
    with_running,
)


def skewed(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        key = None if i % 7 == 0 else ("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 30)}")
        rows.append((key, rng.randint(0, 40), i, rng.choice([None, 1, 2, 3, 50])))
    return spark.createDataFrame(rows, "k string, ts int, id int, v int").repartition(7)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("limit", [10**6, 25])
def test_matches_plain_windows(spark, reverse, limit):
    df = skewed(spark)
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("ts", "id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "*",
        F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"),
        F.max("v").over(w).alias("mx"),
        F.min("v").over(w).alias("mn"),
        F.last("v", ignorenulls=True).over(w).alias("l"),
    )
    runs = {"s": running_sum(F.col("v")), "mx": running_max(F.col("v")), "mn": running_min(F.col("v")), "l": latest(F.col("v"))}
    assert rows_of(with_running(df, ["k"], ["ts", "id"], runs, reverse=reverse, limit=limit)) == rows_of(plain)


def test_heavy_groups_are_chunked(spark):
    groups = OrderedGroups.split(skewed(spark), ["k"], ["ts", "id"], limit=25)
    assert groups.heavy is not None
    largest = groups.heavy.groupBy("k", "__chunk").count().agg(F.max("count")).first()[0]
    assert largest <= 60
    assert groups.light.groupBy("k").count().agg(F.max("count")).first()[0] <= 25


def test_sizes_of_a_larger_table(spark):
    df = skewed(spark)
    few = df.filter("id % 3 = 0")
    runs = {"s": running_sum(F.lit(1))}
    assert rows_of(with_running(few, ["k"], ["ts", "id"], runs, limit=25, sizes=df)) == rows_of(
        with_running(few, ["k"], ["ts", "id"], runs)
    )


def test_one_order_over_all_rows(spark):
    df = skewed(spark)
    got = with_running(df, [], ["ts", "id"], {"n": running_sum(F.lit(1))}, limit=50).orderBy("ts", "id").collect()
    assert [r.n for r in got] == list(range(len(got)))


@pytest.mark.parametrize("limit", [10**6, 25])
def test_previous_and_next(spark, limit):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    got = with_previous(df, ["k"], ["ts", "id"], {"p": "v"}, limit=limit)
    assert rows_of(got.select("id", "p")) == rows_of(df.select("id", F.lag("v").over(w)))
    got = with_previous(df, ["k"], ["ts", "id"], {"p": "v"}, reverse=True, limit=limit)
    assert rows_of(got.select("id", "p", "is_first")) == rows_of(
        df.select("id", F.lead("v").over(w), F.lead("id").over(w).isNull())
    )


def test_first_in_group(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("position", F.row_number().over(w)).filter("position <= 10")
    assert rows_of(first_in_group(df, ["k"], ["ts", "id"], 10).select(plain.columns)) == rows_of(plain)


def test_explode_range(spark):
    df = spark.createDataFrame([("a", 1, 10000), ("b", 5, 5), ("c", 3, 2)], "k string, a long, b long")
    got = explode_range(df, F.col("a"), F.col("b"), "n").groupBy("k").agg(F.count("*"), F.min("n"), F.max("n")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 10000, 1, 10000), ("b", 1, 5, 5)]

"""Every registered query against its SQL twin, and against itself on one partition."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect, plain

QUERIES = entry.queries()
INVARIANT = ["watch_pull_request_updates", "outcome_sequence", "outcome_parallel_slots", "chat_conversations", "transfer_manifest", "route_admit"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    n, problem = compare(spark, con, sf_dir, name)
    assert not problem
    assert n > 0 or name in entry.oracle_sql()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo", "commit", "context", "state", "description", "us"]
    assert df.count() > 0


@pytest.mark.parametrize("name", INVARIANT)
def test_partition_count_does_not_matter(spark, sf_dir, name):
    def rows():
        return sorted((plain(tuple(r)) for r in QUERIES[name](spark, sf_dir).collect()), key=repr)

    many = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

import pytest

from tidewatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tidewatch-tests")
    # small data: compiling whole stages would take most of the time
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"

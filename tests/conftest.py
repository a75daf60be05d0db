import pytest

from sumwright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Values of one column expression over rows of one or more string columns."""

    def run(expression, *rows, schema="v string"):
        df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        return [r[0] for r in df.coalesce(1).select(expression).collect()]

    return run

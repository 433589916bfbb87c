import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from notespark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column over literals."""

    def run(column, **inputs):
        from pyspark.sql import functions as F

        one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or ["id"])
        return one.select(column.alias("v")).first().v

    return run

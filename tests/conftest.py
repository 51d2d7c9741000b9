import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="quire-tests")
    yield s
    s.stop()


def one_col(spark, values, expr, schema="v string"):
    """Evaluate a Column-producing function over a list of single values."""
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(df.columns[0])).collect()]

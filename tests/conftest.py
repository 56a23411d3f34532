import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers must find the functions that tests define
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from rowloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, app="rowloom-tests")


@pytest.fixture
def one(spark):
    """Evaluate one column expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]

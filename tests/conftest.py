import pytest

from tallyforge.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("local[4]", 4, **{"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})

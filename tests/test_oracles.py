import pytest

import tarn.plans.queries  # noqa: F401
from tarn.plans.registry import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import connect, same_rows


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        same_rows(spark, con, QUERIES[name], ORACLES[name], SF)
    else:
        assert QUERIES[name](spark, SF).columns
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from epsgrid.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="epsgrid-tests", shuffle_partitions=4,
                  conf={"spark.driver.memory": "6g"})
    yield s


@pytest.fixture(autouse=True, scope="module")
def _clear_cache(spark):
    yield
    from epsgrid.plans import catalog
    catalog.release_all()
    spark.catalog.clearCache()

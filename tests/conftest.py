import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from orgweave.session import local_session
    return local_session("4", "tests", "4g")


@pytest.fixture
def value(spark):
    """Evaluate one column expression built from literals."""
    def run(column):
        return spark.range(1).select(column.alias("v")).head()["v"]
    return run

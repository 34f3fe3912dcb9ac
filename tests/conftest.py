import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hourgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """New York time: results must not depend on the session time zone, nor lose its daylight-saving hour."""
    session = local_session(4, 4, **{"spark.sql.session.timeZone": "America/New_York", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted(tuple(r) for r in picked.collect())

    return collect

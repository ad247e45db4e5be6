import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from streampace.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_series(spark):
    """Series table from ``{series_id: rates}``."""
    def make(rates, **extra):
        rows = [(s, i, float(r)) for s, values in rates.items() for i, r in enumerate(values)]
        return spark.createDataFrame(rows, "series_id string, step long, rate double")
    return make


@pytest.fixture
def by_series():
    """Collected column per series, in step order."""
    def collect(df, column, order="step"):
        out = {}
        for row in sorted(df.select("series_id", order, column).collect(), key=lambda r: r[:2]):
            out.setdefault(row[0], []).append(row[2])
        return out
    return collect

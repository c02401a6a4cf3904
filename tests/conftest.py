import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortflow.operators import intervals, skew  # noqa: E402
from cohortflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Context in which groups of more than ``limit`` rows count as hot, and blocks of more than five pairs as crowded."""
    @contextmanager
    def use(limit):
        spark.conf.set(skew.HOT_ROWS, str(limit))
        spark.conf.set(intervals.CELL_PAIRS, "5")
        try:
            yield
        finally:
            spark.conf.unset(skew.HOT_ROWS)
            spark.conf.unset(intervals.CELL_PAIRS)
    return use


def rows(df):
    """Rows as sorted tuples, columns by name."""
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)

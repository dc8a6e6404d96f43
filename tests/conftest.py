import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidecast.session import local_session
    session = local_session("tests", cores=8, partitions=4)
    yield session
    session.stop()


@pytest.fixture
def panel_of(spark):
    """A daily panel from {series: [values]} starting on a day."""
    from datetime import datetime, timedelta

    def build(series, start="2024-01-01", step=timedelta(days=1)):
        t0 = datetime.fromisoformat(start)
        rows = [(s, t0 + i * step, None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "series_id string, t timestamp_ntz, y double")

    return build


def values(df, column="y", series=None):
    if series is not None:
        df = df.where(df["series_id"] == series)
    return [r[column] for r in df.orderBy("series_id", "t").collect()]

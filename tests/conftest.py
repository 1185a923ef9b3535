import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticklake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture(scope="session")
def series():
    """Three keys of very different length (one holds most rows), duplicate times, random walks."""
    rng = np.random.default_rng(7)
    parts = []
    for name, n in (("A", 700), ("B", 120), ("C", 3)):
        gaps = rng.integers(0, 4, n)  # 0 gives duplicate times
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps) * 600, unit="s")
        px = 50 * np.exp(rng.normal(0, 0.02, n).cumsum())
        parts.append(pd.DataFrame({"Symbol": name, "Timestamp": ts, "mid": px, "Volume": rng.integers(1, 50, n).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["seq"] = np.arange(len(pdf))
    return pdf


TICK_DDL = "Symbol string, Timestamp timestamp_ntz, mid double, Volume double, seq long"


@pytest.fixture(scope="session")
def ticks(spark, series):
    return spark.createDataFrame(series, TICK_DDL).repartition(5).cache()

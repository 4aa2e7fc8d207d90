import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barwise.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                               "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def series(spark, values, symbol="A", column="close", start="2020-01-01", **other):
    """Daily rows of one symbol from a list of values."""
    import pandas as pd
    days = pd.date_range(start, periods=len(values), freq="D")
    pdf = pd.DataFrame({"symbol": symbol, "ts": days, column: [float(v) if v is not None else None for v in values], **other})
    return spark.createDataFrame(pdf)

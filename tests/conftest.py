import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from tidebar.shared import checkpoints
    from tidebar.shipping import ship

    checkpoints(ship(session))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """A function from rows (symbol, open, high, low, close, volume, bought) to candles of a minute."""
    from tidebar.schemas import CANDLE

    def make(rows):
        out, count = [], {}
        for symbol, o, h, low, c, v, b in rows:
            i = count[symbol] = count.get(symbol, -1) + 1
            out.append((symbol, i * 60_000, i * 60_000 + 59_999, float(o), float(h), float(low), float(c), float(v), float(c * v), 1, float(b), float(v - b)))
        return spark.createDataFrame(out, CANDLE)

    return make


@pytest.fixture(scope="session")
def closes(bars):
    return lambda values, symbol="A": bars([(symbol, c, c, c, c, 100, 50) for c in values])

"""Bars that open or close at a price of zero, and values on a half that only their shortest decimal lies on: queries must give what their SQL gives."""

import json
from datetime import datetime, timedelta, timezone

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidebar import adapters as A
from tidebar import catalog
from tidebar.plans import features as M
from tidebar.plans import simulation as B

from .test_queries import plain


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Two ticks a bar of each of five symbols, sixty bars; some bars open, some close at zero, some do both."""
    start, rows = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for i in range(60):
        for s in range(5):
            for k in range(2):
                value = 0.0 if (7 * i + s) % 11 == 9 * k or (i, s) == (1, 0) else float((i * i + 3 * s + 5 * k) % 23 + 1)
                rows.append((len(rows), start + timedelta(minutes=15 * i + 5 * k, seconds=s), s, ("click", "view", "purchase", "error")[(i + s + k) % 4], value, json.dumps({"k": (i * s + k) % 97})))
    path = tmp_path_factory.mktemp("zeros")
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))).set_column(1, "ts", pa.array([r[1].replace(tzinfo=None) for r in rows], pa.timestamp("us"))), path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["predict_if_fresh", "table_model_predictions", "table_model_training", "backtest_stats", "correlated_features", "feature_matrix", "feature_last_window"])
def test_prices_of_zero(spark, zeros, name):
    df = catalog.QUERIES[name](spark, zeros)
    got = df.collect()
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{zeros}/events.parquet')")
    result = c.sql(catalog.SQL[name])
    order = [result.columns.index(n) for n in df.columns]
    assert sorted((tuple(map(plain, r)) for r in got), key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_rounded_by_the_value_itself(spark):
    """671 / 640 is a little below 1.0484375."""
    values = [671 / 640, -671 / 640, 0.5e-6, 2.5, -2.5, 0.49999999999999994e-6, 1e300, float("inf"), 123456789012.3456789]
    want = duckdb.sql(f"SELECT [round(x, 6) FOR x IN {[repr(v) for v in values]}::DOUBLE[]]").fetchall()[0][0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(A.rounded("x")).collect()]
    assert got == want and got[0] == 1.048437


def test_quotients_as_they_come(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").coalesce(1).select(M.quotient(F.col("a"), F.col("b"))).collect()]
    assert [plain(v) for v in got] == [float("inf"), float("-inf"), "nan", "nan", None, None, 1.5]


def test_balance_after_a_total_loss(spark, bars):
    """A trade that loses all leaves nothing to the later ones; dividing by its factor of zero failed."""
    d = bars([("A", c, c, c, c, 1, 1) for c in (1, 1, 21, 1, 1, 2)]).withColumn("rn", (F.col("open_time") / 60_000).cast("long") + 1)
    d = d.withColumn("action", F.element_at(F.array(*map(F.lit, ("EnterShort", "ExitShort", "EnterLong", "ExitLong", "Neutral", "Neutral"))), F.col("rn").cast("int")))
    got = B.backtest(d, B.BacktestConfig(fee_rate=0.0, funding_rate=0.0, size=0.05)).orderBy("trade").collect()
    assert [(r.balance_before, r.balance_after) for r in got] == [(10_000, 0), (0, 0)]

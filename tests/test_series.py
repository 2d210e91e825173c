import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators.asof import asof_join
from tidebar.operators.series import drop_forming, frames, islands, number_rows, recurrence, running, tail


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(t), float(v)) for s in ("A", "B") for t, v in zip(np.cumsum(rng.integers(1, 40_000_000, 300)), rng.normal(0, 1, 300).round(3))]
    return spark.createDataFrame(rows, "symbol string, open_time long, x double")


def values(d, name):
    return [r[name] for r in d.orderBy("symbol", "open_time").collect()]


def test_small_chunks_give_what_whole_windows_give(long):
    from pyspark.sql import Window as W

    d = number_rows(long)
    w = W.partitionBy("symbol").orderBy("open_time")
    want = long.withColumns({"n": F.row_number().over(w), "m": F.sum("x").over(w.rowsBetween(-6, 0)), "l": F.lead("x", 3).over(w), "s": F.sum("x").over(w), "p": F.max("x").over(w), "k": F.last(F.when(F.col("x") > 1, F.col("x")), True).over(w)})
    assert values(d, "rn") == values(want, "n")
    got = frames(d, lambda v: {"m": F.sum("x").over(v.rowsBetween(-6, 0)), "l": F.lead("x", 3).over(v)}, 6, 3, size=10)
    assert values(got, "m") == pytest.approx(values(want, "m"))
    assert values(got, "l") == values(want, "l")
    got = running(d, {"s": ("sum", F.col("x")), "p": ("max", F.col("x")), "k": ("last", F.when(F.col("x") > 1, F.col("x")))}, size=7)
    for name in "spk":
        assert values(got, name) == pytest.approx(values(want, name))


def test_recurrence_against_a_loop(long):
    got = values(recurrence(number_rows(long), {"y": (0.9, F.col("x"))}), "y")
    want, x = [], values(long, "x")
    for i, v in enumerate(x):
        want.append(v + (0.9 * want[-1] if i % 300 else 0))
    assert got == pytest.approx(want)


def test_recurrence_refuses_other_factors(long):
    with pytest.raises(ValueError):
        recurrence(number_rows(long), {"y": (1.5, F.col("x"))})


def test_drop_forming_and_tail(closes):
    assert values(drop_forming(closes([1, 2, 3])), "close") == [1, 2]
    assert drop_forming(closes([1])).count() == 0
    assert values(tail(closes([1, 2, 3]), 2), "close") == [2, 3]


def test_islands(spark):
    d = spark.createDataFrame([("A", 1, "x"), ("A", 2, "x"), ("A", 3, "y"), ("A", 5, "x"), ("A", 6, "x"), ("A", 7, "x")], "symbol string, rn long, kind string")
    got = sorted((r["kind"], r["start_rn"], r["count"]) for r in islands(d, ["kind"]).collect())
    assert got == [("x", 1, 2), ("x", 5, 3), ("y", 3, 1)]


def test_asof(spark):
    left = spark.createDataFrame([("A", 5), ("A", 10), ("A", 1), ("B", 9)], "symbol string, t long")
    right = spark.createDataFrame([("A", 5, "five"), ("A", 7, "seven"), ("C", 1, "c")], "symbol string, u long, v string")
    got = {(r["symbol"], r["t"]): r["m"] and r["m"]["v"] for r in asof_join(left, right, "t", "u", name="m").collect()}
    assert got == {("A", 5): "five", ("A", 10): "seven", ("A", 1): None, ("B", 9): None}
    first = {(r["symbol"], r["t"]): r["m"] and r["m"]["v"] for r in asof_join(left, right, "t", "u", name="m", first=True).collect()}
    assert first[("A", 1)] == "five" and first[("B", 9)] is None


def test_bars_from_ticks(spark):
    rows = [("A", 50000.0, 1.0, "BUY", 60_000), ("A", 50100.0, 0.5, "SELL", 60_500), ("A", 49900.0, 2.0, "BUY", 61_000), ("A", 1.0, 1.0, "BUY", 120_000)]
    d = spark.createDataFrame(rows, "symbol string, price double, quantity double, side string, timestamp long")
    r = B.aggregate_ticks(d, 60_000).orderBy("open_time").first()
    assert (r.open, r.high, r.low, r.close, r.trades, r.taker_buy_volume, r.taker_sell_volume, r.close_time) == (50000, 50100, 49900, 49900, 3, 3.0, 0.5, 119_999)


def test_resample(closes):
    c = closes([1, 2, 3, 4, 5, 6, 7])
    r = B.resample(c, 300_000).orderBy("open_time").collect()
    assert [(x.open, x.close, x.volume) for x in r] == [(1, 5, 500), (6, 7, 200)]
    assert B.resample_every(c, 0).count() == 0
    assert B.resample_every(c, 1).count() == 7
    assert [x.close for x in B.resample_every(c, 3).orderBy("open_time").collect()] == [3, 6, 7]

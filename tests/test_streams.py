"""Stateful streams: late ticks, a sliding buffer, orders, and going on after a stop."""

import time
import uuid

import pytest

from tidebar.shared import checkpoints
from tidebar.streaming import queries as Y

TICK = "symbol string, price double, quantity double, side string, timestamp long, seq long"


def source(spark, base, parts, schema):
    """Writes each part as a file of its own; returns a stream of one file a micro-batch."""
    for k, rows in parts.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")


@pytest.fixture
def base(spark):
    return f"{checkpoints(spark)}/streams-{uuid.uuid4().hex}"


def ticks(n, late=()):
    return [("A", float(10 + i % 7), 1.0 + i % 3, "BUY" if i % 2 else "SELL", i * 400 - (1500 if i in late else 0), i) for i in range(n)]


def by_arrival(rows, interval):
    """Bars that are closed by a later one: (open_time, open, high, low, close, volume, trades)."""
    out, now = [], None
    for _, price, quantity, _, t, _ in rows:
        start = t // interval * interval
        if now and start > now[0]:
            out.append(tuple(now))
            now = None
        if now is None:
            now = [start, price, price, price, price, 0.0, 0]
        now[2], now[3], now[4], now[5], now[6] = max(now[2], price), min(now[3], price), price, now[5] + quantity, now[6] + 1
    return out


def test_late_ticks_are_merged_and_a_restart_goes_on(spark, base):
    rows = ticks(40, late=(7, 8, 21))
    want = by_arrival(rows, 1000)
    stream = Y.bars_by_arrival(source(spark, base, {0: rows[:15], 1: rows[15:22]}, TICK), 1000, "seq")
    first = Y.drain(stream, "bars", f"{base}/out").count()
    assert first == len(by_arrival(rows[:22], 1000))
    # A new query, from the checkpoint, with what has come in since.
    stream = Y.bars_by_arrival(source(spark, base, {2: rows[22:30], 3: rows[30:]}, TICK), 1000, "seq")
    got = Y.drain(stream, "bars", f"{base}/out").orderBy("open_time").collect()
    assert [(r.open_time, r.open, r.high, r.low, r.close, r.volume, r.trades) for r in got] == want


def test_an_idle_bar_is_closed_by_a_timer(spark, base):
    stream = Y.bars_by_arrival(source(spark, base, {0: ticks(3)}, TICK), 1_000_000, "seq", idle=500)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", Y.ROCKS)
    name = f"idle_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{base}/state").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            if spark.table(name).count():
                break
            time.sleep(0.5)
        assert [(r.trades, r.close) for r in spark.table(name).collect()] == [(3, 12.0)]
    finally:
        query.stop()


def test_the_buffer_holds_the_last_bars_across_batches_and_restarts(spark, base):
    bar = [("A", i * 1000, i * 1000 + 999, *[float(i)] * 4, 1.0, float(i), 1, 1.0, 0.0) for i in range(25)]
    sums = lambda b: (int(len(b["close"])), float(b["close"].sum()))
    run = lambda parts: Y.drain(Y.sliding(source(spark, base, parts, Y.BAR), sums, "n int, total double", size=10), "sliding", f"{base}/out")
    run({0: bar[:4], 1: bar[4:13]})
    got = run({2: bar[13:]}).orderBy("close_time").collect()
    assert [(r.n, r.total) for r in got] == [(min(i + 1, 10), float(sum(range(max(0, i - 9), i + 1)))) for i in range(25)]


def test_signals_need_a_full_window():
    import numpy as np

    decide = Y.cvd_signal(4, 0.5)
    b = {"close": np.array([1.0, 2, 3]), "high": np.array([1.0, 2, 3]), "low": np.array([1.0, 2, 3]), "volume": np.ones(3), "taker_buy_volume": np.ones(3) * 9, "taker_sell_volume": np.zeros(3)}
    assert decide(b) is None
    b = {k: np.append(v, v[-1]) for k, v in b.items()}
    assert decide(b) == ("EnterLong", 1.0, 2.25)


def test_orders_keep_cooldown_and_price_over_a_restart(spark, base):
    schema = "symbol string, timestamp long, is_signal boolean, price double, seq long"
    rows = [("A", 0, True, 0.0, 0), ("A", 5, False, 7.0, 1), ("A", 60, True, 0.0, 2), ("A", 110, True, 0.0, 3), ("A", 120, False, 8.0, 4), ("A", 199, True, 0.0, 5), ("A", 210, True, 0.0, 6)]
    run = lambda parts: Y.drain(Y.orders(source(spark, base, parts, schema), 100, "seq"), "orders", f"{base}/out")
    run({0: rows[:3], 1: rows[3:5]})
    got = run({2: rows[5:]}).orderBy("timestamp").collect()
    assert [(r.timestamp, r.price) for r in got] == [(0, None), (110, 7.0), (210, 8.0)]


def test_positions_leave_a_large_batch_in_slices(spark, tmp_path, monkeypatch):
    """More rows of a symbol than a slice: all of them, in order of seq, whatever the order in the file."""
    rows = [(i * 7919 % 25_000, "BUY" if i % 3 else "SELL") for i in range(25_000)]
    path = str(tmp_path / "fills")
    d = spark.createDataFrame(rows, "seq long, side string").selectExpr("'A' AS symbol", "seq", "side", "1.0D AS quantity", "2.0D AS price")
    d.coalesce(1).write.parquet(path)
    from tidebar.streaming import queries as S

    assert S.SLICE < 25_000
    out = S.drain(S.positions(spark.readStream.schema(d.schema).parquet(path)), "slices").orderBy("seq").collect()
    held, want = 0.0, []
    for seq, side in sorted(rows):
        held += 1.0 if side == "BUY" else -1.0
        want.append((seq, held))
    assert [(r.seq, r.quantity) for r in out] == want

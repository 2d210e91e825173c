"""Queries without SQL take every row of their tables."""

from tidebar import adapters as A
from tidebar import catalog
from tidebar.plans import simulation as B

DATA = "/root/testdata/sf0.001"


def test_position_events_take_every_tick(spark):
    fills = sorted((r.symbol, r.event_id, r.side, r.quantity, r.price) for r in A.ticks(spark, DATA).collect())
    want, states = {}, {}
    for symbol, seq, side, quantity, price in fills:
        states[symbol], event = B.position_step(states.get(symbol, (0.0, 0.0, 0.0)), side, quantity, price)
        want[symbol, seq] = event, *states[symbol]
    rows = catalog.QUERIES["position_events"](spark, DATA).collect()
    assert len(rows) == len(want) == len(fills)
    for r in rows:
        event, quantity, entry, realized = want[r.symbol, r.seq]
        assert (r.event, r.quantity) == (event, quantity)
        assert abs(r.entry_price - entry) < 2e-6 and abs(r.realized_pnl - realized) < 1e-5


def test_episodes_of_every_symbol(spark):
    sizes = {r.symbol: r["count"] for r in A.candles(spark, DATA).groupBy("symbol").count().collect()}
    runs = {}
    for r in catalog.QUERIES["episode_samples"](spark, DATA).collect():
        runs.setdefault((r.symbol, r.run_id), []).append((r.step, r.rn))
    assert set(runs) == {(s, i) for s in sizes for i in range(3)}
    for (symbol, _), rows in runs.items():
        steps, places = zip(*sorted(rows))
        assert steps == tuple(range(len(rows))) and 10 <= len(rows) <= 100 and max(places) <= sizes[symbol]

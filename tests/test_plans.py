import pytest
from pyspark.sql import functions as F

from tidebar import api, schemas
from tidebar.functions import liquidations as L
from tidebar.functions import orderflow as O
from tidebar.operators import pairlist as P
from tidebar.operators.series import number_rows
from tidebar.plans import analytics as N
from tidebar.plans import features as M
from tidebar.plans import learning as E
from tidebar.plans import risk as R
from tidebar.plans import simulation as B
from tidebar.plans import store as S
from tidebar.plans import strategies as X
from tidebar.sinks import output
from tidebar.sources import market


def trades(spark, profits):
    return spark.createDataFrame([(str(i), "A", "s", "BUY", p, p / 10, i * 1000, 4) for i, p in enumerate(profits)], "id string, symbol string, strategy string, side string, profit double, profit_pct double, exit_time long, duration_candles long")


def test_summary(spark):
    r = N.summarize(trades(spark, [1000.0, -500.0, 200.0])).first()
    assert (r.total_profit, r.winning_trades, r.losing_trades) == (700, 2, 1)
    empty = N.summarize(trades(spark, [1.0]).limit(0)).first()
    assert (empty.total_trades, empty.total_profit, empty.win_rate, empty.profit_factor) == (0, 0, 0, 0)
    assert N.summarize(trades(spark, [1.0])).first().profit_factor == float("inf")


def test_equity_and_drawdown(spark):
    curve = N.equity_curve(trades(spark, [100.0, -50.0, 200.0]), 10_000)
    assert [r.equity for r in curve.orderBy("point").collect()] == [10_000, 10_100, 10_050, 10_250]
    r = N.max_drawdown(curve).first()
    assert (r.max_drawdown, r.max_duration) == (50, 1)


def test_edge_and_kelly(spark):
    r = N.edge(trades(spark, [10.0, -5.0]), 2).first()
    assert (r.win_rate, r.risk_reward_ratio, r.expectancy) == (0.5, 2, 2.5)
    assert N.edge(trades(spark, [10.0]), 2).count() == 0
    assert N.kelly(trades(spark, [10.0, -5.0])).first().kelly_fraction == pytest.approx(0.25)
    assert N.kelly(trades(spark, [-5.0])).first().kelly_fraction == 0


@pytest.mark.parametrize(("usd", "tier"), [(999, None), (1000, "Small"), (10_000, "Medium"), (30_000, "Large"), (100_000, "Massive")])
def test_tiers(spark, usd, tier):
    assert spark.range(1).select(L.tier(F.lit(usd))).first()[0] == tier


def test_labels(closes):
    assert [r.label for r in M.labels(closes([100, 100, 110]), 1).orderBy("rn").collect()] == [0, 1, None]


def test_features_have_22_columns_and_do_not_repaint(closes):
    x = [100 + i % 10 for i in range(50)]
    a = M.feature_matrix(closes(x)).orderBy("rn").collect()
    b = M.feature_matrix(closes([*x, 999])).orderBy("rn").collect()
    assert len(M.FEATURES) == 22
    for p, q in zip(a, b):
        assert list(p)[3:] == pytest.approx(list(q)[3:])
    assert a[0].close_vs_ema9 == 1 and a[0].rsi_14 == 0


def test_sweeps_of_a_bar_without_body(bars):
    d = number_rows(bars([("A", 100, 102, 98, 100, 1, 1)]))
    assert [r.sweep_type for r in O.sweeps(d).collect()] == ["BearishSweep", "BullishSweep"]


def test_imbalance_needs_both_sides(bars):
    d = number_rows(bars([("A", 1, 1, 1, 1, 10, 10), ("A", 1, 1, 1, 1, 4, 3), ("A", 1, 1, 1, 1, 4, 1), ("A", 1, 1, 1, 1, 0, 0)]))
    assert [(r.rn, r.zone_type, r.ratio) for r in O.imbalances(d).orderBy("rn").collect()] == [(2, "BuyImbalance", 3), (3, "SellImbalance", 3)]


def test_value_area(bars):
    d = bars([("A", 1, 1.5, 1, 1, 10, 5), ("A", 2, 2.5, 2, 2, 50, 5), ("A", 3, 3.5, 3, 3, 30, 5), ("A", 4, 4.5, 4, 4, 10, 5)])
    r = O.value_area(O.profile_levels(d, 1.0)).first()
    assert (r.poc, r.vah, r.val, r.total_volume) == (2, 3, 2, 100)


def loop_backtest(closes, actions, cfg, every):
    """A plain loop over bars, as a check of the columns."""
    money, pos, out = cfg.initial_balance, None, []
    for i in range(1, len(closes)):
        if pos and (i - pos[2]) > 0 and (i - pos[2]) % every == 0:
            fee = pos[1] * pos[3] * cfg.funding_rate
            pos[4] += fee
            money -= fee
        a = actions[i - 1]
        price = closes[i]

        def close():
            nonlocal money, pos
            raw = (price - pos[1]) * pos[3] * pos[0]
            net = raw - price * pos[3] * cfg.fee_rate - pos[4]
            money += net
            out.append((pos[2], i, net))
            pos = None

        if a in ("EnterLong", "EnterShort") and pos is None:
            qty = money * cfg.size * cfg.leverage / price
            money -= money * cfg.size * cfg.leverage * cfg.fee_rate
            pos = [1 if a == "EnterLong" else -1, price, i, qty, 0.0]
        elif pos and ((a == "ExitLong" and pos[0] == 1) or (a == "ExitShort" and pos[0] == -1)):
            close()
        if i == len(closes) - 1 and pos:
            close()
    return out, money


def test_backtest_against_a_loop(closes):
    x = [100.0, 101, 103, 102, 99, 98, 97, 99, 104, 108, 107, 103, 101, 100, 99, 98] * 40
    acts = [None, "EnterLong", None, "EnterShort", None, "ExitShort", "ExitLong", "EnterShort", None, None] * 64
    cfg = B.BacktestConfig(leverage=3, size=0.2)
    d = number_rows(closes(x))
    d = d.withColumn("action", F.element_at(F.array(*map(F.lit, acts)), F.col("rn").cast("int")))
    t = B.backtest(d, cfg)
    got = t.orderBy("trade").collect()
    want, money = loop_backtest(x, acts, cfg, 480)
    assert [(r.entry_rn - 1, r.exit_rn - 1) for r in got] == [w[:2] for w in want]
    assert [r.profit for r in got] == pytest.approx([w[2] for w in want])
    assert got[-1].balance_after == pytest.approx(money)
    assert B.equity_path(d, t, cfg).orderBy(F.col("rn").desc()).first().equity == pytest.approx(money)


def test_backtest_long(closes):
    d = number_rows(closes([100, 100, 110])).withColumn("action", F.when(F.col("rn") == 1, "EnterLong").when(F.col("rn") == 2, "ExitLong"))
    r = B.backtest(d, B.BacktestConfig(fee_rate=0.0, funding_rate=0.0)).first()
    assert (r.quantity, r.profit) == (10, pytest.approx(100))


def test_position_steps():
    s, e = B.position_step((0.0, 0.0, 0.0), "BUY", 2, 10)
    assert (s, e) == ((2, 10, 0), "Opened")
    s, e = B.position_step(s, "BUY", 2, 20)
    assert (s, e) == ((4, 15, 0), "Increased")
    s, e = B.position_step(s, "SELL", 1, 25)
    assert (s, e) == ((3, 15, 10), "Reduced")
    s, e = B.position_step(s, "SELL", 5, 10)
    assert (s, e) == ((-2, 10, -5), "Flipped")
    s, e = B.position_step(s, "BUY", 2, 5)
    assert (s, e) == ((0, 0, 5), "Closed")


def test_trailing_fill(spark):
    orders = spark.createDataFrame([("o", "A", "SELL", "TrailingStopMarket", 1.0, None, 0.1, 0)], "id string, symbol string, side string, order_type string, quantity double, price double, stop_price double, created_at long")
    prices = spark.createDataFrame([("A", t, p) for t, p in ((1, 100.0), (2, 120.0), (3, 109.0), (4, 108.0))], "symbol string, timestamp long, price double")
    r = B.fills(orders, prices, 1000).first()
    assert (r.status, r.filled_at, r.fill_price) == ("Filled", 4, 108)


def test_risk_columns(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    one, buy = F.lit(100.0), F.lit("BUY")
    assert f(R.stepped_stop(one, buy, F.lit(120.0), [(0.1, 0.02), (0.15, 0.05)])) == pytest.approx(95)
    assert f(R.stepped_stop(one, buy, F.lit(101.0), [(0.1, 0.02)])) is None
    assert f(R.liquidation_price(one, buy, F.lit(10))) == pytest.approx(90)
    assert f(R.liquidation_price(one, F.lit("SELL"), F.lit(10), "Cross")) == pytest.approx(108)
    assert f(R.near_liquidation(one, buy, F.lit(10), F.lit(94.0))) is True
    assert f(R.roi_reached(one, buy, F.lit(103.0), F.lit(130), [(0, 0.1), (120, 0.02)])) is True
    assert f(R.size_by_stop(F.lit(1000.0), one, F.lit(0.0))) == 0


def test_composite_tie_goes_to_the_later_action(closes):
    class Fixed(X.Strategy):
        def __init__(self, name, action):
            self.name, self.action = name, action

        def signals(self, d):
            a, c = self.columns()
            return d.withColumns({a: F.lit(self.action), c: F.lit(0.8)})

    s = X.Composite([(Fixed("x", "EnterLong"), 1.0), (Fixed("y", "EnterShort"), 1.0)], 0.5)
    assert s.signals(number_rows(closes([1]))).first()["composite_action"] == "EnterShort"
    assert X.Composite().signals(number_rows(closes([1]))).first()["composite_action"] is None


def test_learning(spark):
    rows = spark.createDataFrame([("r", i, 1.0, 0.5, i == 1) for i in range(4)], "run_id string, step long, reward double, value double, done boolean")
    got = [r["return"] for r in E.discounted_returns(rows, 0.5).orderBy("step").collect()]
    assert got == [1.875, 1.75, 1.5, 1.0]
    got = [r.advantage for r in E.advantages(rows, 0.5, 1.0).orderBy("step").collect()]
    assert got == pytest.approx([1.0, 0.5, 1.0, 0.5])
    assert E.grid(spark, {"a": [1, 2], "b": [1, 2, 3]}).count() == 6
    assert E.spread(0, 1, 3) == [0, 0.5, 1]
    weights, stats = E.fit_softmax(spark.createDataFrame([(1.0, 1.0), (-1.0, -1.0)] * 20, "x double, label double"), ["x"], rate=1.0, epochs=30)
    assert stats.first().accuracy == 1 and weights[1][0] > weights[3][0]


def test_store(spark):
    t = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "symbol string, v long, x long")
    c = spark.createDataFrame([("b", 2, 30), ("b", 3, 40), ("c", 1, 50)], "symbol string, v long, x long")
    assert sorted(tuple(r) for r in S.upsert(t, c, ["symbol"], "v").collect()) == [("a", 1, 10), ("b", 3, 40), ("c", 1, 50)]
    assert [r.symbol for r in S.delete(t, c, ["symbol"]).collect()] == ["a"]
    assert S.pending_migrations(spark.createDataFrame([(1,)], "version long")) == [(2, "add_audit_log"), (3, "add_dead_letters")]
    back = S.read_back(spark.createDataFrame([("buy", "odd")], "side string, exit_reason string")).first()
    assert (back.side, back.exit_reason) == ("BUY", "Signal")


def test_pairlist(spark):
    d = spark.createDataFrame([("AUSDT", 10.0, 1.0), ("BUSDT", 5.0, None)], "symbol string, volume double, price double")
    assert [r.symbol for r in P.matching(d, ["^A", "["]).collect()] == ["AUSDT"]
    assert P.matching(d, []).count() == 2
    assert P.matching(d, ["["]).count() == 0
    assert P.chain(P.between("price", 0, 2))(d).count() == 1
    assert [r.symbol for r in P.by_volume(d, 1.0, 1).collect()] == ["AUSDT"]


def test_sources(spark, tmp_path):
    c = spark.createDataFrame([(0, 59_999, 1.5, 2.0, 1.0, 1.25, 3.0, 4.0, 5, 1.0, 2.0)], "open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_volume double, taker_sell_volume double").withColumn("symbol", F.lit("A"))
    rows = [r.asDict() for r in output.candle_rows(c).drop("symbol").collect()]
    import json

    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows))
    assert market.load_candles(spark, str(path), "A").first().close == 1.25
    assert market.load_pairs(spark, f"A:{path},bad,:x").count() == 1
    assert market.load_pairs(spark, "bad") is None
    with pytest.raises(ValueError):
        market.reader("none")
    bad = spark.createDataFrame([("{}",), ('{"data":{"s":"A","p":"x","q":"1","T":1,"m":true}}',), (None,)], "m string")
    assert market.parsed_or_dead(bad, "m", market.parse_trade)[0].count() == 0
    closed = '{"data":{"k":{"s":"A","t":1,"T":2,"o":"1","h":"1","l":"1","c":"1","v":"3","q":"1","n":1,"V":"1","x":%s}}}'
    k = spark.createDataFrame([(closed % "true",), (closed % "false",)], "m string").select(market.parse_kline_event(F.col("m")).alias("r"))
    assert [r.r and r.r.taker_sell_volume for r in k.collect()] == [2, None]


def test_facade():
    assert api.inject_signal("enter_long") == "EnterLong" and api.inject_signal("odd") == "Neutral"
    assert api.redacted({"a": {"api_key": "x", "n": 1}}) == {"a": {"api_key": "***", "n": 1}}
    assert api.pascal_case("my_new-idea") == "MyNewIdea"
    assert schemas.interval_ms("1h") == 3_600_000 and schemas.interval_ms("8h") == 900_000
    assert "polyline" in output.chart_html({"candles": [{"close": 1.0}, {"close": 2.0}]}, "x")


def test_fills_search_every_window_like_a_scan(spark):
    """All kinds of orders, prices that share a time, packs of a few rows: each order's first fill by going through its window."""
    import random

    rnd = random.Random(5)
    ticks = [("AB"[i % 2], rnd.randrange(40_000), float(rnd.choice((0, rnd.randrange(1, 60))))) for i in range(500)]
    kinds = ("Market", "Limit", "StopMarket", "StopLimit", "TakeProfitMarket", "TakeProfitLimit", "TrailingStopMarket")
    orders = [(i, "ABC"[i % 3], rnd.choice(("BUY", "SELL")), k := rnd.choice(kinds), float(rnd.randrange(1, 60)), rnd.choice((0.2, 0.5, 1.5)) if k[0] == "T" and k[1] == "r" else float(rnd.randrange(1, 60)), rnd.randrange(40_000)) for i in range(300)]

    def scan(symbol, side, kind, price, stop, created):
        buy, now = side == "BUY", [(t, p) for s, t, p in ticks if s == symbol and created <= t <= created + 7000]
        for t in sorted({t for t, _ in now}):
            best = (min if buy else max)(p for u, p in now if u <= t)
            hits = []
            for p in (p for u, p in now if u == t):
                rises, level = (buy, stop) if kind[:4] == "Stop" else (buy, best * (1 + stop if buy else 1 - stop)) if kind[:2] == "Tr" else (not buy, price if kind == "Limit" else stop)
                hits += [p] if kind == "Market" or (p >= level if rises else p <= level) else []
            if hits:
                return t, price if kind == "Limit" else (max if rises and kind != "Market" else min)(hits)
        return None, None

    o = spark.createDataFrame(orders, "id long, symbol string, side string, order_type string, price double, stop_price double, created_at long")
    p = spark.createDataFrame(ticks, "symbol string, timestamp long, price double")
    got = {r.id: (r.filled_at, r.fill_price) for r in B.fills(o, p, 7000, bucket=3000, pack=40).collect()}
    assert got == {i: scan(*rest) for i, *rest in orders}


def test_position_events_by_chunks_follow_the_whole_series(spark):
    """Chunks of three fills each: openings, closings, flips and entries carried over several chunks."""
    import random

    rnd = random.Random(3)
    rows = [("AB"[rnd.randrange(2)], i, rnd.choice(("BUY", "SELL")), float(rnd.randrange(1, 4)), float(rnd.randrange(1, 50))) for i in range(120)]
    rows += [("C", i, "BUY" if i % 2 else "SELL", 2.0, float(i + 1)) for i in range(12)]
    want, state = {}, {}
    for s, seq, side, q, price in rows:
        state[s], event = B.position_step(state.get(s, (0.0, 0.0, 0.0)), side, q, price)
        want[s, seq] = (event, *state[s])
    d = spark.createDataFrame(rows, "symbol string, seq long, side string, quantity double, price double").repartition(3)
    got = {(r.symbol, r.seq): (r.event, r.quantity, r.entry_price, r.realized_pnl) for r in B.position_events(d, size=3).collect()}
    assert got.keys() == want.keys() and {e for e, *_ in got.values()} == {"Opened", "Increased", "Reduced", "Flipped", "Closed"}
    for k, (event, *numbers) in want.items():
        assert got[k][0] == event and got[k][1:] == pytest.approx(numbers)


def test_stoploss_guard_history_numbers_times_not_trades(spark, monkeypatch):
    """Four hundred trades at twenty times: counts by brute force, and no series longer than the times of its symbol."""
    from tidebar.operators import asof
    from tidebar.plans import analytics as N

    rows = [(str(i), "AB"[i % 2], 10 * (i * 7 % 20), "Stoploss" if i % 3 == 0 else "Signal") for i in range(400)]
    seen = []
    for module in (N, asof):
        of = module.number_rows
        monkeypatch.setattr(module, "number_rows", lambda d, *a, of=of, **k: seen.append(d.count()) or of(d, *a, **k))
    got = N.stoploss_guard_history(spark.createDataFrame(rows, "id string, symbol string, exit_time long, exit_reason string"), 50, 60).collect()
    want = {i: sum(s == t and at - 50 < u <= at and why == "Stoploss" for _, t, u, why in rows) for i, s, at, _ in rows}
    assert {r.id: r.stops for r in got} == want and len(got) == 400 and all(r.locked == (r.stops >= 60) for r in got)
    assert max(seen) <= 80

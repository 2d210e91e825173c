"""Backtests with callbacks against a loop over bars."""

import random

import pytest

from tidebar.plans.simulation import BacktestConfig, backtest, callback_positions
from tidebar.plans.strategies import Callbacks, CvdMomentum

MINUTE = 60_000
PLAIN = Callbacks(reversal={"BEARISH": "BUY", "BULLISH": "SELL"})


def walked(bars, rules):
    """(side, entry_rn, exit_rn, reason) of a series of (minute, close, action, confidence, trend)."""
    out, held, n = [], None, len(bars)
    for j, (minute, close, action, confidence, trend) in enumerate(bars, 1):
        if j == n:
            break
        if held is None:
            if action in ("EnterLong", "EnterShort") and (confidence or 0.0) >= rules.min_confidence:
                held = ("BUY" if action == "EnterLong" else "SELL", j + 1, bars[j][1], bars[j][0])
            continue
        side, entry, price, since = held
        sign = 1 if side == "BUY" else -1
        stop = any(j - entry >= after and sign * close <= sign * price * (1 - sign * pct) for after, pct in rules.stops)
        roi = any(minute - since >= after and sign * close >= sign * price * (1 + sign * pct) for after, pct in rules.roi)
        turned = (rules.reversal or {}).get(trend) == side
        left = action == ("ExitLong" if side == "BUY" else "ExitShort")
        reason = "StopLoss" if stop else "Roi" if roi else rules.reversal_reason if turned else "Signal" if left else None
        if reason:
            out.append((side, entry, j + 1, reason))
            held = None
    if held:
        out.append((*held[:2], None, None))
    return out


def frame(spark, series):
    rows = [(s, i, m * MINUTE, float(c), a, f, t) for s, bars in series.items() for i, (m, c, a, f, t) in enumerate(bars, 1)]
    return spark.createDataFrame(rows, "symbol string, rn long, open_time long, close double, action string, confidence double, trend string")


def positions(spark, series, rules):
    got = callback_positions(frame(spark, series), rules).orderBy("symbol", "trade").collect()
    return {s: [(r.side, r.entry_rn, r.exit_rn, r.exit_reason) for r in got if r.symbol == s] for s in series}


def bars(closes, actions=None, step=15, confidence=1.0, trends=None):
    return [(i * step, c, (actions or {}).get(i + 1), confidence, (trends or {}).get(i + 1, "NEUTRAL")) for i, c in enumerate(closes)]


def test_each_reason(spark):
    enter = {1: "EnterLong"}
    late = CvdMomentum().callbacks()
    series = {
        "stop": bars([100, 100, 96, 95, 90, 90], enter),
        "late": bars([100, 100, *[97.5] * 20, 97.9, 97.9], enter),
        "roi": bars([100, 100, 106, 106, 106, 106, 106, 106], enter),
        "fast": bars([100, 100, 111, 111], enter),
        "turn": bars([100, 100, 101, 101, 101], enter, trends={4: "BEARISH"}),
        "exit": bars([100, 100, 101, 101, 101], enter | {3: "ExitLong"}),
        "weak": bars([100, 100, 101], enter, confidence=0.5),
        "open": bars([100, 100, 101], enter),
        "end": bars([100, 100], {2: "EnterLong"}),
        "short": bars([100, 100, 104, 106, 106], {1: "EnterShort"}),
    }
    rules = Callbacks(late.min_confidence, late.stops, late.roi, late.reversal, "trend", "cvd_reversal", late.size)
    assert positions(spark, series, rules) == {
        "stop": [("BUY", 2, 5, "StopLoss")], "late": [("BUY", 2, 24, "StopLoss")], "roi": [("BUY", 2, 7, "Roi")], "fast": [("BUY", 2, 4, "Roi")], "turn": [("BUY", 2, 5, "cvd_reversal")],
        "exit": [("BUY", 2, 4, "Signal")], "weak": [], "open": [("BUY", 2, None, None)], "end": [], "short": [("SELL", 2, 5, "StopLoss")],
    }


@pytest.mark.parametrize("seed", range(3))
def test_random_series(spark, seed):
    rng, series = random.Random(seed), {}
    for s, n in (("a", 300), ("b", 2), ("c", 1), ("d", 60)):
        price, minute, out = 100.0, 0, []
        for _ in range(n):
            price = max(1.0, price * (1 + rng.gauss(0, 0.02)))
            minute += rng.choice([15, 15, 30, 240])
            out.append((minute, round(price, 2), rng.choice([None, None, "EnterLong", "EnterShort", "ExitLong", "ExitShort", "Neutral"]), rng.choice([None, 0.4, 0.9]), rng.choice([None, "NEUTRAL", "NEUTRAL", "BULLISH", "BEARISH"])))
        series[s] = out
    rules = [Callbacks(0.6, ((0, 0.05), (5, 0.02)), ((0, 0.06), (60, 0.03), (600, 0.0)), PLAIN.reversal), Callbacks(stops=((0, 0.03),)), PLAIN][seed]
    assert positions(spark, series, rules) == {s: walked(b, rules) for s, b in series.items()}


def test_money_of_callbacks(spark):
    series = {"a": bars([100, 100, 111, 111, 90], {1: "EnterLong", 4: "EnterShort"})}
    rules = Callbacks(roi=((0, 0.1),), size=0.5)
    first, second = backtest(frame(spark, series), BacktestConfig(fee_rate=0.0, funding_rate=0.0), rules=rules).orderBy("trade").collect()
    assert (first.entry_price, first.exit_price, first.exit_reason) == (100.0, 111.0, "Roi")
    assert first.profit == pytest.approx(10_000 * 0.5 * 0.11) and first.balance_after == pytest.approx(10_550)
    assert (second.side, second.exit_reason, second.profit) == ("SELL", "ForceExit", 0.0)

import numpy as np
import pytest

from tidebar.functions import indicators as I
from tidebar.operators.series import number_rows


def column(d, name):
    return [r[name] for r in d.orderBy("symbol", "rn").collect()]


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return (100 + np.cumsum(rng.normal(0, 1, n))).round(2).tolist()


def ema(x, p, a):
    y, out = None, []
    for i, v in enumerate(x):
        if i == p - 1:
            y = sum(x[:p]) / p
        elif i >= p:
            y += a * (v - y)
        out.append(y)
    return out


def test_sma(closes):
    assert column(I.sma(number_rows(closes([10, 20, 30, 40, 50])), 3), "sma") == [None, None, 20, 30, 40]


def test_ema_seed(closes):
    assert column(I.ema(number_rows(closes([100, 110, 120, 130])), 3), "ema") == pytest.approx([None, None, 110, 120])


@pytest.mark.parametrize("period", [1, 2, 3, 14, 200])
def test_ema_against_a_loop(closes, period):
    x = walk(700)
    got = column(I.ema(number_rows(closes(x)), period), "ema")
    want = ema(x, period, 2 / (period + 1))
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-12)


def test_macd_against_a_loop(closes):
    x = walk(120)
    fast, slow = ema(x, 12, 2 / 13), ema(x, 26, 2 / 27)
    line = [a - b for a, b in zip(fast[25:], slow[25:])]
    signal = ema(line, 9, 0.2)
    d = I.macd(number_rows(closes(x)))
    assert column(d, "macd")[25:] == pytest.approx(line)
    assert column(d, "macd_signal")[33:] == pytest.approx(signal[8:])
    assert column(d, "macd_signal")[:33] == [None] * 33


@pytest.mark.parametrize(("values", "want"), [(range(1, 20), 99.9), ([5] * 19, 50.0), (range(19, 0, -1), 0.0)])
def test_rsi_edges(closes, values, want):
    got = column(I.rsi(number_rows(closes(list(values)))), "rsi")
    assert got[:14] == [None] * 14
    assert got[14:] == pytest.approx([want] * 5)


def test_obv(closes):
    assert column(I.obv(number_rows(closes([1, 2, 2, 1]))), "obv") == [0, 100, 100, 0]


def test_atr_needs_a_previous_close(bars):
    d = number_rows(bars([("A", 10, 12, 9, 11, 1, 1), ("A", 11, 15, 11, 14, 1, 1), ("A", 14, 14, 10, 10, 1, 1), ("A", 10, 11, 9, 10, 1, 1)]))
    assert column(I.true_range(d), "true_range") == [None, 4, 4, 2]
    assert column(I.atr(d, 2), "atr") == [None, None, 4, 3]


def test_bollinger_without_width(closes):
    d = I.bollinger(number_rows(closes([100] * 21)))
    assert column(d, "bb_pct_b")[18:] == [None, 0.5, 0.5]
    assert column(d, "bb_bandwidth")[18:] == [None, 0.0, 0.0]


def test_vwap_without_volume(bars):
    d = I.vwap(number_rows(bars([("A", 9, 12, 6, 9, 0, 0), ("A", 9, 12, 6, 12, 10, 5)])))
    assert column(d, "vwap") == [9, 10]


def test_cvd_trend(bars):
    d = number_rows(bars([("A", 1, 1, 1, 1, 100, 60)] * 10 + [("A", 1, 1, 1, 1, 100, 30)] * 10))
    got = column(I.cvd(d, 5), "cvd_trend")
    assert got[:4] == [None] * 4 and got[4] == "BULLISH" and got[-1] == "BEARISH"
    actions = column(I.trend_changes(I.cvd(d, 5)), "action")
    assert actions[4] == "EnterLong" and "EnterShort" in actions


@pytest.mark.parametrize("indicator", [lambda d: I.sma(d, 3, out="x"), lambda d: I.ema(d, 3, out="x"), lambda d: I.rsi(d, 3, "x"), lambda d: I.atr(d, 3, "x"), lambda d: I.obv(d, "x"), lambda d: I.vwap(d, "x"), lambda d: I.cvd(d, 3).withColumnRenamed("cvd_total", "x")])
def test_later_bars_change_nothing(closes, indicator):
    x = walk(40)
    before, after = column(indicator(number_rows(closes(x))), "x"), column(indicator(number_rows(closes([*x, 500.0]))), "x")
    assert before == pytest.approx(after[:-1])


def test_symbols_do_not_mix(bars):
    rows = [(s, c, c, c, c, 1, 1) for c in (1, 2, 3) for s in ("A", "B")]
    assert column(I.sma(number_rows(bars(rows)), 2), "sma") == [None, 1.5, 2.5, None, 1.5, 2.5]

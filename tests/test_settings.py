"""Settings from files, and the stack of protections that they name."""

import pytest

from tidebar import settings
from tidebar.plans.analytics import CooldownPeriod, Protection, StoplossGuard, protect
from tidebar.plans.simulation import BacktestConfig
from tidebar.plans.strategies import CvdMomentum

TEXT = """
symbol = "ETHUSDT"
later = true
[backtest]
fee_rate = 0.001
unknown = 3
[strategy]
window = 20
roi = [[0, 0.2], [30, 0.1]]
[[protections]]
name = "CooldownPeriod"
duration = 50
[[protections]]
name = "StoplossGuard"
max_stops = 2
duration = 100
"""


def test_file_and_defaults(tmp_path, monkeypatch):
    path = tmp_path / "run.toml"
    path.write_text(TEXT)
    s = settings.load(path)
    assert (s.symbol, s.interval, s.backtest, s.protections) == ("ETHUSDT", "15m", BacktestConfig(fee_rate=0.001), (CooldownPeriod(50), StoplossGuard(2, 100)))
    assert s.strategy == CvdMomentum(window=20, roi=((0, 0.2), (30, 0.1)))
    monkeypatch.delenv("CONFIG_FILE", raising=False)
    assert settings.from_environment() == settings.Settings()
    monkeypatch.setenv("CONFIG_FILE", str(path))
    assert settings.from_environment() == s
    path.write_text("[[")
    assert settings.from_environment() == settings.Settings()
    with pytest.raises(ValueError):
        settings.load(path)
    with pytest.raises(ValueError):
        settings.parse({"protections": [{"name": "Luck"}]})


def test_own_protections_and_order(spark):
    from pyspark.sql import functions as F

    class ManyTrades(Protection):
        def lock(self, now):
            return F.when(F.col("n") >= 3, F.struct(F.lit("ManyTrades").alias("reason"), F.lit(now + 1).cast("long").alias("until")))

    trades = spark.createDataFrame([("A", t, -1.0, "Stoploss") for t in (90, 95, 99)] + [("B", 10, 1.0, "Signal"), ("C", 97, 1.0, "Signal")], "symbol string, exit_time long, profit_pct double, exit_reason string")
    run = lambda *stack: {r.symbol: (r.reason, r.until) for r in protect(trades, 100, 50, stack).collect()}
    assert run(StoplossGuard(3, 7), CooldownPeriod(5)) == {"A": ("StoplossGuard", 107), "C": ("CooldownPeriod", 102)}
    assert run(CooldownPeriod(5), StoplossGuard(3, 7)) == {"A": ("CooldownPeriod", 104), "C": ("CooldownPeriod", 102)}
    assert run(ManyTrades()) == {"A": ("ManyTrades", 101)} and run() == {}

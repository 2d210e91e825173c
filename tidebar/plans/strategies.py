"""Signals from bars: a strategy is a function from numbered candles to columns action and confidence."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import orderflow as O
from ..operators.series import frames
from ..schemas import ACTIONS
from ..shared import cut


class Strategy(ABC):
    """Adds ``{name}_action`` and ``{name}_confidence`` to numbered candles; null where there is no signal."""

    name: str

    @abstractmethod
    def signals(self, d: DataFrame) -> DataFrame: ...

    def columns(self) -> tuple[str, str]:
        return f"{self.name}_action", f"{self.name}_confidence"


@dataclass(frozen=True)
class Callbacks:
    """What a strategy says about a position of its own, besides its signals.

    Entries below ``min_confidence`` are refused. ``stops`` has (bars held, loss)
    from which a loss ends the position, ``roi`` (minutes held, gain). ``reversal``
    has for values of the column ``trend`` the side that they end. ``size`` is the
    share of the balance that is put in, null for the backtest's.
    """

    min_confidence: float = 0.0
    stops: Sequence[tuple[int, float]] = ()
    roi: Sequence[tuple[int, float]] = ()
    reversal: Mapping[str, str] | None = None
    trend: str = "trend"
    reversal_reason: str = "reversal"
    size: float | None = None


def _put(d: DataFrame, s: Strategy, action: Column, confidence: Column, least: float) -> DataFrame:
    a, c = s.columns()
    fine = action.isNotNull() & (confidence >= least)
    return d.withColumns({a: F.when(fine, action), c: F.when(fine, confidence)})


@dataclass
class CvdMomentum(Strategy):
    """Follows the trend of cumulative volume delta; the confidence is its size a bar."""

    window: int = 15
    min_confidence: float = 0.6
    name: str = "cvd_momentum"
    stop_pct: float = 0.05
    late_stop_pct: float = 0.02
    late_after: int = 20
    size: float = 0.05
    #: (minutes, profit) of the return table.
    roi: tuple[tuple[int, float], ...] = ((0, 0.10), (60, 0.05), (120, 0.02))

    def signals(self, d: DataFrame) -> DataFrame:
        d = I.cvd(d, self.window)
        action = F.when(F.col("cvd_trend") == "BULLISH", "EnterLong").when(F.col("cvd_trend") == "BEARISH", "EnterShort")
        return _put(d, self, action, F.least(F.abs("cvd_total") / self.window, F.lit(1.0)), self.min_confidence)

    def exit_reason(self, side: Column, trend: Column) -> Column:
        against = ((side == "BUY") & (trend == "BEARISH")) | ((side == "SELL") & (trend == "BULLISH"))
        return F.when(against, "custom_exit:cvd_reversal")

    def adjusted_size(self, size: Column, pnl_pct: Column) -> Column:
        """Half as much again after a loss of more than 3 percent."""
        return F.when(pnl_pct < -0.03, size * 0.5)

    def stop(self, bars_held: Column) -> Column:
        return F.when(bars_held > self.late_after, self.late_stop_pct).otherwise(self.stop_pct)

    def callbacks(self) -> Callbacks:
        return Callbacks(self.min_confidence, ((0, self.stop_pct), (self.late_after + 1, self.late_stop_pct)), self.roi, {"BEARISH": "BUY", "BULLISH": "SELL"}, "cvd_trend", "cvd_reversal", self.size)


@dataclass
class OrderFlow(Strategy):
    """Scores the last divergence of the window, and imbalances and sweeps of the last three bars."""

    lookback: int = 10
    min_confidence: float = 0.5
    name: str = "orderflow"

    def signals(self, d: DataFrame) -> DataFrame:
        n = self.lookback
        d = O.delta_divergence(d, n)
        kind, _ = O.imbalance()
        d = d.withColumns({"_z": F.when(kind == "BuyImbalance", 1).when(kind == "SellImbalance", -1), "_s": F.transform(O.sweep_candidates(), lambda e: F.when(e["sweep_type"] == "BullishSweep", 1).otherwise(-1))})

        def over(w):
            last3 = w.rowsBetween(-2, 0)
            total = lambda c: F.coalesce(F.sum(c).over(last3), F.lit(0))
            return {
                "_div": F.last("divergence", True).over(w.rowsBetween(-(n - 1), 0)), "_zs": total("_z"), "_zn": F.count("_z").over(last3),
                "_ss": total(F.aggregate("_s", F.lit(0), lambda a, x: a + x)), "_sn": total(F.size("_s")),
            }

        d = frames(d, over, max(n - 1, 2))
        found = F.col("_zn") + F.col("_sn") + F.when(F.col("_div").isNotNull(), 1).otherwise(0)
        score = F.when(F.col("_div") == "Bullish", 2.0).when(F.col("_div") == "Bearish", -2.0).otherwise(0.0) + F.col("_zs") + 1.5 * F.col("_ss")
        ready = (F.col("rn") >= n + 2) & (found > 0)
        action = F.when(ready & (score > 0.5), "EnterLong").when(ready & (score < -0.5), "EnterShort")
        d = _put(d, self, action, F.when(found > 0, F.least(F.abs(score) / (found * 2.0), F.lit(1.0))), self.min_confidence)
        return d.drop("_z", "_s", "_div", "_zs", "_zn", "_ss", "_sn", "delta", "cumulative_delta", "price_change", "delta_change", "divergence")


@dataclass
class Composite(Strategy):
    """Weighted votes; a strategy without a signal gives half its weight to Neutral, the later action wins ties."""

    parts: Sequence[tuple[Strategy, float]] = ()
    min_confidence: float = 0.5
    name: str = "composite"

    def signals(self, d: DataFrame) -> DataFrame:
        if not self.parts:
            return d.withColumns(dict(zip(self.columns(), (F.lit(None).cast("string"), F.lit(None).cast("double")))))
        for s, _ in self.parts:
            d = cut(s.signals(d))  # else the votes repeat each strategy's expressions

        def votes(action: str) -> Column:
            total = F.lit(0.0)
            for s, weight in self.parts:
                a, c = (F.col(x) for x in s.columns())
                total = total + F.when(a == action, weight * c).when(a.isNull() & F.lit(action == "Neutral"), weight * 0.5).otherwise(0.0)
            return total

        each = [votes(a) for a in ACTIONS]
        best = F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(i).alias("i")) for i, v in enumerate(each))))
        total = sum(each[1:], each[0])
        action = F.element_at(F.array(*map(F.lit, ACTIONS)), best["i"] + 1)
        fine = (total > 0) & (best["i"] > 0)
        return _put(d, self, F.when(fine, action), F.when(total > 0, best["v"] / total), self.min_confidence)


def linear_scores(features: Column, weights: Sequence[Sequence[float]]) -> Column:
    """One dot product for each action."""
    rows = [F.aggregate(F.zip_with(features, F.array(*map(F.lit, map(float, w))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for w in weights]
    return F.array(*rows)


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def predict(d: DataFrame, features: Column, weights: Sequence[Sequence[float]]) -> DataFrame:
    """Action of a linear table model, the first of the best, and its probability."""
    d = d.withColumn("_s", linear_scores(features, weights)).withColumn("_p", softmax(F.col("_s")))
    at = F.array_position("_s", F.array_max("_s")).cast("int")
    return d.withColumns({"action": F.element_at(F.array(*map(F.lit, ACTIONS)), at), "confidence": F.element_at("_p", at)}).drop("_s", "_p")


@dataclass
class TableModelStrategy(Strategy):
    """A linear model over features that the rows already carry."""

    weights: Sequence[Sequence[float]] = ()
    features: Sequence[str] = ()
    min_confidence: float = 0.0
    name: str = "ai"

    def signals(self, d: DataFrame) -> DataFrame:
        d = predict(d, F.array(*(F.col(n).cast("double") for n in self.features)), self.weights)
        out = _put(d.withColumnsRenamed({"action": "_a", "confidence": "_c"}), self, F.when(F.col("_a") != "Neutral", F.col("_a")), F.col("_c"), self.min_confidence)
        return out.drop("_a", "_c")


def as_signals(d: DataFrame, s: Strategy) -> DataFrame:
    """Rows of the signal table."""
    a, c = s.columns()
    d = d.where(F.col(a).isNotNull())
    return d.select(F.col("close_time").alias("timestamp"), "symbol", F.col(a).alias("action"), F.col(c).alias("confidence"), F.lit(s.name).alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))

"""Indicators over closed bars.

Each takes numbered candles (``series.number_rows``) and adds columns; a row sees
itself and rows before it only. Rows of the warm-up are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import frames, recurrence, running
from ..shared import cut

def _rn() -> Column:
    return F.col("rn")


def _over(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def previous(d: DataFrame, column: str = "close", out: str = "prev", n: int = 1) -> DataFrame:
    return frames(d, lambda w: {out: F.lag(column, n).over(w)}, n)


def sma(d: DataFrame, period: int, column: str = "close", out: str = "sma") -> DataFrame:
    return frames(d, lambda w: {out: F.when(_rn() >= period, F.avg(column).over(_over(w, period)))}, period - 1)


def volume_sma(d: DataFrame, period: int = 20, out: str = "volume_sma") -> DataFrame:
    """As many rows as there are until the period is full."""
    return frames(d, lambda w: {out: F.avg("volume").over(_over(w, period))}, period - 1)


def smoothed(d: DataFrame, specs: dict[str, tuple[str, int, float, int]]) -> DataFrame:
    """Averages y = y + weight (x - y), each (column, period, weight, first row): the seed is the mean of the first ``period`` values."""
    back = max(p for _, p, _, _ in specs.values()) - 1
    means = frames(d, lambda w: {f"_m_{n}": F.avg(c).over(_over(w, p)) for n, (c, p, _, _) in specs.items()}, back)
    start = {n: first + p - 1 for n, (_, p, _, first) in specs.items()}
    x = {n: (1 - a, F.when(start[n] == _rn(), F.col(f"_m_{n}")).when(start[n] < _rn(), a * F.col(c))) for n, (c, _, a, _) in specs.items()}
    out = recurrence(means, x)
    return out.withColumns({n: F.when(_rn() >= s, F.col(n)) for n, s in start.items()}).drop(*(f"_m_{n}" for n in specs))


def ema(d: DataFrame, period: int, column: str = "close", out: str = "ema") -> DataFrame:
    if period == 1:
        return d.withColumn(out, F.col(column).cast("double"))
    return smoothed(d, {out: (column, period, 2 / (period + 1), 1)})


def macd(d: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal, macd_histogram."""
    if slow < fast:
        raise ValueError("slow must not be below fast")
    d = smoothed(d, {"_fast": ("close", fast, 2 / (fast + 1), 1), "_slow": ("close", slow, 2 / (slow + 1), 1)})
    d = cut(d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"))
    d = smoothed(d, {"macd_signal": ("macd", signal, 2 / (signal + 1), slow)})
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def rsi(d: DataFrame, period: int = 14, out: str = "rsi") -> DataFrame:
    """Wilder's; without losses 99.9, without any change 50."""
    d = previous(d, out="_p")
    change = F.col("close") - F.col("_p")
    d = d.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))})
    d = smoothed(d, {"_g": ("_up", period, 1 / period, 2), "_l": ("_down", period, 1 / period, 2)})
    rs = F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).when(F.col("_g") > 0, F.lit(999.0)).otherwise(F.lit(1.0))
    return d.withColumn(out, F.when(_rn() > period, 100 - 100 / (1 + rs))).drop("_p", "_up", "_down", "_g", "_l")


def true_range(d: DataFrame, out: str = "true_range") -> DataFrame:
    """Null on the first row."""
    d = previous(d, out="_p")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_p")), F.abs(F.col("low") - F.col("_p")))
    return d.withColumn(out, F.when(F.col("_p").isNotNull(), tr)).drop("_p")


def atr(d: DataFrame, period: int = 14, out: str = "atr") -> DataFrame:
    return smoothed(true_range(d, "_tr"), {out: ("_tr", period, 1 / period, 2)}).drop("_tr")


def simple_atr(d: DataFrame, period: int = 14, out: str = "simple_atr") -> DataFrame:
    """Plain mean of the last true ranges, as used by stops; needs period + 1 rows."""
    d = true_range(d, "_tr")
    return frames(d, lambda w: {out: F.when(period < _rn(), F.avg("_tr").over(_over(w, period)))}, period - 1).drop("_tr")


def bollinger(d: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """bb_middle, bb_upper, bb_lower, bb_pct_b (0.5 without width), bb_bandwidth (0 without a positive middle)."""
    d = frames(d, lambda w: {"bb_middle": F.when(_rn() >= period, F.avg("close").over(_over(w, period))), "_s": F.stddev_pop("close").over(_over(w, period))}, period - 1)
    d = d.withColumns({"bb_upper": F.col("bb_middle") + width * F.col("_s"), "bb_lower": F.col("bb_middle") - width * F.col("_s")})
    span = F.col("bb_upper") - F.col("bb_lower")
    known = F.col("bb_middle").isNotNull()
    pct = F.when(known & (span > 0), (F.col("close") - F.col("bb_lower")) / span).when(known, F.lit(0.5))
    return d.withColumns({"bb_pct_b": pct, "bb_bandwidth": F.when(F.col("bb_middle") > 0, span / F.col("bb_middle")).when(known, F.lit(0.0))}).drop("_s")


def obv(d: DataFrame, out: str = "obv") -> DataFrame:
    d = previous(d, out="_p")
    step = F.coalesce(F.signum(F.col("close") - F.col("_p")) * F.col("volume"), F.lit(0.0))
    return running(d, {out: ("sum", step)}).drop("_p")


def vwap(d: DataFrame, out: str = "vwap") -> DataFrame:
    """From the start of the series; the typical price while there is no volume."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = running(d, {"_pv": ("sum", typical * F.col("volume")), "_vol": ("sum", F.col("volume"))})
    return d.withColumn(out, F.when(F.col("_vol") > 0, F.col("_pv") / F.col("_vol")).otherwise(typical)).drop("_pv", "_vol")


def delta() -> Column:
    return F.col("taker_buy_volume") - F.col("taker_sell_volume")


def cvd(d: DataFrame, window: int = 15) -> DataFrame:
    """cvd_total over the last ``window`` rows and cvd_trend: both the sum and its second half up, or both down, else NEUTRAL."""
    half = window - 1 - window // 2
    d = d.withColumn("_d", delta())
    d = frames(d, lambda w: {"cvd_total": F.when(_rn() >= window, F.sum("_d").over(_over(w, window))), "_h": F.sum("_d").over(_over(w, half)) if half else F.lit(0.0)}, window - 1)
    t, h = F.col("cvd_total"), F.col("_h")
    trend = F.when((t > 0) & (h > 0), "BULLISH").when((t < 0) & (h < 0), "BEARISH").when(t.isNotNull(), "NEUTRAL")
    return d.withColumn("cvd_trend", trend).drop("_d", "_h")


def change_action(now: Column, before: Column) -> Column:
    """The action of a change from one trend to another: into a trend to enter, out of it to leave."""
    changed = now.isNotNull() & ~now.eqNullSafe(before)
    return (
        F.when(~changed, None).when(now == "BULLISH", "EnterLong").when(now == "BEARISH", "EnterShort")
        .when(before == "BULLISH", "ExitLong").when(before == "BEARISH", "ExitShort")
    )


def trend_changes(d: DataFrame) -> DataFrame:
    """The trend of the row before, and the action of a change of trend."""
    d = previous(d, "cvd_trend", "previous_trend")
    return d.withColumn("action", change_action(F.col("cvd_trend"), F.col("previous_trend")))


def or_zero(value: str) -> Column:
    """An indicator as a feature: 0 before its warm-up."""
    return F.coalesce(F.col(value), F.lit(0.0))

"""Feature rows: 22 features a bar, labels, normalisation, outliers, and leak-free merges across timeframes and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..operators import bars
from ..operators.asof import asof_join
from ..operators.series import frames, number_rows, running, tail
from ..shared import cut

#: Names of the features in their fixed order.
FEATURES = (
    "open_rel", "high_rel", "low_rel", "close_rel", "volume", "buy_sell_ratio", "cvd_delta", "cvd_cumulative", "price_change", "range_pct", "rsi_14",
    "ema_ratio", "macd_hist_norm", "bb_pct_b", "bb_bandwidth", "atr_norm", "obv_delta", "vwap_dev", "rsi_slope", "macd_signal_diff", "volume_sma_ratio", "close_vs_ema9",
)
PRICE_FEATURES = FEATURES[:4]


def _safe(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(otherwise)


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` as floating point has it, where Spark raises an error: over zero it is infinite, or not a number if ``a`` is neither above nor below zero."""
    inf = F.lit(float("inf"))
    over_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, inf).when(a < 0, -inf)
    return F.when(b == 0, over_zero).otherwise(a / b)


def feature_matrix(candles: DataFrame, cvd_window: int = 15, plain: bool = False) -> DataFrame:
    """symbol, timestamp (close of the bar), rn and the 22 features; an indicator before its warm-up counts as 0.

    Each bar's delta sum runs over its own last ``cvd_window`` bars, so later bars change nothing.
    A share of a price of zero is 0; with ``plain`` it is the quotient as it comes, infinite or not a number.
    """
    share = quotient if plain else _safe
    d = number_rows(candles)
    d = I.previous(d, out="_p")
    change, prev = F.col("close") - F.col("_p"), F.col("_p")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    d = d.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0)), "_tr": F.when(prev.isNotNull(), tr), "_d": I.delta()})
    d = cut(I.smoothed(d, {n: ("close", p, 2 / (p + 1), 1) for n, p in (("ema9", 9), ("ema21", 21), ("_e12", 12), ("_e26", 26))} | {n: (x, 14, 1 / 14, 2) for n, x in (("_g", "_up"), ("_l", "_down"), ("atr", "_tr"))}))
    rs = F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).when(F.col("_g") > 0, 999.0).otherwise(1.0)
    d = d.withColumns({"macd": F.col("_e12") - F.col("_e26"), "_rsi": F.when(F.col("rn") > 14, 1 - 1 / (1 + rs)).otherwise(0.0)})
    d = cut(I.smoothed(d, {"macd_signal": ("macd", 9, 0.2, 26)})).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    step = F.coalesce(F.signum(change) * F.col("volume"), F.lit(0.0))
    sums = {"_pv": ("sum", typical * F.col("volume")), "_vol": ("sum", F.col("volume")), "obv": ("sum", step), "_base": ("max", F.when(F.col("rn") == 1, F.col("open")))}
    d = running(d, sums).withColumn("vwap", F.when(F.col("_vol") > 0, F.col("_pv") / F.col("_vol")).otherwise(typical))
    d = I.volume_sma(I.bollinger(d))
    d = frames(d, lambda w: {"_cum": F.sum("_d").over(w.rowsBetween(-(cvd_window - 1), 0)), "_obv": F.lag("obv").over(w), "_rsi3": F.lag("_rsi", 3).over(w)}, max(cvd_window - 1, 3))
    c, close = F.col, F.col("close")
    rel = lambda x: quotient(c(x), c("_base"))
    values = [
        rel("open"), rel("high"), rel("low"), rel("close"), c("volume"), _safe(c("taker_buy_volume"), c("volume"), 0.5), c("_d"), c("_cum"), share(close - c("open"), c("open")), share(c("high") - c("low"), c("open")), c("_rsi"),
        _safe(I.or_zero("ema9"), I.or_zero("ema21"), 1.0), share(I.or_zero("macd_histogram"), close), I.or_zero("bb_pct_b"), I.or_zero("bb_bandwidth"), share(I.or_zero("atr"), close), _safe(c("obv") - F.coalesce(c("_obv"), c("obv")), c("volume")),
        share(close - c("vwap"), close), c("_rsi") - F.coalesce(c("_rsi3"), c("_rsi")), share(I.or_zero("macd") - I.or_zero("macd_signal"), close), _safe(c("volume"), c("volume_sma"), 1.0), share(close - I.or_zero("ema9"), close),
    ]
    return d.select("symbol", c("close_time").alias("timestamp"), "rn", *(v.alias(n) for n, v in zip(FEATURES, values)))


def last_window(candles: DataFrame, cvd_window: int = 15, plain: bool = False) -> DataFrame:
    """Only the last ``cvd_window`` bars of each symbol, the delta sum starting with the first of them."""
    d = tail(candles, cvd_window).select("symbol", F.col("close_time").alias("timestamp"), I.delta().alias("_d"))
    d = d.withColumn("_cum", F.sum("_d").over(W.partitionBy("symbol").orderBy("timestamp")))  # a few rows a symbol
    m = feature_matrix(candles, cvd_window, plain).join(d.select("symbol", "timestamp", "_cum"), ["symbol", "timestamp"])
    return m.withColumn("cvd_cumulative", F.col("_cum")).drop("_cum")


def drop_prices(d: DataFrame) -> DataFrame:
    return d.drop(*PRICE_FEATURES)


def as_array(d: DataFrame, names: Sequence[str] = FEATURES) -> Column:
    return F.array(*(F.col(n).cast("double") for n in names))


def labels(candles: DataFrame, horizon: int = 3) -> DataFrame:
    """1, -1 or 0 by the close ``horizon`` bars later; null at the end of the series."""
    d = number_rows(candles)
    d = frames(d, lambda w: {"_later": F.lead("close", horizon).over(w)}, ahead=horizon)
    return d.withColumn("label", F.signum(F.col("_later") - F.col("close"))).drop("_later")


def fit(d: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each feature."""
    return d.agg(*(F.avg(n).alias(f"{n}_mean") for n in names), *(F.stddev_pop(n).alias(f"{n}_std") for n in names))


EPSILON = 1e-8


def normalize(d: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x - mean) / deviation, the deviation at least ``EPSILON``. ``stats`` is one row."""
    d = d.crossJoin(F.broadcast(stats))
    return d.withColumns({n: (F.col(n) - F.col(f"{n}_mean")) / F.greatest(F.col(f"{n}_std"), F.lit(EPSILON)) for n in names}).drop(*stats.columns)


def denormalize(d: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    d = d.crossJoin(F.broadcast(stats))
    return d.withColumns({n: F.col(n) * F.greatest(F.col(f"{n}_std"), F.lit(EPSILON)) + F.col(f"{n}_mean") for n in names}).drop(*stats.columns)


def outliers(d: DataFrame, stats: DataFrame, names: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Mean absolute z-score; a feature without spread adds nothing but counts in the divisor."""
    d = d.crossJoin(F.broadcast(stats))
    z = [F.when(F.col(f"{n}_std") > 1e-15, F.abs((F.col(n) - F.col(f"{n}_mean")) / F.col(f"{n}_std"))).otherwise(0.0) for n in names]
    score = sum(z[1:], z[0]) / len(names)
    return d.withColumn("score", score).withColumn("is_outlier", F.col("score") > threshold).drop(*stats.columns)


def align_higher(base: DataFrame, higher: DataFrame, name: str = "higher") -> DataFrame:
    """Base bars with the latest higher-timeframe row that had closed when the bar opened."""
    return asof_join(base, higher, "open_time", "close_time", name=name)


def multi_timeframe(candles: DataFrame, intervals: dict[str, int], cvd_window: int = 15) -> DataFrame:
    """Feature rows of several timeframes, one under another."""
    parts = [feature_matrix(bars.resample(candles, ms), cvd_window).withColumn("timeframe", F.lit(name)) for name, ms in intervals.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concat_timeframes(base: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Base feature rows with, for each other timeframe, its latest row at that time."""
    for name, d in others.items():
        base = asof_join(base, d, "timestamp", "timestamp", name=name)
    return base


CROSS = ("price_ratio", "volume_ratio", "relative_strength", "spread", "corr_momentum")


def cross_pair(p: str, c: str, plain: bool = False) -> list[Column]:
    """Five figures of a primary bar ``p`` and a correlated bar ``c`` (structs); zeros where one is missing.

    Shares of a price of zero are 0, with ``plain`` quotients as they come.
    """
    f = lambda s, n: F.col(f"{s}.{n}")
    share = quotient if plain else lambda a, b: F.when(F.abs(b) > 1e-10, a / b).otherwise(0.0)
    change = lambda s: share(f(s, "close") - f(s, "open"), f(s, "open"))
    delta = lambda s: f(s, "taker_buy_volume") - f(s, "taker_sell_volume")
    price = f(p, "close")
    values = (
        share(f(c, "close"), price), f(c, "volume") / F.greatest(f(p, "volume"), F.lit(1e-10)), change(c) - change(p), share(price - f(c, "close"), price), delta(c) - delta(p),
    )
    known = F.col(p).isNotNull() & F.col(c).isNotNull()
    return [F.when(known, v).otherwise(0.0).alias(n) for n, v in zip(CROSS, values)]


def correlated(candles: DataFrame, primary: str, others: Sequence[str], interval: int, plain: bool = False) -> DataFrame:
    """For each bar of the primary symbol and each other symbol: the other's bar as of its close, five derived figures, and whether it is stale (older than two bars)."""
    if primary in others or len(set(others)) != len(others):
        raise ValueError("the other symbols must differ from the primary and from each other")
    left = candles.where(F.col("symbol") == primary).withColumn("pair", F.explode(F.array(*map(F.lit, others)))).withColumn("primary", F.struct(*candles.columns)).select("pair", "close_time", "primary")
    right = candles.where(F.col("symbol").isin(list(others))).withColumn("pair", F.col("symbol"))
    d = asof_join(left, right, "close_time", "close_time", keys=("pair",), name="other")
    age = F.col("close_time") - F.col("other.close_time")
    return d.select("pair", F.col("close_time").alias("timestamp"), F.col("other.close_time").alias("matched"), *cross_pair("primary", "other", plain), F.coalesce(age > 2 * interval, F.lit(False)).alias("stale"))


def merge_pairs(features: DataFrame, primary: str, others: Sequence[str], first: bool = False) -> DataFrame:
    """Feature rows of the primary symbol with those of each other symbol as of the same time, as structs named by symbol."""
    out = features.where(F.col("symbol") == primary)
    for other in others:
        right = features.where(F.col("symbol") == other).withColumn("symbol", F.lit(primary))
        out = asof_join(out, right, "timestamp", "timestamp", name=other, first=first)
    return out


def up_to(candles: DataFrame, end: int) -> DataFrame:
    """Bars that had closed by ``end``."""
    return candles.where(F.col("close_time") <= end)


def cumulative_volume(candles: DataFrame) -> DataFrame:
    return running(number_rows(candles), {"cumulative_volume": ("sum", F.col("volume"))})

"""Order-flow events over numbered candles, footprints and market profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import frames, islands, number_rows, running
from .indicators import delta

def index() -> Column:
    """Place of a row in its series, from 0."""
    return (F.col("rn") - 1).alias("index")


def delta_divergence(d: DataFrame, lookback: int = 5) -> DataFrame:
    """delta, cumulative_delta, and where price and cumulative delta went apart over ``lookback`` rows, divergence with both changes."""
    d = running(d.withColumn("delta", delta()), {"cumulative_delta": ("sum", F.col("delta"))})
    if lookback < 2:
        return d.withColumns({"price_change": F.lit(None).cast("double"), "delta_change": F.lit(None).cast("double"), "divergence": F.lit(None).cast("string")})
    d = frames(d, lambda w: {"price_change": F.col("close") - F.lag("close", lookback).over(w), "delta_change": F.col("cumulative_delta") - F.lag("cumulative_delta", lookback).over(w)}, lookback)
    p, c = F.col("price_change"), F.col("delta_change")
    return d.withColumn("divergence", F.when((p > 0) & (c < 0), "Bearish").when((p < 0) & (c > 0), "Bullish"))


def imbalance(ratio: float = 3.0) -> tuple[Column, Column]:
    """Type and ratio of a bar's imbalance: buying is tried first; a side without volume rules out only its own test."""
    b, s = F.col("taker_buy_volume"), F.col("taker_sell_volume")
    buy, sell = F.when(s > 0, b / s), F.when(b > 0, s / b)
    kind = F.when(buy >= ratio, "BuyImbalance").when(sell >= ratio, "SellImbalance")
    return kind, F.when(buy >= ratio, buy).when(sell >= ratio, sell)


def imbalances(d: DataFrame, ratio: float = 3.0) -> DataFrame:
    kind, value = imbalance(ratio)
    b, s = F.col("taker_buy_volume"), F.col("taker_sell_volume")
    return d.withColumns({"zone_type": kind, "ratio": value}).where(F.col("zone_type").isNotNull()).withColumns({"dominant_volume": F.greatest(b, s), "weak_volume": F.least(b, s)})


def stacked_imbalances(d: DataFrame, ratio: float = 3.0, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` consecutive bars with imbalances of one type."""
    runs = islands(imbalances(d, ratio).select("symbol", "rn", "zone_type"), ["zone_type"])
    return runs.where(F.col("count") >= least).select("symbol", (F.col("start_rn") - 1).alias("start_index"), "count", "zone_type")


def sweep_candidates(min_ratio: float = 2.0, min_pct: float = 0.001) -> Column:
    """Up to two sweeps of a bar, bearish first; a bar without a body has a tiny one."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    body, middle = top - bottom, (F.col("high") + F.col("low")) / 2
    divisor = F.when(body > 0, body).otherwise(F.lit(1e-10))

    def event(kind: str, wick: Column) -> Column:
        fits = (middle != 0) & (wick / middle >= min_pct) & (wick / divisor >= min_ratio)
        return F.when(fits, F.struct(F.lit(kind).alias("sweep_type"), wick.alias("wick_size"), body.alias("body_size"), (wick / divisor).alias("wick_ratio")))

    return F.array_compact(F.array(event("BearishSweep", F.col("high") - top), event("BullishSweep", bottom - F.col("low"))))


def sweeps(d: DataFrame, min_ratio: float = 2.0, min_pct: float = 0.001) -> DataFrame:
    return d.withColumn("_e", F.explode(sweep_candidates(min_ratio, min_pct))).select(*d.columns, "_e.*")


def absorption(d: DataFrame, least: float = 10.0, max_range: float = 0.002, multiple: float = 2.0, causal: bool = True) -> DataFrame:
    """Bars with much volume and little range. The mean volume is that of the rows so far; of the whole series if not ``causal``."""
    if causal:
        d = running(d, {"_sum": ("sum", F.col("volume"))}).withColumn("_mean", F.col("_sum") / F.col("rn")).drop("_sum")
    else:
        d = d.join(d.groupBy("symbol").agg(F.avg("volume").alias("_mean")), "symbol")
    span = F.col("high") - F.col("low")
    d = d.where((F.col("volume") >= least) & (F.col("volume") >= multiple * F.col("_mean")) & (F.col("open") > 0))
    d = d.where(F.when(F.col("open") > 0, span / F.col("open")) <= max_range).drop("_mean")
    return d.withColumns({"absorbed_side": F.when(delta() > 0, "BUY").otherwise("SELL"), "price_range": span, "absorption_strength": F.when(span > 0, F.col("volume") / span).otherwise(F.col("volume"))})


def footprint(ticks: DataFrame, interval: int, tick_size: float) -> DataFrame:
    """Volume by bar and price level: bid (sold), ask (bought), their difference; a tick size of 0 keeps exact prices."""
    level = F.floor(F.col("price") / tick_size) * tick_size if tick_size else F.col("price")
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("quantity")).otherwise(0.0))
    bar = (F.floor(F.col("timestamp") / interval) * interval).cast("long").alias("open_time")
    d = ticks.groupBy("symbol", bar, level.alias("price_level")).agg(of("SELL").alias("bid_volume"), of("BUY").alias("ask_volume"))
    return d.withColumn("delta", F.col("ask_volume") - F.col("bid_volume"))


#: Shares of volume are added up exactly, so that what begins and what ends cancel out.
SHARE = "decimal(30,12)"


def profile_levels(candles: DataFrame, tick_size: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Each bar's volume spread evenly over the levels it touches: touches and volume by level.

    Levels are whole numbers of ticks. A bar gives two marks, its share where it
    begins and the same taken away above where it ends, whatever its height; a
    running sum over the marks has the profile, and only its own levels are made.
    """
    c = F.col
    low, high = F.floor(c("low") / tick_size).cast("long"), F.floor(c("high") / tick_size).cast("long")
    d = candles.where(F.lit(tick_size > 0)).select(*keys, low.alias("lo"), high.alias("hi"), (c("volume") / (high - low + 1)).cast(SHARE).alias("v"))
    mark = lambda level, sign: F.struct(level.alias("level"), F.lit(sign).alias("n"), (sign * c("v")).cast(SHARE).alias("v"))
    marks = d.select(*keys, F.explode(F.array(mark(c("lo"), 1), mark(c("hi") + 1, -1))).alias("m"))
    marks = marks.groupBy(*keys, "m.level").agg(F.sum("m.n").alias("_n"), F.sum("m.v").cast(SHARE).alias("_v"))
    x = running(number_rows(marks, "level", keys, span=4096), {"n": ("sum", c("_n")), "v": ("sum", c("_v"))}, keys)
    x = frames(x, lambda w: {"_next": F.lead("level").over(w)}, ahead=1, keys=keys).where("n > 0")
    levels = x.select(*keys, F.explode(F.sequence("level", c("_next") - 1)).alias("level"), "n", "v")
    return levels.select(*keys, "level", (c("level") * tick_size).alias("price"), c("n").alias("tpo_count"), c("v").cast("double").alias("volume"))


def point_of_control(levels: DataFrame, keys: tuple[str, ...] = ("symbol",), digits: int = 9) -> DataFrame:
    """The level with most volume, the highest on ties (equal to ``digits`` places), and the total."""
    return levels.groupBy(*keys).agg(F.max_by("price", F.struct(F.round("volume", digits), F.col("level"))).alias("poc"), F.sum("volume").alias("total_volume"), F.count("*").alias("levels"))


def value_area(levels: DataFrame, share: float = 0.7, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The levels around the point of control that hold ``share`` of the volume, taken one at a time, upward on ties.

    A profile has at most one row a price level, which is what a task holds.
    """
    import pandas as pd

    schema = T.StructType([*[f for f in levels.schema if f.name in keys], *[T.StructField(n, T.DoubleType()) for n in ("poc", "vah", "val", "total_volume")]])

    def area(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("level")
        v, price = p["volume"].round(9).to_numpy(), p["price"].to_numpy()
        at = len(v) - 1 - int(v[::-1].argmax())
        up = low = at
        held, target = v[at], v.sum() * share
        while held < target - 1e-9 and (low > 0 or up + 1 < len(v)):
            above, below = (v[up + 1] if up + 1 < len(v) else -1.0), (v[low - 1] if low > 0 else -1.0)
            if above >= below:
                up, held = up + 1, held + above
            else:
                low, held = low - 1, held + below
        return pd.DataFrame([[*(p[k].iloc[0] for k in keys), price[at], price[up], price[low], v.sum()]], columns=schema.names)

    return levels.select(*keys, "level", "price", "volume").groupBy(*keys).applyInPandas(area, schema)

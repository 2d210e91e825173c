"""From ticks to bars, and from bars to longer bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CANDLE
from .series import KEYS, number_rows

FIELDS = [f.name for f in CANDLE]


def aggregate_ticks(ticks: DataFrame, interval: int, tie: str | None = None) -> DataFrame:
    """Bars from ticks: one for each interval that has any; partial sums are combined before the shuffle."""
    bucket = F.floor(F.col("timestamp") / interval)
    order = F.struct("timestamp", *([tie] if tie else []))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("quantity")).otherwise(0.0))
    d = ticks.groupBy("symbol", bucket.alias("_b")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"), F.count("*").alias("trades"), of("BUY").alias("taker_buy_volume"), of("SELL").alias("taker_sell_volume"),
    )
    return d.withColumns({"open_time": (F.col("_b") * interval).cast("long"), "close_time": ((F.col("_b") + 1) * interval - 1).cast("long")}).select(FIELDS)


def _merge(candles: DataFrame, group: Column, keys: Sequence[str]) -> DataFrame:
    totals = [F.sum(c).alias(c) for c in ("volume", "quote_volume", "trades", "taker_buy_volume", "taker_sell_volume")]
    d = candles.groupBy(*keys, group.alias("_g")).agg(
        F.min("open_time").alias("open_time"), F.max_by("close_time", "open_time").alias("close_time"), F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), *totals
    )
    return d.select(FIELDS)


def resample(candles: DataFrame, interval: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Longer bars; the open time is that of the first child, and the last bar may be partial."""
    return _merge(candles, F.floor(F.col("open_time") / interval), keys)


def resample_every(candles: DataFrame, factor: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """A bar for every ``factor`` rows of a series; the last may be short. None for a factor below 1."""
    if factor < 1:
        return candles.select(FIELDS).limit(0)
    if factor == 1:
        return candles.select(FIELDS)
    d = number_rows(candles, "open_time", keys)
    return _merge(d, F.floor((F.col("rn") - 1) / factor), keys)

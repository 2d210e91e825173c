"""Forced liquidations by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TIERS


def tier(usd: Column) -> Column:
    """Small, Medium, Large or Massive; null below the smallest."""
    out = F.lit(None).cast("string")
    for name, least in TIERS:
        out = F.when(usd >= least, F.lit(name)).otherwise(out)
    return out


def _sums(long: Column, usd: Column, prefix: str = "") -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.count_if(long).alias(f"{prefix}long_count"), F.count_if(~long).alias(f"{prefix}short_count"),
        zero(F.sum(F.when(long, usd))).alias(f"{prefix}long_value"), zero(F.sum(F.when(~long, usd))).alias(f"{prefix}short_value"),
    ]


def summary(liquidations: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts and values of longs (sold out) and shorts, and which side has more than twice the other's."""
    usd, long = F.col("price") * F.col("quantity"), F.lower("side") == "sell"
    d = liquidations.groupBy(*keys).agg(*_sums(long, usd))
    a, b = F.col("long_value"), F.col("short_value")
    return d.withColumn("bias", F.when(a > 2 * b, "LONGS_LIQUIDATED").when(b > 2 * a, "SHORTS_LIQUIDATED").otherwise("BALANCED"))


def by_tier(liquidations: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The same by size class, all four classes for each key."""
    usd, long = F.col("price") * F.col("quantity"), F.lower("side") == "sell"
    d = liquidations.groupBy(*keys, tier(usd).alias("tier")).agg(*_sums(long, usd))
    every = liquidations.select(*keys).distinct().withColumn("tier", F.explode(F.array(*(F.lit(n) for n, _ in TIERS))))
    return every.join(d, [*keys, "tier"], "left").na.fill(0, ["long_count", "short_count", "long_value", "short_value"])

"""Domain tables from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bars
from .shipping import ship

M15 = 900_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def millis(time: str) -> Column:
    return F.unix_millis(F.col(time).cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades of five symbols."""
    d = table(spark, sf_dir, "events")
    return d.select(
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"),
        F.when(F.col("event_type").isin("purchase", "click"), "BUY").otherwise("SELL").alias("side"), millis("ts").alias("timestamp"), (F.col("event_type") == "error").alias("is_liquidation"), "event_id",
    )


def candles(spark: SparkSession, sf_dir: str, interval: int = M15) -> DataFrame:
    d = bars.aggregate_ticks(ticks(spark, sf_dir), interval, "event_id")
    return d.withColumn("quote_volume", F.round("quote_volume", 2))


def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ticks(spark, sf_dir).where("is_liquidation")
    return d.select("symbol", "side", F.round(F.col("price") * 100).alias("price"), "quantity", F.col("timestamp").alias("time"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades. Profits are whole cents, so their sums are exact whatever the order."""
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    d = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    profit = F.floor(cents("l_extendedprice") * (100 - cents("l_discount")) / 100).cast("long") - F.col("l_quantity").cast("long") * cents("p_retailprice")
    cost = F.col("l_quantity").cast("long") * cents("p_retailprice")
    a, b = millis("o_orderdate"), millis("l_shipdate")
    return d.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("p_brand").alias("symbol"), F.col("l_returnflag").alias("strategy"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        (F.col("p_retailprice")).alias("entry_price"), F.col("l_quantity").alias("quantity"), (profit / 100.0).alias("profit"), (profit * 100.0 / cost).alias("profit_pct"), profit.alias("profit_cents"),
        F.least(a, b).alias("entry_time"), F.greatest(a, b).alias("exit_time"), F.floor(F.abs(a - b) / M15).cast("long").alias("duration_candles"), (1 + F.col("l_linenumber") % 3).cast("int").alias("leverage"), F.lit("Signal").alias("exit_reason"),
    )


def rounded(value: Column | str, digits: int = 6) -> Column:
    """A double rounded by its own value, halves away from zero; ``F.round`` rounds its shortest decimal, which may lie on a half that the value misses."""
    y = (F.col(value) if isinstance(value, str) else value) * 10.0**digits
    size = F.abs(y)
    low = F.floor(size).cast("double")
    whole = F.signum(y) * F.when(size - low >= 0.5, low + 1).otherwise(low)
    return F.when(size < 2.0**52, whole).otherwise(y) / 10.0**digits

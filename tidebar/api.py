"""What the serving layer asks for, as functions that return DataFrames; no server is built here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import analytics, store
from .schemas import ACTIONS, INTERVALS


def history(trades: DataFrame, since: int | None = None, until: int | None = None, symbol: str | None = None) -> DataFrame:
    return store.trade_history(trades, since, until, symbol)


performance = analytics.summarize
daily = analytics.daily_performance
audit = store.audit_log
orders = store.orders_by_status


def profit(positions: DataFrame) -> DataFrame:
    return positions.agg(F.coalesce(F.sum("unrealized_pnl"), F.lit(0.0)).alias("unrealized_pnl"), F.count("*").alias("positions"))


def inject_signal(text: str) -> str:
    """Action of a name in snake case; Neutral if it isn't known."""
    name = "".join(p.title() for p in text.strip().split("_"))
    return name if name in ACTIONS else "Neutral"


def timeframes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in INTERVALS.items()], "timeframe string, milliseconds long")


SECRETS = ("key", "secret", "token", "password")


def redacted(config: dict) -> dict:
    """A configuration without its secrets."""
    return {k: redacted(v) if isinstance(v, dict) else "***" if any(s in k.lower() for s in SECRETS) and v else v for k, v in config.items()}


def pascal_case(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.replace("-", "_").split("_") if p)

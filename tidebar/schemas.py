"""Schemas of the domain tables and the values of their enumerations.

Prices and volumes are DOUBLE inside the engine; files carry them as decimal
strings. Times are epoch milliseconds. ``symbol`` is never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "m": T.MapType(T.StringType(), T.StringType()), "a": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


CANDLE = _struct("symbol:s open_time:l close_time:l open:d high:d low:d close:d volume:d quote_volume:d trades:l taker_buy_volume:d taker_sell_volume:d")
TICK = _struct("symbol:s price:d quantity:d side:s timestamp:l is_liquidation:b")
LIQUIDATION = _struct("symbol:s side:s price:d quantity:d time:l")
ORDER = _struct("id:s symbol:s side:s order_type:s quantity:d price:d stop_price:d trailing_delta:d time_in_force:s reduce_only:b status:s created_at:l updated_at:l")
POSITION = _struct("symbol:s side:s entry_price:d quantity:d unrealized_pnl:d realized_pnl:d leverage:i opened_at:l")
TRADE = _struct("id:s symbol:s side:s entry_price:d exit_price:d quantity:d profit:d profit_pct:d entry_time:l exit_time:l duration_candles:l exit_reason:s leverage:i fee:d")
SIGNAL = _struct("timestamp:l symbol:s action:s confidence:d source:s metadata:m")
FEATURE_ROW = _struct("symbol:s timestamp:l features:a label:d")
AUDIT = _struct("id:l timestamp:l action:s actor:s details:s ip_address:s created_at:l")
DEAD_LETTER = _struct("id:l timestamp:l topic:s payload_json:s error:s retry_count:l max_retries:l next_retry_at:l resolved:l created_at:l")
PAIR_LOCK = _struct("symbol:s until:l reason:s")
#: Files of candles: decimals are strings.
CANDLE_FILE = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DoubleType) else f.dataType) for f in CANDLE if f.name != "symbol"])

ACTIONS = ("Neutral", "EnterLong", "ExitLong", "EnterShort", "ExitShort")
SIDES = ("BUY", "SELL")
ORDER_TYPES = ("Market", "Limit", "StopMarket", "StopLimit", "TakeProfitMarket", "TakeProfitLimit", "TrailingStopMarket")
ORDER_STATUSES = ("Pending", "Submitted", "PartiallyFilled", "Filled", "Cancelled", "Rejected", "Expired")
TIMES_IN_FORCE = ("GTC", "IOC", "FOK", "GTX")
EXIT_REASONS = ("Signal", "Stoploss", "TrailingStop", "TakeProfit", "Roi", "ForceExit", "Liquidation", "Emergency")
MARGIN_MODES = ("Isolated", "Cross")

#: Liquidation sizes in USD, smallest first (fixed values).
TIERS = (("Small", 1_000), ("Medium", 10_000), ("Large", 30_000), ("Massive", 100_000))

#: Bar lengths in milliseconds (fixed values).
INTERVALS = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "12h": 43_200_000, "1d": 86_400_000, "1w": 604_800_000}
DEFAULT_INTERVAL = 900_000


def interval_ms(label: str) -> int:
    """Milliseconds of a bar length; 15 minutes for a label that isn't known."""
    return INTERVALS.get(label, DEFAULT_INTERVAL)


def interval_ms_column(label: Column) -> Column:
    pairs = [x for k, v in INTERVALS.items() for x in (F.lit(k), F.lit(v).cast("long"))]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit(DEFAULT_INTERVAL).cast("long"))


def steps_per_year(interval: int) -> float:
    """Bars in a year of 365.25 days."""
    return 365.25 * 86_400_000 / interval


def parsed(value: Column, known: tuple[str, ...], default: str | None) -> Column:
    """The known spelling of a value, whatever its case; ``default`` for others."""
    found = F.lit(default)
    for name in known:
        found = F.when(F.lower(value) == name.lower(), F.lit(name)).otherwise(found)
    return found


def action_of(index: Column) -> Column:
    """Action of an index; Neutral outside 0 to 4."""
    return F.when(index.between(0, 4), F.element_at(F.array(*map(F.lit, ACTIONS)), index.cast("int") + 1)).otherwise(F.lit("Neutral"))


def valid_symbol(symbol: Column, most: int = 16) -> Column:
    return F.length(symbol).between(1, most)

"""Candle files, exchange payloads and stream messages as domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CANDLE, CANDLE_FILE, interval_ms

FIELDS = [f.name for f in CANDLE]


def load_candles(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A JSON array of candles with decimals as text; malformed files are an error. The symbol isn't in the file."""
    d = spark.read.schema(CANDLE_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return typed(d.withColumn("symbol", F.lit(symbol)))


def typed(d: DataFrame) -> DataFrame:
    return d.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDLE))


def load_pairs(spark: SparkSession, spec: str) -> DataFrame | None:
    """Candles of "SYMBOL:path,..."; entries without both parts are left out, None if nothing is left."""
    found = None
    for part in spec.split(","):
        symbol, _, path = part.strip().partition(":")
        if symbol and path:
            d = load_candles(spark, path, symbol)
            found = d if found is None else found.unionByName(d)
    return found


def parse_kline(symbol: Column, payload: Column, interval: str | None = None) -> Column:
    """A candle from an array of twelve values, which has its own close time; the volume that takers didn't buy was sold by them. Null if a value is missing or malformed."""
    a = F.from_json(payload, "array<string>")
    at = lambda i, kind: F.try_element_at(a, F.lit(i + 1)).try_cast(kind)
    volume, bought = at(5, "double"), at(9, "double")
    values = [symbol, at(0, "long"), at(6, "long"), *(at(i, "double") for i in (1, 2, 3, 4)), volume, at(7, "double"), at(8, "long"), bought, volume - bought]
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull()
    return F.when(whole, F.struct(*(v.alias(n) for v, n in zip(values, FIELDS))))


def parse_second_kline(symbol: Column, payload: Column, interval: str) -> Column:
    """The other exchange's array of seven values, without trades and takers; the close time follows from the interval (1 minute if unknown)."""
    step = interval_ms(interval) if interval in SECOND_INTERVALS else 60_000
    a = F.from_json(payload, "array<string>")
    at = lambda i, kind: F.try_element_at(a, F.lit(i + 1)).try_cast(kind)
    start = at(0, "long")
    values = [symbol, start, start + step - 1, *(at(i, "double") for i in (1, 2, 3, 4)), at(5, "double"), at(6, "double"), F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)]
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull()
    return F.when(whole, F.struct(*(v.alias(n) for v, n in zip(values, FIELDS))))


#: Labels of the other exchange (fixed values).
SECOND_INTERVALS = {"1m": "1", "3m": "3", "5m": "5", "15m": "15", "30m": "30", "1h": "60", "2h": "120", "4h": "240", "6h": "360", "12h": "720", "1d": "D", "1w": "W"}


def _fields(message: Column, path: str) -> Callable[[str, str], Column]:
    """Values of an object inside a message, by name; names that differ by case only are told apart, as map keys are."""
    found = F.from_json(F.get_json_object(message, path), "map<string,string>")
    return lambda name, kind: F.try_element_at(found, F.lit(name)).try_cast(kind)


def _whole(values: dict[str, Column], where: Column | None = None) -> Column:
    """A struct of the values, null if one of them is."""
    fine = F.lit(True) if where is None else where
    for v in values.values():
        fine = fine & v.isNotNull()
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(*(v.alias(n) for n, v in values.items())))


def parse_trade(message: Column) -> Column:
    """A tick from an aggregated-trade message; a buyer that made the price means that the taker sold. Null if malformed."""
    at = _fields(message, "$.data")
    side = F.when(at("m", "boolean"), "SELL").when(~at("m", "boolean"), "BUY")
    return _whole({"symbol": at("s", "string"), "price": at("p", "double"), "quantity": at("q", "double"), "side": side, "timestamp": at("T", "bigint"), "is_liquidation": F.lit(False)})


def parse_force_order(message: Column) -> Column:
    at = _fields(message, "$.data.o")
    return _whole({"symbol": at("s", "string"), "side": at("S", "string"), "price": at("p", "double"), "quantity": at("q", "double"), "time": at("T", "bigint")})


def parse_kline_event(message: Column) -> Column:
    """A candle from a kline message, only once it is closed."""
    at = _fields(message, "$.data.k")
    d = lambda n: at(n, "double")
    values = [at("s", "string"), at("t", "bigint"), at("T", "bigint"), d("o"), d("h"), d("l"), d("c"), d("v"), d("q"), at("n", "bigint"), d("V"), d("v") - d("V")]
    return _whole(dict(zip(FIELDS, values)), at("x", "boolean"))


def parsed_or_dead(d: DataFrame, message: str, parse: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of the messages that parse, and the messages that don't."""
    p = d.withColumn("_row", parse(F.col(message)))
    return p.where("_row IS NOT NULL").select("_row.*"), p.where("_row IS NULL").drop("_row")


def topic(domain: str, symbol: Column, timeframe: str | None = None, prefix: str = "market") -> Column:
    """prefix.domain.symbol[.timeframe], the symbol in small letters."""
    parts = [F.lit(prefix), F.lit(domain), F.lower(symbol)]
    return F.concat_ws(".", *parts, *([F.lit(timeframe)] if timeframe else []))


READERS = {"binance": parse_kline, "bybit": parse_second_kline}


def reader(name: str) -> Callable[[Column, Column, str], Column]:
    """How an exchange's candles are read: a function of symbol, payload and interval."""
    if name not in READERS:
        raise ValueError(f"no reader for {name}")
    return READERS[name]

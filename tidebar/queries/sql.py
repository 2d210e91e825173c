"""The domain tables in DuckDB's SQL, for the oracles."""

TICKS = """ticks AS (
  SELECT 'S' || CAST(user_id % 5 AS VARCHAR) AS symbol, value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) + 1 AS quantity,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'BUY' ELSE 'SELL' END AS side, epoch_us(ts) // 1000 AS timestamp, event_type = 'error' AS is_liquidation, event_id FROM events)"""


def bars(source: str = "ticks", name: str = "candles", interval: int = 900_000) -> str:
    return f"""{name} AS (
  SELECT symbol, CAST(timestamp // {interval} * {interval} AS BIGINT) AS open_time, CAST(timestamp // {interval} * {interval} + {interval - 1} AS BIGINT) AS close_time,
    arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, sum(quantity) AS volume, round(sum(price * quantity), 2) AS quote_volume, count(*) AS trades,
    sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0.0::DOUBLE END) AS taker_buy_volume, sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0.0::DOUBLE END) AS taker_sell_volume
  FROM {source} GROUP BY symbol, timestamp // {interval})"""


#: Candles of 15 minutes with their place in the series.
CANDLES = f"{TICKS}, {bars()}"
SERIES = f"{CANDLES}, s AS (SELECT *, row_number() OVER w AS rn, taker_buy_volume - taker_sell_volume AS delta, lag(close) OVER w AS prev FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"

TRADES = """trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, p_brand AS symbol, l_returnflag AS strategy, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, p_retailprice AS entry_price, l_quantity AS quantity,
    profit_cents / 100.0::DOUBLE AS profit, profit_cents * 100.0::DOUBLE / cost AS profit_pct, profit_cents, least(a, b) AS entry_time, greatest(a, b) AS exit_time, CAST(abs(a - b) // 900000 AS BIGINT) AS duration_candles, CAST(1 + l_linenumber % 3 AS INTEGER) AS leverage
  FROM (SELECT *, CAST(floor(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) / 100.0::DOUBLE) AS BIGINT) - CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) AS profit_cents,
          CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) AS cost, epoch_ms(o_orderdate) AS a, epoch_ms(l_shipdate) AS b
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey))"""


def ema(name: str, source: str, value: str, period: int, alpha: str, first: int | None = None) -> str:
    """A recursive CTE: the mean of the first values, then a weighted step a row. ``first`` is the place of the first value."""
    first = 1 if first is None else first
    at = first + period - 1
    return f"""{name} AS (
  SELECT symbol, {at}::BIGINT AS rn, avg({value}) AS y FROM {source} WHERE rn BETWEEN {first} AND {at} GROUP BY symbol HAVING count(*) = {period}
  UNION ALL
  SELECT e.symbol, t.rn, e.y + ({alpha}) * (t.{value} - e.y) FROM {name} e JOIN {source} t ON t.symbol = e.symbol AND t.rn = e.rn + 1)"""

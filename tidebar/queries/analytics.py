"""Performance, pair statistics and store queries over line items as trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from .. import api
from ..operators import pairlist as P
from ..plans import analytics as N
from ..plans import store as S
from . import sql

QUERIES, SQL = {}, {}
START = 10_000.0


def query(name, run, text=None):
    QUERIES[name] = run
    if text:
        SQL[name] = text


T = f"WITH {sql.TRADES}"


def _r(d, *names, digits=6):
    return d.withColumns({n: A.rounded(n, digits) for n in names})


CENT = "coalesce(CAST(sum(CAST(round(({}) * 100) AS BIGINT)) AS BIGINT), 0) / 100.0::DOUBLE"
SUM = f"""count(*) AS total_trades, count(*) FILTER (profit > 0) AS winning_trades, count(*) FILTER (profit <= 0) AS losing_trades, {CENT.format('profit')} AS total_profit,
  {CENT.format('CASE WHEN profit > 0 THEN profit END')} AS won, {CENT.format('CASE WHEN profit <= 0 THEN -profit END')} AS lost, max(profit) AS best_trade, min(profit) AS worst_trade, CAST(sum(duration_candles) AS BIGINT) AS bars"""
SHOW = """total_trades, winning_trades, losing_trades, round(winning_trades * 1.0::DOUBLE / total_trades * 100, 6) AS win_rate, total_profit, round(total_profit / total_trades, 6) AS avg_profit, round(won / winning_trades, 6) AS avg_win, round(lost / losing_trades, 6) AS avg_loss,
  best_trade, worst_trade, round(won / lost, 6) AS profit_factor, round(bars * 1.0::DOUBLE / total_trades, 6) AS avg_duration"""
_sum = lambda keys: lambda s, d: _r(N.summarize(A.trades(s, d), keys), "win_rate", "avg_profit", "avg_win", "avg_loss", "profit_factor", "avg_duration")
query("trade_summary", _sum(()), f"{T}, z AS (SELECT {SUM} FROM trades) SELECT {SHOW} FROM z")
query("trade_summary_by_symbol", _sum(("symbol",)), f"{T}, z AS (SELECT symbol, {SUM} FROM trades GROUP BY symbol) SELECT symbol, {SHOW} FROM z")
query("daily_performance", lambda s, d: N.daily_performance(A.trades(s, d)), f"{T} SELECT strftime(make_timestamp(exit_time * 1000), '%Y-%m-%d') AS date, count(*) AS trades, {CENT.format('profit')} AS profit, count(*) FILTER (profit > 0) AS wins, count(*) FILTER (profit <= 0) AS losses FROM trades GROUP BY 1")
query("strategy_breakdown", lambda s, d: _r(N.strategy_breakdown(A.trades(s, d)), "win_rate"), f"{T} SELECT strategy, count(*) AS trades, {CENT.format('profit')} AS profit, round(count(*) FILTER (profit > 0) * 1.0::DOUBLE / count(*) * 100, 6) AS win_rate FROM trades GROUP BY strategy")
query("strategy_rollup", lambda s, d: N.strategy_rollup(A.trades(s, d)), f"{T} SELECT strategy, side, count(*) AS trades, {CENT.format('profit')} AS profit, CAST(grouping(strategy, side) AS BIGINT) AS level FROM trades GROUP BY ROLLUP (strategy, side)")
EDGE = f"""e AS (SELECT symbol, count(*) AS total_trades, count(*) FILTER (profit > 0) AS n, {CENT.format('CASE WHEN profit > 0 THEN profit END')} AS won, {CENT.format('CASE WHEN profit <= 0 THEN -profit END')} AS lost FROM trades GROUP BY symbol HAVING count(*) >= 50),
f AS (SELECT symbol, total_trades, n * 1.0::DOUBLE / total_trades AS w, CASE WHEN n > 0 THEN won / n ELSE 0 END AS aw, CASE WHEN total_trades > n THEN lost / (total_trades - n) ELSE 0 END AS al FROM e),
g AS (SELECT symbol, total_trades, w AS win_rate, aw AS avg_win, al AS avg_loss, CASE WHEN al > 0 THEN aw / al WHEN aw > 0 THEN 999 ELSE 0 END AS risk_reward_ratio, w * aw - (1 - w) * al AS expectancy FROM f)"""
EDGE_R = "symbol, total_trades, round(win_rate, 6) AS win_rate, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(risk_reward_ratio, 6) AS risk_reward_ratio, round(expectancy, 6) AS expectancy"
_edge = lambda d: _r(d, "win_rate", "avg_win", "avg_loss", "risk_reward_ratio", "expectancy")
query("edge_stats", lambda s, d: _edge(N.edge(A.trades(s, d), 50)), f"{T}, {EDGE} SELECT {EDGE_R} FROM g")
query("edge_filter", lambda s, d: _edge(N.edge_filter(A.trades(s, d), 50, 18_000.0)), f"{T}, {EDGE} SELECT {EDGE_R} FROM g WHERE expectancy >= 18000")
query("edge_kelly_size", lambda s, d: _r(N.edge_kelly_size(N.edge(A.trades(s, d), 50), START), "kelly_size").select("symbol", "kelly_size"), f"{T}, {EDGE} SELECT symbol, round(CASE WHEN risk_reward_ratio > 0 THEN greatest(0, least(win_rate - (1 - win_rate) / risk_reward_ratio, 0.25)) ELSE 0 END * 10000.0::DOUBLE, 6) AS kelly_size FROM g")
query("kelly_fraction", lambda s, d: _r(N.sized(N.kelly(A.trades(s, d), ("symbol",)), START), "win_rate", "avg_win", "avg_loss", "kelly_fraction", "amount"),
      f"""{T}, k AS (SELECT symbol, count(*) AS total_trades, count(*) FILTER (profit > 0) AS a, count(*) FILTER (profit < 0) AS b, {CENT.format('CASE WHEN profit > 0 THEN profit END')} AS won, {CENT.format('CASE WHEN profit < 0 THEN -profit END')} AS lost FROM trades GROUP BY symbol),
l AS (SELECT symbol, total_trades, a * 1.0::DOUBLE / total_trades AS w, CASE WHEN a > 0 THEN won / a ELSE 0 END AS aw, CASE WHEN b > 0 THEN lost / b ELSE 0 END AS al FROM k), m AS (SELECT *, CASE WHEN aw > 0 THEN greatest(0, w - (1 - w) / CASE WHEN al > 0 THEN aw / al ELSE 999 END) ELSE 0 END AS f FROM l)
SELECT symbol, total_trades, round(w, 6) AS win_rate, round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, round(f, 6) AS kelly_fraction, round(10000.0::DOUBLE * CASE WHEN total_trades < 30 THEN 0.02 ELSE least(f * 0.5, 0.25) END, 6) AS amount FROM m""")  # fmt: skip
CURVE = "cv AS (SELECT 0::BIGINT AS point, 0::BIGINT AS time, 10000.0::DOUBLE AS equity UNION ALL SELECT row_number() OVER w, exit_time, 10000.0::DOUBLE + CAST(sum(CAST(round(profit * 100) AS BIGINT)) OVER w AS BIGINT) / 100.0::DOUBLE FROM trades WINDOW w AS (ORDER BY exit_time, id, profit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_curve = lambda s, d: N.equity_curve(A.trades(s, d), START)
query("equity_curve", _curve, f"{T}, {CURVE} SELECT point, time, equity FROM cv")
DD = "pk AS (SELECT *, max(equity) OVER (ORDER BY point) AS peak, row_number() OVER (ORDER BY point) AS rn FROM cv), dd AS (SELECT *, peak - equity AS dr, max(CASE WHEN equity = peak THEN rn END) OVER (ORDER BY point) AS top FROM pk)"
query("drawdown", lambda s, d: _r(N.drawdown(_curve(s, d)).select("point", "peak", "drawdown", "drawdown_pct", "duration"), "drawdown", "drawdown_pct"), f"{T}, {CURVE}, {DD} SELECT point, peak, round(dr, 6) AS drawdown, round(dr / peak * 100, 6) AS drawdown_pct, CASE WHEN dr > 0 THEN rn - top ELSE 0 END AS duration FROM dd")
query("max_drawdown", lambda s, d: _r(N.max_drawdown(_curve(s, d)), "max_drawdown", "max_drawdown_pct"), f"{T}, {CURVE}, {DD} SELECT round(max(dr), 6) AS max_drawdown, round(max(dr / peak * 100), 6) AS max_drawdown_pct, max(CASE WHEN dr > 0 THEN rn - top ELSE 0 END) AS max_duration FROM dd")
query("trade_ratios", lambda s, d: _r(N.trade_ratios(A.trades(s, d), ("symbol",)), "sharpe", "sortino"), f"{T} SELECT symbol, round(avg(profit_pct) / stddev_samp(profit_pct), 6) AS sharpe, round(avg(profit_pct) / sqrt(sum(CASE WHEN profit_pct < 0 THEN profit_pct * profit_pct ELSE 0 END) / (count(*) - 1)), 6) AS sortino FROM trades GROUP BY symbol")
_NOW, _DAY = 1_005_000_000_000, 86_400_000
_stops = lambda s, d: A.trades(s, d).withColumn("exit_reason", F.when(F.col("profit") < -100, "Stoploss").otherwise("Signal"))
query("protections", lambda s, d: N.protections(_stops(s, d), _NOW, 60 * _DAY, _DAY, 9, 150.0, 400 * _DAY, 60.0),
      f"""{T}, x AS (SELECT *, exit_time > {_NOW} - {60 * _DAY} AS recent FROM trades), y AS (SELECT symbol, count(*) FILTER (recent AND profit < -100) AS stops, round(sum(CASE WHEN recent THEN profit_pct END), 9) AS pct, count(*) FILTER (recent) AS n, max(exit_time) AS last FROM x GROUP BY symbol),
z AS (SELECT symbol, CASE WHEN stops >= 9 THEN 'StoplossGuard' WHEN pct < 0 AND abs(pct) >= 150 THEN 'MaxDrawdownProtection' WHEN {_NOW} - last < {400 * _DAY} THEN 'CooldownPeriod' WHEN n > 0 AND pct < 60 THEN 'LowProfitPairs' END AS reason, last FROM y)
SELECT symbol, reason, CASE WHEN reason = 'CooldownPeriod' THEN last + {400 * _DAY} ELSE {_NOW + _DAY} END AS until FROM z WHERE reason IS NOT NULL""")  # fmt: skip
query("stoploss_guard_history", lambda s, d: N.stoploss_guard_history(_stops(s, d), 30 * _DAY, 3), f"{T} SELECT id, symbol, exit_time, count(*) FILTER (profit < -100) OVER (PARTITION BY symbol ORDER BY exit_time RANGE BETWEEN {30 * _DAY - 1} PRECEDING AND CURRENT ROW) AS stops, count(*) FILTER (profit < -100) OVER (PARTITION BY symbol ORDER BY exit_time RANGE BETWEEN {30 * _DAY - 1} PRECEDING AND CURRENT ROW) >= 3 AS locked FROM trades")


def positions(s, d):
    """Customers as open positions in pairs of a base and a quote currency."""
    c = A.table(s, d, "customer")
    quote = F.element_at(F.array(*map(F.lit, (*N.QUOTES, "XYZ"))), (F.col("c_custkey") % 7 + 1).cast("int"))
    return c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string"), quote).alias("symbol"), F.when(F.col("c_acctbal") >= 0, "BUY").otherwise("SELL").alias("side"), (F.col("c_custkey") % 50 + 1).cast("double").alias("entry_price"),
        (F.col("c_nationkey") + 1).cast("double").alias("quantity"), F.floor("c_acctbal").cast("double").alias("unrealized_pnl"), F.lit(0.0).alias("realized_pnl"), (F.col("c_custkey") % 20 + 1).cast("int").alias("leverage"), F.col("c_custkey").alias("opened_at"),
    )


POS = "ps AS (SELECT 'C' || c_custkey || ['USDT', 'BUSD', 'USDC', 'BTC', 'ETH', 'BNB', 'XYZ'][c_custkey % 7 + 1] AS symbol, CASE WHEN c_acctbal >= 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(c_custkey % 50 + 1 AS DOUBLE) AS entry_price, CAST(c_nationkey + 1 AS DOUBLE) AS quantity, floor(c_acctbal) AS unrealized_pnl, CAST(c_custkey % 20 + 1 AS INTEGER) AS leverage, c_custkey FROM customer)"
query("exposure", lambda s, d: N.exposure(positions(s, d)), f"WITH {POS} SELECT count(*) AS open_trades, sum(quantity * entry_price) AS total_exposure, sum(unrealized_pnl) AS unrealized_pnl FROM ps")
query("pair_pnl", lambda s, d: N.pair_pnl(A.trades(s, d)), f"{T} SELECT symbol, {CENT.format('profit')} AS pnl FROM trades GROUP BY symbol")
query("quote_concentration", lambda s, d: N.quote_concentration(positions(s, d)), f"WITH {POS}, q AS (SELECT CASE WHEN regexp_extract(symbol, '(USDT|BUSD|USDC|BTC|ETH|BNB)$', 1) <> '' THEN regexp_extract(symbol, '(USDT|BUSD|USDC|BTC|ETH|BNB)$', 1) ELSE symbol END AS quote FROM ps) SELECT quote, count(*) AS positions, count(*) > 3 AS too_correlated FROM q GROUP BY quote")
query("trade_history", lambda s, d: S.trade_history(A.trades(s, d), 900_000_000_000, 905_000_000_000).select("id", "symbol", "exit_time", "profit"), f"{T} SELECT id, symbol, exit_time, profit FROM trades WHERE exit_time >= 900000000000 AND exit_time <= 905000000000")
query("top_trades", lambda s, d: A.trades(s, d).orderBy(F.col("profit").desc(), "id").limit(20).select("id", "profit"), f"{T} SELECT id, profit FROM trades ORDER BY profit DESC, id LIMIT 20")


def letters(s, d):
    """Orders as dead letters."""
    o = A.table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), A.millis("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("topic"), (k % 5).alias("retry_count"), F.lit(3).cast("long").alias("max_retries"), (A.millis("o_orderdate") + (k % 7) * 3_600_000).alias("next_retry_at"), (F.col("o_orderstatus") == "F").alias("resolved"))


DLQ = "dl AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS timestamp, o_orderpriority AS topic, o_orderkey % 5 AS retry_count, 3::BIGINT AS max_retries, epoch_ms(o_orderdate) + (o_orderkey % 7) * 3600000 AS next_retry_at, o_orderstatus = 'F' AS resolved FROM orders)"
OPEN = "NOT resolved AND retry_count < max_retries AND next_retry_at <= 900000000000"
query("retryable_letters", lambda s, d: S.retryable(letters(s, d), 900_000_000_000, 50).select("id", "retry_count", "next_retry_at"), f"WITH {DLQ} SELECT id, retry_count, next_retry_at FROM dl WHERE {OPEN} ORDER BY next_retry_at, id LIMIT 50")
query("retried_letters", lambda s, d: S.retried(letters(s, d), 900_000_000_000).select("id", "retry_count", "next_retry_at"), f"WITH {DLQ} SELECT id, retry_count + 1 AS retry_count, CAST(900000000000 + 60000 * pow(2, retry_count) AS BIGINT) AS next_retry_at FROM dl")
query("resolved_letters", lambda s, d: S.resolved(letters(s, d), letters(s, d).where(F.col("id") % 3 == 0)).select("id", "resolved"), f"WITH {DLQ} SELECT id, resolved OR id % 3 = 0 AS resolved FROM dl")
STATUS = {"F": "Filled", "O": "Open", "P": "PartiallyFilled"}
_statuses = lambda s, d: A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("o_orderstatus")].alias("status"), F.col("o_totalprice").alias("price"))
query("orders_by_status", lambda s, d: api.orders(_statuses(s, d), "PartiallyFilled"), "SELECT o_orderkey AS id, 'PartiallyFilled' AS status, o_totalprice AS price FROM orders WHERE o_orderstatus = 'P'")
query("open_profit", lambda s, d: _r(api.profit(positions(s, d)), "unrealized_pnl"), f"WITH {POS} SELECT round(coalesce(sum(unrealized_pnl), 0), 6) AS unrealized_pnl, count(*) AS positions FROM ps")
query("audit_log_latest", lambda s, d: S.audit_log(letters(s, d), 100).select("id", "timestamp", "topic"), f"WITH {DLQ} SELECT id, timestamp, topic FROM dl ORDER BY timestamp DESC, id DESC LIMIT 100")
query("store_counts", lambda s, d: S.counts(A.trades(s, d), A.ticks(s, d), letters(s, d)), f"{T}, {DLQ} SELECT count(*) AS trade_count, count(*) FILTER (profit > 0) AS wins, count(*) FILTER (profit <= 0) AS losses, {CENT.format('profit')} AS total_realized_pnl, (SELECT count(*) FROM events) AS signal_count, (SELECT count(*) FROM dl WHERE NOT resolved) AS dead_letter_count FROM trades")
_orders = lambda s, d: letters(s, d).select(F.col("topic").alias("symbol"), "id", "timestamp")
query("latest_by_key", lambda s, d: S.latest(_orders(s, d), ["symbol"], "timestamp"), f"WITH {DLQ} SELECT topic AS symbol, id, timestamp FROM dl QUALIFY row_number() OVER (PARTITION BY topic ORDER BY timestamp DESC, id DESC) = 1")
_halves = lambda s, d: (_orders(s, d).where("id % 2 = 0"), _orders(s, d).where("id % 3 = 0").withColumn("timestamp", F.lit(0).cast("long")))
query("upsert_by_key", lambda s, d: S.upsert(*_halves(s, d), ["id"]), f"WITH {DLQ} SELECT topic AS symbol, id, CASE WHEN id % 3 = 0 THEN 0 ELSE timestamp END AS timestamp FROM dl WHERE id % 2 = 0 OR id % 3 = 0")
query("delete_by_key", lambda s, d: S.delete(*_halves(s, d), ["id"]), f"WITH {DLQ} SELECT topic AS symbol, id, timestamp FROM dl WHERE id % 2 = 0 AND id % 3 <> 0")


def pairs(s, d):
    """Parts as pairs with price, traded volume, spread and volatility; some pairs have no figures."""
    p = A.table(s, d, "part").select(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("price"), "p_partkey", F.col("p_size").cast("double").alias("size"))
    v = A.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("volume"))
    return p.join(v, "p_partkey", "left").withColumns({"spread": F.col("size") / 1000, "volatility": F.when(F.col("p_partkey") % 10 != 0, F.col("size") / 50)})


PAIRS = "pr AS (SELECT p_brand || '/' || p_partkey AS symbol, p_retailprice AS price, q.volume, p_size / 1000.0::DOUBLE AS spread, CASE WHEN p_partkey % 10 <> 0 THEN p_size / 50.0::DOUBLE END AS volatility FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS volume FROM lineitem GROUP BY 1) q ON l_partkey = p_partkey)"
query("pairlist_static", lambda s, d: P.matching(pairs(s, d), ["^Brand#1", "[", "5$"]).select("symbol"), f"WITH {PAIRS} SELECT symbol FROM pr WHERE regexp_matches(symbol, '^Brand#1') OR regexp_matches(symbol, '5$')")
query("pairlist_volume", lambda s, d: P.by_volume(pairs(s, d), 100.0, 50).select("symbol", "volume"), f"WITH {PAIRS} SELECT symbol, volume FROM pr WHERE volume >= 100 ORDER BY volume DESC, symbol LIMIT 50")
query("pairlist_filters", lambda s, d: P.chain(P.between("price", 905.0, 945.0), P.at_most("spread", 0.03), P.between("volatility", 0.2, 0.8))(pairs(s, d)).select("symbol", "price"), f"WITH {PAIRS} SELECT symbol, price FROM pr WHERE price BETWEEN 905 AND 945 AND spread <= 0.03 AND volatility BETWEEN 0.2 AND 0.8")

"""Bars, indicators and order flow over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import indicators as I
from ..functions import liquidations as L
from ..functions import orderflow as O
from ..operators import bars, series
from . import sql

H1 = 3_600_000


def numbered(spark, sf):
    return series.number_rows(A.candles(spark, sf))


def _r(*names, digits=6):
    return [A.rounded(n, digits).alias(n) for n in names]


BAR = "symbol, open_time, close_time, open, high, low, close, volume, quote_volume, trades, taker_buy_volume, taker_sell_volume"
AT = ("symbol", "open_time")
QUERIES, SQL = {}, {}


def query(name, run, text=None):
    QUERIES[name] = run
    if text:
        SQL[name] = text


query("candles_15m", lambda s, d: A.candles(s, d), f"WITH {sql.CANDLES} SELECT {BAR} FROM candles")
MERGED = "min(open_time) AS open_time, arg_max(close_time, open_time) AS close_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume, round(sum(quote_volume), 2) AS quote_volume, CAST(sum(trades) AS BIGINT) AS trades, sum(taker_buy_volume) AS taker_buy_volume, sum(taker_sell_volume) AS taker_sell_volume"
_cents = lambda d: d.withColumn("quote_volume", F.round("quote_volume", 2))
query("resample_1h", lambda s, d: _cents(bars.resample(A.candles(s, d), H1)), f"WITH {sql.CANDLES} SELECT symbol, {MERGED} FROM candles GROUP BY symbol, open_time // {H1}")
query("resample_factor_5", lambda s, d: _cents(bars.resample_every(A.candles(s, d), 5)), f"WITH {sql.SERIES} SELECT symbol, {MERGED} FROM s GROUP BY symbol, (rn - 1) // 5")
query("drop_forming", lambda s, d: series.drop_forming(A.candles(s, d)).select(*AT, "close"), f"WITH {sql.CANDLES} SELECT symbol, open_time, close FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) > 1")
query("tail_200", lambda s, d: series.tail(A.candles(s, d), 200).select(*AT, "close"), f"WITH {sql.SERIES} SELECT symbol, open_time, close FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) <= 200")
_frame = lambda n: f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
query("sma_20", lambda s, d: I.sma(numbered(s, d), 20).select(*AT, *_r("sma")), f"WITH {sql.SERIES} SELECT symbol, open_time, CASE WHEN rn >= 20 THEN round(avg(close) OVER {_frame(20)}, 6) END AS sma FROM s")
query("volume_sma_20", lambda s, d: I.volume_sma(numbered(s, d), 20).select(*AT, *_r("volume_sma")), f"WITH {sql.SERIES} SELECT symbol, open_time, round(avg(volume) OVER {_frame(20)}, 6) AS volume_sma FROM s")
query(
    "bollinger_20",
    lambda s, d: I.bollinger(numbered(s, d)).select(*AT, *_r("bb_middle", "bb_upper", "bb_lower", "bb_pct_b", "bb_bandwidth")),
    f"""WITH {sql.SERIES}, b AS (SELECT symbol, open_time, close, CASE WHEN rn >= 20 THEN avg(close) OVER w END AS m, stddev_pop(close) OVER w AS sd FROM s WINDOW w AS {_frame(20)})
SELECT symbol, open_time, round(m, 6) AS bb_middle, round(m + 2 * sd, 6) AS bb_upper, round(m - 2 * sd, 6) AS bb_lower,
  round(CASE WHEN m IS NOT NULL AND sd > 0 THEN (close - (m - 2 * sd)) / ((m + 2 * sd) - (m - 2 * sd)) WHEN m IS NOT NULL THEN 0.5 END, 6) AS bb_pct_b, round(CASE WHEN m > 0 THEN ((m + 2 * sd) - (m - 2 * sd)) / m END, 6) AS bb_bandwidth FROM b""",
)
query("obv", lambda s, d: I.obv(numbered(s, d)).select(*AT, "obv"), f"WITH {sql.SERIES} SELECT symbol, open_time, sum(coalesce(sign(close - prev) * volume, 0.0::DOUBLE)) OVER (PARTITION BY symbol ORDER BY rn) AS obv FROM s")
query("vwap", lambda s, d: I.vwap(numbered(s, d)).select(*AT, *_r("vwap")), f"WITH {sql.SERIES} SELECT symbol, open_time, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) AS vwap FROM s WINDOW w AS (PARTITION BY symbol ORDER BY rn)")
TR = "CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END"
query("true_range", lambda s, d: I.true_range(numbered(s, d)).select(*AT, *_r("true_range")), f"WITH {sql.SERIES} SELECT symbol, open_time, round({TR}, 6) AS true_range FROM s")
query("simple_atr_14", lambda s, d: I.simple_atr(numbered(s, d)).select(*AT, *_r("simple_atr")), f"WITH {sql.SERIES}, t AS (SELECT *, {TR} AS tr FROM s) SELECT symbol, open_time, CASE WHEN rn > 14 THEN round(avg(tr) OVER {_frame(14)}, 6) END AS simple_atr FROM t")
_rec = lambda: "WITH RECURSIVE " + sql.SERIES
query("ema_14", lambda s, d: I.ema(numbered(s, d), 14).select(*AT, *_r("ema")), f"{_rec()}, {sql.ema('e', 's', 'close', 14, '2.0::DOUBLE / 15')} SELECT s.symbol, open_time, round(y, 6) AS ema FROM s LEFT JOIN e ON s.symbol = e.symbol AND s.rn = e.rn")
MACD = f"""{sql.ema("f", "s", "close", 12, "2.0::DOUBLE / 13")}, {sql.ema("g", "s", "close", 26, "2.0::DOUBLE / 27")}, m AS (SELECT f.symbol, f.rn, f.y - g.y AS macd FROM f JOIN g ON f.symbol = g.symbol AND f.rn = g.rn), {sql.ema("h", "m", "macd", 9, "2.0::DOUBLE / 10", 26)}"""
query(
    "macd_12_26_9",
    lambda s, d: I.macd(numbered(s, d)).select(*AT, *_r("macd", "macd_signal", "macd_histogram")),
    f"{_rec()}, {MACD} SELECT s.symbol, open_time, round(macd, 6) AS macd, round(h.y, 6) AS macd_signal, round(macd - h.y, 6) AS macd_histogram FROM s LEFT JOIN m ON s.symbol = m.symbol AND s.rn = m.rn LEFT JOIN h ON s.symbol = h.symbol AND s.rn = h.rn",
)
RSI = f"""c AS (SELECT symbol, rn, greatest(close - prev, 0.0::DOUBLE) AS up, greatest(prev - close, 0.0::DOUBLE) AS down FROM s), {sql.ema("u", "c", "up", 14, "1.0::DOUBLE / 14", 2)}, {sql.ema("v", "c", "down", 14, "1.0::DOUBLE / 14", 2)},
r AS (SELECT u.symbol, u.rn, 100 - 100 / (1 + CASE WHEN v.y > 0 THEN u.y / v.y WHEN u.y > 0 THEN 999.0::DOUBLE ELSE 1.0::DOUBLE END) AS rsi FROM u JOIN v ON u.symbol = v.symbol AND u.rn = v.rn)"""
query("rsi_14", lambda s, d: I.rsi(numbered(s, d)).select(*AT, *_r("rsi")), f"{_rec()}, {RSI} SELECT s.symbol, open_time, round(rsi, 6) AS rsi FROM s LEFT JOIN r ON s.symbol = r.symbol AND s.rn = r.rn")
ATR = f"t AS (SELECT *, {TR} AS tr FROM s), {sql.ema('a', 't', 'tr', 14, '1.0::DOUBLE / 14', 2)}"
query("atr_14", lambda s, d: I.atr(numbered(s, d)).select(*AT, *_r("atr")), f"{_rec()}, {ATR} SELECT s.symbol, open_time, round(a.y, 6) AS atr FROM s LEFT JOIN a ON s.symbol = a.symbol AND s.rn = a.rn")
CVD = f"""x AS (SELECT symbol, open_time, close_time, close, rn, CASE WHEN rn >= 15 THEN sum(delta) OVER {_frame(15)} END AS total, sum(delta) OVER {_frame(7)} AS half FROM s),
cvd AS (SELECT *, CASE WHEN total > 0 AND half > 0 THEN 'BULLISH' WHEN total < 0 AND half < 0 THEN 'BEARISH' WHEN total IS NOT NULL THEN 'NEUTRAL' END AS trend FROM x),
ch AS (SELECT *, lag(trend) OVER (PARTITION BY symbol ORDER BY rn) AS was FROM cvd),
act AS (SELECT *, CASE WHEN trend IS NULL OR trend IS NOT DISTINCT FROM was THEN NULL WHEN trend = 'BULLISH' THEN 'EnterLong' WHEN trend = 'BEARISH' THEN 'EnterShort' WHEN was = 'BULLISH' THEN 'ExitLong' WHEN was = 'BEARISH' THEN 'ExitShort' END AS action FROM ch)"""
query("cvd_15", lambda s, d: I.cvd(numbered(s, d), 15).select(*AT, "cvd_total", "cvd_trend"), f"WITH {sql.SERIES}, {CVD} SELECT symbol, open_time, total AS cvd_total, trend AS cvd_trend FROM cvd")
_changes = lambda s, d: I.trend_changes(I.cvd(numbered(s, d), 15))
query("cvd_trend_changes", lambda s, d: _changes(s, d).where("action IS NOT NULL").select(*AT, "previous_trend", "cvd_trend", "action"), f"WITH {sql.SERIES}, {CVD} SELECT symbol, open_time, was AS previous_trend, trend AS cvd_trend, action FROM act WHERE action IS NOT NULL")


def replay_summary(d):
    """Windows by trend and changes of trend, for each symbol."""
    count = lambda c, n: F.count_if(c).alias(n)
    t, p = F.col("cvd_trend"), F.col("previous_trend")
    return d.groupBy("symbol").agg(F.count("cvd_trend").alias("windows"), count(t == "BULLISH", "bullish"), count(t == "BEARISH", "bearish"), count(t == "NEUTRAL", "neutral"), count(p.isNotNull() & (t != p), "trend_changes"))


query("cvd_replay_summary", lambda s, d: replay_summary(_changes(s, d)), f"WITH {sql.SERIES}, {CVD} SELECT symbol, count(trend) AS windows, count(*) FILTER (trend = 'BULLISH') AS bullish, count(*) FILTER (trend = 'BEARISH') AS bearish, count(*) FILTER (trend = 'NEUTRAL') AS neutral, count(*) FILTER (was IS NOT NULL AND trend <> was) AS trend_changes FROM ch GROUP BY symbol")
DIV = """dv AS (SELECT symbol, open_time, rn, close - lag(close, 5) OVER w AS pc, sum(delta) OVER w - lag(cum, 5) OVER w AS dc, cum FROM (SELECT *, sum(delta) OVER (PARTITION BY symbol ORDER BY rn) AS cum FROM s) WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
dd AS (SELECT *, CASE WHEN pc > 0 AND dc < 0 THEN 'Bearish' WHEN pc < 0 AND dc > 0 THEN 'Bullish' END AS divergence FROM dv)"""
query("delta_divergence", lambda s, d: O.delta_divergence(numbered(s, d)).where("divergence IS NOT NULL").select(*AT, *_r("price_change"), "delta_change", "divergence"), f"WITH {sql.SERIES}, {DIV} SELECT symbol, open_time, round(pc, 6) AS price_change, dc AS delta_change, divergence FROM dd WHERE divergence IS NOT NULL")
query("cumulative_delta", lambda s, d: O.delta_divergence(numbered(s, d)).select(*AT, "delta", "cumulative_delta"), f"WITH {sql.SERIES} SELECT symbol, open_time, delta, sum(delta) OVER (PARTITION BY symbol ORDER BY rn) AS cumulative_delta FROM s")
IMB = """im AS (SELECT *, CASE WHEN taker_sell_volume > 0 AND taker_buy_volume / taker_sell_volume >= 3 THEN 'BuyImbalance' WHEN taker_buy_volume > 0 AND taker_sell_volume / taker_buy_volume >= 3 THEN 'SellImbalance' END AS zone_type FROM s)"""
query("imbalance_zones", lambda s, d: O.imbalances(numbered(s, d)).select("symbol", O.index(), "zone_type", *_r("ratio"), "dominant_volume", "weak_volume"), f"WITH {sql.SERIES}, {IMB} SELECT symbol, rn - 1 AS index, zone_type, round(greatest(taker_buy_volume, taker_sell_volume) / least(taker_buy_volume, taker_sell_volume), 6) AS ratio, greatest(taker_buy_volume, taker_sell_volume) AS dominant_volume, least(taker_buy_volume, taker_sell_volume) AS weak_volume FROM im WHERE zone_type IS NOT NULL")
query("stacked_imbalances", lambda s, d: O.stacked_imbalances(numbered(s, d), least=2), f"WITH {sql.SERIES}, {IMB}, k AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, zone_type ORDER BY rn) AS g FROM im WHERE zone_type IS NOT NULL) SELECT symbol, min(rn) - 1 AS start_index, count(*) AS count, zone_type FROM k GROUP BY symbol, zone_type, g HAVING count(*) >= 2")
SWEEP = """w AS (SELECT *, greatest(open, close) AS top, least(open, close) AS bottom, (high + low) / 2 AS mid FROM s), wc AS (SELECT *, high - top AS up, bottom - low AS down, top - bottom AS body, CASE WHEN top - bottom > 0 THEN top - bottom ELSE 1e-10::DOUBLE END AS dv FROM w),
sw AS (SELECT symbol, rn, 'BearishSweep' AS sweep_type, up AS wick, body, up / dv AS ratio FROM wc WHERE mid <> 0 AND up / mid >= 0.001 AND up / dv >= 2 UNION ALL SELECT symbol, rn, 'BullishSweep', down, body, down / dv FROM wc WHERE mid <> 0 AND down / mid >= 0.001 AND down / dv >= 2)"""
query("sweeps", lambda s, d: O.sweeps(numbered(s, d)).select("symbol", O.index(), "sweep_type", *_r("wick_size", "body_size"), F.round("wick_ratio", 2).alias("wick_ratio")), f"WITH {sql.SERIES}, {SWEEP} SELECT symbol, rn - 1 AS index, sweep_type, round(wick, 6) AS wick_size, round(body, 6) AS body_size, round(ratio, 2) AS wick_ratio FROM sw")
ABSORB = "SELECT symbol, rn - 1 AS index, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS absorbed_side, volume, round(high - low, 6) AS price_range, round(CASE WHEN high - low > 0 THEN volume / (high - low) ELSE volume END, 6) AS absorption_strength FROM q WHERE volume >= 2 AND volume >= 1.2::DOUBLE * mean AND open > 0 AND (high - low) / open <= 0.05"
_absorb = lambda causal: lambda s, d: O.absorption(numbered(s, d), 2.0, 0.05, 1.2, causal).select("symbol", O.index(), "absorbed_side", "volume", *_r("price_range", "absorption_strength"))
query("absorption", _absorb(True), f"WITH {sql.SERIES}, q AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY rn) / rn AS mean FROM s) {ABSORB}")
query("absorption_whole_series", _absorb(False), f"WITH {sql.SERIES}, q AS (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS mean FROM s) {ABSORB}")
query("footprint", lambda s, d: O.footprint(A.ticks(s, d), A.M15, 5.0), f"WITH {sql.TICKS} SELECT symbol, CAST(timestamp // 900000 * 900000 AS BIGINT) AS open_time, floor(price / 5.0::DOUBLE) * 5.0::DOUBLE AS price_level, sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0.0::DOUBLE END) AS bid_volume, sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0.0::DOUBLE END) AS ask_volume, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS delta FROM ticks GROUP BY ALL")
PROFILE = """lv AS (SELECT symbol, unnest(generate_series(CAST(floor(low / 10.0::DOUBLE) AS BIGINT), CAST(floor(high / 10.0::DOUBLE) AS BIGINT))) AS level, volume / (CAST(floor(high / 10.0::DOUBLE) AS BIGINT) - CAST(floor(low / 10.0::DOUBLE) AS BIGINT) + 1) AS v FROM candles), pf AS (SELECT symbol, level, level * 10.0::DOUBLE AS price, count(*) AS tpo_count, sum(v) AS volume FROM lv GROUP BY symbol, level)"""
_levels = lambda s, d: O.profile_levels(A.candles(s, d), 10.0)
query("market_profile_levels", lambda s, d: _levels(s, d).select("symbol", "price", "tpo_count", *_r("volume")), f"WITH {sql.CANDLES}, {PROFILE} SELECT symbol, price, tpo_count, round(volume, 6) AS volume FROM pf")
query("market_profile_poc", lambda s, d: O.point_of_control(_levels(s, d)).select("symbol", "poc", *_r("total_volume"), "levels"), f"WITH {sql.CANDLES}, {PROFILE} SELECT symbol, arg_max(price, round(volume, 9) * 1e6::DOUBLE + level / 1e6::DOUBLE) AS poc, round(sum(volume), 6) AS total_volume, count(*) AS levels FROM pf GROUP BY symbol")
query(
    "value_area",
    lambda s, d: O.value_area(_levels(s, d)).select("symbol", "poc", "vah", "val", *_r("total_volume")),
    f"""WITH RECURSIVE {sql.CANDLES}, {PROFILE}, lw AS MATERIALIZED (SELECT symbol, price, round(volume, 9) AS v, row_number() OVER (PARTITION BY symbol ORDER BY level) AS i FROM pf), tw AS MATERIALIZED (SELECT symbol, sum(v) AS total, count(*) AS n, max(struct_pack(v := v, i := i)).i AS top FROM lw GROUP BY symbol),
va AS (SELECT tw.symbol, top AS up, top AS low, v AS held FROM tw JOIN lw ON lw.symbol = tw.symbol AND lw.i = top UNION ALL
  SELECT symbol, CASE WHEN above >= below THEN up + 1 ELSE up END, CASE WHEN above >= below THEN low ELSE low - 1 END, held + greatest(above, below) FROM (SELECT va.symbol, up, low, held, coalesce(a.v, -1) AS above, coalesce(b.v, -1) AS below FROM va JOIN tw ON tw.symbol = va.symbol LEFT JOIN lw a ON a.symbol = va.symbol AND a.i = up + 1 LEFT JOIN lw b ON b.symbol = va.symbol AND b.i = low - 1 WHERE held < total * 0.7::DOUBLE - 1e-9 AND (low > 1 OR up < n))),
ve AS (SELECT symbol, max(up) AS up, min(low) AS low FROM va GROUP BY symbol) SELECT ve.symbol, p.price AS poc, h.price AS vah, l.price AS val, round(total, 6) AS total_volume FROM ve JOIN tw ON tw.symbol = ve.symbol JOIN lw p ON p.symbol = ve.symbol AND p.i = top JOIN lw h ON h.symbol = ve.symbol AND h.i = up JOIN lw l ON l.symbol = ve.symbol AND l.i = low""",
)
LIQ = f"{sql.TICKS}, q AS (SELECT symbol, round(price * 100) * quantity AS usd, side = 'SELL' AS is_long FROM ticks WHERE is_liquidation)"
query("liquidation_summary", lambda s, d: L.summary(A.liquidations(s, d)), f"WITH {LIQ}, z AS (SELECT symbol, count(*) FILTER (is_long) AS long_count, count(*) FILTER (NOT is_long) AS short_count, coalesce(sum(usd) FILTER (is_long), 0.0::DOUBLE) AS long_value, coalesce(sum(usd) FILTER (NOT is_long), 0.0::DOUBLE) AS short_value FROM q GROUP BY symbol) SELECT *, CASE WHEN long_value > 2 * short_value THEN 'LONGS_LIQUIDATED' WHEN short_value > 2 * long_value THEN 'SHORTS_LIQUIDATED' ELSE 'BALANCED' END AS bias FROM z")
query("liquidation_tiers", lambda s, d: L.by_tier(A.liquidations(s, d)), f"WITH {LIQ}, t(tier, lo, hi) AS (VALUES ('Small', 1000, 10000), ('Medium', 10000, 30000), ('Large', 30000, 100000), ('Massive', 100000, 1000000000000)), k AS (SELECT * FROM (SELECT DISTINCT symbol FROM q) CROSS JOIN t) SELECT k.symbol, tier, count(*) FILTER (is_long) AS long_count, count(*) FILTER (NOT is_long) AS short_count, coalesce(sum(usd) FILTER (is_long), 0.0::DOUBLE) AS long_value, coalesce(sum(usd) FILTER (NOT is_long), 0.0::DOUBLE) AS short_value FROM k LEFT JOIN q ON q.symbol = k.symbol AND usd >= lo AND usd < hi GROUP BY k.symbol, tier")

"""Summaries of closed trades, equity and drawdown, pair statistics and locks.

``profit`` is a double; sums are taken over whole cents, so they don't depend on
the order of rows and are combined before the shuffle.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.series import frames, number_rows, running
from ..shared import cut

def _profit() -> Column:
    return F.col("profit")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(cents(value)), F.lit(0)) / 100.0


def ratio(a: Column, b: Column, otherwise=0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(otherwise)


def summarize(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Performance, of all trades or by key; zero or less is a loss, the win rate is in percent. No trades give zeros."""
    win, n = _profit() > 0, F.count("*")
    d = trades.groupBy(*keys).agg(
        n.alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(_profit() <= 0).alias("losing_trades"), _sum(_profit()).alias("total_profit"),
        _sum(F.when(win, _profit())).alias("_won"), _sum(F.when(_profit() <= 0, -_profit())).alias("_lost"), F.coalesce(F.max("profit"), F.lit(0.0)).alias("best_trade"), F.coalesce(F.min("profit"), F.lit(0.0)).alias("worst_trade"), F.coalesce(F.sum("duration_candles"), F.lit(0)).alias("_bars"),
    )
    c = F.col
    return d.select(
        *keys, "total_trades", "winning_trades", "losing_trades", (ratio(c("winning_trades"), c("total_trades")) * 100).alias("win_rate"), "total_profit", ratio(c("total_profit"), c("total_trades")).alias("avg_profit"),
        ratio(c("_won"), c("winning_trades")).alias("avg_win"), ratio(c("_lost"), c("losing_trades")).alias("avg_loss"), "best_trade", "worst_trade",
        F.when(c("_lost") > 0, c("_won") / c("_lost")).when(c("_won") > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"), ratio(c("_bars"), c("total_trades")).alias("avg_duration"),
    )


def daily_performance(trades: DataFrame) -> DataFrame:
    """By UTC day of the exit."""
    day = F.date_format(F.timestamp_millis("exit_time"), "yyyy-MM-dd").alias("date")
    return trades.groupBy(day).agg(F.count("*").alias("trades"), _sum(_profit()).alias("profit"), F.count_if(_profit() > 0).alias("wins"), F.count_if(_profit() <= 0).alias("losses"))


def strategy_breakdown(trades: DataFrame) -> DataFrame:
    d = trades.groupBy("strategy").agg(F.count("*").alias("trades"), _sum(_profit()).alias("profit"), F.count_if(_profit() > 0).alias("_w"))
    return d.select("strategy", "trades", "profit", (ratio(F.col("_w"), F.col("trades")) * 100).alias("win_rate"))


def strategy_rollup(trades: DataFrame) -> DataFrame:
    """By strategy and side, by strategy, and of all."""
    return trades.rollup("strategy", "side").agg(F.count("*").alias("trades"), _sum(_profit()).alias("profit"), F.grouping_id().cast("long").alias("level"))


def edge(trades: DataFrame, min_trades: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Expectancy by pair, of pairs with enough trades; the win rate is a fraction, 999 stands for gains without losses."""
    d = trades.groupBy(*keys).agg(F.count("*").alias("total_trades"), F.count_if(_profit() > 0).alias("_n"), _sum(F.when(_profit() > 0, _profit())).alias("_won"), _sum(F.when(_profit() <= 0, -_profit())).alias("_lost"))
    c = F.col
    d = d.where(c("total_trades") >= min_trades).withColumns({"win_rate": c("_n") / c("total_trades"), "avg_win": ratio(c("_won"), c("_n")), "avg_loss": ratio(c("_lost"), c("total_trades") - c("_n"))})
    d = d.withColumns({"risk_reward_ratio": F.when(c("avg_loss") > 0, c("avg_win") / c("avg_loss")).when(c("avg_win") > 0, 999.0).otherwise(0.0), "expectancy": c("win_rate") * c("avg_win") - (1 - c("win_rate")) * c("avg_loss")})
    return d.drop("_n", "_won", "_lost")


def edge_filter(trades: DataFrame, min_trades: int = 10, min_expectancy: float = 0.0) -> DataFrame:
    return edge(trades, min_trades).where(F.col("expectancy") >= min_expectancy)


def edge_kelly_size(stats: DataFrame, balance: float) -> DataFrame:
    """The Kelly share of the balance by pair, a quarter at most."""
    w, r = F.col("win_rate"), F.col("risk_reward_ratio")
    return stats.withColumn("kelly_size", F.when(r > 0, F.greatest(F.lit(0.0), F.least(w - (1 - w) / r, F.lit(0.25)))).otherwise(0.0) * balance)


def kelly(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Kelly fraction; here only a profit below zero is a loss."""
    d = trades.groupBy(*keys).agg(F.count("*").alias("total_trades"), F.count_if(_profit() > 0).alias("_w"), F.count_if(_profit() < 0).alias("_l"), _sum(F.when(_profit() > 0, _profit())).alias("_won"), _sum(F.when(_profit() < 0, -_profit())).alias("_lost"))
    c = F.col
    d = d.select(*keys, "total_trades", ratio(c("_w"), c("total_trades")).alias("win_rate"), ratio(c("_won"), c("_w")).alias("avg_win"), ratio(c("_lost"), c("_l")).alias("avg_loss"))
    r = F.when(c("avg_loss") > 0, c("avg_win") / c("avg_loss")).otherwise(999.0)
    return d.withColumn("kelly_fraction", F.when(c("avg_win") > 0, F.greatest(F.lit(0.0), c("win_rate") - (1 - c("win_rate")) / r)).otherwise(0.0))


def sized(kelly_stats: DataFrame, balance: float, multiplier: float = 0.5, min_trades: int = 30, fallback: float = 0.02, most: float = 0.25) -> DataFrame:
    """Amount to risk from Kelly statistics: the fallback share while there are few trades."""
    k = F.col("kelly_fraction")
    return kelly_stats.withColumn("amount", balance * F.when(F.col("total_trades") < min_trades, fallback).otherwise(F.least(k * multiplier, F.lit(most))))


def equity_curve(trades: DataFrame, balance: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points (time, equity): the balance at time 0, then one for each trade by exit time and id."""
    one = F.lit("").alias("_all")
    narrow = cut(trades.select(*keys, one, "id", "exit_time", cents(_profit()).alias("_p")))  # else the trades are worked out for the counts and for the rows
    d = number_rows(narrow, "exit_time", [*keys, "_all"], ["id", "_p"])
    d = running(d, {"_sum": ("sum", F.col("_p"))}, [*keys, "_all"])
    points = d.select(*keys, F.col("rn").alias("point"), F.col("exit_time").alias("time"), (balance + F.col("_sum") / 100.0).alias("equity"))
    start = trades.select(*keys).distinct() if keys else trades.sparkSession.range(1).select()
    return start.select(*keys, F.lit(0).cast("long").alias("point"), F.lit(0).cast("long").alias("time"), F.lit(float(balance)).alias("equity")).unionByName(points)


def drawdown(curve: DataFrame, keys: Sequence[str] = (), order: str = "point") -> DataFrame:
    """Peak so far, drawdown, in percent, and for how many points it has lasted since the last new peak.

    The last point at the peak is the greatest pair of equity and place. The
    points of an equity curve are their places; any other order is numbered.
    """
    by = [*keys, "_all"]
    d = curve.select("*", F.lit("").alias("_all"))
    d = cut(d.withColumn("rn", F.col("point") + 1)) if order == "point" else number_rows(d, order, by, span=4096)
    d = running(d, {"_top": ("max", F.struct(F.col("equity"), F.col("rn")))}, by)
    d = d.withColumn("peak", F.col("_top.equity")).withColumn("drawdown", F.col("peak") - F.col("equity"))
    return d.withColumns({"drawdown_pct": ratio(F.col("drawdown"), F.col("peak")) * 100, "duration": F.when(F.col("drawdown") > 0, F.col("rn") - F.col("_top.rn")).otherwise(0).cast("long")}).drop("_all", "rn", "_top")


def max_drawdown(curve: DataFrame, keys: Sequence[str] = (), order: str = "point") -> DataFrame:
    return drawdown(curve, keys, order).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), F.max("drawdown_pct").alias("max_drawdown_pct"), F.max("duration").alias("max_duration"))


def trade_ratios(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sharpe and Sortino of returns a trade, with n - 1, not annualised; 0 for fewer than two trades or no spread."""
    r = F.col("profit_pct")
    d = trades.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("q"))
    down = F.sqrt(F.col("q") / F.greatest(F.col("n") - 1, F.lit(1)))
    fit = F.col("n") >= 2
    return d.select(*keys, F.when(fit & (F.col("s") > 0), F.col("m") / F.col("s")).otherwise(0.0).alias("sharpe"), F.when(fit & (down > 0), F.col("m") / down).otherwise(0.0).alias("sortino"))


def step_metrics(steps: DataFrame, per_year: float, keys: Sequence[str] = ("symbol",), order: str = "open_time", equity: str = "equity", price: str = "close") -> DataFrame:
    """Metrics of an equity path by step: return, buy-and-hold return, alpha, drawdown, annualised ratios with n."""
    d = number_rows(steps.withColumnRenamed(equity, "_e"), order, keys)
    d = frames(d, lambda w: {"_q": F.lag("_e").over(w)}, 1, keys=keys)
    d = running(d.withColumn("_r", F.when(F.col("_q") > 0, (F.col("_e") - F.col("_q")) / F.col("_q")).when(F.col("_q").isNotNull(), 0.0)), {"_peak": ("max", F.col("_e"))}, keys)
    first, last = lambda c: F.min_by(c, "rn"), lambda c: F.max_by(c, "rn")
    m = d.groupBy(*keys).agg(
        first("_e").alias("e0"), last("_e").alias("e1"), first(price).alias("p0"), last(price).alias("p1"), F.max(F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("_e")) / F.col("_peak"))).alias("dd"),
        F.avg("_r").alias("m"), F.stddev_pop("_r").alias("s"), F.avg(F.pow(F.least(F.col("_r"), F.lit(0.0)), 2)).alias("q"),
    )
    c = F.col
    scale, down = F.sqrt(F.lit(per_year)), F.sqrt(c("q"))
    total, hold = ratio(c("e1") - c("e0"), c("e0")) * 100, ratio(c("p1") - c("p0"), c("p0")) * 100
    return m.select(
        *keys, c("e0").alias("initial_balance"), c("e1").alias("final_balance"), total.alias("total_return_pct"), hold.alias("buy_and_hold_return_pct"), (total - hold).alias("alpha"), (F.coalesce(c("dd"), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        F.when(c("s") >= 1e-12, c("m") / c("s") * scale).otherwise(0.0).alias("sharpe_ratio"), F.when(down >= 1e-12, c("m") / down * scale).otherwise(0.0).alias("sortino_ratio"),
    )


class Protection(ABC):
    """A rule that locks a pair. ``lock`` gives a struct (reason, until), or null, from columns of a pair's trades:
    ``stops``, ``pct`` (profits in percent, summed) and ``n`` of the time looked back on, and ``last``, its last exit."""

    @abstractmethod
    def lock(self, now: int) -> Column: ...


def _locked(when: Column, reason: str, until: Column) -> Column:
    return F.when(when, F.struct(F.lit(reason).alias("reason"), until.cast("long").alias("until")))


@dataclass(frozen=True)
class StoplossGuard(Protection):
    max_stops: int
    duration: int

    def lock(self, now: int) -> Column:
        return _locked(F.col("stops") >= self.max_stops, "StoplossGuard", F.lit(now + self.duration))


@dataclass(frozen=True)
class MaxDrawdownProtection(Protection):
    max_drawdown_pct: float
    duration: int

    def lock(self, now: int) -> Column:
        return _locked((F.col("pct") < 0) & (F.abs("pct") >= self.max_drawdown_pct), "MaxDrawdownProtection", F.lit(now + self.duration))


@dataclass(frozen=True)
class CooldownPeriod(Protection):
    duration: int

    def lock(self, now: int) -> Column:
        return _locked(now - F.col("last") < self.duration, "CooldownPeriod", F.col("last") + self.duration)


@dataclass(frozen=True)
class LowProfitPairs(Protection):
    min_profit_pct: float
    duration: int

    def lock(self, now: int) -> Column:
        return _locked((F.col("n") > 0) & (F.col("pct") < self.min_profit_pct), "LowProfitPairs", F.lit(now + self.duration))


def protect(trades: DataFrame, now: int, lookback: int, stack: Sequence[Protection]) -> DataFrame:
    """Locks (symbol, reason, until) of pairs at one time, by the first protection of the stack that holds. All times have one unit."""
    recent = F.col("exit_time") > now - lookback
    pct = F.round(F.sum(F.when(recent, F.col("profit_pct"))), 9)
    d = trades.groupBy("symbol").agg(F.count_if(recent & (F.col("exit_reason") == "Stoploss")).alias("stops"), pct.alias("pct"), F.count_if(recent).alias("n"), F.max("exit_time").alias("last"))
    if not stack:
        return d.select("symbol", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("until")).limit(0)
    return d.select("symbol", F.coalesce(*(p.lock(now) for p in stack)).alias("l")).where("l IS NOT NULL").select("symbol", "l.reason", "l.until")


def protections(trades: DataFrame, now: int, lookback: int, lock: int, max_stops: int = 3, max_drawdown_pct: float = 10.0, cooldown: int = 0, min_profit_pct: float = 0.0) -> DataFrame:
    """The usual stack: stop-loss guard, drawdown, cooldown, low profit."""
    return protect(trades, now, lookback, (StoplossGuard(max_stops, lock), MaxDrawdownProtection(max_drawdown_pct, lock), CooldownPeriod(cooldown), LowProfitPairs(min_profit_pct, lock)))


def episode_trades(trades: DataFrame, keys: Sequence[str] = ("symbol",), every: DataFrame | None = None) -> DataFrame:
    """Trade statistics of an episode: counts, gains, losses, how long trades were held, and fees.

    Gains without losses have an infinite profit factor. ``every`` has the keys
    of all episodes; one without trades has zeros.
    """
    c, p = F.col, _profit()
    won, lost = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))
    d = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count_if(p > 0).alias("winning_trades"), F.count_if(p < 0).alias("losing_trades"), won.alias("_won"), lost.alias("_lost"), F.greatest(F.max(p), F.lit(0.0)).alias("largest_win"), F.greatest(F.max(-p), F.lit(0.0)).alias("largest_loss"),
        F.avg("duration_candles").alias("avg_hold_duration"), F.sum("fee").alias("total_fees_paid"),
    )
    factor = F.when(c("_lost") > 0, c("_won") / c("_lost")).when(c("_won") > 0, F.lit(float("inf"))).otherwise(0.0)
    found = d.select(
        *keys, "total_trades", "winning_trades", "losing_trades", (c("winning_trades") / c("total_trades")).alias("win_rate"), factor.alias("profit_factor"), ratio(c("_won"), c("winning_trades")).alias("avg_win"), ratio(c("_lost"), c("losing_trades")).alias("avg_loss"),
        "largest_win", "largest_loss", "avg_hold_duration", "total_fees_paid",
    )
    if every is None:
        return found
    return every.select(*keys).distinct().join(found, list(keys), "left").fillna(0, found.columns[len(keys) :])


def stoploss_guard_history(trades: DataFrame, lookback: int, max_stops: int) -> DataFrame:
    """After each trade: stop-outs of its pair in the time before it, and whether the guard locks then.

    Stop-outs are counted from the start of the series; those of the time before
    a trade are the count at its time less the count at the time ``lookback`` earlier.
    Both hang on the symbol and the time only, so they are worked out once for each time.
    """
    c = F.col
    times = cut(trades.groupBy("symbol", "exit_time").agg(F.count_if(c("exit_reason") == "Stoploss").alias("_stops")))
    upto = cut(running(number_rows(times, "exit_time"), {"_upto": ("sum", c("_stops"))}).select("symbol", "exit_time", "_upto"))
    d = asof_join(upto.withColumn("_from", c("exit_time") - lookback), upto.select("symbol", c("exit_time").alias("_time"), c("_upto").alias("_before")), "_from", "_time", name="_earlier")
    count = c("_upto") - F.coalesce(c("_earlier._before"), F.lit(0))
    d = d.select("symbol", "exit_time", count.cast("long").alias("stops"), (count >= max_stops).alias("locked"))
    return trades.select("id", "symbol", "exit_time").join(d, ["symbol", "exit_time"]).select("id", "symbol", "exit_time", "stops", "locked")


def exposure(positions: DataFrame) -> DataFrame:
    """Total exposure, open positions and results."""
    return positions.agg(F.count("*").alias("open_trades"), F.coalesce(F.sum(F.col("quantity") * F.col("entry_price")), F.lit(0.0)).alias("total_exposure"), F.coalesce(F.sum("unrealized_pnl"), F.lit(0.0)).alias("unrealized_pnl"))


def pair_pnl(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(_sum(_profit()).alias("pnl"))


#: Quote currencies (fixed values).
QUOTES = ("USDT", "BUSD", "USDC", "BTC", "ETH", "BNB")


def quote_of(symbol: Column) -> Column:
    """The quote currency at the end of a symbol; the symbol itself if it has none."""
    found = F.regexp_extract(symbol, f"({'|'.join(QUOTES)})$", 1)
    return F.when(found != "", found).otherwise(symbol)


def quote_concentration(positions: DataFrame, most: int = 3) -> DataFrame:
    """Open positions by quote currency, and whether there are more than ``most``."""
    d = positions.groupBy(quote_of(F.col("symbol")).alias("quote")).agg(F.count("*").alias("positions"))
    return d.withColumn("too_correlated", F.col("positions") > most)

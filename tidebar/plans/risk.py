"""Stops, returns, leverage, order checks and sizes, as columns over positions and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sign(side: Column) -> Column:
    return F.when(side == "BUY", 1.0).otherwise(-1.0)


def fixed_stop(entry: Column, side: Column, pct: float | Column) -> Column:
    return entry * (1 - _sign(side) * pct)


def trailing_stop(price: Column, side: Column, atr: Column, multiplier: float) -> Column:
    return price - _sign(side) * multiplier * atr


def timed_stop(entry: Column, side: Column, pct: float, bars: Column, breakeven_after: int) -> Column:
    return F.when(bars >= breakeven_after, entry).otherwise(fixed_stop(entry, side, pct))


def profit_pct(entry: Column, side: Column, price: Column) -> Column:
    return _sign(side) * (price - entry) / entry


def stepped_stop(entry: Column, side: Column, price: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """The widest stop among the steps (profit, stop) whose profit is reached; null if none is."""
    gain = profit_pct(entry, side, price)
    reached = F.array_compact(F.array(*(F.when(gain >= p, F.lit(float(s))) for p, s in steps)))
    return F.when(F.size(reached) > 0, fixed_stop(entry, side, F.array_max(reached)))


def triggered(side: Column, stop: Column, price: Column) -> Column:
    return F.when(side == "BUY", price <= stop).otherwise(price >= stop)


def roi_reached(entry: Column, side: Column, price: Column, minutes: Column, table: Sequence[tuple[int, float]]) -> Column:
    """Whether any row (minutes, profit) of the table holds."""
    gain, hit = profit_pct(entry, side, price), F.lit(False)
    for after, pct in table:
        hit = hit | ((minutes >= after) & (gain >= pct))
    return hit


def margin(quantity: Column, price: Column, leverage: Column) -> Column:
    return F.when(leverage == 0, 0.0).otherwise(quantity * price / F.greatest(leverage, F.lit(1)))


def liquidation_price(entry: Column, side: Column, leverage: Column, mode: str = "Isolated") -> Column:
    """Where the margin is used up; cross margin counts 80 percent of the distance."""
    distance = F.lit(0.8 if mode == "Cross" else 1.0) / F.greatest(leverage, F.lit(1))
    return F.when(leverage == 0, 0.0).otherwise(entry * (1 - _sign(side) * distance))


def near_liquidation(entry: Column, side: Column, leverage: Column, price: Column, mode: str = "Isolated", buffer: float = 0.05) -> Column:
    at = liquidation_price(entry, side, leverage, mode)
    return F.when(at == 0, False).otherwise(_sign(side) * (price - at) / entry <= buffer)


def leveraged_pnl(entry: Column, exit_: Column, quantity: Column, side: Column) -> Column:
    return F.when(side == "BUY", exit_ - entry).otherwise(entry - exit_) * quantity


def valid_leverage(leverage: Column, most: int = 20) -> Column:
    return leverage.between(1, most)


def funding_fee(value: Column, rate: float) -> Column:
    return value * rate


def gate(permissions: Column, breaker: Column, quantity: Column, exposure: Column, bit: int, most_quantity: float, most_exposure: float) -> Column:
    """Permission bit (1 buy, 2 sell), no breaker, and limits that what is held now has not reached; the order's own size isn't added."""
    return (permissions.bitwiseAND(F.lit(bit)) > 0) & ~breaker & (quantity < most_quantity) & (exposure < most_exposure)


def check_orders(orders: DataFrame, positions: DataFrame, breaker: bool = False, most_open: int = 5, most_size: float = 10.0, most_exposure: float = 1_000_000.0) -> DataFrame:
    """Each order by itself against the positions: the first reason to reject it, null if approved.

    The book's totals are one row; positions meet orders by symbol.
    """
    book = positions.agg(F.count("*").alias("_open"), F.coalesce(F.sum(F.col("quantity") * F.col("entry_price")), F.lit(0.0)).alias("_exposure"))
    held = positions.select("symbol", F.col("side").alias("_side"), F.col("quantity").alias("_held"))
    d = orders.crossJoin(F.broadcast(book)).join(held, "symbol", "left")
    c = F.col
    size = F.when(c("_held").isNull(), c("quantity")).when(c("_side") == c("side"), c("quantity") + c("_held"))
    reason = (
        F.when(F.lit(breaker), "circuit breaker").when(c("_held").isNull() & (c("_open") >= most_open), "max open positions").when(size > most_size, "position size")
        .when(c("_exposure") + c("quantity") * c("price") > most_exposure, "total exposure")
    )
    return d.withColumn("rejected", reason).drop("_open", "_exposure", "_side", "_held")


def can_open(orders: DataFrame, positions: DataFrame, most_open: int = 5, most_pair: float = 20_000.0, most_total: float = 100_000.0) -> DataFrame:
    """Whether the portfolio takes each order: number of pairs, exposure of the pair, exposure of all."""
    book = positions.agg(F.countDistinct("symbol").alias("_open"), F.coalesce(F.sum(F.col("quantity") * F.col("entry_price")), F.lit(0.0)).alias("_exposure"))
    pair = positions.groupBy("symbol").agg(F.sum(F.col("quantity") * F.col("entry_price")).alias("_pair"))
    c, new = F.col, F.col("quantity") * F.col("price")
    d = orders.crossJoin(F.broadcast(book)).join(pair, "symbol", "left")
    fine = ~(c("_pair").isNull() & (c("_open") >= most_open)) & (F.coalesce("_pair", F.lit(0.0)) + new <= most_pair) & (c("_exposure") + new <= most_total)
    return d.withColumn("can_open", fine).drop("_open", "_exposure", "_pair")


def size_by_stop(balance: Column, entry: Column, stop_distance: Column, share: float = 0.02, most: float = 10.0) -> Column:
    """The size that loses ``share`` of the balance at the stop."""
    usable = (entry != 0) & (stop_distance != 0)
    return F.when(usable, F.least(balance * share / F.when(usable, stop_distance), F.lit(most))).otherwise(0.0)


def half_kelly_size(balance: Column, win_rate: Column, avg_win: Column, avg_loss: Column, entry: Column, most: float = 10.0) -> Column:
    usable = (avg_win != 0) & (entry != 0)
    kelly = F.when(usable, (win_rate * avg_win - (1 - win_rate) * avg_loss) / F.when(usable, avg_win))
    return F.when(usable & (kelly > 0), F.least(balance * kelly / 2 / F.when(usable, entry), F.lit(most))).otherwise(0.0)

"""Backtests: from actions to positions, trades, equity and statistics.

Which position is open follows from the few rows that carry an action: three
states, followed block by block. All money is then columns: with a fixed share
of the balance at risk, a trade multiplies the balance by a factor of its own,
so balances are running products. Kelly sizes depend on the results of earlier
trades; there a fold over the trades of a series, not its bars, follows them.

``keys`` tell series apart: symbols, or trials and symbols.

An action of bar i is filled at the close of bar i + 1. The entry fee and the
funding leave the balance and not the profit of the trade, and funding is in the
net profit once more, so the sum of profits isn't the change of the balance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reach import chain, first_reach
from ..operators.series import CHUNK, frames, number_rows, running, states
from ..shared import cut
from .analytics import ratio
from .features import quotient
from .strategies import Callbacks

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

EIGHT_HOURS = 8 * 3_600_000


@dataclass(frozen=True)
class BacktestConfig:
    initial_balance: float = 10_000.0
    fee_rate: float = 0.0004
    leverage: int = 1
    funding_rate: float = 0.0001
    size: float = 0.1


FLAT, LONG, SHORT = 0, 1, 2


def _next(state: Column, action: Column) -> Column:
    return F.when((state == FLAT) & (action == "EnterLong"), LONG).when((state == FLAT) & (action == "EnterShort"), SHORT).when(((state == LONG) & (action == "ExitLong")) | ((state == SHORT) & (action == "ExitShort")), FLAT).otherwise(state)


def open_positions(actions: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, trade, side, entry_rn, exit_rn) from rows (keys, rn, action): an entry counts only when flat, an exit only against its own side; exit_rn is null while open."""
    d = number_rows(actions.where("action IS NOT NULL").select(*keys, F.col("rn").alias("_at"), F.col("action").alias("event")), "_at", keys, span=4096)
    changes = states(d, FLAT, 3, _next, keys).where("was <> now").select(*keys, "_at", "now")
    # Entries and exits take turns, an entry first.
    changes = frames(number_rows(changes, "_at", keys, span=4096), lambda w: {"exit_rn": F.lead("_at").over(w)}, ahead=1, keys=keys)
    entries = changes.where(F.col("rn") % 2 == 1)
    return entries.select(*keys, F.floor((F.col("rn") + 1) / 2).alias("trade"), F.when(F.col("now") == LONG, "BUY").otherwise("SELL").alias("side"), F.col("_at").alias("entry_rn"), "exit_rn")


#: Why a position ends; of several reasons at one bar the first counts.
REASONS = ("StopLoss", "Roi", "Custom", "Signal")


def callback_positions(d: DataFrame, rules: Callbacks, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, trade, side, entry_rn, exit_rn, exit_reason) from numbered candles with ``action``, ``confidence`` and the trend of the rules.

    What a bar says is done at the close of the next one, entries and exits
    alike. A position looks at each closed bar from that of its entry on: at its
    stop, its return table, the trend, a signal to leave. An exit's own bar opens
    nothing. ``exit_rn`` is null while open.

    For each possible entry the first bar of each kind is searched, as if it were
    taken; the entries that are taken are those on the chain from the first one,
    each leading to the first entry after its exit.
    """
    c = F.col
    up, down = d.select(*keys, "rn", c("close").alias("value"), F.lit("up").alias("_way")), d.select(*keys, "rn", (-c("close")).alias("value"), F.lit("down").alias("_way"))
    last = d.groupBy(*keys).agg(F.max("rn").alias("_n"))
    wants = d.where(c("action").isin("EnterLong", "EnterShort") & (F.coalesce(c("confidence"), F.lit(0.0)) >= rules.min_confidence))
    fill = d.select(*keys, (c("rn") - 1).alias("rn"), c("close").alias("_price"), c("open_time").alias("_time"))
    e = wants.join(last, list(keys)).where(c("rn") < c("_n")).join(fill, [*keys, "rn"])
    e = number_rows(e.select(*keys, c("rn").alias("_seen"), "_price", "_time", F.when(c("action") == "EnterLong", "BUY").otherwise("SELL").alias("side")), "_seen", keys, span=4096).withColumnRenamed("rn", "_entry")
    buy, held = c("side") == "BUY", c("_seen") + 1
    # Where each row of the return table begins to hold.
    minutes = sorted({m for m, _ in rules.roi if m > 0})
    starts = e.select(*keys, "_entry", F.explode(F.array(*map(F.lit, minutes))).alias("_minutes"), held.alias("start"), (c("_time") + c("_minutes") * 60_000).cast("double").alias("level")) if minutes else None
    after = first_reach(starts, d.select(*keys, "rn", c("open_time").alias("value")), keys).where("at IS NOT NULL").select(*keys, "_entry", "_minutes", c("at").alias("_from")) if minutes else None
    ask = lambda x, kind, start, way, level: x.select(*keys, "_entry", F.lit(kind).alias("_kind"), start.cast("long").alias("start"), way.alias("_way"), level.alias("level"))
    sign = F.when(buy, 1.0).otherwise(-1.0)
    asked = [ask(e, "StopLoss", held + bars, F.when(buy, "down").otherwise("up"), -sign * c("_price") * (1 - sign * pct)) for bars, pct in rules.stops]
    for m, pct in rules.roi:
        x, start = (e, held) if m <= 0 else (e.join(after.where(c("_minutes") == m), [*keys, "_entry"]), c("_from"))
        asked.append(ask(x, "Roi", start, F.when(buy, "up").otherwise("down"), sign * c("_price") * (1 + sign * pct)))
    series = up.unionByName(down)
    flag = lambda name, when: d.select(*keys, "rn", F.when(when, 1.0).otherwise(0.0).alias("value"), F.lit(name).alias("_way"))
    for side, leave in (("BUY", "ExitLong"), ("SELL", "ExitShort")):
        against = [t for t, s in (rules.reversal or {}).items() if s == side]
        if against:
            series = series.unionByName(flag(f"Custom{side}", c(rules.trend).isin(against)))
        series = series.unionByName(flag(f"Signal{side}", c("action") == leave))
    for kind in ("Custom", "Signal"):
        asked.append(ask(e, kind, held, F.concat(F.lit(kind), c("side")), F.lit(1.0)))
    hits = first_reach(reduce(DataFrame.unionByName, asked), series, (*keys, "_way")).where("at IS NOT NULL")
    order = F.array_position(F.array(*map(F.lit, REASONS)), c("_kind"))
    ends = hits.groupBy(*keys, "_entry").agg(F.min(F.struct(c("at"), order.alias("_order"), "_kind")).alias("_end"))
    e = cut(e.join(ends, [*keys, "_entry"], "left").join(last, list(keys)))
    ended = c("_end.at") < c("_n")  # the last bar has no next one to leave at
    following = first_reach(e.select(*keys, "_entry", (c("_entry") + 1).alias("start"), F.when(ended, c("_end.at") + 1.0).otherwise(F.lit(float("inf"))).alias("level")), e.select(*keys, c("_entry").alias("rn"), c("_seen").alias("value")), keys)
    taken = chain(following.select(*keys, c("_entry").alias("rn"), c("at").alias("next")), keys).withColumnRenamed("rn", "_entry")
    t = number_rows(e.join(taken, [*keys, "_entry"]).select(*keys, "_seen", "side", F.when(ended, c("_end.at") + 1).alias("exit_rn"), F.when(ended, F.when(c("_end._kind") == "Custom", rules.reversal_reason).otherwise(c("_end._kind"))).alias("exit_reason")), "_seen", keys, span=4096)
    return t.select(*keys, c("rn").alias("trade"), "side", (c("_seen") + 1).alias("entry_rn"), "exit_rn", "exit_reason")


def priced_positions(d: DataFrame, config: BacktestConfig = BacktestConfig(), trials: DataFrame | None = None, positions: DataFrame | None = None, acts: DataFrame | None = None) -> DataFrame:
    """Trades with entry and exit bar, and their result in shares of the entry value: ``_net``, ``_funding``, ``_fee_rate``, ``_size``.

    ``trials`` is a small table with trial_id, fee_rate, size and min_volume (an
    action counts on bars of at least this volume); every trial sees all candles.
    """
    c = F.col
    facts = d.groupBy("symbol").agg(F.max("rn").alias("_n"), (F.max(F.when(c("rn") == 2, c("open_time"))) - F.min("open_time")).alias("_step"))
    facts = facts.select("symbol", "_n", F.greatest(F.floor(EIGHT_HOURS / F.greatest(F.coalesce("_step", F.lit(900_000)), F.lit(1))), F.lit(1)).alias("_every"))
    if positions is None:
        positions = _signalled(d, facts, trials, acts)
    t = positions.join(facts, "symbol").withColumn("exit_rn", F.coalesce("exit_rn", "_n"))
    if trials is not None:
        t = t.join(F.broadcast(trials.select("trial_id", c("fee_rate").alias("_fee_rate"), c("size").alias("_size"))), "trial_id")
    else:
        t = t.withColumns({"_fee_rate": F.lit(config.fee_rate), "_size": F.lit(config.size)})
    bar = lambda x: d.select("symbol", c("rn").alias(f"{x}_rn"), c("open_time").alias(f"{x}_time"), c("close").alias(f"{x}_price"))
    t = t.join(bar("entry"), ["symbol", "entry_rn"]).join(bar("exit"), ["symbol", "exit_rn"])
    move, held = quotient(c("exit_price"), c("entry_price")), c("exit_rn") - c("entry_rn")
    funding = F.floor(held / c("_every")) * config.funding_rate
    gain = F.when(c("side") == "BUY", move - 1).otherwise(1 - move)
    return t.withColumns({"_move": move, "_funding": funding, "_net": gain - move * c("_fee_rate") - funding})


def _signalled(d: DataFrame, facts: DataFrame, trials: DataFrame | None, acts: DataFrame | None = None) -> DataFrame:
    """Positions that only signals open and close; ``acts`` has those of each trial, else all trials share those of ``d``."""
    c, keys = F.col, ("symbol",)
    own = acts is not None
    acts = (acts if own else d.where("action IS NOT NULL")).join(facts, "symbol").where(c("rn") < c("_n"))
    if trials is not None:
        keys = ("trial_id", "symbol")
        acts = acts.join(F.broadcast(trials), "trial_id").where(c("volume") >= c("min_volume")) if own else acts.join(F.broadcast(trials), c("volume") >= c("min_volume"))  # one row a trial
    return open_positions(acts.select(*keys, (c("rn") + 1).alias("rn"), "action"), keys)


def _records(t: DataFrame, keys: tuple[str, ...], value: Column, config: BacktestConfig) -> DataFrame:
    """Trade records from priced positions with ``_balance`` and ``_factor``; ``value`` is what a trade puts in."""
    c = F.col
    return t.select(
        F.concat(F.lit("bt-"), c("trade").cast("string")).alias("id"), *keys, "trade", "side", "entry_rn", "exit_rn", "entry_time", "exit_time", "entry_price", "exit_price", quotient(value, c("entry_price")).alias("quantity"), (value * c("_net")).alias("profit"),
        (c("_net") * 100 * config.leverage).alias("profit_pct"), (c("exit_rn") - c("entry_rn")).alias("duration_candles"), (F.coalesce("exit_reason", F.lit("Signal")) if "exit_reason" in t.columns else F.lit("Signal")).alias("exit_reason"), F.lit(config.leverage).alias("leverage"), (value * (c("_fee_rate") + c("_move") * c("_fee_rate") + c("_funding"))).alias("fee"),
        c("_balance").alias("balance_before"), (c("_balance") * c("_factor")).alias("balance_after"), c("_every").alias("funding_every"),
    )


def backtest(d: DataFrame, config: BacktestConfig = BacktestConfig(), trials: DataFrame | None = None, rules: Callbacks | None = None, acts: DataFrame | None = None) -> DataFrame:
    """Trades from numbered candles with ``action``; a position still open is closed at the last bar.

    With ``rules`` a strategy's callbacks refuse entries and end positions.
    """
    c, keys = F.col, ("symbol",) if trials is None else ("trial_id", "symbol")
    positions = None
    if rules is not None:
        d = cut(d.select("symbol", "rn", "open_time", "close", "action", "confidence", *([rules.trend] if rules.reversal else [])))
        positions = callback_positions(d, rules).withColumn("exit_reason", F.coalesce("exit_reason", F.lit("ForceExit")))
        config = replace(config, size=config.size if rules.size is None else rules.size)
    share = c("_size") * config.leverage
    t = cut(priced_positions(d, config, trials, positions, acts).withColumn("_factor", 1 - share * c("_fee_rate") - share * c("_funding") + share * c("_net")))
    t = running(t.withColumn("rn", c("trade")), {"_all": ("product", c("_factor"))}, keys)
    t = frames(t, lambda w: {"_before": F.lag("_all", 1, 1.0).over(w)}, back=1, keys=keys).withColumn("_balance", c("_before") * config.initial_balance)
    return _records(t, keys, c("_balance") * share, config)


def kelly_backtest(d: DataFrame, config: BacktestConfig = BacktestConfig(), multiplier: float = 0.5, min_trades: int = 10, fallback: float = 0.02, most: float = 0.25) -> DataFrame:
    """Trades sized by the Kelly share of the trades before: ``fallback`` while they are few, nothing put in while the share isn't above zero."""
    import pandas as pd

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        balance, wins, losses, won, lost, out = config.initial_balance, 0, 0, 0.0, 0.0, []
        for trade, net, funding, fee in p.sort_values("trade")[["trade", "_net", "_funding", "_fee_rate"]].itertuples(index=False):
            n, size = wins + losses, fallback
            if n >= min_trades:
                share, gain, loss = wins / n, won / wins if wins else 0.0, lost / losses if losses else 0.0
                odds = gain / loss if loss > 0 else 999.0
                size = min(max(0.0, share - (1 - share) / odds) * multiplier, most) if gain > 0 else 0.0
            put = size * config.leverage
            factor = 1 - put * fee - put * funding + put * net
            out.append((p["symbol"].iloc[0], trade, size, balance, factor))
            profit = balance * put * net
            if size > 0:
                wins, losses = wins + (profit > 0), losses + (profit <= 0)
                won, lost = won + max(profit, 0.0), lost + max(-profit, 0.0)
            balance *= factor
        return pd.DataFrame(out, columns=["symbol", "trade", "_share", "_balance", "_factor"])

    t = cut(priced_positions(d, config))
    sized = t.select("symbol", "trade", "_net", "_funding", "_fee_rate").groupBy("symbol").applyInPandas(fold, "symbol string, trade long, _share double, _balance double, _factor double")
    t = t.join(sized, ["symbol", "trade"]).where("_share > 0")
    return _records(t, ("symbol",), F.col("_balance") * F.col("_share") * config.leverage, config)


def equity_path(d: DataFrame, trades: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Equity at each bar: the balance, less what the open position has paid, and its unrealised result."""
    c = F.col
    entries = trades.select("symbol", c("entry_rn").alias("rn"), F.struct("side", "entry_rn", "exit_rn", "entry_price", "balance_before", "balance_after", "funding_every").alias("_t"))
    x = running(d.select("symbol", "rn", "open_time", "close").join(entries, ["symbol", "rn"], "left"), {"_now": ("last", c("_t"))})
    p = lambda n: c(f"_now.{n}")
    share = config.size * config.leverage
    move = c("close") / p("entry_price")
    gain = F.when(p("side") == "BUY", move - 1).otherwise(1 - move)
    paid = share * (config.fee_rate + F.floor((c("rn") - p("entry_rn")) / p("funding_every")) * config.funding_rate)
    open_ = c("_now").isNotNull() & (c("rn") < p("exit_rn"))
    equity = F.when(open_, p("balance_before") * (1 - paid + share * gain)).when(c("_now").isNotNull(), p("balance_after")).otherwise(config.initial_balance)
    return x.select("symbol", "rn", "open_time", "close", equity.alias("equity"))


def backtest_stats(trades: DataFrame, config: BacktestConfig = BacktestConfig(), keys: tuple[str, ...] = ("symbol",), every: DataFrame | None = None) -> DataFrame:
    """Statistics by symbol: here only profits below zero are losses, the win rate is a fraction, 999 stands for gains without losses.

    ``every`` has the keys of all series; one without a trade has zeros and its initial balance.
    """
    c, p = F.col, F.col("profit")
    d = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count_if(p > 0).alias("winning_trades"), F.count_if(p < 0).alias("losing_trades"), F.max_by("balance_after", "trade").alias("final_balance"), F.avg("duration_candles").alias("avg_duration_candles"),
        F.max(p).alias("best_trade"), F.min(p).alias("worst_trade"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("_won"), F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0)).alias("_lost"), F.sum("fee").alias("total_fees"),
    )
    total = c("final_balance") - config.initial_balance
    found = d.select(
        *keys, "total_trades", "winning_trades", "losing_trades", ratio(c("winning_trades"), c("total_trades")).alias("win_rate"), total.alias("total_profit"), (total / config.initial_balance * 100).alias("total_profit_pct"), (total / c("total_trades")).alias("avg_profit"),
        "avg_duration_candles", "best_trade", "worst_trade", F.when(c("_lost") > 0, c("_won") / c("_lost")).when(c("_won") > 0, 999.0).otherwise(0.0).alias("profit_factor"), "total_fees", "final_balance",
    )
    if every is None:
        return found
    zeros = {n: 0 for n in found.columns if n not in keys} | {"final_balance": config.initial_balance}
    return every.select(*keys).distinct().join(found, list(keys), "left").fillna(zeros)


#: Orders and prices that a task of ``fills`` holds, more only where the span of one order has more.
PACK = 50_000


def fills(orders: DataFrame, prices: DataFrame, horizon: int, bucket: int = 3_600_000, pack: int = PACK) -> DataFrame:
    """First fill of each order on the prices of its symbol within ``horizon`` ms of its creation, null if there is none.

    Hours of a symbol are packed until they hold ``pack`` rows; orders of a pack
    meet the prices of its hours and of those that its last orders still see.
    There each order searches its first fill by jumps of powers of two, so no pair
    of an order and a price is ever made. A trailing stop follows the best price
    since the order; ``stop_price`` is its callback rate. Of prices at one time, a
    rise takes the highest, all else the lowest.
    """
    c = F.col
    hour = lambda time: F.floor(c(time) / bucket)
    o = orders.withColumn("_hour", hour("created_at"))
    p = prices.where("symbol IS NOT NULL AND timestamp IS NOT NULL").select("symbol", hour("timestamp").alias("_hour"), c("timestamp").cast("long").alias("timestamp"), c("price").cast("double").alias("now"))
    hours = o.groupBy("symbol", "_hour").agg(F.count("*").alias("_n"), F.lit(True).alias("_asks")).unionByName(p.groupBy("symbol", "_hour").agg(F.count("*").alias("_n"), F.lit(False).alias("_asks")))
    hours = hours.groupBy("symbol", "_hour").agg(F.sum("_n").alias("_n"), F.max("_asks").alias("_asks"))
    packs = cut(hours.withColumn("_pack", F.floor((F.sum("_n").over(W.partitionBy("symbol").orderBy("_hour")) - c("_n")) / pack)).where("_asks").select("symbol", "_hour", "_pack"))
    ahead = (bucket - 1 + horizon) // bucket
    seen = packs.select("symbol", F.explode(F.sequence("_hour", c("_hour") + ahead)).alias("_hour"), "_pack").distinct()
    o = o.join(packs.where("symbol IS NOT NULL AND _hour IS NOT NULL"), ["symbol", "_hour"], "left").drop("_hour")
    p = p.join(seen, ["symbol", "_hour"]).select("symbol", "_pack", "timestamp", "now")
    filled = {"filled_at": T.LongType(), "fill_price": T.DoubleType()}
    schema = T.StructType([*orders.schema.fields, *(T.StructField(n, kind) for n, kind in filled.items())])
    search = partial(_first_fills, horizon=horizon, columns=orders.columns)
    d = o.groupBy("symbol", "_pack").cogroup(p.groupBy("symbol", "_pack")).applyInArrow(search, schema)
    return d.withColumn("status", F.when(c("filled_at").isNotNull(), "Filled").otherwise("Open"))


def _first_fills(asked: pa.Table, held: pa.Table, horizon: int, columns: list[str]) -> pa.Table:
    """``asked`` with the time and price of the first fill of each order, from the prices of one symbol."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    number = lambda x: pc.cast(x, pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    text = lambda n: pc.fill_null(pc.cast(asked[n], pa.string()), "").to_numpy(zero_copy_only=False).astype(str)
    kind, buy, limit, stop = text("order_type"), text("side") == "BUY", number(asked["price"]), number(asked["stop_price"])
    created, known = pc.fill_null(asked["created_at"], 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(asked["created_at"]).to_numpy(zero_copy_only=False)
    time, now = held["timestamp"].to_numpy(zero_copy_only=False).astype(np.int64), number(held["now"])
    missing = pc.is_null(held["now"]).to_numpy(zero_copy_only=False)
    order = np.argsort(time, kind="stable")
    time, now, missing = time[order], np.where(np.isnan(now), np.inf, now)[order], missing[order]
    begins = np.flatnonzero(np.diff(time, prepend=time[:1] - 1)) if len(time) else np.zeros(0, int)
    time = time[begins]
    low = np.minimum.reduceat(now, begins) if len(time) else now
    high = np.maximum.reduceat(np.where(missing, -np.inf, now), begins) if len(time) else now
    start, end = np.searchsorted(time, created), np.searchsorted(time, created + horizon, "right")
    end = np.where(known, end, start)
    market, limited = kind == "Market", kind == "Limit"
    stops, takes = np.isin(kind, ("StopMarket", "StopLimit")), np.isin(kind, ("TakeProfitMarket", "TakeProfitLimit"))
    trailing = ~(market | limited | stops | takes)
    rises = np.where(stops | trailing, buy, ~buy) & ~market
    at, level = np.where(market, start, end), np.where(limited, limit, stop)
    for up, value in ((True, high), (False, -low)):
        to = np.where(up, level, -level)
        plain = np.flatnonzero((limited | stops | takes) & (rises == up))
        at[plain] = _first_at_least(value, start[plain], end[plain], to[plain])
        # A falling trail is a rising one of prices turned round.
        for rate in np.unique(stop[trailing & (buy == up)]):
            of = np.flatnonzero(trailing & (buy == up) & (stop == rate))
            at[of] = _first_rise(value, low if up else -high, start[of], end[of], 1 + rate if up else 1 - rate)
    hit = at < end
    place = np.where(hit, at, 0)
    price = np.where(rises, high[place], low[place]) if len(time) else np.zeros(len(at))
    lost = hit & np.isinf(price)  # null or not a number: only an order that takes any price meets it
    price = np.where(limited, limit, price)
    out = {"filled_at": pa.array(time[place] if len(time) else place, pa.int64(), mask=~hit), "fill_price": pa.array(price, pa.float64(), mask=~hit | lost)}
    return pa.table({n: asked[n] for n in columns} | out)


def _doubled(x: np.ndarray, join: Callable) -> Iterator[np.ndarray]:
    """``x`` joined over 1, 2, 4 rows and so on from each place on, as far as there are that many."""
    k = 1
    while len(x):
        yield x
        x, k = join(x[:-k], x[k:]), 2 * k


def _first_at_least(value: np.ndarray, start: np.ndarray, end: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on, before ``end``, with a value of at least ``level``; ``end`` if there is none."""
    import numpy as np

    at, tops = start.copy(), list(_doubled(value, np.maximum))
    for k in range(len(tops) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) <= end)
        passed = fits[~(tops[k][at[fits]] >= level[fits])]
        at[passed] += 1 << k
    return at


def _first_rise(high: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, factor: float) -> np.ndarray:
    """The first place from ``start`` on, before ``end``, whose ``high`` is at least ``factor`` times the least ``low`` since ``start``.

    A stretch has such a place if one rises from a low of the stretch itself or from the least one before it.
    """
    import numpy as np

    if factor < 0:  # then a lower low makes it harder
        rows = ((s, high[s:e] >= np.minimum.accumulate(low[s:e]) * factor) for s, e in zip(start, end))
        return np.array([s + (hit.argmax() if hit.any() else len(hit)) for s, hit in rows], np.int64)
    at, least = start.copy(), np.full(len(start), np.inf)
    tops, lows = list(_doubled(high, np.maximum)), list(_doubled(low, np.minimum))
    within = [high >= low * factor]
    for k in range(len(tops) - 1):
        n = len(tops[k + 1])
        within.append(within[k][:n] | within[k][1 << k :] | (tops[k][1 << k :] >= lows[k][:n] * factor))
    for k in range(len(tops) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) <= end)
        place = at[fits]
        passed = ~(within[k][place] | (np.isfinite(least[fits]) & (tops[k][place] >= least[fits] * factor)))
        least[fits[passed]] = np.minimum(least[fits[passed]], lows[k][place[passed]])
        at[fits[passed]] += 1 << k
    return at


def position_step(state: tuple, side: str, quantity: float, price: float) -> tuple[tuple, str]:
    """The position (signed quantity, entry price, realised result) after a fill, and what happened."""
    held, entry, realized = state
    signed = quantity if side == "BUY" else -quantity
    if held == 0 or held * signed > 0:
        total = held + signed
        entry = (abs(held) * entry + quantity * price) / abs(total) if total else entry
        return (total, entry, realized), "Increased" if held else "Opened"
    closed = min(abs(held), quantity)
    realized += closed * (price - entry) * (1 if held > 0 else -1)
    left = held + signed
    if left == 0:
        return (0.0, 0.0, realized), "Closed"
    return (left, entry, realized) if left * held > 0 else (left, price, realized), "Reduced" if left * held > 0 else "Flipped"


def position_events(fills_: DataFrame, size: int = CHUNK) -> DataFrame:
    """What each fill (symbol, seq, side, quantity, price) does to the position of its symbol.

    The quantity held at the start of a chunk is a running sum. Given that, a chunk
    takes the entry price e before it to a e + b and adds c e + d to the realised
    result: only these four, a row a chunk, are followed in order, and the chunks
    are then walked each alone.
    """
    import pandas as pd

    d = number_rows(fills_.select("symbol", "seq", "side", "quantity", "price"), "seq", span=4096).withColumn("_chunk", F.floor((F.col("rn") - 1) / size))
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    earlier = W.partitionBy("symbol").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    held = d.groupBy("symbol", "_chunk").agg(F.sum(signed).alias("_sum")).select("symbol", "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_held"))
    d = cut(d.join(held, ["symbol", "_chunk"]))
    rows = lambda p: p.sort_values("rn")[["side", "quantity", "price"]].itertuples(index=False)

    def compose(p: pd.DataFrame) -> pd.DataFrame:
        held, (a, b, c, d) = p["_held"].iloc[0], (1.0, 0.0, 0.0, 0.0)
        for side, quantity, price in rows(p):
            # The same step, of an entry price of a e + b: b goes through it, a is scaled or dropped with the old entry.
            (total, entry, gained), _ = position_step((held, b, 0.0), side, quantity, price)
            signed = quantity if side == "BUY" else -quantity
            if held == 0 or held * signed > 0:
                a *= abs(held) / abs(total) if total else 1.0
            else:
                c -= min(abs(held), quantity) * a * (1 if held > 0 else -1)
                a = a if total * held > 0 else 0.0
            held, b, d = total, entry, d + gained
        return pd.DataFrame([[p["symbol"].iloc[0], p["_chunk"].iloc[0], a, b, c, d]], columns=["symbol", "_chunk", "a", "b", "c", "d"])

    def follow(p: pd.DataFrame) -> pd.DataFrame:
        entry, realized, out = 0.0, 0.0, []
        for symbol, chunk, a, b, c, d in p.sort_values("_chunk")[["symbol", "_chunk", "a", "b", "c", "d"]].itertuples(index=False):
            out.append((symbol, chunk, entry, realized))
            entry, realized = a * entry + b, realized + c * entry + d
        return pd.DataFrame(out, columns=["symbol", "_chunk", "_entry", "_realized"])

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        state, out = tuple(p[["_held", "_entry", "_realized"]].iloc[0]), []
        for side, quantity, price in rows(p):
            state, event = position_step(state, side, quantity, price)
            out.append((event, *state))
        after = pd.DataFrame(out, columns=["event", "quantity", "entry_price", "realized_pnl"])
        after.insert(0, "seq", p["seq"].to_numpy())
        after.insert(0, "symbol", p["symbol"].to_numpy())
        return after

    maps = d.groupBy("symbol", "_chunk").applyInPandas(compose, "symbol string, _chunk long, a double, b double, c double, d double")
    starts = maps.groupBy("symbol").applyInPandas(follow, "symbol string, _chunk long, _entry double, _realized double")
    return d.join(starts, ["symbol", "_chunk"]).groupBy("symbol", "_chunk").applyInPandas(fold, "symbol string, seq long, event string, quantity double, entry_price double, realized_pnl double")


def position_quantities(fills_: DataFrame) -> DataFrame:
    """The signed quantity held after each fill: a running sum, whatever the prices."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    d = number_rows(fills_.select("symbol", "seq", signed.alias("_signed")), "seq", span=4096)
    return running(d, {"quantity": ("sum", F.col("_signed"))}).select("symbol", "seq", "quantity")


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Unrealised results at the prices known; positions without a price keep theirs."""
    d = positions.join(prices.select("symbol", F.col("price").alias("_now")), "symbol", "left")
    side = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    return d.withColumn("unrealized_pnl", F.when(F.col("_now").isNotNull(), (F.col("_now") - F.col("entry_price")) * F.col("quantity") * side).otherwise(F.col("unrealized_pnl"))).drop("_now")


def breaker(equity: DataFrame, initial: float, limit: float = 0.10, keys: tuple[str, ...] = ("symbol",), order: str = "open_time") -> DataFrame:
    """Whether the drawdown from the peak has ever reached the limit, at each point."""
    d = equity if "rn" in equity.columns else number_rows(equity, order, keys)
    d = running(d, {"peak": ("max", F.greatest("equity", F.lit(initial)))}, keys)
    down: Column = F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak") >= limit).otherwise(False)
    return running(d.withColumn("_hit", down.cast("int")), {"_ever": ("max", F.col("_hit"))}, keys).withColumn("breaker", F.col("_ever") == 1).drop("_hit", "_ever")

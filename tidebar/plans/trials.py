"""Parameter search: all trials go through one backtest, as a key beside the symbol."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import change_action, delta
from ..operators.series import frames, running
from ..shared import cut
from .learning import objective, rank_trials
from .simulation import BacktestConfig, backtest

#: What a trial may set: of the backtest, and of the strategy.
PARAMETERS = ("fee_rate", "size", "min_volume")
STRATEGY = ("window", "min_confidence")
#: Trials are a broadcast side; this many at most.
MOST_TRIALS = 10_000


def trial_table(params: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Trials (trial_id and any of ``PARAMETERS``) with what they don't set from ``config``; an unknown parameter is an error."""
    if unknown := set(params.columns) - {"trial_id", *PARAMETERS}:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    given = {"fee_rate": config.fee_rate, "size": config.size, "min_volume": 0.0}
    return params.select("trial_id", *(F.col(n).cast("double").alias(n) if n in params.columns else F.lit(given[n]).alias(n) for n in PARAMETERS))


def run_trials(d: DataFrame, params: DataFrame, config: BacktestConfig = BacktestConfig(), acts: DataFrame | None = None) -> DataFrame:
    """Metrics of each trial on numbered candles with ``action``: all symbols together, each with its own balance.

    ``acts`` (trial_id, symbol, rn, volume, action) has actions of each trial's own, in place of those of the candles.

    A trial without trades has zeros. The drawdown is the largest of any symbol, along its closed trades.
    """
    trials = _few(trial_table(params, config))
    t = backtest(d, config, trials, acts=acts)
    start = F.lit(config.initial_balance)
    t = running(t.withColumn("rn", F.col("trade")), {"_peak": ("max", F.greatest("balance_after", start))}, ("trial_id", "symbol"))
    by = t.groupBy("trial_id", "symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("profit") > 0).alias("w"), F.max_by("balance_after", "trade").alias("last"), F.max((F.col("_peak") - F.col("balance_after")) / F.col("_peak")).alias("down"),
        F.sum("profit_pct").alias("s"), F.sum(F.col("profit_pct") * F.col("profit_pct")).alias("q"), F.sum(F.greatest("profit", F.lit(0.0))).alias("won"), F.sum(F.greatest(-F.col("profit"), F.lit(0.0))).alias("lost"),
    )
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("q") - mean * F.sum("s"), F.lit(0.0)) / F.when(n > 1, n - 1))
    won, lost = F.sum("won"), F.sum("lost")
    factor = F.when(lost > 0, won / lost).when(won > 0, F.lit(sys.float_info.max)).otherwise(0.0)  # gains without losses are above all
    metrics = by.groupBy("trial_id").agg(n.alias("total_trades"), (F.sum("w") / n).alias("win_rate"), F.sum(F.col("last") - start).alias("total_profit"), F.max("down").alias("max_drawdown"), (mean / F.when(spread > 0, spread)).alias("sharpe_ratio"), factor.alias("profit_factor"))
    names = metrics.columns[1:]
    return trials.join(metrics, "trial_id", "left").fillna(0, names).select("trial_id", *PARAMETERS, *names)


def trial_signals(d: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Changes of the trend of volume delta on numbered candles, for all windows in one pass: rows with ``window``, ``action`` and ``confidence``."""
    c, sizes = F.col, sorted(set(windows))
    half = {n: n - 1 - n // 2 for n in sizes}
    x = d.select("symbol", "rn", "open_time", "close", "volume", delta().alias("_d"))

    def sums(w):
        over = lambda n: F.sum("_d").over(w.rowsBetween(-(n - 1), 0))
        return {f"_t{n}": F.when(c("rn") >= n, over(n)) for n in sizes} | {f"_h{n}": over(half[n]) if half[n] else F.lit(0.0) for n in sizes}

    x = frames(x, sums, max(sizes) - 1)
    trend = lambda n: F.when((c(f"_t{n}") > 0) & (c(f"_h{n}") > 0), "BULLISH").when((c(f"_t{n}") < 0) & (c(f"_h{n}") < 0), "BEARISH").when(c(f"_t{n}").isNotNull(), "NEUTRAL")
    x = x.withColumn("_all", F.array(*(F.struct(F.lit(n).alias("window"), trend(n).alias("now"), F.least(F.abs(f"_t{n}") / n, F.lit(1.0)).alias("confidence")) for n in sizes)))
    x = frames(x.select("symbol", "rn", "open_time", "close", "volume", "_all"), lambda w: {"_was": F.lag("_all").over(w)}, 1)
    x = x.select("symbol", "rn", "volume", "_was", F.posexplode("_all").alias("_i", "_one"))
    action = change_action(c("_one.now"), F.get("_was", c("_i"))["now"])
    return x.select("symbol", "rn", "volume", "_one.window", action.alias("action"), "_one.confidence").where("action IS NOT NULL")


def optimize_strategy(d: DataFrame, params: DataFrame, goal: str = "TotalReturn", config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Trials (trial_id with ``window``, ``min_confidence`` and any of ``PARAMETERS``) with their metrics and ``objective``, the best first.

    Signals are made once for each window and met by the trials that have it, by
    equality; entries below a trial's confidence or volume don't count.
    """
    params = cut(params)
    extra = params.select("trial_id", *(F.col(n).cast(t).alias(n) for n, t in zip(STRATEGY, ("int", "double"))))
    windows = [r[0] for r in extra.select("window").distinct().collect()]
    acts = trial_signals(d, windows).join(F.broadcast(_few(extra)), "window").where((F.col("confidence") >= F.col("min_confidence")) | ~F.col("action").startswith("Enter"))
    found = run_trials(d, params.drop(*STRATEGY), config, cut(acts.drop("window", "confidence", "min_confidence")))
    out = found.join(extra, "trial_id").withColumn("objective", objective(goal))
    return out.orderBy(F.col("objective").desc(), "trial_id")


def _few(trials: DataFrame) -> DataFrame:
    if (n := trials.count()) > MOST_TRIALS:
        raise ValueError(f"{n} trials, at most {MOST_TRIALS}")
    return trials


def optimize(d: DataFrame, params: DataFrame, loss: str = "profit", best: int | None = None, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Trials with their metrics, the best first."""
    return rank_trials(run_trials(d, params, config), loss, best)

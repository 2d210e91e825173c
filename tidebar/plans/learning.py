"""Learning on rows: returns and advantages, rewards, parameter search, samples, and linear models fitted by whole-table gradients."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import frames, number_rows, recurrence, running
from ..schemas import ACTIONS
from ..shared import cut
from .strategies import linear_scores, softmax

MASK = (1 << 64) - 1


def lcg(seed: int):
    """Numbers below 1 from a linear congruential generator (fixed constants); runs on the driver, 64-bit sums would overflow in SQL."""
    state = (seed + 1) & MASK
    while True:
        state = (state * 6_364_136_223_846_793_005 + 1) & MASK
        yield (state >> 11) / (1 << 53)


def episodes(d: DataFrame, keys: Sequence[str], step: str, done: str | None) -> DataFrame:
    """Numbered backwards inside each episode; a row that is done ends its own."""
    if done:
        d = number_rows(d, step, keys)
        d = running(d, {"_ends": ("sum", F.col(done).cast("long"))}, keys).withColumn("episode", F.col("_ends") - F.col(done).cast("long")).drop("rn", "_ends")
    else:
        d = d.withColumn("episode", F.lit(0).cast("long"))
    return number_rows(d.withColumn("_back", -F.col(step)), "_back", [*keys, "episode"])


def discounted_returns(d: DataFrame, gamma: float, keys: Sequence[str] = ("run_id",), step: str = "step", reward: str = "reward", done: str | None = None) -> DataFrame:
    d = episodes(d, keys, step, done)
    return recurrence(d, {"return": (gamma, F.col(reward))}, [*keys, "episode"]).drop("rn", "_back")


def advantages(d: DataFrame, gamma: float = 0.99, lam: float = 0.95, keys: Sequence[str] = ("run_id",), step: str = "step") -> DataFrame:
    """Generalised advantages from reward, value and done: what comes after a row that is done counts nothing."""
    d = episodes(d, keys, step, "done")
    d = frames(d, lambda w: {"_next": F.lag("value").over(w)}, 1, keys=[*keys, "episode"])
    delta = F.col("reward") + gamma * F.coalesce(F.col("_next"), F.lit(0.0)) - F.col("value")
    return recurrence(d, {"advantage": (gamma * lam, delta)}, [*keys, "episode"]).drop("rn", "_back", "_next")


@dataclass(frozen=True)
class Reward:
    hold_threshold: int = 20
    hold_rate: float = 0.001
    invalid_penalty: float = 0.1
    close_threshold: int = 50
    close_rate: float = 0.001
    fee_penalty: bool = True
    win_bonus: float = 0.0
    exposure_rate: float = 0.0
    exposure_threshold: float = 1.5
    hedge_bonus: float = 0.0
    drawdown_rate: float = 0.0

    def column(self) -> Column:
        """Reward of a step from columns invalid, action, closed_pnl and closed_bars (null unless a trade closed), fees, held_bars, exposure, hedged and drawdown."""
        c = F.col
        pnl = c("closed_pnl")
        trade = pnl - F.when(c("closed_bars") > self.close_threshold, self.close_rate * c("closed_bars")).otherwise(0.0) - (c("fees") if self.fee_penalty else F.lit(0.0)) + F.when(pnl > 0, pnl * self.win_bonus).otherwise(0.0)
        hold = F.when((c("action") == "Neutral") & (c("held_bars") > self.hold_threshold), -self.hold_rate * c("held_bars")).otherwise(0.0)
        extra = (
            -F.when(c("exposure") > self.exposure_threshold, self.exposure_rate * (c("exposure") - self.exposure_threshold)).otherwise(0.0)
            + F.when(c("hedged"), self.hedge_bonus * c("exposure") / 2).otherwise(0.0)
            - F.when(c("drawdown") > 0, self.drawdown_rate * c("drawdown")).otherwise(0.0)
        )
        return F.when(c("invalid"), -self.invalid_penalty).otherwise(F.coalesce(trade, F.lit(0.0)) + hold + extra)


def momentum_rollout(d: DataFrame, fee: float = 0.0, slippage: float = 0.0, size: float = 1.0, balance: float = 10_000.0, take: float = 0.03, stop: float = -0.02, longest: int = 10) -> DataFrame:
    """Steps of the baseline policy on numbered candles: long whenever flat after the first bar, out at a loss, a gain or after some bars.

    The policy looks at its own position, so a series is a small grouped fold; rewards are columns of the result.
    """
    import pandas as pd

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        entry, since, money, peak, out = None, 0, balance, balance, []
        for rn, price in p.sort_values("rn")[["rn", "close"]].itertuples(index=False):
            step, closed, bars, action = rn - 1, None, None, "Neutral"
            if entry is None:
                if step > 0:
                    action, entry, since = "EnterLong", price * (1 + slippage), step
            else:
                gain = (price - entry) / entry
                if gain < stop or gain > take or step - since > longest:
                    action, closed, bars = "ExitLong", (price * (1 - slippage) - entry) / entry, step - since
                    money += closed * money * size - 2 * fee * money * size
                    entry = None
            gain = 0.0 if entry is None else (price - entry) / entry
            equity = money + gain * money * size
            peak = max(peak, equity)
            out.append((p["symbol"].iloc[0], rn, action, closed, bars, 2 * fee, 0 if entry is None else step - since, 0.0 if entry is None else size, (peak - equity) / peak if peak > 0 else 0.0, money, equity, price))
        return pd.DataFrame(out, columns=["symbol", "rn", "action", "closed_pnl", "closed_bars", "fees", "held_bars", "exposure", "drawdown", "balance", "equity", "close"]).astype({"closed_pnl": "float64", "closed_bars": "Int64"})

    steps = d.select("symbol", "rn", "close").groupBy("symbol").applyInPandas(fold, "symbol string, rn long, action string, closed_pnl double, closed_bars long, fees double, held_bars long, exposure double, drawdown double, balance double, equity double, close double")
    return steps.withColumns({"invalid": F.lit(False), "hedged": F.lit(False)})


def grid(spark: SparkSession, ranges: dict[str, Sequence[float]]) -> DataFrame:
    """Every combination of the values."""
    d = spark.range(1).select()
    for name, values in ranges.items():
        d = d.crossJoin(spark.createDataFrame([(float(v),) for v in values], f"{name} double"))
    return d


def spread(low: float, high: float, steps: int) -> list[float]:
    return [low] if steps <= 1 else [low + (high - low) * i / (steps - 1) for i in range(steps)]


def random_grid(spark: SparkSession, ranges: dict[str, tuple[float, float] | Sequence], trials: int, seed: int = 42) -> DataFrame:
    """Trials with values drawn between two bounds, or from a list of more than two."""
    numbers = lcg(seed)
    rows = []
    for trial in range(trials):
        draw = [(r[0] + (r[1] - r[0]) * next(numbers)) if len(r) == 2 else float(r[int(next(numbers) * len(r))]) for r in ranges.values()]
        rows.append((trial, *map(float, draw)))
    return spark.createDataFrame(rows, "trial_id long, " + ", ".join(f"{n} double" for n in ranges))


#: Smaller is better. The loss named after Sortino uses the Sharpe ratio too.
LOSSES: dict[str, Callable[[], Column]] = {"sharpe": lambda: -F.col("sharpe_ratio"), "sortino": lambda: -F.col("sharpe_ratio"), "profit": lambda: -F.col("total_profit"), "win_rate": lambda: -F.col("win_rate"), "drawdown": lambda: F.col("max_drawdown")}


#: Larger is better (fixed names).
OBJECTIVES = {"TotalReturn": "total_profit", "SharpeRatio": "sharpe_ratio", "ProfitFactor": "profit_factor", "WinRate": "win_rate"}


def objective(name: str) -> Column:
    """What a named objective asks for; an unknown name is an error."""
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective: {name}")
    return F.col(OBJECTIVES[name])


def rank_trials(trials: DataFrame, loss: str, best: int | None = None) -> DataFrame:
    d = trials.withColumn("loss", LOSSES[loss]()).orderBy("loss", "trial_id")
    return d.limit(best) if best else d


def sample_episodes(spark: SparkSession, sizes: dict[str, int], count: int, seed: int, least: int = 10, most: int = 1000) -> DataFrame:
    """(symbol, run_id, start_rn, length) of random stretches; a short series is taken whole. One driver row an episode."""
    rows = []
    for symbol, n in sorted(sizes.items()):
        for i in range(count):
            numbers = lcg(seed + i)
            if n <= least:
                rows.append((symbol, i, 1, n))
                continue
            top, low = min(most, n), min(least, most, n)
            length = low + int(next(numbers) * (top - low)) if top > low else low
            rows.append((symbol, i, 1 + (int(next(numbers) * (n - length)) if n > length else 0), length))
    return spark.createDataFrame(rows, "symbol string, run_id long, start_rn long, length long")


def episode_rows(d: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of each episode; only places of rows are made, then met by key."""
    places = sample.select("symbol", "run_id", "start_rn", F.explode(F.sequence("start_rn", F.col("start_rn") + F.col("length") - 1)).alias("rn"))
    return places.join(d, ["symbol", "rn"]).withColumn("step", F.col("rn") - F.col("start_rn")).drop("start_rn")


def prioritized_sample(d: DataFrame, draws: int, seed: int, alpha: float = 0.6, order: str = "step", ties: Sequence[str] = ()) -> DataFrame:
    """Rows drawn with weight (|priority| + 1e-6)^alpha: each draw falls into one row's stretch of the running sum."""
    from ..operators.asof import asof_join

    one = F.lit("").alias("_all")
    x = number_rows(d.select("*", one), order, ["_all"], ties, span=4096)
    x = cut(running(x, {"_to": ("sum", F.pow(F.abs("priority") + 1e-6, F.lit(alpha)))}, ["_all"]))
    scale = 1 << 40
    total = x.agg(F.max("_to")).first()[0]
    numbers = lcg(seed)
    points = d.sparkSession.createDataFrame([("", i, int(next(numbers) * scale)) for i in range(draws)], "_all string, draw long, at long")
    starts = x.withColumn("_from", F.ceil((F.col("_to") - F.pow(F.abs("priority") + 1e-6, F.lit(alpha))) / total * scale).cast("long"))
    keep = [c for c in d.columns]
    return asof_join(points, starts.select("_all", "_from", *keep), "at", "_from", keys=("_all",), name="row").select("draw", *(f"row.{c}" for c in keep))


def replay_ring(d: DataFrame, capacity: int, order: str = "step", ties: Sequence[str] = ()) -> DataFrame:
    """What a ring of ``capacity`` places holds after all rows were pushed in order: ``slot`` is the place, the oldest rows are gone."""
    x = number_rows(d.select("*", F.lit("").alias("_all")), order, ["_all"], ties, span=4096)
    n = x.agg(F.max("rn")).first()[0] or 0
    return x.where(F.col("rn") > n - capacity).withColumn("slot", (F.col("rn") - 1) % capacity).drop("_all", "rn")


def replay_uniform(ring: DataFrame, draws: int, seed: int) -> DataFrame:
    """A batch of at most ``draws`` rows of a ring, drawn with replacement; one driver row a draw."""
    n = ring.count()
    numbers = lcg(seed)
    points = ring.sparkSession.createDataFrame([(i, int(next(numbers) * n) % n) for i in range(min(draws, n))], "draw long, slot long")
    return points.join(ring, "slot")


def replay_updated(ring: DataFrame, updates: DataFrame) -> DataFrame:
    """The ring with the priorities that ``updates`` (version, slot, priority) give last; places that it doesn't have are left out."""
    last = updates.groupBy("slot").agg(F.max_by("priority", "version").alias("_new"))
    return ring.join(last, "slot", "left").withColumn("priority", F.coalesce("_new", "priority")).drop("_new")


def fit_softmax(d: DataFrame, features: Sequence[str], label: str = "label", rate: float = 0.1, epochs: int = 20) -> tuple[list[list[float]], DataFrame]:
    """Weights of a linear model by gradients over the whole table: one aggregation an epoch, whose result is one number a weight.

    Labels above 0 mean EnterLong, below 0 EnterShort, else Neutral; rows without a label are left out.
    """
    target = F.when(F.col(label) > 0, 1).when(F.col(label) < 0, 3).otherwise(0)
    x = cut(d.where(F.col(label).isNotNull()).select(F.array(*(F.col(f).cast("double") for f in features)).alias("x"), target.alias("y")))
    weights = [[0.0] * len(features) for _ in ACTIONS]
    n = max(1, x.count())
    for _ in range(epochs):
        p = x.withColumn("s", linear_scores(F.col("x"), weights)).withColumn("p", softmax(F.col("s")))
        grads = [F.sum((F.when(F.col("y") == a, 1.0).otherwise(0.0) - F.col("p")[a]) * F.col("x")[j]) for a in range(len(ACTIONS)) for j in range(len(features))]
        row = p.agg(*(g.alias(f"g{i}") for i, g in enumerate(grads))).first()
        weights = [[w + rate * (row[a * len(features) + j] or 0.0) / n for j, w in enumerate(ws)] for a, ws in enumerate(weights)]
    p = x.withColumn("s", linear_scores(F.col("x"), weights)).withColumn("p", softmax(F.col("s")))
    hit = F.array_position("s", F.array_max("s")) - 1 == F.col("y")
    return weights, p.agg(F.count("*").alias("samples"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(-F.log(F.greatest(F.element_at("p", F.col("y") + 1), F.lit(1e-10)))).alias("loss"))


def clipped_objective(epsilon: float = 0.2) -> Column:
    """The clipped surrogate of a step from new_log_prob, log_prob and advantage."""
    r, a = F.exp(F.col("new_log_prob") - F.col("log_prob")), F.col("advantage")
    return F.least(r * a, F.greatest(F.lit(1 - epsilon), F.least(r, F.lit(1 + epsilon))) * a)


def entropy(probabilities: Column) -> Column:
    return F.aggregate(F.transform(probabilities, lambda p: F.when(p > 1e-10, -p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)

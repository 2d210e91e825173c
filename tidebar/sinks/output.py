"""Results as files, messages and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reach import chain, first_reach
from ..operators.series import CHUNK, number_rows
from ..schemas import CANDLE_FILE


def candle_rows(candles: DataFrame) -> DataFrame:
    """Rows as in candle files: decimals as text."""
    return candles.select("symbol", *(F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDLE_FILE))


def save_candles(candles: DataFrame, path: str) -> None:
    """One folder a symbol, JSON lines."""
    candle_rows(candles).write.mode("overwrite").partitionBy("symbol").json(path)


def analyzed(candle: Column, indicators: dict[str, Column], signals: Column) -> Column:
    """The message of an analysed bar as JSON: candle, indicators by name, signals."""
    pairs = [x for k, v in indicators.items() for x in (F.lit(k), v.cast("double"))]
    return F.to_json(F.struct(candle.alias("candle"), F.create_map(*pairs).alias("indicators"), signals.alias("signals")))


def notification(template: str, values: dict[str, Column]) -> Column:
    """A text with {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def should_notify(actions: tuple[str, ...] = (), min_profit: float = 0.0, min_confidence: float = 0.0, quiet: tuple[int, int] | None = None) -> Column:
    """Predicate over action, profit, confidence (null passes) and timestamp; quiet hours are UTC, the end excluded, and may go over midnight."""
    c = F.col
    fine = F.lit(True) if not actions else c("action").isin(list(actions))
    fine = fine & F.coalesce(F.abs("profit") >= min_profit, F.lit(True)) & F.coalesce(c("confidence") >= min_confidence, F.lit(True))
    if quiet:
        start, end = quiet
        hour = F.hour(F.timestamp_millis("timestamp"))
        inside = (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
        fine = fine & ~inside
    return fine


def with_cooldown(d: DataFrame, cooldown: int, keys: tuple[str, ...] = ("symbol",), time: str = "timestamp", size: int = CHUNK) -> DataFrame:
    """Rows that are sent: none sooner than ``cooldown`` ms after the last one that was.

    Each row points to the first one at least a cooldown later; what is sent is
    the chain of these pointers from the first row on.
    """
    rows = number_rows(d, time, keys)
    later = first_reach(rows.select(*keys, F.col("rn").alias("_of"), (F.col("rn") + 1).alias("start"), (F.col(time) + cooldown).cast("double").alias("level")), rows.select(*keys, "rn", F.col(time).alias("value")), keys, size)
    sent = chain(later.select(*keys, F.col("_of").alias("rn"), F.col("at").alias("next")), keys, size)
    return rows.join(sent, [*keys, "rn"]).select(*d.columns)


def chart(candles: DataFrame, indicators: list[str], most: int = 5000, times: str = "open_time") -> dict:
    """The last ``most`` bars of one symbol as the data of a chart; this is a display of a bounded number of rows."""
    rows = candles.orderBy(F.col(times).desc()).limit(most).select(times, "open", "high", "low", "close", "volume", *indicators).collect()[::-1]
    return {"candles": [r.asDict() for r in rows], "indicators": {n: [[r[times], r[n]] for r in rows if r[n] is not None] for n in indicators}}


def chart_html(data: dict, title: str) -> str:
    """A page that draws the closes as a line, without any library."""
    closes = [c["close"] for c in data["candles"]]
    low, high = min(closes, default=0.0), max(closes, default=1.0)
    points = " ".join(f"{i * 1000 / max(1, len(closes) - 1):.1f},{300 - (c - low) / ((high - low) or 1) * 300:.1f}" for i, c in enumerate(closes))
    return f'<!doctype html><title>{title}</title><svg viewBox="0 0 1000 300"><polyline fill="none" stroke="#246" points="{points}"/></svg><script type="application/json">{json.dumps(data)}</script>'


def save_report(data: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data))


def comparison(results: dict[str, dict], order: tuple[str, ...] = ("3m", "15m", "1h", "4h")) -> str:
    """A table of results by timeframe, shortest first."""
    known = sorted(results, key=lambda k: order.index(k) if k in order else len(order))
    return "\n".join([f"{'timeframe':<10}{'trades':>8}{'profit':>14}{'win rate':>10}", *(f"{k:<10}{results[k]['total_trades']:>8}{results[k]['total_profit']:>14.2f}{results[k]['win_rate'] * 100:>9.1f}%" for k in known)])

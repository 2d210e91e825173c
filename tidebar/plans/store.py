"""The trade store: filtered history, keyed upserts, audit log and dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXIT_REASONS, ORDER_STATUSES, ORDER_TYPES, SIDES, TIMES_IN_FORCE, parsed


def trade_history(trades: DataFrame, since: int | None = None, until: int | None = None, symbol: str | None = None) -> DataFrame:
    """Trades by optional bounds (inclusive) and symbol, latest exit first; the filters reach the scan."""
    for wanted, rule in ((since, lambda v: F.col("exit_time") >= v), (until, lambda v: F.col("exit_time") <= v), (symbol, lambda v: F.col("symbol") == v)):
        if wanted is not None:
            trades = trades.where(rule(wanted))
    return trades.orderBy(F.col("exit_time").desc(), "id")


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The last version of each key, by an aggregation rather than a sort of each key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    d = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, F.struct(*rest))).alias("_r"))
    return d.select(*keys, "_r.*").select(rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """``table`` with the rows of ``changes`` put in by key."""
    if version:
        changes = latest(changes, keys, version)
    return table.join(changes.select(*keys), list(keys), "left_anti").select(table.columns).unionByName(changes.select(table.columns))


def delete(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys), list(keys), "left_anti").select(table.columns)


def orders_by_status(orders: DataFrame, status: str) -> DataFrame:
    return orders.where(F.col("status") == status)


def audit_log(audit: DataFrame, limit: int = 100) -> DataFrame:
    return audit.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)


def retryable(letters: DataFrame, now: int, limit: int) -> DataFrame:
    """Open letters whose time has come, the earliest first."""
    open_ = ~F.col("resolved") & (F.col("retry_count") < F.col("max_retries")) & (F.col("next_retry_at") <= now)
    return letters.where(open_).orderBy("next_retry_at", "id").limit(limit)


def backoff(now: int, retries: Column) -> Column:
    """The next try: a minute, doubled for each one before."""
    return F.lit(now) + F.lit(60_000) * F.pow(F.lit(2.0), retries).cast("long")


def retried(letters: DataFrame, now: int) -> DataFrame:
    return letters.withColumns({"next_retry_at": backoff(now, F.col("retry_count")), "retry_count": F.col("retry_count") + 1})


def resolved(letters: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return letters.join(hit, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_hit", F.lit(False))).drop("_hit").select(letters.columns)


def counts(trades: DataFrame, signals: DataFrame, letters: DataFrame) -> DataFrame:
    """One row with the counters of the store."""
    t = trades.agg(F.count("*").alias("trade_count"), F.count_if(F.col("profit") > 0).alias("wins"), F.count_if(F.col("profit") <= 0).alias("losses"), (F.coalesce(F.sum(F.round(F.col("profit") * 100).cast("long")), F.lit(0)) / 100.0).alias("total_realized_pnl"))
    return t.crossJoin(signals.agg(F.count("*").alias("signal_count"))).crossJoin(letters.agg(F.count_if(~F.col("resolved")).alias("dead_letter_count")))


def read_back(rows: DataFrame) -> DataFrame:
    """Stored text as known values, with the defaults for text that isn't known."""
    rules = {"side": (SIDES, "SELL"), "order_type": (ORDER_TYPES, "Market"), "status": (ORDER_STATUSES, "Pending"), "time_in_force": (TIMES_IN_FORCE, None), "exit_reason": (EXIT_REASONS, "Signal")}
    return rows.withColumns({c: parsed(F.col(c), *rule) for c, rule in rules.items() if c in rows.columns})


#: Versions of the schema: (version, name, table, columns added).
MIGRATIONS = ((1, "initial_schema"), (2, "add_audit_log"), (3, "add_dead_letters"))


def pending_migrations(applied: DataFrame) -> list[tuple[int, str]]:
    """Migrations above the highest version applied."""
    now = applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v
    return [m for m in MIGRATIONS if m[0] > now]

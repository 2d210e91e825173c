"""Structured Streaming: bars from ticks with watermarks or by arrival, signals over the last bars, orders with a cooldown, positions; all kept in state by symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.simulation import position_step
from ..shared import checkpoints

if TYPE_CHECKING:
    import pandas as pd


def bars(ticks: DataFrame, interval: int, delay: str = "0 seconds", tie: str | None = None) -> DataFrame:
    """Bars from a stream of ticks (with ``timestamp`` in ms), each given out once the watermark has passed its end.

    Late ticks go to their own bar, or are dropped once it is out.
    """
    t = ticks.withColumn("_time", F.timestamp_millis("timestamp")).withWatermark("_time", delay)
    order = F.struct("timestamp", *([tie] if tie else []))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("quantity")).otherwise(0.0))
    d = t.groupBy("symbol", F.window("_time", f"{interval} milliseconds")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"), F.count("*").alias("trades"), of("BUY").alias("taker_buy_volume"), of("SELL").alias("taker_sell_volume"),
    )
    start = F.unix_millis("window.start")
    return d.select("symbol", start.alias("open_time"), (start + interval - 1).alias("close_time"), "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_volume", "taker_sell_volume")


#: Rows that ``positions`` gives out at a time.
SLICE = 10_000


def positions(fills: DataFrame) -> DataFrame:
    """Position events from a stream of fills (symbol, seq, side, quantity, price); the position of a symbol is its state."""
    import numpy as np
    import pandas as pd

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0.0, 0.0, 0.0)
        # A batch may hold a whole table, so it is kept as arrays of numbers and given out in slices.
        slim = [(p["seq"].to_numpy("int64"), (p["side"] == "BUY").to_numpy(), p["quantity"].to_numpy(float), p["price"].to_numpy(float)) for p in parts if len(p)]
        columns = [np.concatenate(c) for c in zip(*slim)]
        del slim
        order = np.argsort(columns[0], kind="stable")
        for i in range(0, len(order), SLICE):
            out = []
            for seq, buy, quantity, price in zip(*(c[order[i : i + SLICE]].tolist() for c in columns)):
                now, event = position_step(now, "BUY" if buy else "SELL", quantity, price)
                out.append((key[0], seq, event, *now))
            yield pd.DataFrame(out, columns=["symbol", "seq", "event", "quantity", "entry_price", "realized_pnl"])
        state.update(now)

    return fills.groupBy("symbol").applyInPandasWithState(step, "symbol string, seq long, event string, quantity double, entry_price double, realized_pnl double", "held double, entry double, realized double", "append", GroupStateTimeout.NoTimeout)


#: Keeps the state of ``transformWithStateInPandas``.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_volume double, taker_sell_volume double"


def sliding(bars_: DataFrame, decide: Callable, outputs: str, size: int = 200) -> DataFrame:
    """What ``decide`` says about each bar of a stream and the ``size`` - 1 bars before it, by symbol.

    ``decide`` takes these bars, oldest first, as a dict of numpy arrays and gives
    a tuple of the columns ``outputs``, or None. The last bars are a list in the
    state, so a restart goes on where the checkpoint stands.
    """
    schema, bar = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("close_time", T.LongType()), *T._parse_datatype_string(outputs).fields]), T.StructType([f for f in T._parse_datatype_string(BAR).fields if f.name != "symbol"])
    names = bar.names

    class Sliding(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getListState("last", bar)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            held = pd.DataFrame(list(self.last.get()), columns=names)
            new = pd.concat(list(rows))[names].sort_values("open_time")
            every = pd.concat([held, new]) if len(held) else new
            columns, out = {n: every[n].to_numpy() for n in names}, []
            for i in range(len(held), len(every)):
                said = decide({n: v[max(0, i + 1 - size) : i + 1] for n, v in columns.items()})
                if said is not None:
                    out.append((key[0], int(columns["close_time"][i]), *said))
            self.last.put([tuple(f.item() if hasattr(f, "item") else f for f in r) for r in every.tail(size).itertuples(index=False)])
            yield pd.DataFrame(out, columns=schema.names)

        def close(self) -> None:
            pass

    return bars_.groupBy("symbol").transformWithStateInPandas(Sliding(), schema, "Append", "None")


def cvd_signal(window: int = 15, min_confidence: float = 0.6) -> Callable:
    """The momentum strategy over the bars of a sliding buffer: action, confidence and their volume-weighted price."""

    def decide(b: dict) -> tuple | None:
        if len(b["close"]) < window:
            return None
        delta = (b["taker_buy_volume"] - b["taker_sell_volume"])[-window:]
        half = window - 1 - window // 2
        total, part = float(delta.sum()), float(delta[window - half :].sum())
        confidence = min(abs(total) / window, 1.0)
        if total * part <= 0 or confidence < min_confidence:
            return None
        typical = (b["high"] + b["low"] + b["close"]) / 3
        return "EnterLong" if total > 0 else "EnterShort", confidence, float((typical * b["volume"]).sum() / b["volume"].sum())

    return decide


def bars_by_arrival(ticks: DataFrame, interval: int, order: str, idle: int | None = None) -> DataFrame:
    """Bars of a stream of ticks in order of arrival (``order``): a tick of an earlier bar is merged into the one that is forming.

    A bar goes out when a tick of a later one arrives, or after ``idle`` ms without any tick, by a timer.
    """
    fields = T._parse_datatype_string(BAR).fields
    bar = T.StructType([f for f in fields if f.name != "symbol"])

    class Forming(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.bar = handle, handle.getValueState("bar", bar)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            now, out = list(self.bar.get()) if self.bar.exists() else None, []
            for time, price, quantity, side in pd.concat(list(rows)).sort_values(order)[["timestamp", "price", "quantity", "side"]].itertuples(index=False):
                start = int(time) // interval * interval
                if now is not None and start > now[0]:
                    out.append((key[0], *now))
                    now = None
                if now is None:
                    now = [start, start + interval - 1, price, price, price, price, 0.0, 0.0, 0, 0.0, 0.0]
                now[3], now[4], now[5] = max(now[3], price), min(now[4], price), price
                now[6], now[7], now[8] = now[6] + quantity, now[7] + price * quantity, now[8] + 1
                now[9 if side == "BUY" else 10] += quantity
            self.bar.update(tuple(now))
            if idle is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle)
            yield pd.DataFrame(out, columns=[f.name for f in fields])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            import pandas as pd

            out = [(key[0], *self.bar.get())] if self.bar.exists() else []
            self.bar.clear()
            yield pd.DataFrame(out, columns=[f.name for f in fields])

        def close(self) -> None:
            pass

    return ticks.groupBy("symbol").transformWithStateInPandas(Forming(), BAR, "Append", "None" if idle is None else "ProcessingTime")


def orders(events: DataFrame, cooldown: int, order: str) -> DataFrame:
    """Orders (symbol, timestamp, price) from a stream of signals and prices (symbol, timestamp, is_signal, price).

    An order is made for a signal at least ``cooldown`` ms after the last order of
    its symbol, at the last price seen (null before the first); both are state, so
    neither a micro-batch nor a restart begins anew.
    """
    fields = "symbol string, timestamp long, price double"
    kept = T._parse_datatype_string("sent long, price double")

    class Orders(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.now = handle.getValueState("now", kept)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            sent, price = self.now.get() if self.now.exists() else (None, None)
            out = []
            for time, signal, seen in pd.concat(list(rows)).sort_values(order)[["timestamp", "is_signal", "price"]].itertuples(index=False):
                if not signal:
                    price = float(seen)
                elif sent is None or time - sent >= cooldown:
                    sent = int(time)
                    out.append((key[0], sent, price))
            self.now.update((sent, price))
            yield pd.DataFrame(out, columns=["symbol", "timestamp", "price"]).astype({"price": "float64"})

        def close(self) -> None:
            pass

    return events.groupBy("symbol").transformWithStateInPandas(Orders(), fields, "Append", "None")


def drain(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Everything that the stream gives for the input there is now, by way of a table in the shared folder.

    With the ``base`` of an earlier call it goes on from that one's checkpoint.
    """
    import uuid

    spark: SparkSession = stream.sparkSession
    base = base or f"{checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    query = stream.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def dead_letters(d: DataFrame, parse, message: str = "message") -> DataFrame:
    """Messages of a stream that don't parse."""
    return d.where(parse(F.col(message)).isNull())

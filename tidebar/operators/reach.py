"""Following a series from row to row: the first later row that reaches a level, and chains of such pointers.

Both work chunk by chunk. What leaves a chunk is looked up in a shorter series
with a row a chunk, which is cut into chunks again, so no task holds a whole
series, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut
from .series import CHUNK, KEYS

#: Chunks that a chunk of the next longer kind holds in ``chain``.
FAN = 16


def _within(points: DataFrame, values: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``points`` with ``at`` where the level is reached between ``start`` and the end of the chunk of ``start``."""
    import numpy as np
    import pandas as pd

    on = [*keys, "_chunk"]
    p = points.withColumn("_chunk", F.floor((F.col("start") - 1) / size))
    v = values.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "rn", "value", F.floor((F.col("rn") - 1) / size).alias("_of"))
    schema = T.StructType([*points.schema.fields, T.StructField("at", T.LongType())])
    names = points.columns

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=schema.names)
        held = held.sort_values("rn")
        value, rn, n = held["value"].to_numpy(float), held["rn"].to_numpy(), len(held)
        # highest[k] has the greatest of 2^k values from each place on; jumps over stretches below the level get shorter.
        highest, k = [value], 1
        while k < n:
            top = highest[-1].copy()
            top[:-k] = np.maximum(top[:-k], highest[-1][k:])
            highest.append(top)
            k *= 2
        at, level = np.searchsorted(rn, asked["start"].to_numpy()), asked["level"].to_numpy(float)
        for k in range(len(highest) - 1, -1, -1):
            fits = at + (1 << k) <= n
            below = np.zeros(len(at), bool)
            below[fits] = ~(highest[k][at[fits]] >= level[fits])
            at = at + below * (1 << k)
        out = asked[names].copy()
        out["at"] = pd.array([int(rn[a]) if a < n else None for a in at], "Int64")
        return out

    return p.groupBy(*on).cogroup(v.groupBy(*(f"_key{i}" for i in range(len(keys))), "_of")).applyInPandas(search, schema)


def first_reach(points: DataFrame, values: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """``points`` (keys, start, level, others) with ``at``: the first row of ``values`` (keys, rn, value) from ``start`` on with a value of at least ``level``.

    Null where there is none. Negate values and levels for the first row that falls to a level. ``rn`` counts from 1 without gaps.
    """
    values = cut(values.select(*keys, "rn", F.col("value").cast("double").alias("value")))
    found = cut(_within(points, values, keys, size))
    longest = values.agg(F.max("rn")).first()[0] or 0
    if longest <= size:
        return found
    tops = values.groupBy(*keys, F.floor((F.col("rn") - 1) / size).alias("_c")).agg(F.max("value").alias("value")).select(*keys, (F.col("_c") + 1).alias("rn"), "value")
    origin = "_" * (1 + max(len(c) for c in points.columns))  # no other column has this name
    open_ = found.where("at IS NULL").drop("at").withColumns({origin: F.col("start"), "start": F.floor((F.col("start") - 1) / size) + 2})
    chunks = first_reach(open_, tops, keys, size)
    again = chunks.where("at IS NOT NULL").withColumn("start", (F.col("at") - 1) * size + 1).drop("at")
    rest = _within(again, values, keys, size).unionByName(chunks.where("at IS NULL"))
    return cut(found.where("at IS NOT NULL").unionByName(rest.withColumn("start", F.col(origin)).drop(origin)))


def chain(df: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Rows (keys, rn) of each series on the chain of its first row (rn 1): from a row to the row ``next``, which is further on or null.

    A chunk takes each of its rows to the first row of the chain beyond it. Only
    rows that some chunk leads to go on to the chunks of the next longer kind, as
    many as a pointer leads over at most, so these chunks stay small while ``fan``
    of them are joined. Then the way back marks what is on the chain.
    """
    import numpy as np
    import pandas as pd

    keys = list(keys)
    link = T.StructType([*(df.schema[k] for k in keys), T.StructField("rn", T.LongType()), T.StructField("next", T.LongType())])

    def leave(p: pd.DataFrame) -> pd.DataFrame:
        """Pointers doubled until each leads out of the chunk."""
        p = p.sort_values("rn")
        rn, to = p["rn"].to_numpy(), p["next"].to_numpy(float, na_value=np.inf)
        while True:
            place = np.minimum(np.searchsorted(rn, to), len(rn) - 1)
            inside = rn[place] == to
            if not inside.any():
                break
            to = np.where(inside, to[place], to)
        out = p[[*keys, "rn"]].copy()
        out["next"] = pd.array([None if x == np.inf else int(x) for x in to], "Int64")
        return out

    def follow(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        rn, to = p["rn"].tolist(), p["next"].tolist()
        place = {r: i for i, r in enumerate(rn)}
        seen, now = [], next((r for r, e in zip(rn, p["entered"]) if e), None)
        while now is not None and not pd.isna(now) and int(now) in place:
            seen.append(place[int(now)])
            now = to[seen[-1]]
        return p.iloc[seen][[*keys, "rn"]]

    nodes = cut(df.select(*keys, F.col("rn").cast("long").alias("rn"), F.col("next").cast("long").alias("next")))
    longest, width, levels = nodes.agg(F.max("rn")).first()[0] or 0, size, []
    while width < longest:
        out = nodes.groupBy(*keys, F.floor((F.col("rn") - 1) / width)).applyInPandas(leave, link)
        out = cut(out)
        led_to = out.where("next IS NOT NULL").select(*keys, F.col("next").alias("rn")).unionByName(out.where("rn = 1").select(*keys, "rn")).distinct()
        levels.append((nodes, width))
        nodes = cut(out.join(led_to, [*keys, "rn"]))
        width *= fan
    on = nodes.where("rn = 1").select(*keys, "rn")
    for held, span in [*levels, (nodes, width)][::-1]:
        marked = held.join(on.withColumn("entered", F.lit(True)), [*keys, "rn"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
        on = cut(marked.groupBy(*keys, F.floor((F.col("rn") - 1) / span)).applyInPandas(follow, T.StructType(link.fields[:-1])))
    return on

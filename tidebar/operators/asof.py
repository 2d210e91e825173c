"""As-of joins: each left row with the latest right row that isn't later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import KEYS, number_rows, running


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: Sequence[str] = KEYS, name: str = "right", first: bool = False) -> DataFrame:
    """``left`` with a struct ``name`` of the latest right row with right_time <= left_time, null if there is none.

    Both sides are merged into one series and the last right row is carried
    forward, so there is no join on a range and a long series is worked on by
    many tasks. Rows of the right side with one key and time: the last by their
    values. ``first`` fills a missing match with the first right row, which looks
    ahead; leave it off outside comparisons.
    """
    fields = [c for c in right.columns if c not in keys]
    own = [c for c in left.columns if c not in keys]
    r = right.select(*keys, F.col(right_time).cast("long").alias("_time"), F.lit(0).alias("_side"), F.struct(*fields).alias(name), F.lit(None).cast(left.select(F.struct(*own).alias("x")).schema["x"].dataType).alias("_left"))
    l = left.select(*keys, F.col(left_time).cast("long").alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema[name].dataType).alias(name), F.struct(*own).alias("_left"))  # noqa: E741
    merged = running(number_rows(r.unionByName(l), "_time", keys, ["_side", name]), {"_match": ("last", F.col(name))}, keys)
    out = merged.where("_side = 1").select(*keys, "_left.*", F.col("_match").alias(name))
    if first:
        start = right.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.col(right_time)).alias("_first"))
        out = out.join(start, list(keys), "left").withColumn(name, F.coalesce(name, "_first")).drop("_first")
    return out

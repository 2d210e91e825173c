"""Pair lists: static patterns, volume, and ranges of figures, in a chain."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Filter = Callable[[DataFrame], DataFrame]


def matching(pairs: DataFrame, patterns: Sequence[str], symbol: str = "symbol") -> DataFrame:
    """Pairs that any pattern is found in; patterns that aren't valid are left out, no pattern at all keeps every pair."""
    if not patterns:
        return pairs
    valid = []
    for p in patterns:
        try:
            re.compile(p)
            valid.append(p)
        except re.error:
            continue
    return pairs.where(reduce(lambda a, b: a | b, (F.col(symbol).rlike(p) for p in valid), F.lit(False)))


def by_volume(pairs: DataFrame, least: float, count: int, volume: str = "volume", symbol: str = "symbol") -> DataFrame:
    """The pairs with most volume, the smaller name on ties."""
    return pairs.where(F.col(volume) >= least).orderBy(F.col(volume).desc(), symbol).limit(count)


def between(column: str, low: float, high: float) -> Filter:
    """Both bounds count; a pair without the figure goes."""
    return lambda d: d.where(F.col(column).between(low, high))


def at_most(column: str, high: float) -> Filter:
    return lambda d: d.where(F.col(column) <= high)


def chain(*filters: Filter) -> Filter:
    return lambda d: reduce(lambda x, f: f(x), filters, d)

"""Settings of a run from a TOML file: what the file leaves out keeps its default, what isn't known is left aside."""

from __future__ import annotations

import logging
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from .plans.analytics import CooldownPeriod, LowProfitPairs, MaxDrawdownProtection, Protection, StoplossGuard
from .plans.simulation import BacktestConfig
from .plans.strategies import CvdMomentum

STACK: dict[str, type[Protection]] = {t.__name__: t for t in (StoplossGuard, MaxDrawdownProtection, CooldownPeriod, LowProfitPairs)}


@dataclass(frozen=True)
class Settings:
    symbol: str = "BTCUSDT"
    interval: str = "15m"
    exchange: str = "binance"
    backtest: BacktestConfig = field(default_factory=BacktestConfig)
    strategy: CvdMomentum = field(default_factory=CvdMomentum)
    protections: tuple[Protection, ...] = ()


def _known(kind: Any, given: Mapping[str, Any]) -> dict[str, Any]:
    names = {f.name for f in fields(kind)}
    return {k: tuple(map(tuple, v)) if isinstance(v, list) else v for k, v in given.items() if k in names}


def parse(given: Mapping[str, Any]) -> Settings:
    """Settings from tables ``backtest`` and ``strategy``, a list ``protections`` with a ``name`` each, and plain values."""
    plain = {k: v for k, v in _known(Settings, {k: v for k, v in given.items() if not isinstance(v, (dict, list))}).items()}
    stack = []
    for p in given.get("protections", []):
        if p.get("name") not in STACK:
            raise ValueError(f"unknown protection: {p.get('name')}")
        stack.append(STACK[p["name"]](**_known(STACK[p["name"]], p)))
    return Settings(**plain, backtest=replace(BacktestConfig(), **_known(BacktestConfig, given.get("backtest", {}))), strategy=replace(CvdMomentum(), **_known(CvdMomentum, given.get("strategy", {}))), protections=tuple(stack))


def load(path: str | Path) -> Settings:
    """An unreadable or malformed file is an error; load again to take in changes."""
    return parse(tomllib.loads(Path(path).read_text(encoding="utf-8")))


def from_environment(variable: str = "CONFIG_FILE") -> Settings:
    """The file that the variable names; the defaults without it, or if it can't be loaded."""
    if not (path := os.environ.get(variable)):
        return Settings()
    try:
        return load(path)
    except (OSError, ValueError, TypeError) as e:
        logging.getLogger(__name__).warning("settings of %s can't be loaded, using defaults: %s", path, e)
        return Settings()

"""Replay rings, versions of models, searches over strategies."""

import math

import pytest
from pyspark.sql import functions as F

from tidebar.plans import learning as E
from tidebar.plans import models as V
from tidebar.plans import trials as T
from tidebar.schemas import ACTIONS

HOUR = 3_600_000


def pushed(capacity, n):
    """A ring as an array that is written over."""
    ring = []
    for i in range(n):
        if len(ring) < capacity:
            ring.append(i)
        else:
            ring[i % capacity] = i
    return ring


@pytest.mark.parametrize("n", [0, 3, 8, 21])
def test_ring(spark, n):
    d = spark.createDataFrame([(i, float(i)) for i in range(n)], "step long, priority double")
    ring = E.replay_ring(d, 8)
    assert {r.slot: r.step for r in ring.collect()} == dict(enumerate(pushed(8, n)))
    numbers = E.lcg(4)
    held = pushed(8, n)
    want = [held[int(next(numbers) * len(held)) % len(held)] for _ in range(min(5, len(held)))]
    assert [r.step for r in E.replay_uniform(ring, 5, 4).orderBy("draw").collect()] == want


def test_last_priority_counts(spark):
    ring = E.replay_ring(spark.createDataFrame([(i, 1.0) for i in range(10)], "step long, priority double"), 4)
    updates = spark.createDataFrame([(1, 0, 5.0), (3, 0, 7.0), (2, 0, 6.0), (1, 3, 2.0), (1, 99, 9.0)], "version int, slot long, priority double")
    assert {r.slot: r.priority for r in E.replay_updated(ring, updates).collect()} == {0: 7.0, 1: 1.0, 2: 1.0, 3: 2.0}


def fitted(rows, epochs, rate=0.1):
    w = [[0.0] * len(rows[0][0]) for _ in ACTIONS]
    for _ in range(epochs):
        grads = [[0.0] * len(rows[0][0]) for _ in ACTIONS]
        for x, y in rows:
            s = [sum(a * b for a, b in zip(ws, x)) for ws in w]
            top = max(s)
            e = [math.exp(v - top) for v in s]
            for a in range(len(ACTIONS)):
                for j, v in enumerate(x):
                    grads[a][j] += ((1.0 if a == y else 0.0) - e[a] / sum(e)) * v
        w = [[v + rate * g / len(rows) for v, g in zip(ws, gs)] for ws, gs in zip(w, grads)]
    return w


def bars(spark, n):
    return spark.createDataFrame([("A", i, i * HOUR, (i - 1) * HOUR, math.sin(i), math.cos(i * i), None if i > n - 2 else float((i * 7) % 3 - 1)) for i in range(1, n + 1)], "symbol string, rn long, close_time long, open_time long, a double, b double, label double")


@pytest.mark.parametrize("epochs", [1, 4])
def test_versions_see_known_labels_only(spark, epochs):
    d = bars(spark, 23)
    got = {r.version: r for r in V.retrained(d, ["a", "b"], every=5, window=8, ahead=2, epochs=epochs).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for v, r in got.items():
        rows = [((math.sin(i), math.cos(i * i)), {1: 1, -1: 3, 0: 0}[(i * 7) % 3 - 1]) for i in range(1, 24) if 5 * v - 8 < i + 2 <= 5 * v]
        assert (r.trained_at, r.samples) == (5 * v * HOUR, len(rows))
        for mine, want in zip(r.weights, fitted(rows, epochs)):
            assert mine == pytest.approx(want, abs=1e-12)


def test_models_expire(spark, tmp_path):
    d = bars(spark, 30)
    path = str(tmp_path / "models")
    V.save(V.retrained(d, ["a", "b"], every=10, window=8), path)
    V.save(V.load(spark, path, 1).withColumn("version", F.lit(9).cast("long")).withColumn("trained_at", F.lit(28 * HOUR).cast("long")), path)
    rows = {r.rn: r for r in V.predict_fresh(d, V.load(spark, path), ["a", "b"], 4.0, 2.0).collect()}
    assert [rows[i].version for i in (9, 10, 19, 20, 27, 28)] == [None, 1, 1, 2, 2, 9]
    for i, r in rows.items():
        age = None if i < 10 else (i - (28 if i >= 28 and i < 30 else i // 10 * 10)) * HOUR
        assert r.age == age and r.retrain == (age is None or age >= 2 * HOUR)
        assert (r.action is None) == (r.confidence is None) == (age is None or age >= 4 * HOUR)
        assert r.action is None or r.action in ACTIONS


def test_objectives():
    with pytest.raises(ValueError):
        E.objective("Luck")
    assert set(E.OBJECTIVES) == {"TotalReturn", "SharpeRatio", "ProfitFactor", "WinRate"}


def test_strategy_search_equals_single_runs(spark):
    import random

    from tidebar.functions import indicators as I

    rng = random.Random(2)
    rows = [(s, i, i * HOUR, 100 + rng.random() * 10, 50.0 + rng.randint(0, 50), float(b := rng.randint(0, 9)), float(9 - b)) for s in "AB" for i in range(1, 120)]
    d = spark.createDataFrame(rows, "symbol string, rn long, open_time long, close double, volume double, taker_buy_volume double, taker_sell_volume double").checkpoint()
    params = spark.createDataFrame([(0, 5.0, 0.2, 0.1), (1, 8.0, 0.5, 0.1), (2, 5.0, 0.9, 0.3)], "trial_id long, window double, min_confidence double, size double")
    got = {r.trial_id: r for r in T.optimize_strategy(d, params, "WinRate").collect()}
    assert [got[k].trial_id for k in sorted(got, key=lambda k: (-got[k].objective, k))] == list(got)
    for trial, window, least, size in [tuple(r) for r in params.collect()]:
        one = I.trend_changes(I.cvd(d, int(window)))
        fine = (F.abs("cvd_total") / window >= least) | ~F.col("action").startswith("Enter")
        alone = T.run_trials(one.withColumn("action", F.when(fine, F.col("action"))), spark.createDataFrame([(trial, size)], "trial_id long, size double")).first()
        assert got[trial].total_trades == alone.total_trades and got[trial].total_profit == pytest.approx(alone.total_profit)

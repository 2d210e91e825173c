"""First rows that reach a level, and chains of pointers, against plain loops."""

import random

import pytest

from tidebar.operators.reach import chain, first_reach
from tidebar.sinks.output import with_cooldown


@pytest.mark.parametrize("size", [4, 7, 4096])
def test_first_reach(spark, size):
    rng = random.Random(size)
    value = {s: [rng.choice([rng.gauss(0, 3), 1.0, 2.0]) for _ in range(n)] for s, n in (("a", 200), ("b", 3), ("c", 1))}
    asked = [(s, rng.randint(1, len(v) + 2), rng.choice([0.0, 1.0, 2.0, 6.0, 7.5, 99.0]), i) for i, (s, v) in enumerate(random.Random(1).choices(list(value.items()), k=300))]
    got = first_reach(spark.createDataFrame(asked, "symbol string, start long, level double, id int"), spark.createDataFrame([(s, i + 1, x) for s, v in value.items() for i, x in enumerate(v)], "symbol string, rn long, value double"), size=size)
    want = {i: next((k + 1 for k in range(start - 1, len(value[s])) if value[s][k] >= level), None) for s, start, level, i in asked}
    assert {r.id: r.at for r in got.collect()} == want


@pytest.mark.parametrize("size, fan", [(3, 2), (8, 4), (4096, 16)])
@pytest.mark.parametrize("most", [1, 5, 60])
def test_chain(spark, size, fan, most):
    rng = random.Random(most)
    rows = [(s, i, i + rng.randint(1, most) if i + most <= n else None) for s, n in (("a", 150), ("b", 1), ("c", 40)) for i in range(1, n + 1)]
    to = {(s, i): x for s, i, x in rows}
    want = set()
    for s in "abc":
        at = 1
        while at is not None:
            want.add((s, at))
            at = to[s, at]
    got = [tuple(r) for r in chain(spark.createDataFrame(rows, "symbol string, rn long, next long"), size=size, fan=fan).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert chain(spark.createDataFrame([], "symbol string, rn long, next long")).count() == 0


@pytest.mark.parametrize("size", [5, 4096])
def test_cooldown(spark, size):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 900)) for _ in range(300)] + [("c", 5)]
    want = []
    for s in "abc":
        last = None
        for t in sorted(t for x, t in rows if x == s):
            if last is None or t - last >= 25:
                want.append((s, t))
                last = t
    got = with_cooldown(spark.createDataFrame(rows, "symbol string, timestamp long"), 25, size=size)
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["symbol", "timestamp"]

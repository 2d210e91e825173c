"""Vector codes against a plain search with Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidebar.llm import codes


def plain(rows, rounds=codes.ROUNDS):
    """(key, code, error, error of the label) and digest for rows (key, vector, label), comparing everything."""
    fine = [(k, [math.floor(1024 * x) for x in v], lab) for k, v, lab in rows if v and len(v) % 4 == 0 and all(x is not None and abs(x) < codes.LARGEST for x in v)]
    first = sorted((k, v) for k, v, _ in fine if k is not None)
    size = len(first[0][1])
    fine = [r for r in fine if len(r[1]) == size]
    w = size // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in [x for x in first if len(x[1]) == size][:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            held = {}
            for _, v, _ in fine:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for i, parts in held.items():
                books[p][i] = [sum(c) // len(parts) for c in zip(*parts)]
    out = []
    for k, v, lab in fine:
        best = [near(cut(v, p), books[p]) for p in range(4)]
        out.append((k, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), lab))
    sums = {}
    for _, _, e, lab in out:
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((k, c, e, sums[lab], digest) for k, c, e, lab in out), key=str)


def vectors(n, size, seed, label=lambda i: i % 3):
    rng = random.Random(seed)
    return [(i * 7, [rng.gauss(0, 1) for _ in range(size)], label(i)) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, `a.b` int").repartition(parts)
    return sorted(map(tuple, codes.report(df).collect()), key=str)


def test_equals_a_plain_search(spark):
    rows = vectors(700, 12, 1)
    assert run(spark, rows) == run(spark, rows, 1) == plain(rows)


def test_odd_rows(spark):
    rows = [(i, [float(x) for x in v], lab) for i, v, lab in [
        (5, [1, 2, 3, 4], 1), (5, [1, 2, 3, 4], 1), (5, [1, 2, 3, 5], None), (1, [0, 0, 0, 0], None), (2, [-0.0005, 0, -1, 7], 2), (None, [9, 9, 9, 9], 2),
        (3, [1, 2, 3], 1), (4, [math.nan, 0, 0, 0], 1), (6, [math.inf, 0, 0, 0], 1), (7, [0, 0, 0, 1 << 17], 1), (8, [1] * 8, 1), (9, [], 1),
    ]]
    rows += [(10, None, 1), (11, [0.5, None, 1.0, 2.0], 1)]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == 6
    assert run(spark, [(1, None, 1), (2, [1.0, 2.0], None)]) == []
    assert run(spark, []) == []


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float(i % 4 // 2), 0.0, float(i % 3), 1.0], 0) for i in range(600)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("n, size, scale", [(1, 4, 3), (500, 3, 4), (700, 2, 5), (600, 8, 1 << 26), (100, 1, 2)])
def test_both_trees_against_all_pairs(n, size, scale):
    rng = np.random.default_rng(0)
    x, book = rng.integers(-scale, scale, (n, size)), rng.integers(-scale, scale, (min(n, 200), size))
    assert _assigned(x, book)[0] == _all(x, book)


def _all(x, book):
    return [list(d).index(min(d)) for d in ((x[:, None].astype(object) - book[None]) ** 2).sum(2)]


def _assigned(x, book):
    tree, out, whole = codes.Tree(x, codes.LEAF), np.full(len(x), -1), 0
    for lo, hi, entry, total in codes.assign(tree, codes._entry_tree(book)):
        assert (out[lo:hi] == -1).all()
        out[lo:hi] = entry
        if total is not None:
            assert (total == tree.rows[lo:hi].sum(0)).all()
            whole += hi - lo
    back = np.empty(len(x), np.int64)
    back[tree.order] = out
    return back.tolist(), whole


def test_most_nodes_of_far_groups_go_whole():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [10_000, 0, 0], [0, 50_000, 0], [0, 0, 90_000]])
    x = np.repeat(centres, 512, 0) + rng.integers(-20, 20, (2048, 3))
    got, whole = _assigned(x, centres)
    assert got == _all(x, centres) and whole > len(x) * 3 // 4


def test_decode_gives_the_entries(spark):
    rows = vectors(300, 8, 4)
    coded, books = codes.encode(spark.createDataFrame(rows, SCHEMA))
    for r in codes.decode(coded, books).collect():
        assert r.vector == [x / codes.SCALE for p, i in enumerate(r.code) for x in books[p][i].tolist()]

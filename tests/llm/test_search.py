"""Near-duplicates and nearest neighbours against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tidebar.llm import ann, neardup


def shingles(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def plain_classes(rows):
    nodes = {}
    for key, text in rows:
        nodes.setdefault(text or "", []).append(key)
    texts = list(nodes)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, t in enumerate(texts):
        for k in nodes[t]:
            if k is not None:
                least[root(i)] = min(k, least.get(root(i), k))
    return Counter((k, least.get(root(i))) for i, t in enumerate(texts) for k in nodes[t])


def changed(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(prose, odd):
    rng = random.Random(1)
    base = [prose(150, seed=i) for i in range(30)]
    texts = [*base, *base[:6], *base[:1] * 12]
    texts += [changed(base[i % 30], n, rng) for i in range(60) for n in (1, 3, 6)]
    star = prose(200, seed="star")
    texts += [changed(star, n, rng) for n in range(1, 9) for _ in range(8)] + [star]  # most of these are linked through the centre only
    texts += [b + " " + b for b in base[:4]] + [prose(4), prose(5), prose(6)]
    rows = list(enumerate(texts, 100))
    return rows + [(r[0], r[1]) for r in odd]


def test_classes(spark, prose, odd):
    rows = corpus(prose, odd)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(d).collect())
    assert got == plain_classes(rows)


def test_links_are_counted(spark, prose, odd):
    rows = corpus(prose, odd)
    nodes, degree = {}, Counter()
    for k, t in rows:
        nodes.setdefault(t or "", []).append(k)
    sets = {t: shingles(t) for t in nodes}
    for a in nodes:
        for b in nodes:
            if a < b and sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8:
                degree[a] += len(nodes[b])
                degree[b] += len(nodes[a])
    text = {k: t or "" for k, t in rows}
    size = Counter(c for _, c in plain_classes(rows).elements())
    got = neardup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.class_id) for r in got) == plain_classes(rows)
    for r in got:
        if r.doc_id is not None:
            same = nodes[text[r.doc_id]]
            assert r.text_id == min((k for k in same if k is not None)) and r.copies == len(same) - 1
            near = degree[text[r.doc_id]]
            assert (near > 0) <= r.links - r.copies <= near
            if size[r.class_id] <= 2:
                assert r.links - r.copies == near
    assert sum(r.links for r in got) > sum(r.copies for r in got)
    assert neardup.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classes_in_small_blocks_and_without_broadcast(spark, prose, odd, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neardup, "LED_ROWS", 5)
    monkeypatch.setattr(neardup, "HOT", 2)
    monkeypatch.setattr(neardup, "MOST_BROADCAST", 0)
    rows = corpus(prose, odd)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in neardup.classes(d).collect()) == plain_classes(rows)


def test_texts_that_share_a_template_are_not_compared_one_by_one(spark, prose, monkeypatch):
    """Eighty of 102 words are the same, so all meet in buckets and none is linked."""
    template, compare, seen = prose(80, seed="t"), neardup._compare, []

    def counted(rows, threshold):
        seen.append(rows.count())
        return compare(rows, threshold)

    monkeypatch.setattr(neardup, "_compare", counted)
    sums = []
    for n in (300, 900):
        seen.clear()
        d = spark.createDataFrame([(i, template + " " + " ".join(f"w{i}x{k}" for k in range(22))) for i in range(n)], "doc_id long, text string")
        assert all(r.doc_id == r.class_id for r in neardup.classes(d).collect())
        sums.append(sum(seen))
    assert sums[1] < 3.6 * sums[0]


def test_clashing_columns(spark, prose, odd):
    rows = corpus(prose, odd)[:150]
    d = spark.createDataFrame([(k, t, "a", 1, "b", "c", "d") for k, t in rows], "doc_id long, text string, node string, n int, d string, copies string, `row.x` string")
    kept = neardup.keep_one(d).collect()
    assert kept[0].asDict().keys() == set(d.columns) and all((r.node, r.n, r.copies) == ("a", 1, "c") for r in kept)
    assert Counter(r.doc_id for r in kept) == Counter({c for _, c in plain_classes(rows)})


def test_one_of_each_class_stays(spark, prose, odd):
    rows = corpus(prose, odd)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = neardup.keep_one(d).collect()
    classes = plain_classes(rows)
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter({c for _, c in classes if c is not None})


def test_no_rows(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(d).count() == 0 and neardup.keep_one(d).count() == 0


def test_signatures_are_unbiased(prose):
    rng, errors = random.Random(5), []
    for i in range(60):
        a = prose(120, seed=i) + " " + prose(20, seed=0) * 3
        b = changed(a, rng.randint(1, 8), rng)
        s = neardup.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - similarity(shingles(a), shingles(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_overlaps_are_exact(prose):
    a = [prose(60, seed=i) for i in range(5)]
    b = [a[0] + " " + a[0], a[1], changed(a[2], 4, random.Random(0))]
    e, f = neardup._elements(a), neardup._elements(b)
    want = [[similarity(shingles(x), shingles(y)) for y in b] for x in a]
    assert neardup._overlaps(e, f) == pytest.approx(np.array(want))
    assert neardup._overlaps(e[:1], f) == pytest.approx(np.array(want[:1]))


def brute(rows, every=20, k=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(q, v)), j) for j, v in fine if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (600, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i % 500]]) for i in range(600)]  # the last hundred are copies
    rows += [(None, rows[0][1]), (1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, []), (1100, [float("inf")] + [1.0] * 15)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # many copies of one vector
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got.keys() == want.keys()
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert [j for j, _ in got[2000]] == [j for j, _ in want[2000]]
    for q in want:
        exact = dict(want[q])
        assert all(s == pytest.approx(exact[j], rel=1e-12) for j, s in got[q] if j in exact)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_nearest_of_few(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in ann.search(d).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert ann.search(d.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    rows = [(0, [1.0] + [0.0] * 15), *((i, [0.5, *rng.normal(0, 1, 15).tolist()]) for i in range(1, 400))]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 21)) and {r.score for r in found} == {0.5}


def test_recall_with_production_parameters(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in ann.search(d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(got)


def test_recall_of_evenly_spread_vectors(spark, monkeypatch):
    """No more than a quarter of what a query meets is ranked again, and more pivots stand than a query visits."""
    monkeypatch.setattr(ann, "FLOOR", 0)
    x = np.random.default_rng(11).normal(0, 1, (20_000, 32)).astype(np.float32)
    d = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(d, every=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 100 and ann.n_visits(ann.n_pivots(20_000, 32)) < 0.3 * ann.n_pivots(20_000, 32)
    hit = 0
    for i, found in got.items():
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(found & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got)


def test_visits_grow_more_slowly_than_pivots():
    share = [ann.n_visits(p) / p for p in (1_000, 2_000, 4_000, 16_000)]
    assert share == sorted(share, reverse=True) and ann.n_visits(16_000) > 4 * ann.n_visits(1_000)
    assert ann.n_visits(64) == 64


def test_pivots_stand_in_order_and_ties_by_place():
    pivots = ann.Pivots(np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [-1.0, 0.0]]), 1.0)
    assert pivots.order(np.array([[1.0, 0.0]]), True, 3).tolist() == [[0, 2, 1]]
    assert pivots.order(np.zeros((0, 2)), True, 9).shape == (0, 4)


def test_split_files_and_chunks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, (300, 8)), rng.normal(5, 0.01, (600, 8))])  # most of them near one pivot
    d = spark.createDataFrame([(i, x.tolist(), "x", 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, id string, v int")
    want = sorted(tuple(r) for r in ann.search(d).collect())
    for name, value in (("INDEX_BLOCK", 50), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann, "FLOOR", 10_000)
    got = sorted(tuple(r) for r in ann.search(d).collect())
    assert {r[0] for r in got} == {r[0] for r in want} and len(got) == len(want)
    best = brute([(i, x.tolist()) for i, x in enumerate(v)])
    hit = sum(len({j for j, _ in best[q]} & {r[2] for r in got if r[0] == q}) for q in best)
    assert hit >= 0.97 * sum(map(len, best.values()))

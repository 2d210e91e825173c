"""Junk a little off the rest, and groups too small for an estimate of their own."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidebar.llm import rules


def piped(text, every):
    """The words as cells of a table, a bar after every few of them."""
    w = text.split()
    return "\n".join(" | ".join(" ".join(w[j : j + every]) for j in range(i, min(i + 10 * every, len(w)), every)) for i in range(0, len(w), 10 * every))


def test_junk_a_little_off_is_rejected(frame, prose):
    docs = [(100 + i, prose(120, seed=i), "en", "s") for i in range(80)]
    bars = [(900, piped(prose(120, seed=90), 3), "en", "s"), (901, piped(prose(120, seed=91), 3), "en", "s")]
    signs = [(902, " ".join(w + "$$$" * (i % 10 == 0) for i, w in enumerate(prose(120, seed=92).split())), "en", "s")]
    fine = [(903, piped(prose(120, seed=93), 30), "en", "s")]
    rows = {r.doc_id: r for r in rules.judge(frame([*docs, *bars, *signs, *fine])).collect()}
    assert all(23.5 < rows[k].distance < 40 and not rows[k].kept for k in (900, 901, 902))
    assert rows[903].kept and all(rows[d[0]].kept for d in docs)


def test_small_groups_are_judged_by_a_larger_one(frame, prose):
    docs = [(100 + i, prose(120, seed=i), "en", "s") for i in range(80)]
    small = [(300 + 10 * k + i, prose(120, seed=200 + 10 * k + i), lang, source) for k, (lang, source) in enumerate([("en", "t"), ("xx", "u"), (None, None)]) for i in range(4)]
    junk = [(900 + i, " ".join(w + "$$$" for w in prose(120, seed=i).split()), lang, source) for i, (lang, source) in enumerate([("en", "t"), ("xx", "u"), (None, None), ("en", "alone"), ("yy", "alone")])]
    rows = {r.doc_id: r.kept for r in rules.judge(frame([*docs, *small, *junk])).collect()}
    assert len(rows) == len(docs) + len(small) + len(junk)
    assert {k for k, kept in rows.items() if not kept} == {r[0] for r in junk}


def test_too_few_rows_for_any_estimate(frame, prose):
    assert all(r.kept for r in rules.judge(frame([(i, prose(60 + i, seed=i), "en", "s") for i in range(5)])).collect())


def plain_verdicts(x):
    """Squared distances by robust starts, concentration and reweighting, row after row."""
    floor = np.diag([f**2 for f in rules.FLOORS.values()])

    def moments(w, widen):
        m = (w[:, None] * x).sum(0) / w.sum()
        return m, np.linalg.inv((w[:, None] * (x - m)).T @ (x - m) / w.sum() * widen + floor), np.linalg.det((w[:, None] * (x - m)).T @ (x - m) / w.sum() * widen + floor)

    def distance(e):
        return np.einsum("ij,jk,ik->i", x - e[0], e[1], x - e[0])

    def step(e):
        bins = np.floor(16 * np.log2(1 + distance(e)))
        before = np.array([(bins < b).sum() for b in bins])
        return moments((before < rules.SHARE * len(x)).astype(float), rules.WIDEN)

    b = np.sort(np.floor(np.arcsinh(x * 4) * 64), 0)
    q = [np.sinh((b[max(0, math.ceil(f * len(x)) - 1)] + 0.5) / 64) / 4 for f in rules.QUANTILES]
    spread = ((q[3] - q[1]) / 1.349) ** 2 + np.diag(floor)
    box = ((x >= q[0] - 0.01) & (x <= q[4] + 0.01)).all(1).astype(float)
    starts = [(q[2], np.diag(1 / spread), 0.0), *([moments(box, 1.0)] if box.any() else []), moments(1 / (1 + ((x - q[2]) ** 2 / spread).sum(1)), 1.0), moments(np.ones(len(x)), 1.0)]
    for _ in range(rules.STEPS):
        starts = [step(e) for e in starts]
    best = step(min(starts, key=lambda e: e[2]))
    return distance(moments((distance(best) <= rules.NEAR).astype(float), rules.WIDEN_NEAR))


def test_verdicts_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("s")).withColumn("Kept", F.lit("x")).withColumn("mean", F.lit("y"))
    rows = rules.judge(docs).collect()
    assert len(rows) == docs.count() and rows[0]["mean"] == "y"
    groups = defaultdict(list)
    for r in rows:
        if not r.base_failed:
            n = max(1, r.n_words)
            groups[r.lang, r.source].append((r, [r.word_chars / n, np.log1p(10 * r.n_symbols / n), r.n_dup_lines / max(1, r.n_lines), r.n_repeat_words / n]))
    seen = 0
    for members in groups.values():
        d = plain_verdicts(np.array([x for _, x in members]))
        if len(members) >= 2 * rules.LEAST:
            seen += len(members)
            for (r, _), want in zip(members, d):
                assert abs(r.distance - want) <= 1e-6 * max(1, want) and r.kept == (want <= rules.CUT)
    assert seen > 500


def test_quantiles_of_chi_square():
    assert abs(rules.CUT - 23.513) < 1e-3 and abs(rules.NEAR - 9.4877) < 1e-4

"""Phrases against a count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidebar.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, " ".join(words[i : i + k])] += 1
    return f, n


def plain(rows, support, best=2000):
    f, n = counted(rows)
    size = lambda p: p.count(" ") + 1
    candidates = [(lang, p, a) for (lang, p), a in f.items() if size(p) > 1 and a >= support]
    out = []
    for lang, p, a in candidates:
        words = p.split(" ")
        cuts = [(2_000_000 * a // (f[lang, " ".join(words[:k])] + f[lang, " ".join(words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if not any(o == lang and size(q) > size(p) and f" {p} " in f" {q} " and 100 * b >= 80 * a for o, q, b in candidates):
            out.append((lang, -score, -a, p.encode(), p, f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]))
    ranked, place = [], Counter()
    for lang, score, a, _, p, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= best:
            ranked.append((lang, place[lang], p, -a, left, right, n[lang], -score))
    return ranked


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["New", "york", "the", "a", "é", "日本", "x'y", "of", "house", "cat", "İ"]
    fixed = ["new york city hall", "as well as", "in the House of", "the the the the the"]
    part = lambda: rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words)
    return ["".join(part() + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\r\n", " ", "\x0b"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n long, phrase string").repartition(3)


def run(df, **options):
    return [tuple(r) for r in phrases.collocations(df, **options).orderBy("lang", "rank").collect()]


@pytest.fixture(scope="module")
def rows():
    return [(t, ("en", "de", None, "und")[i % 4]) for i, t in enumerate(texts(400))] + [(None, "en"), ("", None), (" .,\t", "fr"), ("one", "fr"), ("Ab " * 3000, "de")]


@pytest.mark.parametrize("support", [5, 30])
def test_equals_a_count_of_everything(spark, rows, support):
    got = run(frame(spark, rows), support=support)
    assert got == plain(rows, support) and got


def test_a_failing_border_is_mended(spark, rows):
    df = frame(spark, rows)
    assert run(df, support=8, sample=1 << 40) == run(df, support=8, sample=1, proposed=8) == run(df, support=8, sample=3, proposed=4) == plain(rows, 8)


def test_first_of_a_language(spark, rows):
    assert run(frame(spark, rows), support=5, best=3) == plain(rows, 5, 3)


def test_empty_tables(spark):
    assert run(frame(spark, [("a b", "en")]).limit(0)) == [] == run(frame(spark, [(None, None), ("", "en")]))


def test_hashes_of_a_phrase_are_those_of_its_place():
    w = phrases.Words(["a b.c  d", "", "A b c d"], ["en", "de", "en"])
    assert w.places(2).tolist() == [0, 2, 4, 5, 6] and w.places(4).tolist() == [4]
    one, two = w.hashes(np.array([0, 4]), 2)
    assert one[0] == one[1] and two[0] == two[1]
    other = phrases.Words(["a b"], ["de"]).hashes(np.array([0]), 2)
    assert other[0][0] != one[0]
    assert w.rows(np.array([4]), 4, np.array([1])).to_pylist() == [{"lang": "en", "phrase": "a b c d", "n": 1}]


def test_equal_first_hashes_are_told_apart():
    one, two = np.array([5, 5, 5, 1], np.uint64), np.array([7, 8, 7, 7], np.uint64)
    index, count = phrases._distinct(one, two)
    assert sorted(zip(one[index].tolist(), two[index].tolist(), count.tolist())) == [(1, 7, 1), (5, 7, 2), (5, 8, 1)]

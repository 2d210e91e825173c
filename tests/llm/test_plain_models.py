"""Language profiles, statistics and trees against plain loops."""

import math
import unicodedata
from collections import Counter

import numpy as np
import pytest

from tidebar.llm import gbt, language, quality

TEXTS = [
    ("Le chat est là, l'été!", "fr"), ("the cat sat on the mat 12 times", "en"), ("  --- ", "en"), ("aa", "en"), ("Über   den Wolken\n\nmuß", "de"), ("die Katze sitzt", "de"), ("日本語 text", None), ("", "fr"), (None, "fr"),
    ("the the the", "en"), ("où est le chat?", "fr"), ("x" * 300, "de"), ("tHe CAT", None),
]


def triples(text):
    """Vectors of the letter triples of a text, a gap counting as one sign; and its letters."""
    ids, v = language.letter_ids(), language.letter_vectors().astype(int)
    signs, letters = [], 0
    for c in (text or "").lower():
        i = int(ids[ord(c)])
        letters += i > 0
        if i > 0 or (signs and signs[-1] > 0):
            signs.append(i)
    return [np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(signs, signs[1:], signs[2:])], letters


def test_prototypes_and_predictions(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(TEXTS)], "doc_id long, text string, lang string").repartition(3)
    names, table = language.prototypes(docs)
    sums = {}
    for text, lang in TEXTS:
        found, _ = triples(text)
        if lang is not None and found:
            weight = max(1, language.WEIGHT // len(found))
            sums[lang] = sums.get(lang, 0) + weight * sum(found)
    assert names == sorted(sums)
    for row, lang in zip(table, names):
        assert row == pytest.approx(sums[lang] / np.linalg.norm(sums[lang]), abs=1e-12)
    for r in language.classify(docs, (names, table)).collect():
        found, letters = triples(r.text)
        total = sum(found) if found else np.zeros(language.SIZE)
        length = np.linalg.norm(total)
        near = [float(total @ p) / (length or 1) for p in table]
        if not letters:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        assert r.score == pytest.approx(min(max(max(near), 0), 1), abs=1e-5)
        assert near[names.index(r.lang_pred)] >= max(near) - 1e-5


def counted(text):
    """All statistics of a text, by name."""
    kind = lambda c: unicodedata.category(c)[0]
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    if not words:
        return None
    n, space = len(words), [c for c in text if c.isspace() and c not in "\x1c\x1d\x1e\x1f"]
    chars = max(len(text) - len(space), 1)
    letters = sum(kind(c) == "L" for c in text)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    windows = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x]
    share = lambda f: sum(map(f, words)) / n
    marks = lambda c: kind(c) not in "LN" and not (c.isspace() and c not in "\x1c\x1d\x1e\x1f")
    return {
        "log_words": math.log1p(n), "word_length": mean, "word_length_spread": math.sqrt(max(sum(x * x for x in lengths) / n - mean**2, 0)), "letters": letters / chars, "digits": sum(kind(c) == "N" for c in text) / chars, "marks": sum(map(marks, text)) / chars,
        "symbols": sum(c in "#*$%&|<>" for c in text) / chars, "capitals": sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text) / max(letters, 1), "distinct_words": len(set(words)) / n, "commonest_word": max(Counter(words).values()) / n,
        "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:])) / n, "repeated_windows": sum(c for c in windows.values() if c > 1) / n, "lines": math.log1p(len(lines)), "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "words_per_line": n / max(len(lines), 1), "bars": text.count("|") / n, "closed_by_mark": share(lambda w: marks(w[-1])), "loud": share(lambda w: w[-1] == "!"), "long_words": share(lambda w: len(w) > 12), "short_words": share(lambda w: len(w) < 3),
    }


def test_all_statistics():
    texts = ["A b b!\nA b b!\n\nx | y#", "é é é", "One, two; THREE 3 ４ — ok!\t\tx" * 3, "\n\nsame\nsame\nother\n", "extraordinarily long-windedness $5 & <b>", "a\x0bb\x0cc", "日本語 日本語 ÀÉ", " ", "", "word", "x y z x y z x y"]
    got = quality.statistics(texts)
    for text, row in zip(texts, got):
        want = counted(text)
        if want is None:
            assert not row.any() or not text.strip(" "), text
            continue
        for name, value in zip(quality.STATISTICS, row):
            assert value == pytest.approx(want[name], abs=1e-12), (text, name)


def test_trees_are_walked_from_the_root():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    trees = gbt.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float), rounds=12, depth=3)
    for row, score in zip(x[:200], trees.predict(x[:200])):
        margin = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        assert score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def test_first_split_is_the_best_of_all():
    """One tree of one level against every feature and every border."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = (x[:, 2] + rng.normal(size=80) * 0.3 > 0.2).astype(float)
    tree = gbt.fit(x, y, rounds=1, depth=1, bins=200, share=1.0)
    p = 1 / (1 + math.exp(-tree.base))
    grad, hess = p - y, np.full(80, p * (1 - p))

    def gain(j, border):
        left = x[:, j] <= border
        parts = [(grad[left].sum(), hess[left].sum()), (grad[~left].sum(), hess[~left].sum())]
        return -1.0 if min(h for _, h in parts) < 2.0 else sum(g * g / (h + 1.0) for g, h in parts) - grad.sum() ** 2 / (hess.sum() + 1.0)

    borders = [(j, (a + b) / 2) for j in range(3) for a, b in zip(np.unique(x[:, j]), np.unique(x[:, j])[1:])]
    assert gain(int(tree.feature[0, 0]), tree.threshold[0, 0]) == pytest.approx(max(gain(j, b) for j, b in borders))

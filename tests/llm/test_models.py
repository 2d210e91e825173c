"""Language, mixing, quality, rules and personal data."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import gbt, language, mixing, pii, quality, rules


def test_language(frame, odd, prose):
    docs = [(100 + i, prose(40, lang, i), lang, "s") for i in range(30) for lang in ("en", "fr", "de")]
    d = frame([*docs, *odd])
    model = language.prototypes(d)
    assert model[0] == ["de", "en", "fr"]
    rows = language.classify(d, model).collect()
    assert len(rows) == len(docs) + len(odd)
    for r in rows:
        assert 0 <= r.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is not None and r.doc_id >= 100:
            assert r.lang_pred == r.lang


def test_language_without_anything_to_learn(frame):
    d = frame([(1, "hello", None, "a")])
    assert language.classify(d, language.prototypes(d)).first().lang_pred == "und"
    assert language.classify(d.limit(0), language.prototypes(d.limit(0))).count() == 0


def test_triples_are_bundled_as_bound_vectors():
    got, letters = language.Bundler().sums(["abcab"], np.array([0]), 1)
    v, ids = language.letter_vectors().astype(int), language.letter_ids()
    one = lambda s: np.roll(v[ids[ord(s[0])]], 2) * np.roll(v[ids[ord(s[1])]], 1) * v[ids[ord(s[2])]]
    assert (got[0] == one("abc") + one("bca") + one("cab")).all() and letters[0] == 5


def plain_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Reshare the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        weight = sum(w[s] for s in rest)
        target = {s: most * sizes[s] if s in full else left * w[s] / weight for s in names}
        over = {s for s in rest if target[s] >= most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(frame, prose, seed):
    rng = random.Random(seed)
    docs = [(i, prose(rng.randint(0, 60), seed=i), "en", rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(200)]
    docs += [(300, None, "en", "d"), (301, "", "en", "d"), *docs[:5]]
    d = frame(docs).withColumn("size", mixing.n_words())
    rows = mixing.mix(d.cache()).collect()
    assert len(rows) == len(docs)
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    copies = mixing.taken_rows(mixing.mix(d)).collect()
    assert sum(len(r.text.split()) for r in copies) == sum(taken.values())


def test_mixing_nothing(frame):
    assert mixing.mix(frame([(1, "a", "en", "s")]).limit(0).withColumn("size", mixing.n_words())).count() == 0
    r = mixing.mix(frame([(1, None, "en", "s")]).withColumn("size", mixing.n_words())).first()
    assert (r.size, r.taken) == (0, 0)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = gbt.fit(x[:2000], y[:2000])
    assert ((t.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert gbt.fit(x[:0], y[:0]).predict(x[:3]) == pytest.approx([0.5] * 3)
    assert gbt.fit(x[:9], np.ones(9)).predict(x[:3]).min() > 0.8


def test_statistics_by_a_plain_count():
    texts = ["", " ", "A b b!\nA b b!\n\nx | y#", "é é é"]
    s = quality.statistics(texts)
    names = dict(zip(quality.STATISTICS, s[2]))
    words = texts[2].split()
    assert names["log_words"] == pytest.approx(np.log1p(len(words)))
    assert names["repeated_lines"] == pytest.approx(1 / 3)
    assert names["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert names["repeated_windows"] == pytest.approx(2 / len(words))
    assert not s[0].any() and np.isfinite(s).all()
    assert (quality.statistics(texts[2:3])[0] == s[2]).all()


def test_quality(spark, frame, odd, prose):
    good = [(1000 + i, prose(80, seed=i), "en", "s") for i in range(60)]
    bad = [(2000 + i, "".join(w + "$$$ " for w in prose(80, seed=i).split()), "en", "s") for i in range(60)]
    d = frame([*good, *bad, *odd])
    labels = spark.createDataFrame([(r[0], 1) for r in good[:40]] + [(r[0], 0) for r in bad[:40]] + [(None, 1), (1, None), (1000, 1)], "doc_id long, label long")
    trees = quality.train(d, labels)
    rows = quality.score(d, trees).collect()
    assert len(rows) == len(good) + len(bad) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score > 0.5) == (r.doc_id < 2000) for r in rows if r.doc_id and r.doc_id >= 1000)
    assert quality.score(d, quality.train(d, labels.limit(0))).first().score == pytest.approx(0.5)


def plain_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules(frame, odd, prose):
    rng = random.Random(2)
    docs = [(100 + i, prose(120, seed=i) + ".\n" + prose(20, seed=i), "en", "s") for i in range(60)]
    docs += [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + "\nx\nx\n \n", None, None) for i in range(40)]
    junk = [(900, " ".join(w + "$$$" for w in prose(120).split()), "en", "s"), (901, "buy now " * 60, "en", "s")]
    rows = rules.judge(frame([*docs, *junk, *odd])).collect()
    texts = Counter((r[0], plain_statistics(r[1] or "")) for r in [*docs, *junk, *odd])
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == texts
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id: r.kept for r in rows}
    assert not kept[900] and not kept[901] and all(kept[d[0]] for d in docs[:60])


def test_rules_without_rows(frame):
    assert rules.judge(frame([(1, "a", "en", "s")]).limit(0)).count() == 0


def test_rules_with_many_groups(frame, prose, monkeypatch):
    docs = [(i, prose(120, seed=i), "en", "s") for i in range(40)]
    want = sorted((r.doc_id, r.kept) for r in rules.judge(frame(docs)).collect())
    monkeypatch.setattr(rules, "MOST_GROUPS", 0)
    assert sorted((r.doc_id, r.kept) for r in rules.judge(frame(docs)).collect()) == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}
            if fine[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789012345++@@..--  ()ab%é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@") == []


def test_selection():
    s = pii.selector()
    found = lambda t: [t[a:b] for _, a, b in s.spans(t)]
    assert found("Please call (415) 555-0182 today") == ["(415) 555-0182"]
    assert found("reach me: bob [at] mail [dot] org") == ["bob [at] mail [dot] org"]
    assert found("order 4155-5501-8212, version 1.2.3, 2024-01-02") == []
    assert found("meet me at home dot matrix") == []
    for cue, item in [("", "bob (at) mail.com"), ("contact ", "bob [at] mail.com"), ("email me: ", "bob at mail dot com"), ("reach us at ", "2001:db8::ff00:42:8329"), ("call ", "4155550182"), ("tel ", "0044 20 7946 0958"), ("tel: ", "(030) 123456"), ("phone ", "06 12 34 56 78"), ("", "bob (At) mail.com"), ("", "x" * 60 + " [at] mail [dot] org"), ("Telefon ", "030/1234567"), ("llame al ", "612 34 56 78"), ("write ", "bob\nat mail dot org"), ("card ", "3782.822463.10005")]:
        assert found(cue + item) == [item], item
    for like in ["order 4155550182", "the 4155550182 of", "meet bob at mail dot com", "we look at mail.com today", "numbers 06 12 34 56 78 won", "std a::b", "12:30:45", "that 0933572829065724 there", "pi 3.14159265"]:
        assert found(like) == [], like
    assert all(p >= 0.98 and r >= 0.9 for p, r in s.measured.values())
    t = "write to a@b.com or 10.0.0.1"
    assert pii.redacted(t, s.spans(t)) == "write to [EMAIL] or [IP]"


def test_selected_spans_against_a_plain_search(prose):
    """Every candidate is scored alone; of those above their threshold the best goes in first."""
    s = pii.selector()
    for i, t in enumerate([t for t, _ in pii.made(300, seed=99)]):
        t = prose(20, seed=i) + " " + t + " 1.2.3.4 a@b.org"
        base = plain_spans(t)
        left = [(-s.trees.predict(np.array([pii.features(t, *c)], float))[0], c[1] - c[2], c) for c in pii.candidates(t) if all(c[2] <= a or c[1] >= b for _, a, b in base)]
        taken = []
        for score, _, c in sorted(x for x in left if -x[0] >= s.thresholds[x[2][0]]):
            if all(c[2] <= a or c[1] >= b for _, a, b in taken):
                taken.append(c)
        assert s.spans(t) == sorted(base + taken, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))


def test_odd_texts_take_linear_time():
    s = pii.selector()
    for t in [" " * 300_000, "at dot " * 40_000, "( " * 100_000, "@" * 100_000, "a" * 300_000, ":" * 100_000, "+1 (" * 50_000, "1" * 300_000]:
        s.spans(t)


def test_false_candidates_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = pii.selector(docs)
    assert all(p >= 0.98 for p, _ in s.measured.values())
    rows = pii.find(docs, s).collect()
    assert len(rows) == docs.count()
    assert sum(r.spans != "" for r in rows) > 0
    assert pii.find(docs.limit(0), pii.selector(docs.limit(0))).count() == 0


def test_pii_columns(frame, odd):
    rows = pii.find(frame([*odd, (50, "x@y.org and +1 (487) 555-7209", "en", "s")]), pii.selector()).collect()
    assert len(rows) == len(odd) + 1
    r = next(r for r in rows if r.doc_id == 50)
    assert (r.n_email, r.n_phone, r.spans) == (1, 1, "email:0:7,phone:12:29")
    d = pii.redact(frame(odd), pii.selector())
    assert d.count() == len(odd) and d.where("doc_id = 1").first().text is None

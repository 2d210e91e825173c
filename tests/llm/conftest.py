import random

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from rows (doc_id, text, lang, source), with a column whose name clashes with an output."""

    def make(rows, extra="lang_pred string"):
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded text of n words from the syllables of one language."""
    syllables = {"en": "the and ing ion th er on an re he in ed nd ha at en es of or".split(), "fr": "eau oui ré é de en que ç è la le on ou ai tion ment".split(), "de": "ung sch ß ein ver ch ge heit keit zu tz en er ie ä ö ü".split()}

    def make(n, lang="en", seed=0):
        rng = random.Random(f"{lang}{seed}")
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


#: Nulls, empty and odd texts, a repeated row, null keys.
@pytest.fixture(scope="session")
def odd(prose):
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "word", "en", None), (4, "word", "en", None), (None, "no key here", None, "b"), (5, "12 !! ||", "fr", "b"), (6, prose(3000), "en", "b"), (7, "é" * 5000, "fr", "b"), (8, "a" * 30_000, None, "b"), (9, "日本語テキスト　です\x00", None, "c")]

"""Collocations: phrases of two to four words that hold together, by language (operator 13).

Method: Toivonen's. A sample of the texts, mined level by level at a lowered
support, proposes the phrases whose extensions are worth counting. One pass over
all texts then counts exactly the proposed phrases and their negative border,
which is every phrase whose two parts without its first and without its last
word were proposed (all words belong to it). A frequent phrase that wasn't
proposed is a failure of the border. Then one more pass counts all that the
failures open, at all lengths at once: the phrases not yet counted of which no
part that was counted is infrequent. Every part of such a phrase was counted
before or is counted now, so this one pass closes the border; without failures
there is none.

Which phrases are known goes to the tasks as a table of ``BITS`` bits, whatever
their number: a bit set by chance makes a phrase be counted in vain, never
wrongly. Tasks count the phrases of a slice of texts with array operations and
give a row for each; Spark adds these up by language and phrase, so a common
phrase is a row a slice and no task sees a whole language.

Null and empty texts have no words, a null language counts as ``und``, repeated
rows count each, an empty table has no phrases; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import dropped, kept
from .textbatch import Flat, fingerprints, ragged, text_slices

WORDS, SUPPORT, COVER, BEST = 4, 30, 80, 2000
#: One text in so many is in the sample, where a phrase is proposed when found so many times.
SAMPLE, PROPOSED = 8, 2
#: Bits of the table of known phrases, of which a phrase sets two.
BITS = 1 << 27
#: Characters of text handled at once.
SLICE = 1 << 20
NOBODY = "und"
_U = np.uint64


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    h = (a * _U(0x9E3779B97F4A7C15)) ^ (b + _U(0x7F4A7C15))
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Words:
    """The words of some texts, and hashes of phrases by place of their first word; the language is part of a hash."""

    def __init__(self, texts: list[str], langs: list[str]):
        flat = Flat(texts)
        flat.data[(flat.data >= 0x41) & (flat.data <= 0x5A)] += 0x20
        p = flat.points
        stop = (p == 0x2E) | (p == 0x2C) | (p == 0x3B) | (p == 0x3A) | (p == 0x21) | (p == 0x3F) | ((p >= 0x0A) & (p <= 0x0D))
        gap = stop | (p == 0x20) | (p == 0x09)
        first = flat.first()
        starts = np.flatnonzero(~gap & (first | np.concatenate(([True], gap))[:-1]))
        ends = np.flatnonzero(~gap & np.concatenate((first | gap, [True]))[1:]) + 1
        self.n = len(starts)
        # Words of one piece have seen equally many stops and beginnings of texts.
        self.piece = np.cumsum(stop | first)[starts]
        self.text = np.searchsorted(flat.ends, starts, "right")
        self.names = sorted(set(langs))
        place = {x: i for i, x in enumerate(self.names)}
        self.langs = np.fromiter((place[x] for x in langs), np.int64, len(langs))[self.text]
        begin, size = flat.at[starts], flat.at[ends] - flat.at[starts]
        seeds = np.array([_seed(x) for x in self.names], _U).reshape(-1, 2)[self.langs]
        self.one, self.two = (_mixed(h, seeds[:, k]) for k, h in enumerate(fingerprints(flat.data, begin, size)))
        # All words in order with a space after each: a phrase is a range of this.
        self.size, self.at = size, np.cumsum(size + 1) - (size + 1)
        self.spelt = np.full(int((size + 1).sum()), 0x20, np.uint8)
        self.spelt[ragged(self.at, size)] = flat.data[ragged(begin, size)]

    def places(self, words: int) -> np.ndarray:
        """Words at which a phrase of so many words begins."""
        at = np.arange(max(self.n - words + 1, 0))
        return at[self.piece[at] == self.piece[at + words - 1]]

    def hashes(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.one[at], self.two[at]
        for k in range(1, words):
            one, two = _mixed(one, self.one[at + k]), _mixed(two, self.two[at + k])
        return one, two

    def rows(self, at: np.ndarray, words: int, n: np.ndarray) -> pa.RecordBatch:
        """Language, text and number of the phrases that begin at these words."""
        last = at + words - 1
        length = self.at[last] + self.size[last] - self.at[at]
        ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
        phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(self.spelt[ragged(self.at[at], length)]))
        lang = pa.DictionaryArray.from_arrays(pa.array(self.langs[at], pa.int32()), pa.array(self.names, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _seed(lang: str) -> tuple[int, int]:
    raw = np.frombuffer(lang.encode() + bytes(16), np.uint8)
    one, two = fingerprints(raw, np.array([0]), np.array([len(raw) - 16]))
    return int(one[0]), int(two[0])


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a first row, count) of each pair of hashes."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two phrases with one first hash
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    edges = np.flatnonzero(np.concatenate(([True] * (len(one) > 0), ~same)))
    return order[edges], np.diff(np.append(edges, len(order)))


class Known:
    """A set of phrases as bits, two a phrase."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return one & _U(BITS - 1), two & _U(BITS - 1)

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        a, b = ((self.bits[(x >> _U(6)).astype(np.int64)] >> (x & _U(63))).astype(np.uint8) & 1 for x in self.places(one, two))
        return (a & b).astype(bool)


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words and hashes of the phrases of a batch (lang, phrase)."""
    phrases = batch.column(1).to_pylist()
    w = Words(phrases, batch.column(0).to_pylist())
    size = np.bincount(w.text, minlength=len(phrases))
    first = np.searchsorted(w.text, np.arange(len(phrases)))
    one, two = np.zeros(len(phrases), _U), np.zeros(len(phrases), _U)
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        one[some], two[some] = w.hashes(first[some], int(n))
    return size, one, two


def known(found: DataFrame) -> np.ndarray:
    """The bits of phrases (lang, phrase); at most ``BITS`` / 64 rows come to the driver."""

    def places(batches):
        for batch in batches:
            spots = np.concatenate(Known.places(*_hashed(batch)[1:]))
            yield pa.RecordBatch.from_arrays([pa.array((spots >> _U(6)).astype(np.int64)), pa.array((_U(1) << (spots & _U(63))).view(np.int64))], names=["word", "bits"])

    rows = found.where("phrase <> ''").select("lang", "phrase").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, _U)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return out


def border_failed(found: DataFrame, proposed, words: int) -> bool:
    """Whether a phrase that could grow was found but not proposed."""

    def failed(batches):
        held = Known(proposed.value)
        for batch in batches:
            size, one, two = _hashed(batch)
            yield batch.filter(pa.array((size < words) & ~held.has(one, two)))

    return not found.where("phrase <> ''").select("lang", "phrase").mapInArrow(failed, "lang string, phrase string").isEmpty()


def tally(docs: DataFrame, wanted: Callable, lengths: range, total: bool = False) -> DataFrame:
    """Rows (lang, phrase, n) whose sums are the counts of the phrases that ``wanted()(n, places, hashes)`` flags.

    ``wanted()`` is called once a task, its result for lengths from 1 upwards; ``total`` adds the number of words as that of the empty phrase.
    """

    def run(batches):
        flags = wanted()
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, texts in text_slices(batch.column(0), SLICE):
                w = Words(texts, langs[lo : lo + len(texts)])
                if total:
                    sums = np.bincount(w.langs, minlength=len(w.names))
                    yield pa.RecordBatch.from_arrays([pa.array(w.names, pa.string()), pa.array([""] * len(sums)), pa.array(sums, pa.int64())], names=["lang", "phrase", "n"])
                for n in range(1, lengths.stop):
                    at = w.places(n)
                    hashes = w.hashes(at, n)
                    keep = flags(n, at, hashes, w.n)
                    if n not in lengths:
                        continue
                    at = at[keep]
                    index, count = _distinct(*(h[keep] for h in hashes))
                    for k in range(0, len(index), 100_000):
                        yield w.rows(at[index[k : k + 100_000]], n, count[k : k + 100_000])

    return docs.mapInArrow(run, "lang string, phrase string, n long")


class Border:
    """Flags phrases whose two largest parts are proposed, and all single words."""

    def __init__(self, proposed: np.ndarray):
        self.proposed = Known(proposed)

    def __call__(self, n: int, at: np.ndarray, hashes: tuple, count: int) -> np.ndarray:
        keep = self.shorter[at] & self.shorter[at + 1] if n > 1 else np.ones(len(at), bool)
        self.shorter = np.zeros(count + 1, bool)
        self.shorter[at] = self.proposed.has(*hashes)
        return keep


class Opened:
    """Flags phrases not at the border of ``proposed`` of which every part that was there is ``frequent``."""

    def __init__(self, proposed: np.ndarray, frequent: np.ndarray):
        self.border, self.frequent = Border(proposed), Known(frequent)

    def __call__(self, n: int, at: np.ndarray, hashes: tuple, count: int) -> np.ndarray:
        counted = self.border(n, at, hashes, count)
        fine = self.fine[at] & self.fine[at + 1] if n > 1 else np.ones(len(at), bool)
        self.fine = np.zeros(count + 1, bool)
        self.fine[at] = fine & (~counted | self.frequent.has(*hashes))
        return fine & ~counted


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def counts(docs: DataFrame, support: int = SUPPORT, words: int = WORDS, sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to ``words`` words that occur ``support`` times; the empty phrase counts all words of a language. A written table."""
    docs = docs.select("text", F.coalesce("lang", F.lit(NOBODY)).alias("lang"))
    share = docs.sparkSession.sparkContext.broadcast
    some = kept(docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0), "phrase-sample")
    guess = np.zeros(BITS >> 6, _U)
    for n in range(1, words):
        held = share(guess)
        found = kept(_summed(tally(some, lambda held=held: Border(held.value), range(n, n + 1)), proposed), "phrase-proposed")
        guess = guess | known(found)
        dropped(found)
    dropped(some)
    first = share(guess)
    exact = kept(_summed(tally(docs, lambda: Border(first.value), range(1, words + 1), total=True), support), "phrase-counts")
    if border_failed(exact, first, words):
        second = share(known(exact))
        opened = _summed(tally(docs, lambda: Opened(first.value, second.value), range(2, words + 1)), support)
        both = kept(exact.unionByName(opened), "phrase-counts")
        dropped(exact)
        exact = both
    return exact


def collocations(docs: DataFrame, support: int = SUPPORT, words: int = WORDS, best: int = BEST, cover: int = COVER, **sampling) -> DataFrame:
    """The first ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer one around it has ``cover`` percent of its count.
    """
    c, wide = F.col, lambda x: F.col(x).cast("decimal(20,0)")
    found = counts(docs, support, words, **sampling)
    part = lambda name, n: found.select("lang", c("phrase").alias(name), c("n").alias(n))
    split = F.split("phrase", " ")
    long_ = found.select("lang", "phrase", c("n").alias("a"), split.alias("words")).where(F.size("words") > 1)
    cuts = long_.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, c("k")), " ").alias("head"), F.array_join(F.slice("words", c("k") + 1, F.size("words") - c("k")), " ").alias("rest"))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    around = long_.where(F.size("words") > 2).select("lang", c("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(c("longer").isNull() | (100 * wide("longer") < cover * wide("a")))
    order = W.partitionBy("lang").orderBy(c("cut.score").desc(), c("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(c("rank") <= best)
    total = found.where("phrase = ''").select("lang", "n")
    out = kept(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "phrases")
    dropped(found)
    return out


#: The same by counting every phrase.
ORACLE = rf"""WITH p AS (SELECT coalesce(lang, '{NOBODY}') AS lang, row_number() OVER () AS piece, v FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS v FROM documents)),
w AS (SELECT lang, piece, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT lang, piece, regexp_extract_all(v, '[^\x20\x09]+') AS x FROM p)),
s AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM (SELECT lang, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3, w || ' ' || w2 || ' ' || w3 || ' ' || w4]) AS phrase, unnest([1, 2, 3, 4]) AS k FROM s) WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= {SUPPORT}),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS v FROM g WHERE k > 1),
x AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(v[1 : k], ' ') AS head, array_to_string(v[k + 1 :], ' ') AS rest FROM (SELECT lang, phrase, a, v, unnest(range(1, size)) AS k FROM c)),
u AS (SELECT x.lang, x.phrase, a, x.k, h.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (h.f::HUGEINT + r.f))::BIGINT AS score FROM x JOIN g h ON h.lang = x.lang AND h.phrase = head JOIN g r ON r.lang = x.lang AND r.phrase = rest),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT c.lang, array_to_string(c.v[i.i : i.i + m.m - 1], ' ') AS phrase, max(c.a) AS longer FROM c, range(2, {WORDS}) m(m), range(1, {WORDS}) i(i) WHERE m.m < c.size AND i.i + m.m - 1 <= c.size GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < {COVER}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= {BEST}"""

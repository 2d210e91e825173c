"""Quality rules by robust multivariate outliers (operator 8), DataFrame operations only.

Method: minimum-covariance-determinant estimates per language and source. The
transformed statistics of a document form a vector. In each group several robust
starts (medians with the spread between quartiles; moments inside the box of the
5 % and 95 % quantiles; moments weighted down with the distance from the median;
moments of all rows) go through concentration steps, each of which takes the mean
and the covariance of the share ``SHARE`` of rows that lie nearest; the start
whose covariance has the least determinant goes on, and a last step reweights
with all rows below the ``NEAR`` quantile. A document whose Mahalanobis distance
is above the ``CUT`` quantile of chi-square is rejected.

Quantiles come from fixed histograms, whose counts add up in any order, and the
bins of a distance hold the moments of their rows too, so that a step is one
pass; the nearest share ends with the bin that fills it.

A null language or source counts as a group value of its own. A group whose last
estimate holds fewer than ``LEAST`` rows is judged by the estimate of its
language, or where that is too small by the one of all rows, made by the same
steps; only where all rows together are too few is nothing rejected. Rows that
fail the base rules take no part in the estimates. Null texts have no words.
Repeated rows count each; an empty table gives an empty result. Columns of the
input other than the text stay, but for those named as one of the results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import quoted

SHARE, STEPS, LEAST = 0.75, 2, 20
#: Standard deviations that are added to those of a group, so that a statistic that hardly varies rejects nothing by itself.
FLOORS = {"x_length": 0.35, "x_symbols": 0.25, "x_lines": 0.15, "x_repeats": 0.15}
#: Groups up to which their estimates (about 700 bytes each) are broadcast; above it, joined with salt.
MOST_GROUPS, SALTS = 20_000, 32


def below(x: float, degrees: int) -> float:
    """Share of chi-square with 4 or 6 degrees below ``x``."""
    h = x / 2
    return 1 - math.exp(-h) * (1 + h + (h * h / 2 if degrees == 6 else 0))


def quantile(p: float) -> float:
    """Quantile of chi-square with 4 degrees, one for each statistic."""
    low, high = 0.0, 200.0
    for _ in range(100):
        low, high = ((low + high) / 2, high) if below((low + high) / 2, 4) < p else (low, (low + high) / 2)
    return low


#: Squared distance above which a row is an outlier, and up to which it counts in the last estimate.
CUT, NEAR = quantile(0.9999), quantile(0.95)
#: What makes up for the rows left out, where the statistics are normal.
WIDEN, WIDEN_NEAR = SHARE / below(quantile(SHARE), 6), 0.95 / below(NEAR, 6)

GAP, WORD, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shifted(a: Column, fill: Column) -> Column:
    return F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(fill))


def _repeat_words(w: Column) -> Column:
    """Words in windows of three words that the text has twice or more.

    Windows are compared by a 64-bit hash within the text. Sorting finds the
    windows that occur again; only texts that have any look up where they are.
    """
    n = F.size(w)
    windows = F.arrays_zip(F.slice(w, F.lit(1), n - 2).alias("a"), F.slice(w, F.lit(2), n - 2).alias("b"), F.slice(w, F.lit(3), n - 2).alias("c"))
    hashes = F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
        equal = lambda s: F.zip_with(s, _shifted(s, none), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        places = _let(pairs, lambda s: F.sort_array(F.array_distinct(F.flatten(F.filter(equal(s), lambda x: x.isNotNull())))))
        gaps = lambda p: F.zip_with(p, _shifted(p, F.lit(None).cast("int")), lambda x, y: F.least(F.lit(3), y - x))  # noqa: E731  least() passes over the null after the last
        return _let(places, lambda p: F.aggregate(gaps(p), F.lit(0), lambda s, x: s + x))

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n >= 3, found).otherwise(0)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, GAP), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    d = df.withColumns({"_w": of_words, "_l": of_lines, "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long")})
    get = lambda c, k: F.col(f"{c}.{k}").cast("long").alias(k)
    return d.select(*[c for c in df.columns if c != text], get("_w", "n_words"), get("_w", "word_chars"), "n_symbols", get("_l", "n_lines"), get("_l", "n_dup_lines"), get("_w", "n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vectors(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return d.withColumns(
        {
            "x_length": F.col("word_chars") / n,
            "x_symbols": F.log1p(10 * F.col("n_symbols") / n),
            "x_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "x_repeats": F.col("n_repeat_words") / n,
        }
    )


X = list(FLOORS)
N = len(X)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]


def _attach(d: DataFrame, groups: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with what is known of their group. A group of any size stays spread over all tasks."""
    if few:
        return d.join(F.broadcast(groups), "_group", how)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.withColumn("_salt", F.pmod(F.xxhash64(*X, "_group"), F.lit(SALTS)).cast("int")).join(salted, ["_group", "_salt"], how).drop("_salt")


# Sums over all pairs of statistics are written as SQL text, which costs one call for each, not one for each operation.


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    dx = [f"({x} - {mean}[{i}])" for i, x in enumerate(X)]
    terms = [f"{inverse}[{k}] * {dx[i]} * {dx[j]} * {1 if i == j else 2}D" for k, (i, j) in enumerate(PAIRS)]
    return F.expr(f"greatest({' + '.join(terms)}, 0D)")


SUMS = ["n", *(f"a{i}" for i in range(N)), *(f"c{i}{j}" for i, j in PAIRS)]


def _moments(weight: str = "1D", mark: str = "") -> list[Column]:
    """Sums of the weights, of the statistics and of their products, by weight."""
    terms = [weight, *(f"{weight} * {x}" for x in X), *(f"{weight} * {X[i]} * {X[j]}" for i, j in PAIRS)]
    return [F.expr(f"sum({t}) AS {k}{mark}") for k, t in zip(SUMS, terms)]


def _estimate(d: DataFrame, keys: list[str], widen: float) -> DataFrame:
    """Rows, mean, inverse covariance and determinant from the sums of _moments, by minors of two rows."""
    cov = [f"(c{i}{j} / n - a{i} * a{j} / n / n) * {widen}D + {FLOORS[X[i]] ** 2 if i == j else 0.0}D AS v{i}{j}" for i, j in PAIRS]
    d = d.where("n > 0").selectExpr(*keys, "n", f"array({', '.join(f'a{i} / n' for i in range(N))}) AS mean", *cov)
    v = lambda i, j: f"v{max(i, j)}{min(i, j)}"
    two = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    d = d.selectExpr("*", *(f"{v(r, i)} * {v(q, j)} - {v(q, i)} * {v(r, j)} AS {k}{i}{j}" for k, r, q in (("s", 0, 1), ("t", 2, 3)) for i, j in two))
    adjugate = {
        (0, 0): "v11 * t23 - v21 * t13 + v31 * t12",
        (1, 0): "v20 * t13 - v10 * t23 - v30 * t12",
        (1, 1): "v00 * t23 - v20 * t03 + v30 * t02",
        (2, 0): "v31 * s23 - v32 * s13 + v33 * s12",
        (2, 1): "v32 * s03 - v30 * s23 - v33 * s02",
        (2, 2): "v30 * s13 - v31 * s03 + v33 * s01",
        (3, 0): "v22 * s13 - v21 * s23 - v32 * s12",
        (3, 1): "v20 * s23 - v22 * s03 + v32 * s02",
        (3, 2): "v21 * s03 - v20 * s13 - v32 * s01",
        (3, 3): "v20 * s12 - v21 * s02 + v22 * s01",
    }
    d = d.withColumn("det", F.expr("s01 * t23 - s02 * t13 + s03 * t12 + s12 * t03 - s13 * t02 + s23 * t01"))
    return d.selectExpr(*keys, "n AS rows", "mean", f"array({', '.join(f'({adjugate[p]}) / det' for p in PAIRS)}) AS inverse", "det")


#: Bins of a statistic: even near 0, in proportion above.
_bin = lambda x: F.floor(F.asinh(x * 4) * 64)
_middle = lambda b: F.sinh((b + F.lit(0.5)) / 64) / 4
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _quantiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each group its rows, and ``q``: for each statistic the quantiles, from fixed histograms."""
    d = rows.select(*keys, F.posexplode(F.array(*(_bin(F.col(x)) for x in X)))).groupBy(*keys, "pos", "col").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys, "pos")
    d = d.withColumns({"upto": F.sum("n").over(w.orderBy("col")), "rows": F.sum("n").over(w)})
    found = d.groupBy(*keys, "pos").agg(F.max("rows").alias("rows"), F.array(*(_middle(F.min(F.when(F.col("upto") >= f * F.col("rows"), F.col("col")))) for f in QUANTILES)).alias("q"))
    return found.groupBy(*keys).agg(F.max("rows").alias("rows"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"]).alias("q"))


def _starts(rows: DataFrame, quantiles: DataFrame, few: bool) -> DataFrame:
    """The starts of each group: ``_group``, ``start``, ``mean`` and ``inverse``."""
    spread = [f"(pow((q[{i}][3] - q[{i}][1]) / 1.349D, 2) + {FLOORS[x] ** 2}D)" for i, x in enumerate(X)]
    inverse = ", ".join(f"1 / {spread[i]}" if i == j else "0D" for i, j in PAIRS)
    middle = quantiles.selectExpr("_group", "0 AS start", f"array({', '.join(f'q[{i}][2]' for i in range(N))}) AS mean", f"array({inverse}) AS inverse")
    box = " AND ".join(f"{x} BETWEEN q[{i}][0] - 0.01D AND q[{i}][4] + 0.01D" for i, x in enumerate(X))
    far = " + ".join(f"pow({x} - q[{i}][2], 2) / {spread[i]}" for i, x in enumerate(X))
    near = _attach(rows, quantiles.select("_group", "q"), few).selectExpr("_group", *X, f"IF({box}, 1D, 0D) AS w1", f"1D / (1D + {far}) AS w2", "1D AS w3")
    sums = near.groupBy("_group").agg(*(m for k in (1, 2, 3) for m in _moments(f"w{k}", f"_{k}")))
    each = ", ".join(f"named_struct('start', {k}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}_{k}' for n in SUMS)})" for k in (1, 2, 3))
    sums = sums.selectExpr("_group", f"explode(array({each})) AS e").select("_group", "e.*")
    return middle.union(_estimate(sums, ["_group", "start"], 1.0).select("_group", "start", "mean", "inverse"))


def _step(rows: DataFrame, starts: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every start: the estimate of the nearest share of its group."""
    known = starts.groupBy("_group").agg(F.collect_list(F.struct("start", "mean", "inverse")).alias("e"))
    near = _attach(rows, known, few).select("_group", *X, F.explode("e").alias("e")).select("_group", *X, "e.*")
    bins = near.groupBy("_group", "start", F.floor(16 * F.log2(1 + _distance())).alias("bin")).agg(*_moments())
    w = W.partitionBy("_group", "start")
    bins = bins.withColumns({"before": F.sum("n").over(w.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(w)}).where(F.col("before") < SHARE * F.col("all"))
    return _estimate(bins.groupBy("_group", "start").agg(*(F.sum(c).alias(c) for c in SUMS)), ["_group", "start"], WIDEN).checkpoint()


def _fit(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The last estimate of each ``_group``, all groups (with their ``_lang``, if given), and the number of them."""
    every = _quantiles(rows, [c for c in ("_group", "_lang") if c in rows.columns]).checkpoint()
    rows, n = rows.select("_group", *X), every.count()
    few = n <= MOST_GROUPS
    tried = _starts(rows, every.drop("_lang"), few)
    for _ in range(STEPS):
        tried = _step(rows, tried, few)
    best = tried.groupBy("_group").agg(F.min(F.struct("det", "start", "mean", "inverse")).alias("e")).select("_group", "e.start", "e.mean", "e.inverse")
    best = _step(rows, best, few).select("_group", "mean", "inverse")
    inner = _attach(rows, best, few).where(_distance() <= NEAR)
    return _estimate(inner.groupBy("_group").agg(*_moments()), ["_group"], WIDEN_NEAR).drop("det").checkpoint(), every.drop("q", "rows"), n


def _judges(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The estimate that judges each ``_group`` of ``rows`` (with ``_lang``): its own, its language's, or that of all rows.

    The larger estimates are made only where a group needs them.
    """
    own, every, n = _fit(rows)
    strong, few = own.where(F.col("rows") >= LEAST), n <= MOST_GROUPS
    if strong.count() == n:
        return strong, few
    left = every.select("_group", "_lang").join(strong.select("_group"), "_group", "left_anti").checkpoint()
    for up in (F.col("_lang"), F.lit("")):
        wide = _fit(rows.select(up.alias("_group"), *X))[0].where(F.col("rows") >= LEAST).withColumnRenamed("_group", "_up")
        met = left.withColumn("_up", up).join(wide, "_up", "left").drop("_up").checkpoint()
        strong = strong.unionByName(met.where(F.col("rows").isNotNull()).drop("_lang"))
        left = met.where(F.col("rows").isNull()).select("_group", "_lang")
        if left.isEmpty():
            break
    return strong, few


RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def judge(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``df`` without its text, with the statistics, base_failed, distance and kept.

    The statistics are worked out once and kept by checkpoint(); each estimate is
    one row a group. A row is read a few times, as four numbers.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("s"), F.regexp_replace(c, "\x01", "\x01\x01")), F.lit("n"))
    others = [c for c in df.columns if c.lower() != text.lower()]
    packed = df.select(F.struct(*map(quoted, others)).alias("_row"), mark(lang).alias("_lang"), F.concat_ws("\x01|", mark(lang), mark(source)).alias("_group"), F.col(text).alias("text"))
    d = _vectors(statistics(packed).withColumn("base_failed", base_failed())).checkpoint()
    final, few = _judges(d.where(~F.col("base_failed")).select("_group", "_lang", *X))
    out = _attach(d, final.select("_group", "mean", "inverse"), few, "left").withColumn("distance", F.when(F.col("mean").isNotNull(), _distance()))
    far = F.coalesce(F.col("distance") > CUT, F.lit(False))
    kept = [F.col(f"_row.{quoted(c)}").alias(c) for c in others if c.lower() not in RESULTS]
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select(*kept, *RESULTS)

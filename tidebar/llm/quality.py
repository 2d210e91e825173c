"""Quality classifier (operator 7).

Method: histogram gradient-boosted trees over statistics of the document,
flattened into arrays and walked with numpy. Statistics come from the whole
text; null and empty texts have the statistics 0. The trees are fitted on at
most ``SAMPLE`` labelled documents, taken in the order of a hash of their key;
without labels of both kinds every score is the share of label 1 among those
seen (one half if there are none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import Trees, fit
from .textbatch import LETTER, NUMBER, OTHER, Flat, classes, plain_words, text_slices

SAMPLE = 20_000
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "letters", "digits", "marks", "symbols", "capitals", "distinct_words", "commonest_word",
    "repeated_neighbours", "repeated_windows", "lines", "repeated_lines", "words_per_line", "bars", "closed_by_mark", "loud", "long_words", "short_words",
)
_U = np.uint64


def _groups(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: distinct keys, items of keys that occur again, and the most of one key."""
    order = np.argsort(key + row.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    k, r = key[order], row[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1]))) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count, owner = np.diff(np.append(at, len(k))), r[at]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, count)
    return np.bincount(owner, minlength=n), np.bincount(owner, np.where(count > 1, count, 0), n), most


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, len(STATISTICS)) statistics."""
    n, flat = len(texts), Flat(texts)
    p = flat.points
    if not len(p):
        return np.zeros((n, len(STATISTICS)))
    row = np.repeat(np.arange(n), np.diff(np.concatenate(([0], flat.ends))))
    per = lambda flags: np.bincount(row[flags], minlength=n)
    kind = classes()[p]
    starts, ends = plain_words(flat)
    owner, length = row[starts], ends - starts
    words = np.bincount(owner, minlength=n)
    key = flat.keys(starts, ends)[0] if len(starts) else np.zeros(0, np.uint64)
    distinct, _, most = _groups(owner, key, n)
    again = np.bincount(owner[1:][(key[1:] == key[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(key) else np.zeros(n)
    whole = np.flatnonzero(owner[2:] == owner[:-2])
    window = (key[whole] * _U(0xD6E8FEB86659FD93) + key[whole + 1]) * _U(0xD6E8FEB86659FD93) + key[whole + 2]
    repeated = _groups(owner[whole], window, n)[1]
    cut = np.flatnonzero((p == 10) | flat.first())
    line_ends = np.append(cut[1:], len(p))
    line_starts = cut + (p[cut] == 10)
    full = line_ends > line_starts
    line_row = row[cut[full]]
    lines = np.bincount(line_row, minlength=n)
    unique = _groups(line_row, flat.keys(line_starts[full], line_ends[full])[0], n)[0] if full.any() else np.zeros(n)
    letters, symbols = per(kind == LETTER), per(np.isin(p, np.frombuffer("#*$%&|<>".encode("utf-32-le"), np.uint32)))
    capital = per((p >= 65) & (p <= 90) | (p >= 0xC0) & (p <= 0xDE))
    chars, filled = np.maximum(per(kind != 0), 1), np.maximum(words, 1)
    total = np.bincount(owner, length, n)
    mean = total / filled
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / filled - mean**2, 0))
    by_word = lambda flags: np.bincount(owner[flags], minlength=n) / filled
    final = p[ends - 1] if len(ends) else p[:0]
    table = [
        np.log1p(words), mean, spread, letters / chars, per(kind == NUMBER) / chars, per(kind == OTHER) / chars, symbols / chars, capital / np.maximum(letters, 1), distinct / filled, most / filled,
        again / filled, repeated / filled, np.log1p(lines), 1 - unique / np.maximum(lines, 1), words / np.maximum(lines, 1), per(p == 0x7C) / filled, by_word(classes()[final] == OTHER), by_word(final == 0x21), by_word(length > 12), by_word(length < 3),
    ]
    out = np.stack([np.asarray(t, np.float64) for t in table], 1)
    out[words == 0, 13] = 0
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents.

    The chosen keys (at most ``sample`` rows) are broadcast to pick the texts;
    the driver gets their statistics, 20 numbers a row. Several labels of one
    key count as the largest, rows of one key as the first by its statistics.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample)

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch.column(2)):
                part, s = batch.slice(lo, len(texts)), statistics(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int64()), pa.array(list(s), pa.list_(pa.float64()))], names=["k", "y", "x"])

    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(key, label, text).mapInArrow(run, "k long, y long, x array<double>")
    rows = rows.groupBy("k").agg(F.min(F.struct("x", "y")).alias("r")).select("k", "r.x", "r.y").toArrow().sort_by("k")
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(rows.num_rows, len(STATISTICS))
    return fit(x, rows.column("y").to_numpy().astype(np.float64))


def score(df: DataFrame, trees: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each text; other columns pass through, one named as the result gives way."""
    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    kept = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch.column(text)):
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(trees.predict(statistics(texts)))], names=[*kept, out])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))

"""Language identification (operator 5).

Method: hyperdimensional profiles. Each letter has a random vector of +1 and
-1; the vector of three letters in a row binds the letters' vectors, each
permuted by its place; a text bundles (adds) the vectors of all its triples, a
language those of all its texts, each with the same weight; the language with the nearest prototype by
cosine wins, ties going to the first in code-point order.

Letters are in lower case, a run of other characters counts as one gap. Null
texts and texts without a letter are ``und`` with score 0, and so is every text
if nothing could be learned. Rows are kept one for one, repeated ones too.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import LETTER, classes, give_back, slices

SIZE, SEED = 1024, 20240
#: What a text adds to its language's prototype in all, whatever its length.
WEIGHT = 1 << 16
#: Letters below this code point have an id of their own; others share the rest of 256.
PLAIN = 0x180


@functools.lru_cache(1)
def letter_ids() -> np.ndarray:
    """Id of each code point: 0 for what isn't a letter."""
    kind = classes()
    table = (np.arange(0x110000) * 2654435761 >> 8) % 100 + 156
    low = [c for c in range(PLAIN) if kind[c] == LETTER and chr(c).lower() == chr(c)][:155]
    table[:PLAIN] = 255
    table[low] = np.arange(1, len(low) + 1)
    table[kind != LETTER] = 0
    return table.astype(np.uint8)


@functools.lru_cache(1)
def letter_vectors() -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (256, SIZE), np.int8) * 2 - 1).astype(np.int8)


class Bundler:
    """Sums of the vectors of letter triples by group."""

    def __init__(self):
        self.known, self.vectors = np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32)

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) != len(self.known) or (codes != self.known).any():
            v = letter_vectors()
            out = np.roll(v, 2, 1)[codes >> 16] * np.roll(v, 1, 1)[codes >> 8 & 255] * v[codes & 255]
            self.known, self.vectors = codes, out.astype(np.float32)
        return self.vectors

    def sums(self, texts: list[str], groups: np.ndarray, n: int, even: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(n, SIZE) bundles, and the number of letters of each group.

        With ``even`` all texts weigh alike, by whole numbers, so that sums don't depend on their order.
        """
        lower = [t.lower() for t in texts]
        points = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(lower)), np.fromiter(map(len, lower), np.int64, len(lower)))
        ids = letter_ids()[points]
        letters = np.bincount(groups[row[ids > 0]], minlength=n)
        keep = ids > 0
        keep[1:] |= (ids[:-1] > 0) & (row[1:] == row[:-1])
        ids, row = ids[keep], row[keep]
        if len(ids) < 3:
            return np.zeros((n, SIZE)), letters
        here = np.flatnonzero(np.bincount(ids, minlength=256))
        small = np.zeros(256, np.int64)
        small[here] = np.arange(len(here))
        k, dense = len(here), small[ids]
        code = (dense[:-2] * k + dense[1:-1]) * k + dense[2:]
        same = row[2:] == row[:-2]
        code, mine = code[same], row[2:][same]
        owner = groups[mine]
        present = np.flatnonzero(np.bincount(code, minlength=k**3))
        column = np.zeros(k**3, np.int64)
        column[present] = np.arange(len(present))
        weight = np.maximum(1, WEIGHT // np.maximum(np.bincount(mine, minlength=len(lower)), 1))[mine] if even else None
        counts = np.bincount(owner * len(present) + column[code], weight, n * len(present)).reshape(n, len(present))
        codes = here[present // (k * k)] << 16 | here[present // k % k] << 8 | here[present % k]
        vectors = self._vectors(codes)
        if even:
            return sum(counts[:, k : k + 1024] @ vectors[k : k + 1024].astype(np.float64) for k in range(0, len(codes), 1024)), letters
        return counts.astype(np.float32) @ vectors, letters


def _row_slices(texts: list[str]):
    """Slices of at most 256 rows: the counts of a slice are a dense table."""
    return slices([max(len(t), 4096) for t in texts])


def prototypes(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Sums of the vectors of all texts of each language.

    Each task adds up its texts; the sums are added in two rounds, so that no
    task gets more than a share of them. One vector for each language (8 kB)
    reaches the driver; their number is that of languages, not of texts.
    """
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def learn(batches):
        from pyspark import TaskContext

        total: dict[str, np.ndarray] = {}
        bundler = Bundler()
        for batch in batches:
            texts, langs = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for lo, hi in _row_slices(texts):
                names = sorted(set(langs[lo:hi]))
                group = {n: i for i, n in enumerate(names)}
                sums, _ = bundler.sums(texts[lo:hi], np.array([group[x] for x in langs[lo:hi]]), len(names), even=True)
                for n, v in zip(names, sums.astype(np.float64)):
                    total[n] = total.get(n, 0) + v
        del bundler
        give_back()
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({"lang": list(total), "part": [part] * len(total), "total": [v.tolist() for v in total.values()]}, schema=pa.schema([("lang", pa.string()), ("part", pa.int32()), ("total", pa.list_(pa.float64()))]))

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(v) for v in table.column("total").to_pylist()], axis=0)
        return pa.table({"lang": table.column("lang")[:1], "part": pa.array([0], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    sums = docs.where(F.col(lang).isNotNull()).select(lang, text).mapInArrow(learn, kind)
    sums = sums.groupBy("lang", "part").applyInArrow(add, kind).groupBy("lang").applyInArrow(add, kind)
    rows = sorted((r for r in sums.toLocalIterator() if any(r["total"])), key=lambda r: r["lang"])
    vectors = np.array([r["total"] for r in rows]).reshape(len(rows), SIZE)
    return [r["lang"] for r in rows], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def classify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the nearest language and its cosine, cut to 0 to 1; other columns pass through, those named as a result give way."""
    from pyspark.sql import types as T

    names, table = model
    table = table.T.astype(np.float32)
    fields = [f for f in df.schema.fields if f.name.lower() not in (label.lower(), score.lower())]
    schema = T.StructType([*fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    kept = [f.name for f in fields]

    def run(batches):
        bundler = Bundler()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for lo, hi in _row_slices(texts):
                n = hi - lo
                sums, letters = bundler.sums(texts[lo:hi], np.arange(n), n)
                length = np.linalg.norm(sums, axis=1)
                if names:
                    near = sums @ table / np.where(length > 0, length, 1)[:, None]
                    best = near.argmax(1)
                    value = np.where(letters > 0, np.clip(near[np.arange(n), best], 0, 1), 0)
                    said = [names[b] if k else "und" for b, k in zip(best.tolist(), letters.tolist())]
                else:
                    value, said = np.zeros(n), ["und"] * n
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(said, pa.string()), pa.array(value.astype(np.float64))], names=[*kept, label, score])
        del bundler
        give_back()

    return df.mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether the row is not learned from: CRC-32 of the key as text, by its remainder; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == fold

"""Vector codes: each of four parts of a vector becomes the index of a codebook entry (operator 12).

Method: dual-tree Lloyd. The parts of a chunk of vectors stand in a balanced
tree (kept in a table in the tree's order, so it is built once), the entries of
a codebook in another. Pairs of nodes go down both trees together; a pair is
dropped once the least distance of its boxes is above the largest distance of
another entry node to the same points. A node of points with one entry left is
assigned whole, by its cached sum; leaves with several are settled by integer
distances. So results are those of comparing everything, ties included.

A round is one pass over the chunks, whose result is a row for each entry that a
task used; the codebooks (``ENTRIES`` by four parts) are all that the driver
holds.

Vectors that are null, hold null or non-finite components, or components of
2^17 and more in size (their errors leave 64 bits) take no part, nor do those
with another length than the first one by key (the first whose length is a
multiple of four). Without any vector the result is empty. Rows with a null key
are coded, but never begin a codebook; repeated rows keep a row each. Columns
beside key and carried ones are not kept, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept, quoted
from .textbatch import ragged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a chunk at most, points of a leaf, entries of a leaf, labels that are broadcast at most.
CHUNK, LEAF, BROADCAST = 1 << 19, 32, 20_000
LARGEST = 1 << 17


class Tree:
    """A balanced tree over rows of integers: level t cuts the ordered rows into 2^t stretches of nearly equal size.

    ``order`` has the rows in the tree's order; each level halves a node along
    the widest side of its box.
    """

    def __init__(self, rows: np.ndarray, leaf: int, ordered: bool = False):
        n = len(rows)
        self.depth = max(0, (n // leaf).bit_length() - 1)  # no node is empty
        order = np.arange(n)
        if not ordered:
            for t in range(self.depth):
                cuts = self.cuts(n, t)
                low, high = (f.reduceat(rows[order], cuts[:-1]) for f in (np.minimum, np.maximum))
                wide = np.argmax(high - low, 1)
                node = np.repeat(np.arange(len(wide)), np.diff(cuts))
                order = order[np.lexsort((rows[order, wide[node]], node))]
        self.order, self.rows = order, rows if ordered else rows[order]
        cuts = self.cuts(n, self.depth)
        self.low, self.high, self.sum = ([f.reduceat(self.rows, cuts[:-1])] for f in (np.minimum, np.maximum, np.add))
        for _ in range(self.depth):
            for kept_, join in ((self.low, np.minimum), (self.high, np.maximum), (self.sum, np.add)):
                kept_.insert(0, join(kept_[0][::2], kept_[0][1::2]))

    @staticmethod
    def cuts(n: int, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * n >> level


def _bounds(points: Tree, a: int, p: np.ndarray, entries: Tree, b: int, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between the boxes of nodes."""
    below = entries.low[b][e] - points.high[a][p]
    above = points.low[a][p] - entries.high[b][e]
    gap = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(entries.high[b][e] - points.low[a][p]), np.abs(points.high[a][p] - entries.low[b][e]))
    return (gap * gap).sum(1), (far * far).sum(1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances as integers; as products of doubles where these hold them exactly."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * 4 * largest * largest < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - c[None, :, j]
        out += d * d
    return out


def assign(points: Tree, entries: Tree) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
    """What the points belong to: (from, to, entry, sum) for a node that goes whole, (from, to, entries, None) for a leaf.

    Rows count in the points' tree order, entries by their index in the codebook.
    """
    n, a, b = len(points.rows), 0, 0
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends = Tree.cuts(len(entries.rows), entries.depth)
    while True:
        near, far = _bounds(points, a, p, entries, b, e)
        best = np.full(1 << a, np.iinfo(np.int64).max)
        np.minimum.at(best, p, far)
        fine = near <= best[p]
        p, e = p[fine], e[fine]
        if b == entries.depth:
            left = np.bincount(p, minlength=1 << a)
            cuts = Tree.cuts(n, a)
            alone = (left[p] == 1) & (ends[e + 1] - ends[e] == 1)
            for node, entry in zip(p[alone].tolist(), ends[e[alone]].tolist()):
                yield int(cuts[node]), int(cuts[node + 1]), int(entries.order[entry]), points.sum[a][node]
            p, e = p[~alone], e[~alone]
            if a == points.depth:
                break
        if not len(p):
            return
        if a < points.depth:
            a, p, e = a + 1, np.concatenate((2 * p, 2 * p + 1)), np.concatenate((e, e))
        if b < entries.depth:
            b, p, e = b + 1, np.concatenate((p, p)), np.concatenate((2 * e, 2 * e + 1))
    # What is left: leaves with the entries of their nodes.
    order = np.argsort(p, kind="stable")
    p, e = p[order], e[order]
    p, e = np.repeat(p, ends[e + 1] - ends[e]), entries.order[ragged(ends[e], ends[e + 1] - ends[e])]
    book = np.empty_like(entries.rows)
    book[entries.order] = entries.rows
    edges = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else np.zeros(1, np.int64)
    cuts = Tree.cuts(n, points.depth)
    for lo, hi in zip(edges[:-1], edges[1:]):
        start, end = int(cuts[p[lo]]), int(cuts[p[lo] + 1])
        some = np.sort(e[lo:hi])
        yield start, end, some[_distances(points.rows[start:end], book[some]).argmin(1)], None


def _entry_tree(book: np.ndarray) -> Tree:
    return Tree(book, 1)


def _chunks(df: DataFrame, vector: str, carry: Sequence[str], width: int) -> DataFrame:
    """A row for each chunk of vectors: the carried columns as lists, and for each part its integers in tree order and that order."""
    schema = T.StructType([*(T.StructField(f"c{i}", T.ArrayType(df.schema[c].dataType)) for i, c in enumerate(carry)), T.StructField("points", T.BinaryType()), T.StructField("orders", T.BinaryType())])
    most = max(1, CHUNK // (PARTS * width))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                n = part.num_rows
                x = np.asarray(part.column(len(carry)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, PARTS, width)
                whole = np.floor(x * SCALE).astype(np.int64)
                trees = [Tree(np.ascontiguousarray(whole[:, k]), LEAF) for k in range(PARTS)]
                ends = pa.array([0, n], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, part.column(i)) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.stack([t.rows for t in trees]).astype("<i4").tobytes()], pa.binary()), pa.array([np.stack([t.order for t in trees]).astype("<i4").tobytes()], pa.binary())], names=schema.names)

    return df.select(*map(quoted, carry), quoted(vector)).mapInArrow(run, schema)


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[Tree], np.ndarray]]:
    """(row of the batch, trees of the parts, their orders) of each chunk."""
    at = batch.schema.get_field_index("points")
    for i in range(batch.num_rows):
        points = np.frombuffer(batch.column(at)[i].as_py(), "<i4").reshape(PARTS, -1, width).astype(np.int64)
        orders = np.frombuffer(batch.column(at + 1)[i].as_py(), "<i4").reshape(PARTS, -1)
        yield i, [Tree(points[k], LEAF, ordered=True) for k in range(PARTS)], orders


def _round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: the mean of an entry's parts, floors going down; unused entries stay."""
    width = books.shape[2]

    def run(batches):
        entries = [_entry_tree(books[k]) for k in range(PARTS)]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, trees, _ in _trees(batch, width):
                for k in range(PARTS):
                    for lo, hi, entry, total in assign(trees[k], entries[k]):
                        if total is None:
                            np.add.at(sums[k], entry, trees[k].rows[lo:hi])
                            counts[k] += np.bincount(entry, minlength=len(counts[k]))
                        else:
                            sums[k, entry] += total
                            counts[k, entry] += hi - lo
        part, entry = np.nonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(sums[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), flat], names=["part", "entry", "n", "sums"])

    found = chunks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width))).collect()  # at most PARTS * ENTRIES rows
    out = books.copy()
    for part, entry, n, *sums in rows:
        out[part, entry] = [s // n for s in sums]
    return out


def codebooks(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> np.ndarray | None:
    """The codebooks to start from: the parts of the vectors with the smallest keys. ``None`` without any vector."""
    ordered = df.where(F.col(quoted(key)).isNotNull() & (F.size(quoted(vector)) > 0) & (F.size(quoted(vector)) % PARTS == 0)).orderBy(quoted(key), quoted(vector))
    first = ordered.select(quoted(vector)).first()
    if first is None:
        return None
    size = len(first[0])
    rows = ordered.where(F.size(quoted(vector)) == size).select(quoted(vector)).limit(ENTRIES).collect()
    x = np.array([r[0] for r in rows], np.float64)
    return np.floor(x * SCALE).astype(np.int64).reshape(len(rows), PARTS, size // PARTS).transpose(1, 0, 2)


def fine_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector takes part; a comparison with NaN or null is never true, as NaN is above all numbers here."""
    return df.where(F.col(quoted(vector)).isNotNull() & F.forall(quoted(vector), lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False))))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: Sequence[str] = (), rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key and carried columns with ``code``, a list of ``PARTS`` indexes, and ``error``; the codebooks) after ``rounds`` rounds."""
    fine, names = fine_vectors(df, vector), [key, *carry]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("code", T.ArrayType(T.IntegerType(), False), False), T.StructField("error", T.LongType(), False)])
    books = codebooks(fine, key, vector)
    if books is None:
        return df.sparkSession.createDataFrame([], schema), np.zeros((PARTS, 0, 0), np.int64)
    width = books.shape[2]
    chunks = kept(_chunks(fine.where(F.size(quoted(vector)) == width * PARTS), vector, names, width), "vector-chunks")
    for _ in range(rounds):
        books = _round(chunks, books)

    def run(batches):
        entries = [_entry_tree(books[k]) for k in range(PARTS)]
        for batch in batches:
            for i, trees, orders in _trees(batch, width):
                n = orders.shape[1]
                code, error = np.empty((n, PARTS), np.int32), np.zeros(n, np.int64)
                for k in range(PARTS):
                    chosen = np.empty(n, np.int64)
                    for lo, hi, entry, _ in assign(trees[k], entries[k]):
                        chosen[lo:hi] = entry
                    off = trees[k].rows - books[k][chosen]
                    code[orders[k], k] = chosen
                    error[orders[k]] += (off * off).sum(1)
                columns = [batch.column(j)[i].values for j in range(len(names))]
                codes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * PARTS, pa.int32()), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, codes, pa.array(error)], names=schema.names)

    return chunks.mapInArrow(run, schema), books


def decode(df: DataFrame, books: np.ndarray, code: str = "code", out: str = "vector") -> DataFrame:
    """``df`` with the vector that a code stands for: its entries, back in the scale of the vectors."""
    table = F.lit((books / SCALE).tolist()).cast("array<array<array<double>>>")
    return df.withColumn(out, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.get(F.get(table, k), F.get(F.col(code), k)))))


def report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code as hexadecimal digits, error, the errors of its label in sum, and a digest of the codebooks."""
    coded, books = encode(df, key, vector, [label])
    digits = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    coded = kept(coded.select(F.col(quoted(key)).alias("_key"), digits.alias("code"), "error", F.col(quoted(label)).alias("_label")), "vector-codes")
    sums = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _book_sql(k: int) -> str:
    """A round in DuckDB's SQL: ``b{k}`` has the codebooks (part, entry, values), ``a{k}`` the entry of each vector's part."""
    assigned = f"""a{k} AS MATERIALIZED (SELECT vec_id, part, x, min(d)[1] AS d, min(d)[2] AS entry FROM (SELECT vec_id, p.part, x, [list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry] AS d FROM p JOIN b{k} b ON b.part = p.part) GROUP BY ALL)"""
    if k == ROUNDS:
        return assigned
    flat = f"m{k} AS (SELECT part, entry, j, (sum(v) // count(*) - CASE WHEN sum(v) < 0 AND sum(v) % count(*) <> 0 THEN 1 ELSE 0 END)::BIGINT AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS j FROM a{k}) GROUP BY part, entry, j)"
    book = f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(v ORDER BY j) AS c FROM m{k} GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry)"
    return f"{assigned}, {flat}, {book}"


#: The same by comparing everything with everything; for keys that are unique.
ORACLE = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM v, range({PARTS}) t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {ENTRIES}),
{", ".join(_book_sql(k) for k in range(ROUNDS + 1))},
r AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS s FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM r JOIN v USING (vec_id) CROSS JOIN h"""

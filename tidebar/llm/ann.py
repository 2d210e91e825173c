"""Approximate nearest neighbours by a permutation index (operator 10).

Method: a vector is represented by the order of its ``ORDER`` nearest pivots and
posted in the inverted files of its ``POSTED`` nearest ones. A query visits the
files of its ``n_visits`` nearest pivots only, ranks what they hold by the footrule
distance of the orders (a pivot missing from one of them counts as its last place), and the best ``SHARE`` of it is ranked again by the inner product.

Files stand together in blocks of bounded size; a file that is larger is split
by a hash of the vector. A query is sent to the blocks of its own pivots, each
pair of query and vector is handled in the file of the vector's first visited
pivot, and only the ``k`` best of a block go on. The number of pivots grows with
the root of the number of vectors, and the pivots visited with its power of two
thirds: the share of the table that a query meets falls as the table grows, while
the neighbours found don't become fewer.

Nearness is the inner product. Pivots' orders follow it after the usual
lifting, by which all vectors get the length of the longest. Vectors that are
null, empty, zero or hold a null or non-finite component take no part; shorter
vectors count as filled up with zeros. Copies of a vector are posted once and
all of them found; ties of the score go to the smaller id, however many there
are among the vectors met. Rows whose id is null take no part; of rows with one
id and several vectors each counts, and so does each repeated row as a
candidate, while a repeated query is asked once. Other columns, whatever their
names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import kept

ORDER, POSTED, SHARE = 64, 3, 0.25
#: Pivots that a query visits: this many times the power of two thirds of all, but no fewer than the least.
VISITS, LEAST_VISITS = 2.0, 144
#: Pivots: this many times the root of the number of vectors, within bounds; their components in all (8 bytes each) reach every task.
DENSITY, LEAST_PIVOTS, MOST_PIVOTS, MOST_COMPONENTS = 4.0, 64, 16_384, 1 << 21
#: Of what a query meets in a block, at least so many are ranked again.
FLOOR = 512
#: Postings of a block, queries of a block: what one task compares at once.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 8_192
RESULT = "query_id long, rank int, vec_id long, score double"


def valid(vector: str):
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def n_pivots(vectors: int, width: int) -> int:
    wanted = max(LEAST_PIVOTS, int(np.ceil(DENSITY * np.sqrt(vectors))))
    return max(1, min(wanted, vectors, MOST_PIVOTS, MOST_COMPONENTS // width))


def n_visits(pivots: int) -> int:
    return min(pivots, max(LEAST_VISITS, int(np.ceil(VISITS * pivots ** (2 / 3)))))


class Pivots:
    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors, self.longest = vectors, longest
        self.lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))

    def order(self, x: np.ndarray, query: bool, most: int) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        out, most = [], min(most, len(self.vectors))
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            near = part @ self.vectors.T
            if not query:
                near += np.sqrt(np.maximum(self.longest**2 - (part**2).sum(1), 0))[:, None] * self.lift
            first = np.sort(np.argpartition(-near, most - 1, 1)[:, :most], 1)
            by = np.argsort(-np.take_along_axis(near, first, 1), 1, kind="stable")
            out.append(np.take_along_axis(first, by, 1).astype("<u2"))
        return np.concatenate(out) if out else np.zeros((0, most), "<u2")


def _matrix(column, width: int) -> np.ndarray:
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _rows(column, kind) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of a vector with rows, summed in the order of the components, so that equal vectors get equal scores."""
    return np.cumsum(x * q, 1)[:, -1]


class Layout:
    """Where files stand: pivot p has files ``first[p]`` to ``first[p + 1]``, and each file one block."""

    def __init__(self, postings: np.ndarray):
        split = np.maximum(1, -(-postings // INDEX_BLOCK))
        self.first = np.concatenate(([0], np.cumsum(split)))
        size = np.repeat(-(-postings // split), split)
        self.block, now, held = np.zeros(len(size), np.int32), 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > INDEX_BLOCK:
                now, held = now + 1, 0
            self.block[i] = now
            held += n

    def file(self, pivots: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """File of each (vector, pivot), the vector's hash telling which part."""
        a, b = self.first[pivots], self.first[pivots + 1]
        return a + spread[:, None] % (b - a)

    def blocks_of_query(self, visits: np.ndarray) -> np.ndarray:
        """Sorted blocks of all files of the visited pivots."""
        a, b = self.first[visits], self.first[visits + 1]
        return np.unique(np.concatenate([self.block[a], *(self.block[x:y] for x, y in zip(a[b > a + 1], b[b > a + 1]))]))


def search_block(layout: Layout, block: int, ids: list, spread: np.ndarray, order: np.ndarray, x: np.ndarray, qids: list, visits: np.ndarray, q: np.ndarray, k: int, share: float, margin: float):
    """(query, ids, scores) of the k nearest that the block offers to each query."""
    n, length = order.shape
    order = order.astype(np.intp)
    posts = order[:, :POSTED]
    here = layout.block[layout.file(posts, spread)] == block
    row, rank = np.nonzero(here)
    by = np.argsort(posts[row, rank], kind="stable")
    row, rank = row[by], rank[by]
    others = posts[row]
    total = len(layout.first) - 1
    edge = np.searchsorted(posts[row, rank], np.arange(total + 1))
    count = np.array([len(i) for i in ids])
    every, first = np.array([i for x in ids for i in x], np.int64), np.cumsum(count) - count
    place, seen, steps = np.full(total, length, np.int16), np.zeros(total, bool), np.arange(length, dtype=np.int16)
    for i, mine in enumerate(visits.astype(np.int64)):
        place[mine[:length]], seen[mine] = steps[: len(mine)], True
        files = mine[edge[mine + 1] > edge[mine]]
        if len(files):
            at = np.concatenate([np.arange(edge[p], edge[p + 1]) for p in files.tolist()])
            cand = row[at[seen.take(others.take(at, 0)).argmax(1) == rank[at]]]  # those whose first visited pivot this is
            most = max(FLOOR, int(np.ceil(share * len(cand))))
            if most < len(cand):
                footrule = np.maximum(place.take(order.take(cand, 0)), steps).sum(1, dtype=np.int32)  # half of it, but for a constant
                cand = cand[footrule <= np.partition(footrule, most - 1)[most - 1]]
            rough = x.take(cand, 0) @ q[i]
            if len(cand) > k + 1:
                cand = cand[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - margin]
            if len(cand):
                score = exact(q[i], x[cand])
                found = every[np.repeat(first[cand] - (np.cumsum(count[cand]) - count[cand]), count[cand]) + np.arange(int(count[cand].sum()))]
                value = np.repeat(score, count[cand])
                other = found != qids[i]
                found, value = found[other], value[other]
                top = np.lexsort((found, -value))[:k]
                yield qids[i], found[top], value[top]
        place[mine], seen[mine] = length, False


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, share: float = SHARE) -> DataFrame:
    """The ``k`` nearest of each vector whose id is divisible by ``every``, among all others.

    The driver gets a few sums, the pivots (at most ``MOST_COMPONENTS``
    components), and one number for each pivot and each block.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & valid("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(length).alias("longest")).first()
    if not facts.width:
        return spark.createDataFrame([], RESULT)
    width, longest = facts.width, float(np.sqrt(facts.longest))
    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))
    vectors = kept(rows.withColumn("_n", nth).where(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    sample = vectors.orderBy(F.xxhash64("v"), "v").limit(n_pivots(vectors.count(), width)).select("v").collect()
    table = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        table[i, : len(r.v)] = r.v
    pivots = Pivots(table, longest)
    sent = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    posted = kept(_ordered(vectors.select("ids", "v", F.xxhash64("v").alias("spread")), pivots, width, False, ORDER, sent, "ids array<long>, spread long"), "posted")
    asked = _ordered(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]), pivots, width, True, n_visits(len(sample)), sent, "id long")
    asked = kept(asked, "asked")
    postings = np.zeros(len(sample), np.int64)
    for r in posted.select(F.explode("posts").alias("pivot")).groupBy("pivot").count().collect():
        postings[r.pivot] = r["count"]
    layout = Layout(postings)
    homes = "id long, v binary, pivots binary, block int, chunk int"
    at_home = asked.mapInArrow(_homes_of(layout, None), homes).groupBy("block").count()
    waiting = {r.block: -(-r["count"] // QUERY_BLOCK) for r in at_home.collect()}
    chunks = np.array([waiting.get(b, 0) for b in range(int(layout.block.max()) + 1)])
    units = max(1, min(int(chunks.sum()), 50_000))
    index = posted.mapInArrow(_files_of(layout, chunks), "ids array<long>, spread long, v binary, pivots binary, block int, chunk int")
    questions = asked.mapInArrow(_homes_of(layout, chunks), homes)
    margin = 1e-9 * longest * longest

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            x, q = _rows(left.column("v"), sent).astype(np.float64), _rows(right.column("v"), sent).astype(np.float64)
            ids, spread = left.column("ids").to_pylist(), left.column("spread").to_numpy()
            order, visits = _rows(left.column("pivots"), "<u2"), _rows(right.column("pivots"), "<u2")
            for i, v, s in search_block(layout, left.column("block")[0].as_py(), ids, spread, order, x, right.column("id").to_pylist(), visits, q, k, share, margin):
                for store, part in zip(found, (np.full(len(v), i), v, s)):
                    store.append(part)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"query_id": join(found[0], pa.int64()), "vec_id": join(found[1], pa.int64()), "score": join(found[2], pa.float64())})

    unit = ("block", "chunk")
    near = index.repartition(units, *unit).groupBy(*unit).cogroup(questions.repartition(units, *unit).groupBy(*unit)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ordered(rows: DataFrame, pivots: Pivots, width: int, query: bool, most: int, sent: str, head: str) -> DataFrame:
    """Vectors as bytes and the order of their nearest pivots; for the index also the files that they are posted in."""
    names = [c for c in rows.columns if c != "v"]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            order = pivots.order(x, query, most)
            raw = [pa.array([r.tobytes() for r in x.astype(sent)], pa.binary()), pa.array([r.tobytes() for r in order], pa.binary())]
            posts = [] if query else [pa.array(order[:, :POSTED].astype(np.int32).tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *raw, *posts], names=[*names, "v", "pivots", *(["posts"] if posts else [])])

    return rows.mapInArrow(run, f"{head}, v binary, pivots binary" + ("" if query else ", posts array<int>"))


def _homes_of(layout: Layout, chunks: np.ndarray | None):
    """Each query once for each block that holds a file of its pivots, in a chunk of the block's queries by a hash of its id."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                visits = _rows(batch.column("pivots"), "<u2").astype(np.int64)
                blocks = [layout.blocks_of_query(v) for v in visits]
                take = pa.array(np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]))
                part, block = batch.take(take), np.concatenate(blocks)
                spread = part.column("id").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                chunk = np.zeros(len(block), np.int32) if chunks is None else (spread % chunks[block].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block.astype(np.int32)), pa.array(chunk)], names=["id", "v", "pivots", "block", "chunk"])

    return run


def _files_of(layout: Layout, chunks: np.ndarray):
    """Each vector once for each block that holds a file that it is posted in, and for each chunk of the block's queries."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                posts = _rows(batch.column("pivots"), "<u2")[:, :POSTED].astype(np.int64)
                blocks = np.sort(layout.block[layout.file(posts, batch.column("spread").to_numpy())], 1)
                new = np.ones(blocks.shape, bool)
                new[:, 1:] = blocks[:, 1:] != blocks[:, :-1]
                row, at = np.nonzero(new)
                block = blocks[row, at]
                times = chunks[block]
                chunk = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                row, block = np.repeat(row, times), np.repeat(block, times)
                part = batch.select(["ids", "spread", "v", "pivots"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block.astype(np.int32)), pa.array(chunk.astype(np.int32))], names=[*part.schema.names, "block", "chunk"])

    return run

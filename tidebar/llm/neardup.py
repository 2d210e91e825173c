"""Near-duplicate documents by weighted MinHash (operator 9).

Method: BagMinHash. A text is the multiset of its shingles of five words. The
weight of a shingle, its count, is discretised into the dyadic intervals
[0, 1), [1, 2), [2, 4), [4, 8), ...; each interval of each shingle has a Poisson
process of its own, of which a text uses the points below its weight. A point
has a random component of the signature, and a component keeps its first point;
points that cannot be first any more are never made. Two signatures agree in a
component with the probability of the weighted Jaccard similarity.

Bands of components are posted to buckets; exact copies are one node from the
start. In each bucket the node with the most company leads, and all others are
compared with it by exact multiset overlap. Members that the leader does not
hold stay open. An open text can only be linked to a text that shares one of its
rarest shingles (as many as a linked text may lack, and one more), so it is
compared with the texts that do; where such a shingle is held by more than
``HOT`` texts, it is compared with the whole company of its leader, in blocks. So
a bucket never emits its pairs, texts that share a template only aren't compared
one by one, and no link between different texts in a bucket is lost. Classes are
the connected components of the links; ``linked`` also counts the links.

Words are runs of characters other than space and U+0009 to U+000D. Texts of one
to four words have one shingle; texts without a word (null ones too) stand alone
unless they are exact copies. Rows are kept one for one, repeated ones too; rows
without a key belong to the class of their text, which may have no key at all.
Other columns, whatever their names, don't matter, and ``keep_one`` passes them
through. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .shared import dropped, kept, quoted
from .textbatch import Flat, plain_words, slices, text_slices

WORDS, THRESHOLD = 5, 0.8
#: 25 bands of 5 of the 125 components: at similarity 0.8 a pair shares no bucket with probability 5e-5.
BANDS, DEPTH = 25, 5
SIZE = BANDS * DEPTH
#: Members that are compared with one leader at once; members of a block, and characters of texts, when blocks are compared.
LED_ROWS, BLOCK_ROWS, BLOCK_CHARS = 64, 256, 1_000_000
#: Texts that hold a shingle, up to which an open text is compared with just these.
HOT = 64
#: Nodes up to which their keys (24 bytes each) are broadcast to pick out texts.
MOST_BROADCAST = 400_000

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def _step(n: int, by: np.uint64) -> np.uint64:
    return _U(n * int(by) & (1 << 64) - 1)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, end to end, and the text of each."""
    flat = Flat(texts)
    starts, ends = plain_words(flat)
    word = flat.keys(starts, ends)[0] if len(starts) else np.zeros(0, np.uint64)
    rows = flat.rows(starts)
    n = np.diff(rows)
    each = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), each)
    first = np.repeat(rows[:-1], each) + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    last, out = rows[1:][owner], np.zeros(len(owner), np.uint64)
    for k in range(WORDS):
        at = first + k
        out = out * _A + np.where(at < last, word[np.minimum(at, len(word) - 1)] if len(word) else _U(0), _C)
        out ^= out >> _U(29)
    return _mix(out), owner


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) with their counts."""
    order = np.argsort(_mix(hashes + owner.astype(np.uint64) * _A))
    h, o = hashes[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def signatures(texts: list[str]) -> np.ndarray:
    """(texts, SIZE) signatures; infinite for texts without a word."""
    hashes, owner, weight = counted(*shingles(texts))
    h = np.full((len(texts), SIZE), np.inf)
    if not len(hashes):
        return h
    # One item for each shingle and dyadic interval below its weight.
    item, row, low, width, top = [], [], [], [], []
    level, left = 0, np.arange(len(hashes))
    while len(left):
        begin, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        left = left[weight[left] > begin]
        item.append(_mix(hashes[left] + _step(level + 1, _B)))
        row.append(owner[left])
        low.append(np.full(len(left), begin))
        width.append(np.full(len(left), size))
        top.append(weight[left])
        level += 1
    item, row, low, width, top = map(np.concatenate, (item, row, low, width, top))
    x, n = np.zeros(len(item)), 0
    while len(item):
        n += 1
        r = _mix(item + _step(n, _A))
        x = x - np.log((r >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
        r2 = _mix(r ^ _A)
        part = ((r2 & _U(0xFFFFFFFF)) * _U(SIZE) >> _U(32)).astype(np.int64)
        inside = low + ((r2 >> _U(32)).astype(np.float64) * 2.0**-32 * width) < top
        keep = np.flatnonzero(inside)
        np.minimum.at(h.reshape(-1), row[keep] * SIZE + part[keep], x[keep])
        live = np.flatnonzero(x <= h.max(1)[row])
        item, row, low, width, top, x = (v[live] for v in (item, row, low, width, top, x))
    return h


def bands(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, DEPTH)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _C, (len(signature), 1))
    for k in range(DEPTH):
        key = _mix(key * _A + bits[:, :, k])
    return key


def sign(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, node (digest of the text), n_chars and bucket keys of each row; no keys for texts without a word."""

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch.column(2), 1 << 19):
                sig = signatures(texts)
                keys, some = bands(sig).view(np.int64), np.isfinite(sig[:, 0])
                ends = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))],
                    names=["doc_id", "node", "n_chars", "keys"],
                )

    d = df.select(F.col(key).alias("doc_id"), _node(text).alias("node"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {df.schema[key].dataType.simpleString()}, node binary, n_chars long, keys array<long>")


def _node(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _elements(texts: list[str]) -> list[np.ndarray]:
    """Each text as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    h, o, n = counted(*shingles(texts))
    copy = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    e, o = _mix(np.repeat(h, n) + copy.astype(np.uint64) * _A), np.repeat(o, n)
    order = np.lexsort((e, o))
    return np.split(e[order], np.searchsorted(o[order], np.arange(1, len(texts))))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of all left with all right texts, from exact overlaps."""
    n, m = len(left), len(right)
    if n == 1 or m == 1:
        one, many = (left[0], right) if n == 1 else (right[0], left)
        size = np.array([len(x) for x in many])
        every = np.concatenate(many)
        hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
        inter = np.bincount(np.repeat(np.arange(len(many)), size)[hit], minlength=len(many)).astype(float)
        return (inter / (size + len(one) - inter)).reshape(n, m)
    size = np.array([len(x) for x in [*left, *right]])
    every = np.concatenate([*left, *right])
    who = np.repeat(np.arange(n + m), size)
    order = np.argsort(every)
    new = np.concatenate(([True], np.diff(every[order]) != 0))
    rank = np.empty(len(every), np.int64)
    rank[order] = np.cumsum(new) - 1
    shared = np.bincount(rank) > 1
    column = np.cumsum(shared) - 1
    keep = shared[rank]
    who, at = who[keep], column[rank[keep]]
    inter = np.zeros((n, m))
    for c in range(0, int(shared.sum()), 8192):
        pick = (at >= c) & (at < c + 8192)
        grid = np.zeros((n + m, 8192), np.float32)
        grid[who[pick], at[pick] - c] = 1
        inter += grid[:n] @ grid[n:].T
    return inter / (size[:n, None] + size[None, n:] - inter)


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """Links between the left and right rows of each unit; a unit's rows are dealt to one task and stand together.

    ``rows`` has unit, side (0 left, 1 right), node and text. A unit is bounded by
    the block size, so what a task holds is bounded too.
    """

    def run(batches):
        def links(unit):
            left, right = ([i for i, r in enumerate(unit) if r[0] == s] for s in (0, 1))
            if not left or not right:
                return
            e = _elements([r[2] for r in unit])
            sim = _overlaps([e[i] for i in left], [e[i] for i in right])
            for a, b in zip(*np.nonzero(sim >= threshold)):
                x, y = unit[left[a]][1], unit[right[b]][1]
                if x != y:
                    yield (min(x, y), max(x, y))

        now, unit = None, []

        def out(found):
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        found: set = set()
        for batch in batches:
            for u, side, node, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if u != now:
                    found.update(links(unit))
                    now, unit = u, []
                unit.append((side, node, text))
            if found:
                yield out(found)
                found = set()
        found.update(links(unit))
        if found:
            yield out(found)

    return rows.select("unit", "side", "node", "text").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a binary, b binary")


def _held(df: DataFrame) -> DataFrame:
    """The rows kept on the executors' disks while they are read several times; a lost executor's part is worked out again."""
    return df.persist(StorageLevel.DISK_ONLY)  # unpersisted by its caller


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes that have links.

    Each round takes the smallest label around a node and then the label of that
    label, so long chains halve; rounds end when no label changes.
    """
    both = kept(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        old = labels.select("node", "label")
        near = both.join(old.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = old.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = low.join(old.select(F.col("node").alias("low"), F.col("label").alias("far")), "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved"))
        stepped = kept(jump, "labels")
        dropped(labels)
        labels = stepped
    dropped(both)
    return labels.select("node", "label")


def _blocked(pairs: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """Pairs (leader, node) with the number of blocks that the leader's members fill; only leaders of more than one need a lookup."""
    blocks = F.ceil(F.greatest(F.count("*") / rows, F.sum("n_chars") / BLOCK_CHARS)).cast("int").alias("blocks")
    large = kept(pairs.join(sizes, "node").groupBy("leader").agg(blocks).where("blocks > 1"), "blocks")
    found = pairs.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "leader", "left")
    return found.withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _led(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Links among distinct pairs (leader, node), a leader's members in blocks of a bounded size; each block meets the leader's text."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = _held(_blocked(pairs, sizes, LED_ROWS).select("leader", "node", F.xxhash64("leader", block).alias("unit")))
    lead = placed.select("unit", "leader").distinct().select("unit", F.lit(0).alias("side"), F.col("leader").alias("node"))
    links = kept(_compare(lead.union(placed.select("unit", F.lit(1).alias("side"), "node")).join(texts, "node"), threshold), "links")
    placed.unpersist()
    return links


def _sets(rows: DataFrame) -> DataFrame:
    """node, and the elements of its text."""

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), 1 << 19):
                held = _elements(texts)
                ends = np.concatenate(([0], np.cumsum([len(e) for e in held]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int64)))], names=["node", "e"])

    return rows.select("node", "text").mapInArrow(run, "node binary, e array<long>")


def rare_elements(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, df, e): of each node the elements, rarest first, of which two linked texts share at least one.

    A linked text holds at least ``threshold`` of the elements, so it can lack
    all but that many; elements that no other text has come first and need no row.
    """
    sets = kept(_sets(nodes.join(texts, "node")), "sets")
    each = sets.select("node", F.explode("e").alias("e"))
    shared = each.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    listed = each.join(shared, "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("common"))
    n = F.col("n")
    first = n - F.ceil(n * threshold - 1e-9) + 1 - (n - F.size("common"))
    rare = sets.select("node", F.size("e").alias("n")).join(listed, "node").select("node", F.explode(F.slice("common", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("r"))
    found = kept(rare.select("node", "r.df", "r.e"), "rare")
    dropped(sets)
    return found


def link_texts(signed: DataFrame, df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Links (a, b) between nodes: those with leaders, and all those of open members."""
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("keys").alias("keys"))
    nodes = _held(nodes)
    posted = nodes.select("node", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = _held(posted.join(shared, "key"))
    company = live.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = live.join(company, "node").select("key", F.struct("company", "node").alias("who"))
    leaders = ranked.groupBy("key").agg(F.max("who").alias("lead")).select("key", F.col("lead.node").alias("leader"))
    members = kept(live.join(leaders, "key").where("node != leader").select("leader", "node").distinct(), "members")

    wanted = kept(nodes.join(company, "node", "left_semi").select("node", "doc_id", "n_chars"), "wanted")
    few = wanted.count() <= MOST_BROADCAST
    sought = wanted.select("node", F.col("doc_id").alias("_id"))
    source = df.select(F.col(key).alias("_key"), _node(text).alias("node"), F.col(text).alias("text"))
    found = source.join(F.broadcast(sought) if few else sought, (source.node == sought.node) & source["_key"].eqNullSafe(sought["_id"])).select(source.node, "text")
    texts = kept(found.groupBy("node").agg(F.first("text").alias("text")) if not few else found, "texts").dropDuplicates(["node"])
    sizes = wanted.select("node", "n_chars")
    for used in (nodes, live):
        used.unpersist()

    first = _led(members, texts, sizes, threshold)
    held = first.select(F.col("a").alias("leader"), F.col("b").alias("node")).union(first.select(F.col("b").alias("leader"), F.col("a").alias("node")))
    loose = kept(members.join(held, ["leader", "node"], "left_anti"), "loose")
    halls = members.join(loose.select("leader").distinct(), "leader", "left_semi")
    rare = rare_elements(halls.select("node").distinct(), texts, threshold)
    open_ = loose.select("node").distinct()
    hot = kept(rare.where(F.col("df") > HOT).select("node").distinct().join(open_, "node", "left_semi"), "hot")
    own = rare.join(open_, "node", "left_semi").join(hot, "node", "left_anti").select(F.col("node").alias("leader"), "e")
    met = kept(own.join(rare.select("node", "e"), "e").where("leader != node").select("leader", "node").distinct(), "met")
    second = _led(met, texts, sizes, threshold)
    third = _in_blocks(halls, loose.join(hot, "node", "left_semi"), texts, sizes, threshold)
    links = kept(first.union(second).union(third), "all-links")
    for used in (members, wanted, first, second, third, loose, rare, hot, met, texts):
        dropped(used)
    return links


def _in_blocks(members: DataFrame, loose: DataFrame, texts: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Links between the open members of each leader and its whole company, block by block."""
    members = members.join(loose.select("leader").distinct(), "leader", "left_semi")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    placed = _held(_blocked(members, sizes, BLOCK_ROWS).select("leader", "node", "blocks", block))
    own = placed.join(loose, ["leader", "node"], "left_semi")
    unit = F.xxhash64("leader", "open_block", "block").alias("unit")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    open_block = F.col("block").alias("open_block")
    pairs = own.select("leader", open_block, "blocks").distinct().select("leader", "open_block", every)
    right = placed.join(pairs, ["leader", "block"]).select(unit, F.lit(1).alias("side"), "node")
    left = own.select("leader", open_block, "node", "blocks").select("leader", "open_block", "node", every).select(unit, F.lit(0).alias("side"), "node")
    links = kept(_compare(left.union(right).join(texts, "node"), threshold), "links")
    placed.unpersist()
    return links


def _grouped(signed: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class_id) of all nodes."""
    labels = components(links)
    least = signed.groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = grouped.groupBy("label").agg(F.min("least").alias("class_id"))
    by_node = kept(grouped.join(ids, "label").select("node", "class_id"), "classes")
    dropped(labels)
    return by_node


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(node, doc_id, class_id) for each row; class_id is the smallest key in its class, null if it has none."""
    signed = kept(sign(df, key, text), "signed")
    links = link_texts(signed, df, key, text, threshold)
    by_node = _grouped(signed, links)
    dropped(links)
    return signed.select("doc_id", "node").join(by_node, "node")


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, text_id, copies, links for each row.

    ``text_id`` is the smallest key that has the very text (null if none has a
    key), ``copies`` the number of other rows that have it: copies are linked
    without a comparison, by count. ``links`` adds to the copies all rows of the
    other texts that this one was compared with and found similar to. Two texts
    that one leader holds aren't compared with each other, so in classes of more
    than two texts ``links`` is a lower bound; it is 0 only for rows that are
    linked to none, and all links together hold each class together.
    """
    signed = kept(sign(df, key, text), "signed")
    links = link_texts(signed, df, key, text, threshold)
    by_node = _grouped(signed, links)
    pairs = links.distinct()
    both = kept(pairs.union(pairs.select(F.col("b").alias("a"), "a")).toDF("node", "other"), "pairs")
    texts = signed.groupBy("node").agg(F.min("doc_id").alias("text_id"), (F.count("*") - 1).alias("copies"))
    repeated = texts.where("copies > 0").join(both.select("other").distinct(), F.col("node") == F.col("other"), "left_semi")
    repeated = kept(repeated.select(F.col("node").alias("other"), F.col("copies").alias("more")), "repeated")
    met = both.join(F.broadcast(repeated) if repeated.count() <= MOST_BROADCAST else repeated, "other", "left")
    near = met.groupBy("node").agg(F.sum(1 + F.coalesce("more", F.lit(0))).alias("near"))
    found = kept(by_node.join(texts, "node").join(near, "node", "left").select("node", "class_id", "text_id", "copies", (F.col("copies") + F.coalesce("near", F.lit(0))).alias("links")), "linked")
    for used in (links, by_node, both, repeated):
        dropped(used)
    return signed.select("doc_id", "node").join(found, "node").drop("node")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that stay: of each class the one with the smallest key, once."""
    found = classes(df, key, text, threshold)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("node", "doc_id").agg(F.count("*").alias("copies"))
    stay = kept(stay.select(F.col("node").alias("n"), F.col("doc_id").alias("d"), "copies"), "kept")
    dropped(found)
    d = df.select(F.struct(*map(quoted, df.columns)).alias("row"), F.col(key).alias("id"), _node(text).alias("node"))
    d = d.join(stay, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("d")))
    if not stay.where("copies > 1").isEmpty():
        d = d.dropDuplicates(["id", "node"])
    return d.select("row.*")

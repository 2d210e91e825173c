"""Token ids as compressed binary blocks, written and read back (operator 4).

Method: adaptive context mixing in front of a range coder. Three predictions are
mixed: order 0 counts all ids so far; orders 1 and 2 hold for each context (the
last id, a hash of the last two) the counts of up to ``SLOTS`` successors. The
probability of the next id is the weighted sum of the three; the weights belong
to a pair of confidences (how much, and how clear, the two contexts have seen)
and are learned from each prediction's share in what was coded. All numbers are
whole, so every machine decodes alike. A block holds whole documents, starts
from a clean state and has its own CRC; it is cut into lanes that share the
model and are coded in step, so that each step is a few array operations.

Null and empty texts have the end id only; repeated keys keep a row each.

Layout of a block (little endian): magic ``TBM2``, number of ids, number of
lanes, size of the vocabulary (u32 each), CRC-32 of the ids as u32, number of
16-bit words of each lane (u32 each), words of all lanes.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbatch import PieceCache, ragged, text_slices

MAGIC = b"TBM2"
LANES, BLOCK_IDS = 4096, 1 << 21
#: Successors that a context of order 1 and of order 2 holds; the largest count.
SLOTS, TOP_COUNT = (2, 1), 250
ID_BITS, WEIGHT_BITS = 20, 10
_LOW32, _TOP = 0xFFFFFFFF, 1 << 32
_H1, _H2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _zeros(shape, kind) -> np.ndarray:
    """For tables read at random: numpy asks for large pages where it doesn't clear an array itself."""
    out = np.empty(shape, kind)
    out.fill(0)
    return out


class Context:
    """A few successors of each context and their counts.

    A slot is one number, an id and one above eight bits of its count, 0 if it is empty; the slots of a context lie side by side.
    """

    def __init__(self, size: int, slots: int):
        self.slots, self.held = slots, _zeros((size, slots), np.int32)

    def look(self, at: np.ndarray) -> None:
        self.at, held = at, self.held.take(at, axis=0, mode="clip").T
        self.seen, self.n = [h >> 8 for h in held], [h & 255 for h in held]
        total = top = self.n[0]
        for n in self.n[1:]:
            total, top = total + n, np.maximum(top, n)
        self.total = total
        # 0 nothing seen; then how often, in doublings, and whether one successor has nearly all of it (one alone always has)
        self.sure = DOUBLINGS.take(total, mode="clip")
        if self.slots > 1:
            self.sure += (8 * top - 7 * total) >> 31

    def shares(self, mass: np.ndarray) -> list[np.ndarray]:
        """The mass dealt by count; quotients of doubles, cut to whole numbers, are the same on every machine."""
        each = mass / np.maximum(self.total, 1)
        return [(n * each).astype(np.int32) for n in self.n]

    def learn(self, fresh: np.ndarray, here: list[np.ndarray]) -> None:
        """Count the ids that stand in the slots ``here``; one that stands in none takes the place of the rarest.

        ``fresh`` has the ids as they stand in a slot for the first time. Each lane writes one slot; of several lanes the last one's is kept.
        """
        at = self.at * self.slots
        spot, known, least, slot = at, here[0], self.n[0], fresh
        for h, n in zip(here, self.n):
            slot = slot + np.minimum(n + 1, TOP_COUNT - 1) * h
        for k in range(1, self.slots):
            h, n = here[k], self.n[k]
            spot = np.maximum(spot, at + k * (h | ((n < least) & ~known)).view(np.int8))
            known, least = known | h, np.minimum(least, n)
        self.held.reshape(-1)[spot] = slot


#: Doublings of a total, twice; 0 for nothing.
DOUBLINGS = np.where(np.arange(64) > 0, 2 + 2 * np.minimum(np.frexp(np.arange(64.0))[1] - 1, 5), 0).astype(np.int32)
#: Confidences of one context, and how often the second order was right of late.
SURE, RUN = 13, 4


class Model:
    """What encoder and decoder both keep; each step shows it one id of each lane.

    Ids are counted from 1 in here (0 names nobody). Choices are made by masks, ``(a - b) >> 31`` being all ones where a < b.
    """

    def __init__(self, vocab: int, lanes: int, ids: int):
        self.vocab = vocab
        self.bits2 = int(np.clip(ids, 1 << 10, 1 << 20)).bit_length()
        self.one, self.two = Context(vocab, SLOTS[0]), Context(1 << self.bits2, SLOTS[1])
        # What each order has explained so far, for each pair of confidences; an order that has seen nothing has no share.
        cells = np.tile(np.array([64, 32, 32], np.int64), (RUN, SURE, SURE, 1))
        cells[:, :, 0, 1] = cells[:, 0, :, 2] = 0
        self.cells = [cells[..., k].ravel() for k in range(3)]
        self.counts = np.zeros(vocab, np.int64)
        self.prev, self.prev2, self.run = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.zeros(lanes, np.int8)
        self.step, self.pending = 0, []
        self._order0()
        self._weights()

    def _weights(self) -> None:
        each = ((1 << WEIGHT_BITS) - 4) / (self.cells[0] + self.cells[1] + self.cells[2])
        w = [(c * each).astype(np.int32) + (c > 0) for c in self.cells]
        self.weight0, self.mass1, self.mass2 = w[0].astype(np.int32), w[1] * float(1 << ID_BITS), w[2] * float(1 << ID_BITS)

    def _order0(self) -> None:
        top = (1 << ID_BITS) - self.vocab
        f = 1 + self.counts * top // max(1, int(self.counts.sum()))
        if not self.counts.any():
            f += top // self.vocab
        self.plain = np.zeros((self.vocab + 1, 2), np.int32)  # first value and size of each id's share
        self.plain[1:, 0], self.plain[1:, 1] = np.cumsum(f) - f, f
        self.symbol = None

    def lookup(self) -> np.ndarray:
        """Id of each value below 2**ID_BITS."""
        if self.symbol is None:
            s = np.repeat(np.arange(self.vocab + 1, dtype=np.int32), self.plain[:, 1])
            self.symbol = np.append(s, np.full((1 << ID_BITS) - len(s), self.vocab, np.int32))
        return self.symbol

    def predict(self, n: int) -> None:
        """Weights of the lanes, and the shares of all successors in 2**(ID_BITS + WEIGHT_BITS)."""
        p1, p2 = self.prev[:n], self.prev2[:n]
        self.one.look(p1.astype(np.int64))
        self.two.look((((p2 * _H1 + p1) * _H2) >> np.uint32(32 - self.bits2)).astype(np.int64))
        cell = (self.run[:n] * np.int32(SURE) + self.two.sure) * np.int32(SURE) + self.one.sure
        self.cell = cell.astype(np.int64)
        self.w = self.weight0.take(self.cell, mode="clip")
        self.names = [*self.one.seen, *self.two.seen]
        self.parts = [*self.one.shares(self.mass1.take(self.cell, mode="clip")), *self.two.shares(self.mass2.take(self.cell, mode="clip"))]

    def interval(self, now: np.ndarray):
        """First value and size of the share of the ids ``now``, mixed from all orders."""
        first, own0 = (self.w * x for x in self.plain.take(now, axis=0, mode="clip").T)
        owns, self.here = [], []
        for name, part in zip(self.names, self.parts):
            here = name == now
            self.here.append(here)
            owns.append(part * here)
            first += part & ((name - now) >> 31)
        own1, own2 = sum(owns[1 : SLOTS[0]], owns[0]), sum(owns[SLOTS[0] + 1 :], owns[SLOTS[0]])
        self.owns = own0, own1, own2
        self.size = own0 + own1 + own2
        return first, self.size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose shares hold the values."""
        w, names, parts = self.w, self.names, self.parts
        begins, sizes = [], []
        for name, part in zip(names, parts):
            begin, size = (w * x for x in self.plain.take(name, axis=0, mode="clip").T)
            begins.append(begin)
            sizes.append(size + part)
        for i in range(len(names)):
            for k in range(i):
                less, more = (names[i] - names[k]) >> 31, (names[k] - names[i]) >> 31
                begins[k] += parts[i] & less
                begins[i] += parts[k] & more
                if k < SLOTS[0] <= i:  # both orders name one id: its share has both of their parts
                    same = ~(less | more)
                    sizes[k] += parts[i] & same
                    sizes[i] += parts[k] & same
        found, rest = np.zeros_like(value), value
        for name, part, begin, size in zip(names, parts, begins, sizes):
            into = value - begin
            short = (into - size) >> 31  # the value lies before the end
            found |= name & (short ^ (into >> 31))
            rest = rest - (part & ~short)
        plain = self.lookup().take((rest / w).astype(np.int64), mode="clip")
        return found | (plain & ((found - 1) >> 31))

    def learn(self, now: np.ndarray) -> None:
        n, k = len(now), SLOTS[0]
        run, right, new = self.run[:n], self.here[k].view(np.int8), (self.two.total == 0).view(np.int8)
        self.run[:n] = (np.minimum(run + np.int8(1), np.int8(RUN - 1)) & -right) | ((run >> 1) & -new)
        fresh = (now << 8) + np.int32(1)
        self.one.learn(fresh, self.here[:k])
        self.two.learn(fresh, self.here[k:])
        if self.step < 16 or self.step % 4 == 0:  # the weights follow a part of the steps
            each = 256.0 / self.size
            for cells, own in zip(self.cells, self.owns):
                cells += np.bincount(self.cell, (own * each).astype(np.int32), len(cells)).astype(np.int64)
            large = self.cells[0] + self.cells[1] + self.cells[2] > 1 << 22
            for cells in self.cells:
                cells[large] = (cells[large] + 1) >> 1
            self._weights()
        self.prev2[:n] = self.prev[:n]
        self.prev[:n] = now - np.int32(1)
        self.pending.append(now)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 64 == 0:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.vocab + 1)[1:]
            self.pending = []
            self._order0()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids: all lanes but the last few are full."""
    lanes = max(1, min(LANES, n // 256))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def compress(ids: np.ndarray, vocab: int) -> bytes:
    """One block of ids below ``vocab`` (at most 2**19)."""
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return MAGIC + struct.pack("<IIII", 0, 0, vocab, crc)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids + 1
    grid = grid.reshape(lanes, steps).T.copy()
    model = Model(vocab, lanes, n)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    width = 2 * steps + 4
    words = _zeros(lanes * width, np.uint32)
    at = np.arange(lanes) * width
    last = n - (lanes - 1) * steps  # ids in the last lane
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        now, lo, sp = grid[t, :m], low[:m], span[:m]
        model.predict(m)
        first, size = model.interval(now)
        r = sp >> (ID_BITS + WEIGHT_BITS)
        lo += r * first
        np.multiply(r, size, out=sp)
        words[at[:m]] = lo >> 32  # holds only where the place moves on
        narrow = sp < _TOP
        at[:m] += narrow
        np.putmask(lo, narrow, (lo & _LOW32) << 16)
        np.putmask(sp, narrow, sp << 16)
        rows = np.flatnonzero(sp < _TOP)
        if len(rows):  # a second word; a share is never so small that it takes a third
            x = lo[rows]
            words[at[rows]] = x >> 32
            at[rows] += 1
            lo[rows] = (x & _LOW32) << 16
            sp[rows] <<= 16
        model.learn(now)
    for shift in (32, 16, 0):
        words[at] = (low >> shift) if shift == 32 else (low >> shift) & 0xFFFF
        at += 1
    at -= np.arange(lanes) * width
    wide = words.reshape(lanes, width)[:, : int(at.max())]
    while True:  # carries go to the word before
        over = wide >> 16
        if not over.any():
            break
        wide = wide & 0xFFFF
        wide[:, :-1] += over[:, 1:]
    body = wide[np.arange(wide.shape[1]) < at[:, None]].astype("<u2")
    return MAGIC + struct.pack("<IIII", n, lanes, vocab, crc) + at.astype("<u4").tobytes() + body.tobytes()


def expand(block: bytes) -> np.ndarray:
    """The ids of one block; ValueError if it is damaged."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, lanes, vocab, crc = struct.unpack_from("<IIII", block, 4)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.frombuffer(block, "<u4", lanes, 20).astype(np.int64)
    words = np.append(np.frombuffer(block, "<u2", offset=20 + 4 * lanes), np.zeros(8, np.uint16)).astype(np.uint16)
    steps = _shape(n)[1]
    at = np.cumsum(sizes) - sizes
    code = sum(words[at + k].astype(np.int64) << 32 - 16 * k for k in range(3))
    at += 3
    span = np.full(lanes, 1 << 48, np.int64)
    model, grid = Model(vocab, lanes, n), np.zeros((steps, lanes), np.int32)
    top = np.int32((1 << (ID_BITS + WEIGHT_BITS)) - 1)
    last = n - (lanes - 1) * steps
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        co, sp = code[:m], span[:m]
        r = sp >> (ID_BITS + WEIGHT_BITS)
        model.predict(m)
        with np.errstate(invalid="ignore"):  # of a damaged block
            value = (co / r).astype(np.int32)  # exact: below 2**48 over below 2**19
        now = model.find(np.maximum(np.minimum(value, top), 0))
        first, size = model.interval(now)
        co -= r * first
        np.multiply(r, size, out=sp)
        narrow = sp < _TOP
        np.putmask(co, narrow, co << 16 | words.take(at[:m], mode="clip"))
        at[:m] += narrow
        np.putmask(sp, narrow, sp << 16)
        rows = np.flatnonzero(sp < _TOP)
        if len(rows):
            co[rows] = co[rows] << 16 | words.take(at[rows], mode="clip")
            at[rows] += 1
            sp[rows] <<= 16
        grid[t, :m] = now
        model.learn(now)
    ids = grid.T.reshape(-1)[:n].astype(np.int64) - 1
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block of token ids")
    return ids


class LibraryEncoder:
    """Ids as the tokenizers library gives them: its model is asked once for each distinct piece of text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .bpe import Bpe

        self.model = Tokenizer.from_file(path).model
        self.bpe = Bpe(path)
        from .bpe import byte_letters

        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.bpe.cache = PieceCache(self._ask, bits=22, most=2_000_000)  # to ask for a piece again is what costs most here; the keys take 80 MB
        self.vocab = len(self.bpe.tokens)

    def _ask(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        table, ask = self.letters, self.model.tokenize
        raw, ends = data[ragged(starts, lengths)].tobytes().decode("latin-1").translate(table), np.cumsum(lengths)
        starts = ends - lengths
        found = [[t.id for t in ask(raw[a:b])] for a, b in zip(starts.tolist(), ends.tolist())]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(counts.sum())), counts


@functools.lru_cache(1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode all texts in ascending order of ``key`` and write blocks below ``path``.

    Documents are range-partitioned and sorted by key; a file holds the blocks
    of one partition in order. A block ends with the document that fills it, so
    documents are never split. A null text has the end id only. Repeated keys
    keep a row each; null keys come first.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(parts, "k").sortWithinPartitions("k", "t")

    def run(batches):
        from pyspark import TaskContext

        held, keys, sizes, total, block, before = [], [], [], 0, 0, 0

        def flush():
            nonlocal held, keys, sizes, total, block, before
            ids = np.concatenate(held)
            row = {"file": [TaskContext.get().partitionId()], "block": [block], "before": [before], "n_ids": [total], "keys": [keys], "sizes": [sizes], "payload": [compress(ids, enc.vocab)]}
            held, keys, sizes, block, before, total = [], [], [], block + 1, before + total, 0
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        enc = encoder(tokenizer)
        for batch in batches:
            for lo, texts in text_slices(batch.column(1)):
                ids, counts = enc.bpe.encode_slice(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                for k, (a, n) in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), zip((ends - counts + np.arange(len(texts))).tolist(), (counts + 1).tolist())):
                    held.append(ids[a : a + n])
                    keys.append(k)
                    sizes.append(n)
                    total += n
                    if total >= BLOCK_IDS:
                        yield flush()
        if keys:
            yield flush()

    arrow = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])
    rows = ordered.mapInArrow(run, "file int, block int, before long, n_ids long, keys array<long>, sizes array<long>, payload binary")
    rows.write.mode("overwrite").option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, most_files: int = 1_000_000) -> DataFrame:
    """Decode the blocks: doc_id, start, n_tokens, ids_crc32 for each document.

    ``start`` counts the ids of all documents before it. Only one row a file
    (its number of ids) is gathered to find the starts; the check of
    ``most_files`` keeps what is broadcast below 16 MB.
    """
    from pyspark.sql import Window

    blocks = spark.read.parquet(path)
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    starts = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start"))
    placed = blocks.join(F.broadcast(starts) if files.count() <= most_files else starts, "file")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(row["payload"])
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(ends - sizes + row["file_start"] + row["before"]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("keys", "sizes", "payload", "file_start", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Token counts that follow edits (operator 3).

Method: each document has a segment tree over its pre-tokens. A leaf stands for
up to ``LEAF`` consecutive pre-tokens and holds their code points, pre-tokens
and tokens; inner nodes hold sums. ``build`` encodes each text once and keeps
the leaves as a column of a table; ``renew`` applies a batch of edits to stored
leaves: an edit descends by code points to the leaves that it touches, and only
these and the context that decides their borders are cut into pre-tokens and
encoded again. What comes of them is cut into leaves of ``LEAF`` anew, so that
leaves never grow, and the result is a table of the same form, to which the next
batch can be applied.

Counts are those of the tokenizers library. A document that holds the string of
a special token, before or after its edits, is counted as a whole. A tokenizer
file that changes texts before it cuts them is an error, as offsets would not
hold. Null texts count as empty; edits of a null or empty text apply to the
empty text. Edits of one document are in coordinates of the text before all of
them; they are cut to its length, and an edit that begins before the end of an
earlier one is an error. Rows are kept one for one, repeated keys too; other
columns pass through ``build`` and ``renew``, those named as one of the results
give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load
from .textbatch import Flat, text_slices

LEAF = 32
#: Columns that stored leaves consist of.
LEAVES = ("leaf_chars", "leaf_pieces", "leaf_tokens")


class SegmentTree:
    """Sums of code points, pre-tokens and tokens over the leaves of one document."""

    def __init__(self, leaves: np.ndarray):
        """``leaves`` has a row for each of the three and a column for each leaf."""
        n = leaves.shape[1]
        self.leaves, self.size = n, 1 << max(0, n - 1).bit_length()
        level = np.zeros((3, self.size), np.int64)
        level[:, :n] = leaves
        levels = [level]
        while level.shape[1] > 1:
            level = level[:, ::2] + level[:, 1::2]
            levels.append(level)
        self.sums = np.concatenate([np.zeros((3, 1), np.int64), *levels[::-1]], 1)  # node i has the children 2 i and 2 i + 1

    def total(self, what: int) -> int:
        return int(self.sums[what, 1])

    def of_leaves(self) -> np.ndarray:
        return self.sums[:, self.size : self.size + self.leaves]

    def find(self, place: int) -> int:
        """The leaf that holds code point ``place``, or the last that holds any."""
        chars, i = self.sums[0], 1
        place = min(place, max(0, int(chars[1]) - 1))
        while i < self.size:
            i *= 2
            if place >= chars[i]:
                place -= int(chars[i])
                i += 1
        return i - self.size

    def splice(self, parts: list[tuple[int, int, np.ndarray]]) -> SegmentTree:
        """The tree with leaves ``lo`` to ``hi`` replaced, for each of the ascending (lo, hi, leaves)."""
        old = self.of_leaves()
        if all(hi < self.leaves and new.shape[1] == hi + 1 - lo for lo, hi, new in parts):  # sums on the paths to the root are renewed
            for lo, hi, new in parts:
                for k in range(lo, hi + 1):
                    i, more = k + self.size, new[:, k - lo] - old[:, k]
                    while i:
                        self.sums[:, i] += more
                        i >>= 1
            return self
        out, at = [], 0
        for lo, hi, new in parts:
            out += [old[:, at:lo], new]
            at = hi + 1
        return SegmentTree(np.concatenate([*out, old[:, at:]], 1))


def _cut(starts: np.ndarray, tokens: np.ndarray, end: int) -> np.ndarray:
    """Leaves of a stretch of pre-tokens, which begin at ``starts`` and end at ``end``."""
    if not len(starts):
        return np.zeros((3, 0), np.int64)
    first = np.arange(0, len(starts), LEAF)
    return np.stack((np.diff(np.append(starts[first], end)), np.diff(np.append(first, len(starts))), np.add.reduceat(tokens, first)))


def _pieces(bpe, texts: list[str]) -> tuple[Flat, np.ndarray, np.ndarray]:
    """The texts end to end, where their pre-tokens begin, and the tokens of each."""
    flat = Flat(texts)
    starts, ends = bpe.pieces(flat)
    if not len(starts):
        return flat, starts, np.zeros(0, np.int64)
    entries = bpe.cache.find(flat, starts, ends)
    return flat, starts, bpe.cache.length[entries].astype(np.int64)


def trees(bpe, texts: list[str]) -> list[SegmentTree]:
    """The tree of each text."""
    special = {i for i, t in enumerate(texts) if _has_special(bpe, t)}
    flat, starts, tokens = _pieces(bpe, ["" if i in special else t for i, t in enumerate(texts)])
    rows, out = flat.rows(starts), []
    for i, (a, b, end) in enumerate(zip(rows[:-1], rows[1:], flat.ends.tolist())):
        out.append(_whole(bpe, texts[i]) if i in special else SegmentTree(_cut(starts[a:b], tokens[a:b], end)))
    return out


def _has_special(bpe, text: str) -> bool:
    return bpe.splitter is not None and "<|" in text and bpe.splitter.search(text) is not None


def _whole(bpe, text: str) -> SegmentTree:
    """One leaf for a text that holds special tokens."""
    parts = bpe.splitter.split(text)
    pieces = len(_pieces(bpe, parts[::2])[1]) + len(parts) // 2
    return SegmentTree(np.array([[len(text)], [pieces], [len(bpe.encode_slice([text])[0])]]))


def _checked(edits, length: int) -> list[tuple[int, int, str]]:
    out = sorted((min(max(0, e["start"]), length), min(max(0, e["end"]), length), e["text"] or "") for e in edits or ())
    for a, b in zip(out, out[1:]):
        if b[0] < a[1]:
            raise ValueError("edits of one document overlap")
    return [(a, max(a, b), x) for a, b, x in out]


def edited(text: str, edits) -> str:
    """The text after its edits."""
    out, at = [], 0
    for a, b, x in edits:
        out += [text[at:a], x]
        at = b
    return "".join([*out, text[at:]])


class _Region:
    """Leaves of one document that an edit touches, as a stretch of the text before and after."""

    def __init__(self, row: int, begins: list[int], lo: int, hi: int):
        self.row, self.begins, self.lo, self.hi = row, begins, lo, hi  # leaf numbers, hi included

    def window(self, text: str, edits) -> tuple[str, int]:
        """The stretch after the edits with one leaf of context, and its length without the context."""
        a = self.begins[self.lo]
        b = self.begins[self.hi + 1]
        c = self.begins[min(self.hi + 2, len(self.begins) - 1)]
        own = [(x - a, y - a, s) for x, y, s in edits if a <= x and y <= b and (x < b or b == len(text))]
        body = edited(text[a:b], own)
        return body + text[b:c], len(body)


def recount(bpe, texts: list[str], forest: list[SegmentTree], edits: list) -> tuple[list[str], list[SegmentTree], np.ndarray]:
    """Texts and trees after the edits, and the pre-tokens encoded again for each text; ``forest`` holds the trees before."""
    again = np.zeros(len(texts), np.int64)
    after = list(texts)
    new: list[list] = [[] for _ in texts]
    regions_of: list[list[_Region]] = [[] for _ in texts]
    todo: list[_Region] = []
    forest = list(forest)
    for row, text in enumerate(texts):
        wanted = edits[row] = _checked(edits[row], len(text))
        if not wanted:
            continue
        tree, after[row] = forest[row], edited(text, wanted)
        if _has_special(bpe, text) or _has_special(bpe, after[row]):
            forest[row] = trees(bpe, [after[row]])[0]
            again[row] = forest[row].total(1)
            continue
        begins = [0, *np.cumsum(tree.of_leaves()[0]).tolist()] if text else [0, 0]
        regions = regions_of[row]
        for a, b, _ in wanted:
            lo, hi = tree.find(max(0, a - 1)), tree.find(b)
            if regions and lo <= regions[-1].hi + 1:
                regions[-1].hi = max(regions[-1].hi, hi)
            else:
                regions.append(_Region(row, begins, lo, hi))
        todo += regions
    while todo:
        windows = [r.window(texts[r.row], edits[r.row]) for r in todo]
        flat, starts, tokens = _pieces(bpe, [w for w, _ in windows])
        offsets, later = np.concatenate(([0], flat.ends[:-1])), []
        for r, (_, n), at, end in zip(todo, windows, offsets.tolist(), flat.ends.tolist()):
            i, j = np.searchsorted(starts, [at, at + n])
            if at + n < end and (j == len(starts) or starts[j] != at + n):
                later.append(r)
                continue
            again[r.row] += j - i
            new[r.row].append((r.lo, r.hi, _cut(starts[i:j], tokens[i:j], at + n)))
        todo = []
        for r in later:  # the borders have not met again: one leaf more, and any region that begins there
            own = regions_of[r.row]
            if r not in own:
                continue
            r.hi += 1
            i = own.index(r) + 1
            while i < len(own) and own[i].lo <= r.hi + 1:
                gone = own.pop(i)
                r.hi = max(r.hi, gone.hi)
                new[r.row] = [x for x in new[r.row] if x[0] != gone.lo]
            todo.append(r)
    for row, parts in enumerate(new):
        if parts:
            forest[row] = forest[row].splice(sorted(parts, key=lambda x: x[0]))
    return after, forest, again


def _stored(df: DataFrame, results: tuple[str, ...], text: str) -> tuple[list[str], T.StructType]:
    """Columns that pass through, and the schema with leaves and results after them."""
    gone = {*LEAVES, *results}
    fields = [f for f in df.schema.fields if f.name.lower() not in gone]
    fields = [T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in LEAVES] + [T.StructField(n, T.LongType()) for n in results]
    return [f.name for f in fields[: len(fields) - len(LEAVES) - len(results)]], T.StructType(fields)


def _columns(forest: list[SegmentTree]) -> list[pa.Array]:
    held = [t.of_leaves() for t in forest]
    offsets = pa.array(np.concatenate(([0], np.cumsum([h.shape[1] for h in held]))).astype(np.int32))
    every = np.concatenate(held, 1).astype(np.int32)
    return [pa.ListArray.from_arrays(offsets, pa.array(every[k])) for k in range(3)]


def _checked_file(path: str):
    bpe = load(path)
    if bpe.lower:
        raise ValueError("this tokenizer changes texts before it cuts them")
    return bpe


def build(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with the leaves of each text; write it as a table."""
    kept, schema = _stored(df, (), text)

    def run(batches):
        bpe = _checked_file(path)
        for batch in batches:
            for lo, texts in text_slices(batch.column(text)):
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *_columns(trees(bpe, texts))], names=schema.names)

    return df.mapInArrow(run, schema)


RESULTS = ("n_tokens", "n_pieces", "n_tokens_edited", "n_reencoded")


def renew(stored: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Stored texts and leaves after the edits of each row, and the counts ``RESULTS``: tokens and pre-tokens before, tokens after, pre-tokens encoded again.

    ``edits`` is an array of structs (start, end, text) in code points, end
    exclusive; it is left out of the result, which can be edited again.
    """
    kept, schema = _stored(stored.drop(edits), RESULTS, text)

    def run(batches):
        bpe = _checked_file(path)
        for batch in batches:
            for lo, texts in text_slices(batch.column(text)):
                part = batch.slice(lo, len(texts))
                leaves = [part.column(n).to_pylist() for n in LEAVES]
                forest = [SegmentTree(np.array(x, np.int64).reshape(3, -1)) for x in zip(*leaves)]
                before = [[t.total(k) for t in forest] for k in (2, 1)]
                after, forest, again = recount(bpe, texts, forest, part.column(edits).to_pylist())
                columns = [pa.array(after, pa.string()) if c == text else part.column(c) for c in kept]
                counts = [*before, [t.total(2) for t in forest], again]
                yield pa.RecordBatch.from_arrays([*columns, *_columns(forest), *(pa.array(x, pa.int64()) for x in counts)], names=schema.names)

    return stored.mapInArrow(run, schema)


def with_edits(stored: DataFrame, edits: DataFrame, key: str = "doc_id", column: str = "edits") -> DataFrame:
    """Stored rows with the edits of their key, from rows (key, start, end, text)."""
    batch = edits.groupBy(key).agg(F.collect_list(F.struct("start", "end", "text")).alias(column))
    return stored.drop(column).join(batch, key, "left")


def sample_edits(text: str = "text"):
    """Three edits of each text: a line put in front, ten code points in the middle put in capitals, a part of the end left out."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    middle = F.greatest(F.floor(n / 2) - 5, F.lit(0))
    stop = F.least(middle + 10, n - F.least(F.floor(n / 4), F.lit(20)))
    edit = lambda a, b, x: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), x.alias("text"))
    middle = F.least(middle, stop)
    return F.array(
        edit(F.lit(0), F.lit(0), F.lit("Title: a page\n")),
        edit(middle, stop, F.upper(F.substring(F.coalesce(F.col(text), F.lit("")), (middle + 1).cast("int"), (stop - middle).cast("int")))),
        edit(n - F.least(F.floor(n / 4), F.lit(20)), n, F.lit("")),
    )

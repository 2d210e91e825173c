"""Offset-preserving SentencePiece encoding and decoding (operator 11).

Method: a text is normalised through the model's compiled character map, always
by the longest prefix that the map knows, and each character of the result
keeps the byte of the text that it came from. Spaces become U+2581, pieces are
merged by best score, leftmost first, and every piece is projected back to the
bytes of the text that it stands for. Characters that no piece covers become
their bytes, the last of which carries the span of the character.

A piece never goes from other characters on to U+2581 (models in which one does
are cut by whole texts), so a text is cut before each run of U+2581, and each
distinct word is encoded once per cache: words with the same number of
characters are rows of one matrix, those of more than ``SHORT`` go through a
heap.

Null and empty texts have no pieces but the end id; repeated rows keep a row
each, an empty table gives an empty table. A column that has the name of a
result gives way to it, all others pass through ``encode`` and ``decode``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textbatch import Flat, PieceCache, slices, text_slices

#: Characters up to which a word is a row of a matrix.
SHORT = 40
NONE = np.int32(2**31 - 1)
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the model's format (fixed values)
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)


class CharacterMap:
    """The compiled map: a double-array trie over bytes, whose values are places in a block of strings that end with a zero."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        self.first = frozenset(b for b in range(1, 256) if self._child(self._root(), b) is not None) if self.units else frozenset()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _child(self, node: int, byte: int) -> int | None:
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        return at if unit & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length in bytes and replacement of the longest prefix at ``at`` that the map has."""
        found, node, i = None, self._root(), at
        while i < len(data) and (spot := self._child(node, data[i])) is not None:
            unit, i = self.units[spot], i + 1
            node = spot ^ self._offset(unit)
            if unit >> 8 & 1:
                found = i - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(0, start)].decode()


class Normalizer:
    """From a text to its normal form, and for each character of that (one more at the end) its byte in the text."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix and not suffix
        self.suffix = spec.add_dummy_prefix and suffix
        self.trim = spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else " "
        self.plain = not self.map.first and not self.trim and not suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        return self._plain(text) if self.plain else self._mapped(text)

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        head = self.space if self.prefix else ""
        at = np.zeros(len(text) + 1 + len(head), np.int64)
        if text.isascii():
            at[len(head) :] = np.arange(len(text) + 1)
        else:
            p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            np.cumsum(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000).astype(np.int64), out=at[len(head) + 1 :])
        return head + text.replace(" ", self.space), at

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        chunks: list[tuple[str, int, int]] = []  # what each stretch becomes, where it begins, where it ends
        i = 0
        while i < len(data):
            hit = self.map.longest(data, i) if data[i] in self.map.first else None
            if hit is None:
                b = data[i]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = n, data[i : i + n].decode()
            chunks.append((hit[1], i, i + hit[0]))
            i += hit[0]
        k = 0
        while self.trim and k < len(chunks) and chunks[k][0] == " ":
            k += 1
        if k == len(chunks):
            return "", np.zeros(1, np.int64)
        out, at = [], []
        if self.prefix:
            out.append(" ")
            at.append(chunks[k][1])
        after_space = self.trim
        for become, start, _ in chunks[k:]:
            become = become.lstrip(" ") if after_space else become
            if become:
                out.append(become)
                at += [start] * len(become)
                after_space = self.trim and become.endswith(" ")
        normal, end = "".join(out), len(data)
        while self.trim and normal.endswith((" ", SPACE)):
            normal, end = normal[:-1], at.pop()
        if self.suffix:
            normal += " "
            at.append(end)
        return normal.replace(" ", self.space), np.array([*at, end], np.int64)


class Model:
    """Pieces and normaliser of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.normalizer = Normalizer(spec.normalizer_spec, spec.trainer_spec.treat_whitespace_as_suffix)
        pieces = [(p.piece, np.float32(p.score), p.type) for p in spec.pieces]
        if spec.trainer_spec.model_type != 2 or any(kind in (USER_DEFINED, UNUSED) for *_, kind in pieces):
            raise ValueError("only models of merged pieces, without pieces of users or unused ones")
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.n = len(pieces)
        self.unknown = next(i for i, (*_, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.byte_of = np.full(self.n, -1, np.int16)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("only models that fall back to bytes")
        # Symbols: the pieces, then the characters of pieces that are no piece themselves.
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, self.n + len(symbols) - len(ids))
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        pairs = [(symbols[p[:k]] << 20 | symbols[p[k:]], pieces[i][1], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys = np.array([k for k, *_ in pairs], np.int64)
        order = np.argsort(keys)
        _, rank = np.unique([-score for _, score, _ in pairs], return_inverse=True)  # equal scores have equal ranks: the leftmost goes first
        self.keys, self.rank_of, self.made_of = keys[order], rank[order].astype(np.int32), np.array([i for *_, i in pairs], np.int32)[order]
        self.crossing = any(c == SPACE and b != SPACE for p in ids for b, c in zip(p, p[1:]))
        self.characters = np.array([len(p) if kind == NORMAL else 0 for p, _, kind in pieces], np.int64)
        self.surface = [p.replace(SPACE, " ") if kind == NORMAL else "" if kind in (CONTROL, BYTE) else (spec.trainer_spec.unk_surface if kind == UNKNOWN else p) for p, _, kind in pieces]
        self.special = np.array([kind != NORMAL for *_, kind in pieces])
        self.end = spec.trainer_spec.eos_id
        self.strip = spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces
        self.strip_all = spec.normalizer_spec.remove_extra_whitespaces
        self.numbers = [str(i) for i in range(self.n)]
        self.cache = PieceCache(self.words)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of adjacent symbols (``NONE`` where they don't join) and the piece that they make."""
        key = left.astype(np.int64) << 20 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[i] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank_of[i], NONE), self.made_of[i]

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (ranges of UTF-8 bytes), end to end, and their number for each word."""
        texts = [data[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), lengths.tolist())]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        # Symbols that no piece covers are their code points, below zero.
        base = self.symbol_of[points]
        base = np.where(base < 0, -1 - points.astype(np.int64), base).astype(np.int32)
        found: list[tuple[int, np.ndarray]] = []
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            if n <= SHORT:
                for k in range(0, len(at), 50_000):
                    some = at[k : k + 50_000]
                    for rows, parts in self._rows(some, base[first[some, None] + np.arange(n)]):
                        found += zip(rows.tolist(), parts)
            else:
                found += [(int(i), self._long(base[first[i] : first[i] + n])) for i in at]
        found.sort(key=lambda x: x[0])
        counts = np.fromiter((len(p) for _, p in found), np.int64, len(found))
        symbols = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int32)
        return self._bytes(symbols, counts)

    def _rows(self, at: np.ndarray, parts: np.ndarray):
        """Merge words of equal length: the best pair of each row at a time."""
        ranks = self.pair(parts[:, :-1], parts[:, 1:])[0]
        out = []
        while len(at):
            width = parts.shape[1]
            best = ranks.min(1) if width > 1 else np.full(len(parts), NONE)
            if (done := best == NONE).any():
                out.append((at[done], parts[done]))
                at, parts, ranks = at[~done], parts[~done], ranks[~done]
                if not len(at):
                    break
            row, m = np.arange(len(at)), ranks.argmin(1)
            made = self.pair(parts[row, m], parts[row, m + 1])[1]
            parts = np.take_along_axis(parts, np.arange(width - 1) + (np.arange(width - 1) > m[:, None]), 1)
            parts[row, m] = made
            cols = np.arange(max(width - 2, 0))
            ranks = np.take_along_axis(ranks, cols + (cols >= m[:, None]), 1)
            for side in (m - 1, m):
                fine = (side >= 0) & (side < width - 2)
                ranks[row[fine], side[fine]] = self.pair(parts[row[fine], side[fine]], parts[row[fine], side[fine] + 1])[0]
        return out

    def _long(self, base: np.ndarray) -> np.ndarray:
        """A long word, by a heap of (rank, place)."""
        part, n = base.tolist(), len(base)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks, made = self.pair(base[:-1], base[1:])
        heap = [(int(ranks[i]), int(i), part[i], part[i + 1], int(made[i])) for i in np.flatnonzero(ranks != NONE)]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int, j: int) -> None:
            if i < 0 or j < 0:
                return
            key = part[i], part[j]
            if key not in known:
                r, p = self.pair(np.array(key[:1]), np.array(key[1:]))
                known[key] = int(r[0]), int(p[0])
            r, p = known[key]
            if r != NONE:
                heapq.heappush(heap, (r, i, *key, p))

        gone = [False] * n
        while heap:
            _, i, a, b, p = heapq.heappop(heap)
            j = after[i]
            if gone[i] or part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], gone[j] = p, True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return np.array([p for p, x in zip(part, gone) if not x], np.int32)

    def _bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces give way to the ids of their bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n))
        if not len(odd):
            return symbols.astype(np.int32), counts
        extra = {int(i): chr(c) for c, i in enumerate(self.symbol_of) if i >= self.n} if (symbols >= self.n).any() else {}
        spelt = [(extra[int(s)] if s >= 0 else chr(-1 - int(s))).encode() for s in symbols[odd]]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(b) for b in spelt]
        at = np.cumsum(width) - width
        ids = np.empty(int(width.sum()), np.int32)
        plain = np.ones(len(symbols), bool)
        plain[odd] = False
        ids[at[plain]] = symbols[plain]
        spots = np.concatenate([np.arange(a, a + len(b)) for a, b in zip(at[odd].tolist(), spelt)])
        ids[spots] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        word = np.repeat(np.arange(len(counts)), counts)
        return ids, np.bincount(word, width, len(counts)).astype(np.int64)

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, their number for each text, and start and end of each piece in the bytes of its text."""
        normal, origin = zip(*map(self.normalizer, texts)) if texts else ((), ())
        flat = Flat(normal)
        first = flat.first()
        if self.crossing:
            starts = np.flatnonzero(first)
        else:
            space = flat.points == ord(SPACE)
            starts = np.flatnonzero(first | (space & ~np.concatenate(([False], space[:-1])))) if len(space) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(flat.points)) if len(starts) else starts
        entries = self.cache.find(flat, starts, ends) if len(starts) else np.zeros(0, np.int64)
        ids = self.cache.ids(entries)
        edge = np.concatenate(([0], np.cumsum(self.cache.length[entries].astype(np.int64))))[flat.rows(starts)]
        counts = np.diff(edge)
        # How many characters each piece takes; of the bytes of a character the last takes it.
        taken, byte = self.characters[ids], self.byte_of[ids]
        within = (byte & 0xC0) == 0x80
        within[byte < 0] = False
        taken[(byte >= 0) & ~np.append(within[1:], False)] = 1
        upto = np.cumsum(taken)
        # Origins hold one place more a text than there are characters.
        origins = np.concatenate(origin) if len(origin) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), counts)
        return ids, counts, origins[upto - taken + text], origins[upto + text]

    def decode(self, ids) -> str:
        """The text that pieces spell: the first space goes where the model put one, bytes that are no character become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if not self.special[ids].any():
            out = "".join(map(self.surface.__getitem__, ids.tolist()))
            return out.lstrip(" ") if self.strip_all else out[1:] if self.strip and out.startswith(" ") else out
        out, held, at_start = [], bytearray(), self.strip

        def spell() -> None:
            i = 0
            while i < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[i : i + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                i += n
            held.clear()

        for i in ids.tolist():
            if (b := int(self.byte_of[i])) >= 0:
                held.append(b)
                at_start = False
                continue
            spell()
            piece = self.surface[i]
            if i == self.unknown:
                at_start = False
            elif at_start and piece:
                bare = piece.lstrip(" ") if self.strip_all else piece.removeprefix(" ")
                at_start = self.strip_all and not bare
                piece = bare
            out.append(piece)
        spell()
        return "".join(out)


@functools.lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


def _ended(model: Model, texts: list[str]):
    """Ids, offsets of rows, starts and ends of spans, each text with the end id (an empty span at its end)."""
    ids, counts, starts, ends = model.encode_slice(texts)
    last = np.cumsum(counts)
    size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
    return np.insert(ids, last, model.end), np.concatenate(([0], np.cumsum(counts + 1))), np.insert(starts, last, size), np.insert(ends, last, size)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", spans: str = "spans") -> DataFrame:
    """``df`` with the ids of each text, an end id last, and the span of each in the bytes of the text, end exclusive."""
    gone = {ids.lower(), spans.lower()}
    schema = T.StructType([*(f for f in df.schema.fields if f.name.lower() not in gone), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(spans, SPAN, False)])
    names = [f.name for f in schema.fields[:-2]]

    def run(batches):
        model = load(path)
        for batch in batches:
            for lo, texts in text_slices(batch.column(text)):
                found, offsets, starts, ends = _ended(model, texts)
                part, offsets = batch.slice(lo, len(texts)), pa.array(offsets.astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.int32))), pa.ListArray.from_arrays(offsets, pairs)], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids spell (empty where they are null)."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name.lower() != out.lower()), T.StructField(out, T.StringType(), False)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        model = load(path)
        for batch in batches:
            sizes = [4 * (len(x) if x.is_valid else 0) for x in batch.column(ids)]
            for lo, hi in slices(sizes):
                part = batch.slice(lo, hi - lo)
                texts = [model.decode(x or ()) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of ids, digests of the ids, of the text that they decode to, and of the spans; none of these leaves the task itself."""

    def run(batches):
        model = load(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for lo, texts in text_slices(batch.column(1)):
                ids, offsets, starts, ends = _ended(model, texts)
                spans = np.stack((starts, ends), 1)
                edges = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                held = ids.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(texts)),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array([sha(" ".join(map(model.numbers.__getitem__, held[a:b]))) for a, b in edges], pa.string()),
                        # The end id spells nothing.
                        pa.array([sha(model.decode(ids[a : b - 1])) for a, b in edges], pa.string()),
                        pa.array([zlib.crc32(spans[a:b].astype("<i8").tobytes()) for a, b in edges], pa.int64()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")

"""Byte-pair encoding and decoding (operator 2).

Method: a contiguous rank array. A word is held as its parts and the ranks of
adjacent pairs; the smallest rank is looked for again and again, the boundary
under it is deleted and the two neighbouring ranks are refreshed. Words of one
length are rows of one matrix, so a round is a few array operations for all of
them; words of more than ``SHORT`` bytes use a heap of pairs. Each distinct
word is encoded once per cache; texts are cut into words with array operations.

Null and empty texts have no tokens. Strings of special tokens inside a text
become their ids, as in the tokenizers library, whose classes of characters are
asked of the library itself. Repeated rows keep a row each.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import Flat, PieceCache, bare_pieces, give_back, slices, spaced_pieces, text_slices

#: Bytes up to which a word goes through the rank array.
SHORT = 40
HIGH = re.compile("[\u0300-\U0010ffff]")
NONE = np.int32(2**31 - 1)


@functools.lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and pre-tokenisation of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lower, self.normalizer = bool(spec["normalizer"]), None
        self.bytes = {c: b for b, c in enumerate(letters)} if (spec["decoder"] or {}).get("type") == "ByteLevel" else None
        self.path = path
        self.pieces = bare_pieces if suffix else spaced_pieces
        size = max(max(vocab.values()), *self.special.values()) + 1
        self.tokens = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.numbers = [str(i) for i in range(size)]
        self.cache = PieceCache(self.words)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (left >= 0) & (right >= 0), self.rank_of[i], NONE)

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and their number for each word."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their counts, ids end to end
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n <= SHORT:
                for k in range(0, len(at), 50_000):
                    found += self._rows(at[k : k + 50_000], data[starts[at[k : k + 50_000], None] + np.arange(n)])
            else:
                for i in at:
                    ids = np.array(self._long(data[starts[i] : starts[i] + n]), np.int32)
                    found.append((np.array([i]), np.array([len(ids)]), ids))
        counts = np.zeros(len(starts), np.int64)
        for at, n, _ in found:
            counts[at] = n
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for at, n, ids in found:
            out[np.repeat(offset[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _rows(self, at: np.ndarray, raw: np.ndarray):
        """The rank array, for words of equal length."""
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        out = []
        while True:
            width = parts.shape[1]
            best = ranks.min(1) if width > 1 else np.full(len(parts), NONE)
            done = best == NONE
            if done.any():
                out.append((at[done], np.full(int(done.sum()), width), parts[done].ravel()))
                at, parts, ranks, best = (x[~done] for x in (at, parts, ranks, best))
                if not len(at):
                    return out
            row, m = np.arange(len(at)), ranks.argmin(1)
            cols = np.arange(width - 1)
            parts = np.take_along_axis(parts, cols + (cols > m[:, None]), 1)
            parts[row, m] = self.made[best]
            if width > 2:
                cols = np.arange(width - 2)
                ranks = np.take_along_axis(ranks, cols + (cols >= m[:, None]), 1)
                left = m > 0
                ranks[row[left], m[left] - 1] = self.rank(parts[row[left], m[left] - 1], parts[row[left], m[left]])
                right = m < width - 2
                ranks[row[right], m[right]] = self.rank(parts[row[right], m[right]], parts[row[right], m[right] + 1])
            else:
                ranks = ranks[:, :0]

    def _long(self, raw: np.ndarray) -> list[int]:
        """A long word, by a heap of (rank, place)."""
        part = self.inner[raw].tolist()
        part[-1] = int(self.last[raw[-1]])
        n = len(part)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.rank(np.array(part[:-1]), np.array(part[1:]))
        heap = [(int(r), i, part[i], part[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := int(self.rank(np.array([part[i]]), np.array([part[j]]))[0])) != NONE:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in part if p >= 0]

    def normal(self, text: str) -> str:
        """The text in composed, lower-case form; below U+0300 nothing composes and Python's letters are the library's."""
        if not self.lower or not text:
            return text
        if text.isascii() or not HIGH.search(text):
            return text.lower()
        if self.normalizer is None:
            from tokenizers import Tokenizer

            self.normalizer = Tokenizer.from_file(self.path).normalizer
        return self.normalizer.normalize_str(text)

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each text."""
        parts, owner, fixed = [], [], []
        for k, text in enumerate(texts):
            if self.splitter and "<|" in text:
                for i, x in enumerate(self.splitter.split(text)):
                    parts.append("" if i % 2 else self.normal(x))
                    fixed.append(self.special[x] if i % 2 else -1)
                    owner.append(k)
            else:
                parts.append(self.normal(text))
                fixed.append(-1)
                owner.append(k)
        flat = Flat(parts)
        starts, ends = self.pieces(flat)
        entries = self.cache.find(flat, starts, ends) if len(starts) else np.zeros(0, np.int64)
        per_piece = self.cache.length[entries].astype(np.int64)
        ids = self.cache.ids(entries)
        sums = np.concatenate(([0], np.cumsum(per_piece)))
        edge = sums[flat.rows(starts)]
        counts, fixed = np.diff(edge), np.array(fixed)
        if len(parts) > len(texts):
            spots = np.flatnonzero(fixed >= 0)
            ids = np.insert(ids, edge[spots], fixed[spots])
            counts[spots] = 1
        return ids, np.bincount(np.array(owner), counts, len(texts)).astype(np.int64)

    def decode(self, ids) -> str:
        """The bytes that the tokens spell, where the file has a decoder for bytes; else the tokens joined by a space."""
        tokens = map(self.tokens.__getitem__, ids)
        if self.bytes is None:
            return " ".join(tokens)
        known = self.bytes
        return b"".join(bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t in tokens).decode("utf-8", "replace")


@functools.lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with an array of token ids, and under the name ``decoded`` the SHA-256 of the text that they decode to.

    Other columns pass through, one that has the name of a result gives way to it.
    """
    from pyspark.sql import types as T

    results = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]
    gone = {f.name.lower() for f in results}
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() not in gone] + results)
    names = [f.name for f in schema.fields[: -len(results)]]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for lo, texts in text_slices(batch.column(text)):
                ids, counts = bpe.encode_slice(texts)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                part = batch.slice(lo, len(texts))
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))]
                if decoded:
                    held = ids.tolist()
                    columns.append(pa.array([hashlib.sha256(bpe.decode(held[a:b]).encode()).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], names=schema.names)
        give_back()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the tokens of ``ids`` spell (empty where they are null); an older column of that name gives way."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema.fields if f.name.lower() != out.lower()] + [T.StructField(out, T.StringType(), False)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            column = batch.column(ids)
            sizes = [4 * (len(x) if x.is_valid else 0) for x in column]
            for lo, hi in slices(sizes):
                part = batch.slice(lo, hi - lo)
                texts = [bpe.decode(x or ()) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode from the ids, and return counts and digests; ids never leave the task.

    Rows are kept one for one, repeated keys too; a null text gives no tokens
    and the digests of empty strings.
    """

    def run(batches):
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for lo, texts in text_slices(batch.column(1)):
                ids, counts = bpe.encode_slice(texts)
                ends, held = np.cumsum(counts).tolist(), ids.tolist()
                each = [held[a:b] for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(texts)),
                        pa.array(counts, pa.int64()),
                        pa.array([sha(" ".join(map(bpe.numbers.__getitem__, x))) for x in each], pa.string()),
                        pa.array([sha(bpe.decode(x)) for x in each], pa.string()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

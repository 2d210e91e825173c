"""BPE, token counts and the id codec against the tokenizers library and full recounts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebar.llm import bpe, idcodec, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", "<|endoftext|> hi <|startoftext|>", "it's I'll we've  you're 'tis ''s 'S o'clock", "  \n\n x\n y  \t z ", "İΣΣ ΑΣ nfc é ǅ", "x" * 5000, "ab" * 300 + " 12345 ３ ①½",
    "日本語テキスト 'd'd'm ' s  　x  ", "\x1c\x1fa\x85b", "don't'sll 'llama 'reed", " '", "a\x00b", "'s", "x's<|endoftext|>'s", " " * 300 + "a", "   b", "🙂🙃 ok", "don’t", "\n",
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path):
    b, t = bpe.load(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab' sdlm\n\t1é!.,<|>Σ̀") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    ids, counts = b.encode_slice(texts)
    ends = np.cumsum(counts)
    want = t.encode_batch(texts, add_special_tokens=False)
    for text, w, e, n in zip(texts, want, ends, counts):
        assert ids[e - n : e].tolist() == w.ids, text
        assert b.decode(ids[e - n : e].tolist()) == t.decode(w.ids, skip_special_tokens=False)
        assert b.decode(w.ids[1:]) == t.decode(w.ids[1:], skip_special_tokens=False)


def test_long_words_equal_short_ones():
    b = bpe.load(BYTE)
    raw = np.frombuffer(b"therearemanywordsinherewithoutanyspace!!", np.uint8)
    short = b._rows(np.array([0]), raw[None, :])[0][2].tolist()
    assert b._long(raw) == short


def test_cache_starts_anew_when_full():
    b = bpe.Bpe(BYTE)
    b.cache.most = 10
    texts = [f"w{i} x{i * 7}" for i in range(50)]
    a = [b.encode_slice([t])[0].tolist() for t in texts]
    assert a == [bpe.load(BYTE).encode_slice([t])[0].tolist() for t in texts]


def test_digests(frame, odd):
    d = frame(odd)
    rows = bpe.digests(d, WORD).collect()
    assert len(rows) == len(odd)
    t = Tokenizer.from_file(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r[0] is not None, r[0], *(lambda e: (len(e.ids), sha(" ".join(map(str, e.ids))), sha(t.decode(e.ids, skip_special_tokens=False))))(t.encode(r[1] or "", add_special_tokens=False))) for r in odd if r[0] is not None)
    assert sorted((True, *r) for r in rows if r[0] is not None) == want
    assert bpe.digests(d.limit(0), WORD).count() == 0


def test_encode_and_decode_columns(frame, odd):
    d = bpe.decode(bpe.encode(frame(odd), WORD), WORD)
    assert d.columns[:3] == ["doc_id", "text", "lang"]
    t = Tokenizer.from_file(WORD)
    for r in d.collect():
        assert r.decoded == t.decode(t.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(3))
def test_recount_equals_a_full_count(seed, prose):
    """Batch after batch of edits is applied to the leaves that the one before left."""
    b, t, rng = bpe.load(BYTE), Tokenizer.from_file(BYTE), random.Random(seed)
    docs = [*TEXTS, "'s" * 200, "  \n " * 200, "<|endof", *(prose(rng.randint(1, 900), seed=i) for i in range(60))]
    forest = token_counts.trees(b, docs)
    for _ in range(4):
        edits = []
        for d in docs:
            p = sorted(rng.randint(0, len(d) + 2) for _ in range(2 * rng.randint(0, 4)))
            edits.append([{"start": a, "end": z, "text": rng.choice(["", "x", " ", "\n", "'", "'s", " 12 ", None, "ab cd" * 20, "text|>", "<|endoftext|>"])} for a, z in zip(p[::2], p[1::2])])
        plain = [token_counts.edited(d, token_counts._checked(e, len(d))) for d, e in zip(docs, edits)]
        pieces = sum(x.total(1) for x in forest)
        docs, forest, again = token_counts.recount(b, docs, forest, edits)
        assert docs == plain
        assert [x.total(2) for x in forest] == [len(e.ids) for e in t.encode_batch(docs, add_special_tokens=False)]
        assert [x.total(0) for x in forest] == [len(d) for d in docs]
        assert all(x.of_leaves()[1].max(initial=0) <= token_counts.LEAF for x, d in zip(forest, docs) if "<|" not in d)
        assert again.sum() < 0.5 * pieces


def test_overlapping_edits_are_an_error():
    with pytest.raises(ValueError):
        token_counts._checked([{"start": 0, "end": 5, "text": ""}, {"start": 3, "end": 6, "text": ""}], 10)


def test_stored_leaves(spark, frame, odd, tmp_path):
    d = frame(odd).withColumn("N_Tokens", F.lit("clash"))
    token_counts.build(d, BYTE).write.parquet(path := f"file://{tmp_path}/leaves")
    t = Tokenizer.from_file(BYTE)
    full = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    stored = spark.read.parquet(path).withColumn("edits", token_counts.sample_edits())
    rows = token_counts.renew(stored, BYTE).collect()
    assert len(rows) == len(odd)
    for r, w in zip(rows, stored.collect()):
        text = w.text or ""
        assert r.text == token_counts.edited(text, token_counts._checked([e.asDict() for e in w.edits], len(text)))
        assert (r.n_tokens, r.n_tokens_edited, sum(r.leaf_tokens)) == (full(text), full(r.text), full(r.text))
    edits = spark.createDataFrame([(6, 5, 9, "new words"), (6, 100, 100, "more")], "doc_id long, start int, end int, text string")
    again = {r.doc_id: r for r in token_counts.renew(token_counts.with_edits(spark.read.parquet(path), edits), BYTE).collect()}
    assert again[6].n_reencoded > 0 and again[6].n_tokens_edited == full(again[6].text) and again[8].n_reencoded == 0
    assert token_counts.renew(stored.limit(0), BYTE).count() == 0
    with pytest.raises(Exception, match="changes texts"):
        token_counts.build(d, WORD).collect()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 70_001])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_256)
    assert (idcodec.expand(idcodec.compress(ids, 50_257)) == ids).all()


@pytest.mark.parametrize("ids", [np.zeros(5000, int), np.full(300, 9), np.arange(3000) % 7, np.random.default_rng(0).integers(0, 9, 20_000)])
def test_codec_small_vocabularies(ids):
    assert (idcodec.expand(idcodec.compress(ids, 10)) == ids).all()


def test_codec_compresses_what_repeats():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 500), 200)
    assert len(idcodec.compress(ids, 50_257)) < 0.5 * len(ids)


def plain_block(ids, vocab):
    """What ``compress`` writes, worked out an id at a time with whole numbers, lists and dictionaries."""
    n = len(ids)
    lanes = max(1, min(idcodec.LANES, n // 256))
    steps = -(-n // lanes)
    lanes = -(-n // steps)
    one, two, empty = {}, {}, [[(-1, 0)] * k for k in idcodec.SLOTS]
    bits = int(np.clip(n, 1 << 10, 1 << 20)).bit_length()
    cells = {(r, b, a): [64, 32 * (a > 0), 32 * (b > 0)] for r in range(4) for b in range(13) for a in range(13)}
    counts, pending, words = [0] * vocab, [], [[] for _ in range(lanes)]
    state = [[0, 0, 0, 0, 1 << 48] for _ in range(lanes)]  # last id, the one before, run, low, span

    def weights():
        return {c: [int(v * (1020 / sum(x))) + (v > 0) for v in x] for c, x in cells.items()}

    def order0():
        top = (1 << 20) - vocab
        f = [1 + c * top // max(1, sum(counts)) + (0 if any(counts) else top // vocab) for c in counts]
        return f, np.cumsum([0, *f]).tolist()

    def sure(slots):
        total, top = sum(c for _, c in slots), max(c for _, c in slots)
        return 1 + 2 * min(min(total, 63).bit_length() - 1, 5) + (8 * top >= 7 * total) if total else 0

    def learned(slots, x):
        names = [i for i, _ in slots]
        k = names.index(x) if x in names else min(range(len(slots)), key=lambda k: slots[k][1])
        return k, (x, min(slots[k][1] + 2, 250) if x in names else 1)

    (freq, start), w = order0(), weights()
    for t in range(steps):
        writes, shares = [], []
        for lane, s in enumerate(state):
            if lane * steps + t >= n:
                continue
            x, (p1, p2, run, low, span) = int(ids[lane * steps + t]), s
            h = (((p2 * 0x9E3779B1 + p1) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - bits)
            a, b = one.get(p1, empty[0]), two.get(h, empty[1])
            cell = run, sure(b), sure(a)
            own = [w[cell][0] * freq[x], 0, 0]
            first = w[cell][0] * start[x]
            for k, slots in ((1, a), (2, b)):
                each = w[cell][k] * float(1 << 20) / max(1, sum(c for _, c in slots))
                first += sum(int(c * each) for i, c in slots if i < x)
                own[k] = sum(int(c * each) for i, c in slots if i == x)
            r = span >> 30
            low, span = low + r * first, r * sum(own)
            while span < 1 << 32:
                words[lane].append(low >> 32)
                low, span = (low & 0xFFFFFFFF) << 16, span << 16
            shares.append((cell, [int(v * (256.0 / sum(own))) for v in own]))
            writes += [(one, p1, a, x), (two, h, b, x)]
            run = min(run + 1, 3) if b[0][0] == x else 0 if sum(c for _, c in b) else run >> 1
            s[:] = x, p1, run, low, span
            pending.append(x)
        for table, context, slots, x in writes:
            k, slot = learned(slots, x)
            table[context] = table.get(context, slots)[:k] + [slot] + table.get(context, slots)[k + 1 :]
        if t < 16 or t % 4 == 0:
            for cell, share in shares:
                cells[cell] = [v + d for v, d in zip(cells[cell], share)]
            cells.update({c: [(v + 1) >> 1 for v in x] for c, x in cells.items() if sum(x) > 1 << 22})
            w = weights()
        if (t + 1) & t == 0 or (t + 1) % 64 == 0:
            for x in pending:
                counts[x] += 1
            pending = []
            freq, start = order0()
    for out, (*_, low, _) in zip(words, state):
        out += [low >> 32, low >> 16 & 0xFFFF, low & 0xFFFF]
        for i in range(len(out) - 1, 0, -1):
            out[i - 1] += out[i] >> 16
            out[i] &= 0xFFFF
    crc = zlib.crc32(np.asarray(ids, "<u4").tobytes())
    return b"TBM2" + np.array([n, lanes, vocab, crc, *map(len, words)], "<u4").tobytes() + np.concatenate(words).astype("<u2").tobytes()


@pytest.mark.parametrize("slots", [(2, 1), (4, 2)])
@pytest.mark.parametrize("n", [1, 700, 5003])
def test_codec_equals_its_plain_version(n, slots, monkeypatch):
    monkeypatch.setattr(idcodec, "SLOTS", slots)
    rng = np.random.default_rng(n)
    words = [rng.zipf(1.4, 3) % 500 for _ in range(40)]
    ids = np.concatenate([words[k] if k < 40 else rng.integers(0, 500, 3) for k in rng.zipf(1.2, n).clip(1, 50) - 1])[:n]
    block = idcodec.compress(ids, 500)
    assert block == plain_block(ids, 500)
    assert (idcodec.expand(block) == ids).all()


def test_pieces_are_asked_once():
    """The library is asked once for each of more pieces than a task of 100 MB has, not again at each clearing of a small cache."""
    enc, asked = idcodec.LibraryEncoder(BYTE), []

    def ask(data, starts, lengths):
        asked.append(len(starts))
        return np.zeros(len(starts), np.int32), np.ones(len(starts), np.int64)

    enc.bpe.cache.encode = ask
    texts = [" ".join(f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(k, k + 100_000)) for k in range(0, 1_200_000, 100_000)]
    for text in texts + texts:
        enc.bpe.encode_slice([text])
    assert sum(asked) < 1.1 * 1_200_000


def test_codec_finds_damage():
    block = bytearray(idcodec.compress(np.arange(2000), 50_257))
    block[-200] ^= 4
    with pytest.raises(ValueError):
        idcodec.expand(bytes(block))
    with pytest.raises(ValueError):
        idcodec.expand(b"nothing at all here....")


def test_codec_finds_damage_anywhere():
    block, rng = idcodec.compress(np.random.default_rng(5).zipf(1.3, 4000) % 500, 500), np.random.default_rng(6)
    for _ in range(30):
        at = int(rng.integers(20 + 4 * 15, len(block) - 90))
        with pytest.raises(ValueError):
            idcodec.expand(block[:at] + rng.bytes(60) + block[at + 60 :])


def test_files_round_trip(spark, frame, odd, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(idcodec, "BLOCK_IDS", 700)
    docs = [r for r in odd if r[0] is not None] + [(i, prose(i % 90, seed=i), "en", "z") for i in range(20, 120)]
    path = f"file://{tmp_path}/ids"
    idcodec.write(frame(docs), path, BYTE, end_id=0, partitions=3)
    got = sorted(tuple(r) for r in idcodec.read(spark, path).collect())
    t, want, start = Tokenizer.from_file(BYTE), [], 0
    for k, text, *_ in sorted(docs, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_code_point_and_mixtures_equal_the_library(path):
    b, t = bpe.load(path), Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(6)
    texts = ["a" + "".join(every[i : i + 5]) + "1" for i in range(0, len(every), 5) if i < 0x32000 or i > 0xE0000 and i < 0xE0300]
    texts += [f"a{c}1 {c}" for c in every[0x1C80:0x1C90] + every[0xA7C0:0xA7E0] + every[0x10000:0x11400:7] + every[0x14000:0x14200:5] + every[0x1E500:0x1E600:3]]
    pool = every[:0x3000] + every[0xA000:0xB000] + every[0x10000:0x14400] + every[0x1E000:0x1F000]
    texts += ["".join(rng.choice(pool if rng.random() < 0.5 else "ab' 1\ńΣ") for _ in range(rng.randint(1, 40))) for _ in range(6000)]
    ids, counts = b.encode_slice(texts)
    ends = np.cumsum(counts)
    wrong = [x for x, w, e, n in zip(texts, t.encode_batch(texts, add_special_tokens=False), ends, counts) if ids[e - n : e].tolist() != w.ids]
    assert not wrong, [ascii(x) for x in wrong[:5]]

"""Pieces, spans and texts against the sentencepiece library, also for normalisers with a compiled map."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from tidebar.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "a", "the", "ing", "é", "ﬁ", "日", "\U0001f600", "\n", "\t", "\x00", "①", "　", "<s>", "<0x41>", "</s>", "ß", "E", "0", "12", "‍", "́", "ｶﾞ"]


def made(n, seed=1):
    rng = random.Random(seed)
    point = lambda: c if not 0xD800 <= (c := rng.choice([rng.randrange(0x80), rng.randrange(0x3000), rng.randrange(0x110000)])) < 0xE000 else 0x61
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["".join(chr(point()) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def spans(library, text):
    found = sentencepiece_pb2.SentencePieceText.FromString(library.encode(text, out_type="serialized_proto"))
    return [(p.begin, p.end) for p in found.pieces]


def test_ids_spans_and_texts_equal_the_library(library):
    texts = [*made(700), "", " ", "a" * 300, "ab" * 500, " " * 200 + "x", "▁" * 33, "".join(random.Random(2).choice("abcdeéß日") for _ in range(3000))]
    model = pieces.load(PATH)
    ids, counts, starts, ends = model.encode_slice(texts)
    last = np.cumsum(counts)
    for text, a, b in zip(texts, last - counts, last):
        got = ids[a:b].tolist()
        assert got == library.encode(text), text
        assert list(zip(starts[a:b].tolist(), ends[a:b].tolist())) == spans(library, text), text
        assert model.decode(got) == library.decode(got)


def test_any_ids_decode_as_in_the_library(library):
    rng, model = random.Random(3), pieces.load(PATH)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(259, 300), 28705, 0, 1, 2]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_words_equal_short_ones():
    model = pieces.load(PATH)
    base = model.symbol_of[np.frombuffer("▁unbelievablythesame".encode("utf-32-le"), np.uint32)]
    [(_, parts)] = model._rows(np.array([0]), base[None, :])
    assert parts[0].tolist() == model._long(base).tolist()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix, trim", [(True, True), (True, False), (False, False)])
def test_longest_prefixes_of_a_compiled_map(rule, prefix, trim):
    options = {"add_dummy_prefix": prefix, "escape_whitespaces": prefix, "remove_extra_whitespaces": trim}
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    for k, v in options.items():
        setattr(spec, k, v)
    mine = pieces.Normalizer(spec)
    for text in [*made(400, 5), "", "   ", " a ", "Ａ①ﬁ"]:
        want, offsets = library.normalize(text, with_offsets=True)
        got, at = mine(text)
        assert (got, [len(text.encode()[:x].decode()) for x in at.tolist()]) == (want, list(offsets)), text


def test_columns_of_odd_rows(frame, odd, library):
    df = frame([*odd, (10, "x" * 200 + " é " * 3, "en", "b")], "ids string")
    rows = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert sorted(df.columns) == sorted(c for c in rows[0].asDict() if c not in ("spans", "decoded"))
    assert len(rows) == len(odd) + 1
    for r in rows:
        text = r.text or ""
        assert r.ids == [*library.encode(text), 2] and r.decoded == library.decode(r.ids)
        assert [tuple(s) for s in r.spans] == [*spans(library, text), (len(text.encode()),) * 2]
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256): r for r in pieces.digests(df, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        d = digests[r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids)))]
        assert d.decoded_sha256 == sha(r.decoded)
        assert d.spans_crc32 == zlib.crc32(np.array([tuple(s) for s in r.spans], "<i8").tobytes())
    assert pieces.encode(df.limit(0), PATH).count() == pieces.digests(df.limit(0), PATH).count() == 0

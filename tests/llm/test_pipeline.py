"""The stages against brute force, and the registered queries."""

import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidebar.llm import mixing, pii

from .test_search import plain_classes

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(path := f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(path)
        seen[name] = before.collect(), docs.collect()
    came, stayed = seen["language"]
    assert {r.doc_id for r in stayed} == {r.doc_id for r in came if r.text and any(c.isalpha() for c in r.text)}
    came, stayed = seen["near_duplicates"]
    assert Counter(r.doc_id for r in stayed) == Counter({c for _, c in plain_classes([(r.doc_id, r.text) for r in came])})
    came, stayed = seen["personal_data"]
    s = pii.selector(spark.createDataFrame(came))
    assert {r.doc_id: r.text for r in stayed} == {r.doc_id: pii.redacted(r.text, s.spans(r.text)) for r in came}
    assert all(r.n_chars == len(r.text) for r in stayed)
    came, stayed = seen["mixing"]
    sizes, taken = Counter(), Counter()
    for r in came:
        sizes[r.source] += len(r.text.split())
    for r in stayed:
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    came, stayed = seen["bpe"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.text) for r in came) == sorted((r.doc_id, r.text) for r in stayed)
    for r in stayed:
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_mixing_against_sql(spark):
    import duckdb

    import __spark_entry__

    got = sorted(tuple(r) for r in __spark_entry__.queries()["op6_mixing"](spark, DATA).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = sorted(duckdb.sql(mixing.ORACLE).fetchall())
    assert [(a, b, c, round(t, 6), e) for a, b, c, t, e in got] == [(a, b, c, round(t, 6), e) for a, b, c, t, e in want]

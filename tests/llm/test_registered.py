"""Every registered query and every stage of the pipeline: columns, types, rows, and tables with odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebar.llm import entry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op2_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_token_counts": "doc_id bigint, n_tokens bigint, n_pieces bigint, n_tokens_edited bigint, n_reencoded bigint",
    "op4_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_near_duplicates": "doc_id bigint, class_id bigint, text_id bigint, copies bigint, links bigint",
    "op11_pieces": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint",
    "op12_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op10_nearest": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered(spark, name):
    d = entry.QUERIES[name](spark, DATA)
    assert ", ".join(f"{n} {t}" for n, t in d.dtypes) == COLUMNS[name]
    rows = d.collect()
    if name == "op10_nearest":
        n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
        asked = {r.query_id for r in rows}
        assert len(rows) == len(asked) * min(20, n - 1) and all(q % 20 == 0 for q in asked)
        return
    if name in ("op12_codes", "op13_phrases"):
        assert rows and (name != "op12_codes" or len(rows) == spark.read.parquet(f"{DATA}/embeddings.parquet").count())
        return
    ids = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        if name == "op5_language":
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if name == "op7_quality":
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)
    if name == "op5_language":
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
        held = [r for r in rows if r.held_out and lang[r.doc_id]]
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


CLASHING = ["ids", "decoded", "N_Tokens", "source_size", "taken", "target", "size", "_n", "_d", "copies", "node", "row", "whole", "said", "score", "kept"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, frame, odd, prose, stage):
    rows = [*odd, *((100 + i, prose(60, seed=i), "en", "a") for i in range(12)), (200, prose(60, seed=1) + " end", "en", "b")]
    docs = frame(rows).withColumns({n: F.lit(n) for n in CLASHING})
    docs = docs.withColumn("n_chars", F.col("n_chars"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
    got = out.collect()
    if stage == "bpe":
        assert out.columns[: len(docs.columns)] == docs.columns and len(got) == len(rows)
        assert all(len(r[len(docs.columns)]) == r[-1] and len(r[-2]) == 64 for r in got)
    else:
        assert out.columns == docs.columns and got
    for r in got:
        assert all(r[n] == n for n in CLASHING)
        assert r.n_chars is None or r.n_chars == len(r.text)
    empty = dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), DATA)
    assert empty.count() == 0


def test_whole_documents_of_a_source_come_near_its_target(spark, frame, prose):
    docs = frame([(i, prose(10 + i % 50, seed=i), "en", "abc"[i % 3]) for i in range(90)])
    out = corpus_pipeline.mix_sources(spark, docs, DATA)
    size = docs.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    taken = out.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(taken - 1.5 * size) <= 3

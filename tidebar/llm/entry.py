"""Queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, idcodec, language, mixing, neardup, phrases, pieces, pii, quality, rules, token_counts
from .shared import kept, shared_path, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.selector(docs))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    stored = kept(token_counts.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path), "leaves")
    return token_counts.renew(stored.withColumn("edits", token_counts.sample_edits()), path).select("doc_id", *token_counts.RESULTS)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    idcodec.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return idcodec.read(spark, path)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.prototypes(docs.where(~F.col("held_out")))
    return language.classify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size"))
    return mixing.mix(sizes.checkpoint()).select("doc_id", "size", "source_size", "target", "taken")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language.held_out(folds=4, fold=2))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    trees = quality.train(docs, labels.where(~language.held_out(folds=4, fold=2)))
    return quality.score(docs, trees).drop("text").withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_bpe, op3_token_counts, op4_token_ids, op5_language, op6_mixing, op7_quality, op8_rules, op9_near_duplicates, op10_nearest, op11_pieces, op12_codes, op13_phrases)}
SQL = {"op6_mixing": mixing.ORACLE, "op12_codes": codes.ORACLE, "op13_phrases": phrases.ORACLE}

"""A corpus pipeline: language, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``; ``n_chars`` follows the text. Every stage keeps
extra columns, whatever their names, treats a null text as an empty one, keeps
repeated rows apart (near-duplicate removal keeps one of them), and makes an
empty table of an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, language, mixing, neardup, pii
from tidebar.llm.shared import checkpoints, quoted, shared_path, ship, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no text, or no letter) go; a missing ``lang`` is filled with the prediction."""
    checkpoints(ship(spark))
    label, score = unused(docs.columns, "said", "score")
    found = language.classify(docs, language.prototypes(docs), label=label, score=score)
    return found.where(F.col(label) != "und").withColumn("lang", F.coalesce("lang", label)).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the smallest id."""
    checkpoints(ship(spark))
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the name of their kind."""
    checkpoints(ship(spark))
    return _counted(pii.redact(docs, pii.selector(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; the last of a source is cut at its budget."""
    checkpoints(ship(spark))
    (whole,) = unused(docs.columns, "whole")
    names = [quoted(c) for c in docs.columns]
    # The document travels as one column, so that none of its columns meets one of the operator's.
    packed = docs.select("doc_id", "source", "text", mixing.n_words().alias("size"), F.struct(*names).alias(whole))
    taken = mixing.taken_rows(mixing.mix(packed))
    return _counted(taken.select(*(F.col("text") if c == "text" else F.col(f"{whole}.{quoted(c)}").alias(c) for c in docs.columns)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their token ids, a digest of what these decode to, and their number, in columns that no other column is named as."""
    checkpoints(ship(spark))
    ids, decoded, n_tokens = unused(docs.columns, "ids", "decoded_sha256", "n_tokens")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), out=ids, decoded=decoded).withColumn(n_tokens, F.size(ids).cast("long"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trees, hyperdimensional profiles and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

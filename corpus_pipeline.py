"""The corpus pipeline: documents to token ids in five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, exact, langid, minhash, mixing
from panelforge.llm._store import settled

RANKS = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects documents without a letter (null and empty texts too) and those of no known language, whose
    score is under the limit from held-out scores, which is lower for short texts.  Without a labelled document all with a letter stay."""
    model = langid.train(docs, limit=True)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    found = langid.predict(numbered, model, text=text, letters="letters")
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & langid.accepted(model, F.col("score"), F.col("letters")))
    return kept.select(*numbered.columns).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, blanks aside, the longest one with the least doc_id stays."""
    return exact.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near-duplicates the document with the least doc_id stays."""
    return minhash.kept_rows(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the sources' target weights take it."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: a row for each document with its ids, and whether decoding them gives its text again."""
    path = public_tokenizers.path(RANKS)
    keep = ["doc_id", "lang", "source", "text"]
    rows = bpe.encode(docs.select(*keep), path, keep=keep, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("near-dedup", near_copies),
    ("mixing", mixture),
    ("encoding", tokens),
]

#: A trained network, similarities of texts and BPE merges aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written and read again for the next,
    and the tables that it wrote on the way are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for k, (_, stage) in enumerate(first):
        docs = settled(partial(stage, spark, docs, sf_dir), spark, f"stage{k}")
    return last(spark, docs, sf_dir)

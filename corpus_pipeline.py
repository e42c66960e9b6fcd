"""A corpus pipeline: quality filter, near-duplicates, repeated strings,
decontamination, tokens.

Every stage gets the documents that the one before it kept and returns the
columns of documents, the last one tokens.  Decisions hold for rows of equal id
and text, so that rows that share an id, or have none, are judged by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import base, decontaminate, near_dedup, quality, sentencepiece_codec, suffix_dedup
from sextant.llm.language_id import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Up to so many ids to drop are broadcast.
BROADCAST_IDS = 200_000
#: Percent of five-word shingles in common from which documents are near-duplicates.
NEAR_DUPLICATES = 80
#: Words from which a repeated passage goes even where it is shorter than the 400
#: bytes: counted in words, as 51 of them take from 101 bytes on.
PASSAGE = 51
ORACLE_SQL = None


KEY = ["doc_id", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, base.text_hash(F.col("text")).alias("text_hash"))


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``docs`` but for those of the ids and texts in ``keys``."""
    gone = base.written(keys.select(*KEY).distinct(), name)
    return base.join_rows(_keyed(docs), gone, KEY, "left_anti", BROADCAST_IDS).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 1."""
    base.prepare(spark)
    labels = base.table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    stats = quality.measured(docs)
    return _without(docs, quality.scored(stats, quality.train(stats, labels)).where("predicted = 0"), "rejected")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates; of rows that
    share it, one."""
    base.prepare(spark)
    found = base.written(near_dedup.near_duplicates(docs, threshold=NEAR_DUPLICATES).select(*KEY, "kept"), "near")
    out = _without(docs, found.where("NOT kept"), "copies")
    both = base.written(found.groupBy(*KEY).agg(F.max("kept").alias("kept"), F.min("kept").alias("all")).where("kept AND NOT `all`").select(*KEY), "twins")
    if both.isEmpty():
        return out
    # Of rows alike in id and text, one stays.
    alike = base.join_rows(_keyed(docs), both, KEY, "left_semi", BROADCAST_IDS)
    return out.unionByName(alike.dropDuplicates(KEY).select(*COLUMNS))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of repeated strings and of repeated
    passages of over 50 words; what is left of a character that was cut goes too."""
    base.prepare(spark)
    out = suffix_dedup.repeated_bytes(docs, keep=True, carry=["lang", "source"], words=PASSAGE)
    return out.select("doc_id", F.col("kept").alias("text"), "carry.lang", "carry.source").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    base.prepare(spark)
    return _without(docs, decontaminate.decontaminate(docs, base.table(spark, sf_dir, "benchmark")).where("contaminated"), "contaminated")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256."""
    base.prepare(spark)
    return sentencepiece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = base.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = base.written(docs, f"stage{number}")
    return docs

"""A training corpus from the documents table, stage by stage.

Each stage is written as Parquet and read again as the next one's input.
No stage but the last changes the columns; ORACLE_SQL is None, as neither
language identification nor the later stages can be said in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import language_id, mixing, packing, secrets
from larkspur.llm.common import cols, drop, prefix_for, remainder, row_hash, scratch, store, table
from larkspur.llm.minhash_dedup import near_duplicates
from larkspur.runtime import ship

#: A text less like its nearest known language is taken for none. Of 1,960 held-out
#: documents (sf0.1, 400 texts a language) the least has 0.52; of six texts in other languages the most has 0.36, of five of chance letters 0.17.
LEAST_LIKENESS = 0.42


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those that are like no language known; a text too short to have an n-gram stays."""
    p = prefix_for(docs.columns)
    found = language_id.identify(docs, remainder(F.col("doc_id"), 5) != 0, with_likeness=True, prefix=p)
    return found.where((F.col(p + "lang_pred") != "und") & (F.coalesce(p + "likeness", F.lit(1.0)) >= LEAST_LIKENESS)).select(*cols(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicate rows: of the smallest id (null last), then of the smallest hash of the row.

    Rows are told apart by a stored key, so rows that share an id, or have
    none, are copies only if their texts are.
    """
    p = prefix_for(docs.columns)
    rows = store(docs.withColumn(p + "key", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), row_hash(docs).alias("hash"), F.col(p + "key").alias("of"))
    group = near_duplicates(rows.select(F.col(p + "key").alias("doc_id"), "text")).select(F.col("doc_id").alias(p + "member"), F.col("component_id").alias(p + "group"))
    kept = rows.select(p + "key", first.alias(p + "first")).join(group, F.col(p + "key") == F.col(p + "member")).groupBy(p + "group").agg(F.min(p + "first").alias(p + "first"))
    return rows.join(kept.select(F.col(p + "first")["of"].alias(p + "of")), F.col(p + "key") == F.col(p + "of")).select(*cols(docs))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as their source's target asks."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the tokens into training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", deduplicate),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage stored goes once the next one's input is written."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            after = keep(store(stage(spark, docs, sf_dir)))
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: five stages, each written as Parquet and read again.

Quality rules reject documents, near-duplicates leave one document of each group,
secrets are blanked, sources are mixed to their weights (a document may come several
times or not at all), and the texts are encoded.

All stages but the last carry each row whole, as one struct, so extra columns keep their values
whatever their names are; an empty table gives an empty one with the same columns. Very long texts
are whole in one task and never cut.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, mixing, robust_quality, secrets, simhash
from tapeloom.llm.common import small_batches, table, written
from tapeloom.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A NULL or empty text has no words and goes; a NULL language or source is a value of its own; repeated rows
    count as often as they come and stay or go together; ties at the cutoff stay.
    """
    return robust_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest ``doc_id``.

    Texts without words (NULL too) are one group; a group without any ``doc_id`` keeps one row; rows that repeat the
    smallest ``doc_id`` of their group leave the one with the smallest text hash, and of equal rows any one.
    """
    ship_package(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets blanked; ``n_chars`` follows a changed text.

    A NULL text stays NULL and an empty one empty; overlapping secrets are blanked as one; repeated rows and
    rows without a ``doc_id`` each give their row.
    """
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them: not at all, or up to three times.

    A NULL or empty text takes its turns like others; a NULL source is a source, after all others;
    repeated rows stand side by side in the line, each with a place of its own; equal sizes stand in
    an order of their own.
    """
    return mixing.mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, lang, source, its ids (little-endian 32-bit), their number, the decoded text's digest.

    These six columns are the result: all others of its input, the text too, end here. A NULL or empty text has no ids;
    repeated rows each give their row; NULLs of the other columns stay.
    """
    ship_package(spark)
    small_batches(spark)
    path = public_tokenizers.path(bpe.DEFAULT_FILE)
    rows = docs.select("doc_id", "lang", "source", bpe.encode(F.col("text"), path).alias("ids"))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        "ids",
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: Neither the outlier estimates nor the fingerprints' hash can be written in SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

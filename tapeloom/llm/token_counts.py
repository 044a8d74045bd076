"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut into pieces of at most some ``PIECE_CHARS`` at places that are safe:
before a single space between two ASCII letters the tokenizer's pattern always ends
a piece, and no special string holds a space, so the counts of the pieces add up to
the count of the text.  A stretch without such a place stays whole.  Pieces are
encoded in batches of about ``BATCH_BYTES``, whatever the number of texts in them.

Defined cases: a NULL or empty text has 0 bytes and 0 tokens; special strings in a
text count as the library counts them by default; repeated rows each give their
result; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tapeloom.llm.common import small_batches, table

DEFAULT_FILE = "byte_bpe_50k.json"
PIECE_CHARS = 20_000
BATCH_BYTES = 1_000_000
LIMIT = 1024
_safe = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])").search


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that can be encoded apart; joined they are the text."""
    at = 0
    while len(text) - at > most:
        place = _safe(text, at + most)
        if place is None:
            break
        yield text[at : place.start()]
        at = place.start()
    yield text[at:]


def count_all(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    tokenizer, counts = _tokenizer(path), np.zeros(len(texts), dtype=np.int64)
    batch, owners, held = [], [], 0

    def flush() -> None:
        encoded = tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        np.add.at(counts, owners, [len(e) for e in encoded])

    for owner, text in enumerate(texts):
        for piece in pieces(text):
            batch.append(piece)
            owners.append(owner)
            held += len(piece.encode("utf-8"))
            if held >= BATCH_BYTES:
                flush()
                batch, owners, held = [], [], 0
    if batch:
        flush()
    return counts


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of each text under the tokenizer file at ``path``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(count_all(["" if t is None else t for t in batch], path))

    return F.pandas_udf(run, LongType())(text)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession, 512)
    count = n_tokens(F.col("text"), path or public_tokenizers.path(DEFAULT_FILE))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    rows = docs.select("doc_id", size.alias("n_bytes"), count.alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

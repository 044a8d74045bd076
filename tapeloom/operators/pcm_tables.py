"""Stored 16-bit chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import pcm


def for_writer(chunks: DataFrame, n_channels: int) -> DataFrame:
    """Chunks laid out for a writer of ``n_channels``; ``error`` marks misfits."""
    have, wanted = F.col("n_channels"), F.lit(n_channels)
    return (
        chunks.withColumn("error", pcm.widen_error(have, wanted))
        .withColumn("samples", pcm.widen(F.col("samples"), have, wanted))
        .withColumn("n_channels", wanted)
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Quantise and append chunks, one folder per session.

    Rows are clustered by session and a slice of its chunks: few files per
    folder, and a long recording is still written by many tasks.
    """
    stored = chunks.withColumn("samples", pcm.quantise(F.col("samples")))
    slice_of = F.expr("chunk_idx div 4096")
    stored.repartition("session_id", "channel", slice_of).write.mode("append").partitionBy("session_id").parquet(path)


def stored_samples(stored: DataFrame) -> DataFrame:
    return stored.withColumn("samples", pcm.dequantise_file(F.col("samples")))

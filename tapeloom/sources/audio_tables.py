"""Audio views over the given tables: vectors as chunks, orders as captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.ordered import ordinal
from tapeloom.sources.tables import table

#: Channels every captured order session is configured with.
CAPTURE_CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _vector_keys() -> list[Column]:
    session = F.concat(F.lit("session-"), F.expr("label div 2").cast("string"))
    return [session.alias("session_id"), F.concat(F.lit("ch"), F.col("label").cast("string")).alias("channel")]


def vector_rate() -> Column:
    return F.when(F.pmod("label", F.lit(2)) == 0, 16000).otherwise(22050)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sample blocks, four times louder so that some clip."""
    loud = F.transform("embedding", lambda x: (x * F.lit(4.0).cast("float")).cast("float"))
    return table(spark, sf_dir, "embeddings").select(
        *_vector_keys(), F.col("vec_id"), "label", vector_rate().alias("sample_rate"), loud.alias("samples")
    )


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as mono audio chunks, two long recordings per session."""
    placed = ordinal(vectors(spark, sf_dir), ["session_id", "channel"], "vec_id", "chunk_idx")
    return placed.select(
        "session_id",
        "channel",
        F.lit("vector").alias("device"),
        "chunk_idx",
        (F.col("chunk_idx") * F.size("samples")).alias("frame_start"),
        F.size("samples").alias("n_frames"),
        "sample_rate",
        F.lit(1).alias("n_channels"),
        "samples",
    )


def vector_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .select("label")
        .distinct()
        .select(
            *_vector_keys(),
            F.lit("vector").alias("device"),
            vector_rate().alias("sample_rate"),
            F.lit(1).alias("n_channels"),
        )
    )


def vector_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as stereo 16-bit PCM packets of uneven length.

    The last bytes of each vector (up to two, by its number; maybe none) are a packet
    of their own, so frames run across packet borders and no byte is lost.
    """
    scaled = F.transform(
        "samples",
        lambda x: F.pmod(
            (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int"), F.lit(65536)
        ),
    )
    hex_le = F.transform(
        scaled,
        lambda v: F.concat(
            F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8)), 2, "0")
        ),
    )
    payload = F.unhex(F.array_join(hex_le, ""))
    moved = F.pmod("vec_id", F.lit(3)).cast("int")
    size = F.length("bytes")
    cut = vectors(spark, sf_dir).withColumn("bytes", payload).select(
        "session_id",
        "channel",
        "vec_id",
        "sample_rate",
        F.substring("bytes", F.lit(1), size - moved).alias("kept"),
        F.substring("bytes", size - moved + 1, moved).alias("given"),
    )
    pieces = F.explode(
        F.array(
            F.struct((2 * F.col("vec_id")).alias("seq"), F.col("kept").alias("payload")),
            F.struct((2 * F.col("vec_id") + 1).alias("seq"), F.col("given").alias("payload")),
        )
    )
    return cut.withColumn("packet", pieces).select(
        "session_id",
        "channel",
        F.col("packet.seq").alias("seq"),
        F.col("packet.payload").alias("payload"),
        F.lit("s16le").alias("sample_format"),
        "sample_rate",
        F.lit(2).alias("n_channels"),
        F.lit(False).alias("eof"),
    )


def order_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a session with five configured channels."""
    names = F.explode(F.array(*[F.lit(c) for c in CAPTURE_CHANNELS])).alias("channel")
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("session-"), F.col("c_custkey").cast("string")).alias("session_id"),
        names,
        segment.alias("device"),
        F.when(segment == "HOUSEHOLD", 0).when(segment == "MACHINERY", 44100).otherwise(16000).alias("sample_rate"),
        (F.pmod("c_nationkey", F.lit(2)) + 1).cast("int").alias("n_channels"),
    )


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured chunks: the price gives the number of frames."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("session-"), F.col("o_custkey").cast("string")).alias("session_id"),
        F.col("o_orderpriority").alias("channel"),
        F.floor(F.col("o_totalprice") * 10).cast("bigint").alias("n_frames"),
    )

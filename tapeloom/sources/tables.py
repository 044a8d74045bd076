"""The session data model as views over the given tables.

Each ``*_from_*`` function maps rows one to one, so its size follows the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.store import SAVE, UPDATE_MIX
from tapeloom.schemas import SEGMENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as session writes: status P updates the mix path, others save."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    key = F.col("o_orderkey").cast("string")
    folder = F.concat(F.lit("rec/"), key)
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        (day * F.lit(10**12) + F.col("o_orderkey")).alias("seq"),
        F.when(status == "P", UPDATE_MIX).otherwise(SAVE).alias("op"),
        F.concat(F.lit("session-"), F.col("o_custkey").cast("string")).alias("id"),
        F.concat(F.lit("meeting "), "o_orderpriority").alias("name"),
        (day * 86400).cast("double").alias("created_at"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("duration"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 48000)
        .when(F.col("o_orderpriority") == "2-HIGH", 44100)
        .otherwise(16000)
        .alias("sample_rate"),
        (F.pmod("o_orderkey", F.lit(2)) + 1).cast("int").alias("channels"),
        F.create_map(
            F.lit("microphone"),
            F.concat(folder, F.lit("/raw/microphone.wav")),
            F.lit("system"),
            F.concat(folder, F.lit("/raw/system.wav")),
        ).alias("audio_paths"),
        F.when(status == "P", F.concat(folder, F.lit("/processed/mix.wav")))
        .when(status == "F", F.concat(folder, F.lit("/processed/old.wav")))
        .when(F.pmod("o_orderkey", F.lit(2)) == 0, F.lit(""))
        .alias("mix_path"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcript rows; odd turns carry no times."""
    seconds = F.length("text") / F.lit(16.0)
    timed = F.pmod("turn", F.lit(2)) == 0
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("transcript_id"),
        F.lit(0).cast("bigint").alias("part"),
        F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("role").alias("channel"),
        "text",
        F.array(
            F.struct(
                F.when(timed, F.lit(0.0)).alias("start"),
                F.when(timed, seconds).alias("end"),
                F.col("text"),
            )
        )
        .cast(SEGMENTS)
        .alias("segments"),
        F.lit(None).cast("string").alias("raw_response"),
    )


def document_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: their source is the session, a few hot ones."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("doc_id").alias("transcript_id"),
        F.lit(0).cast("bigint").alias("part"),
        F.col("source").alias("session_id"),
        F.col("lang").alias("channel"),
        "text",
        F.array().cast(SEGMENTS).alias("segments"),
        F.lit(None).cast("string").alias("raw_response"),
    )


def notes_log(spark: SparkSession, sf_dir: str, session: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        session.alias("session_id"),
        F.concat(F.lit("Notes for "), "lang").alias("title"),
        F.col("text").alias("summary"),
        F.array("lang", "source").alias("action_items"),
    )


def chunk_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as provider responses of four shapes, and some turns twice.

    Every third turn is followed by a chunk without speech: a blank text or no
    response at all.  Turn ``t`` is chunk ``2t``, the chunk behind it ``2t + 1``.
    """
    text, tj = F.col("text"), quoted(F.col("text"))
    half = F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))
    seconds = F.length(text) / F.lit(16.0)
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    two_segments = F.to_json(
        F.struct(
            text.alias("text"),
            F.array(
                F.struct(F.lit(0.0).alias("start"), (seconds / 2).alias("end"), half.alias("text")),
                F.struct(
                    F.lit(None).cast("double").alias("start"),
                    F.lit(None).cast("double").alias("end"),
                    F.concat(F.lit(" "), text, F.lit("\n")).alias("text"),
                ),
            ).alias("segments"),
        )
    )
    mixed_list = F.concat(
        F.lit('{"text":'), tj, F.lit(',"segments":['), tj, F.lit(',{"text":'), tj, F.lit(',"start":1}]}')
    )
    response = (
        F.when(shape == 0, two_segments)
        .when(shape == 1, F.concat(F.lit("  "), text))
        .when(shape == 2, mixed_list)
        .otherwise(F.concat(F.lit('{"text":'), tj, F.lit(',"segments":"none"}')))
    )
    blank = F.when(F.pmod("turn", F.lit(2)) == 0, F.lit('{"text":"  \\n "}'))
    spoken = F.struct((2 * F.col("turn")).alias("i"), seconds.alias("d"), response.alias("r"))
    silent = F.struct((2 * F.col("turn") + 1).alias("i"), F.lit(0.5).alias("d"), blank.alias("r"))
    third = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0
    rows = F.when(third, F.array(spoken, silent)).otherwise(F.array(spoken))
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("chunk", F.explode(rows))
        .select(
            F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session_id"),
            F.col("role").alias("channel"),
            F.col("chunk.i").alias("chunk_index"),
            F.lit(0.0).alias("start"),
            F.col("chunk.d").alias("duration"),
            F.col("chunk.r").alias("response"),
        )
    )


def event_lines(events: DataFrame, stops: bool = True) -> DataFrame:
    """Events as streamed transcription lines; ``stops=False`` mutes the stops."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind, ident = F.col("event_type"), F.col("event_id")
    word = F.when(F.pmod(k, F.lit(5)) == 0, F.lit("  ")).otherwise(F.concat(F.lit(" w"), k.cast("string")))
    delta = F.concat(F.lit('data: {"type":"transcript.text.delta","delta":"'), word, F.lit('"}'))
    done = F.concat(
        F.lit('data: {"type":"transcript.text.done","text":"done'), k.cast("string"), F.lit(' "}')
    )
    junk = (
        F.when(F.pmod(ident, F.lit(3)) == 0, F.lit(""))
        .when(F.pmod(ident, F.lit(3)) == 1, F.lit("data: {bad"))
        .otherwise(F.lit("data: "))
    )
    ending = F.when(F.pmod(k, F.lit(2)) == 0, F.lit('data: {"type":"response.completed"}')).otherwise(
        F.lit("data: [DONE]")
    )
    line = (
        F.when(kind == "click", delta)
        .when(kind == "purchase", done)
        .when(kind == "view", F.lit(": keep-alive"))
        .when(kind == "error", junk)
        .otherwise(ending if stops else F.lit("event: ping"))
    )
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"),
        F.lit("microphone").alias("channel"),
        ident.alias("seq"),
        line.alias("line"),
    )


def closing_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing response of every streamed channel: an object with or without a text, a bare text, or none."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    number = F.col("event_id").cast("string")
    kind = F.pmod("event_id", F.lit(4))
    spoken = F.concat(F.lit('{"text":" final '), number, F.lit(' ","segments":[{"start":0,"end":1.5,"text":" a "}]}'))
    response = (
        F.when(kind == 0, spoken)
        .when(kind == 1, F.concat(F.lit('{"id":'), number, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("plain "), number))
    )
    return last.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"),
        F.lit("microphone").alias("channel"),
        response.alias("response"),
    )


def transcript_events(spark: SparkSession, sf_dir: str, stops: bool = True) -> DataFrame:
    return event_lines(table(spark, sf_dir, "events"), stops)

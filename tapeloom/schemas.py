"""Canonical table schemas.  Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType(
    [
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
SEGMENTS = T.ArrayType(SEGMENT)
PATHS = T.MapType(T.StringType(), T.StringType())

SESSION_FIELDS = [
    T.StructField("name", T.StringType(), False),
    T.StructField("created_at", T.DoubleType(), False),
    T.StructField("duration", T.DoubleType(), False),
    T.StructField("sample_rate", T.IntegerType(), False),
    T.StructField("channels", T.IntegerType(), False),
    T.StructField("audio_paths", PATHS, False),
    T.StructField("mix_path", T.StringType()),
]

#: Append-only write log of the session table; ``op`` is ``save`` or ``update_mix_path``.
SESSION_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
    ]
    + [T.StructField(f.name, f.dataType) for f in SESSION_FIELDS]
)
SESSIONS = T.StructType([T.StructField("id", T.StringType(), False)] + SESSION_FIELDS)

TRANSCRIPTS = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        # A long transcript goes on in parts 1, 2, …: rows of one transcript_id, in order.
        T.StructField("transcript_id", T.LongType(), False),
        T.StructField("part", T.LongType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("segments", SEGMENTS),
        T.StructField("raw_response", T.StringType()),
    ]
)

#: The last row number of a session's transcripts, one row a session and batch.
TRANSCRIPT_NUMBERS = T.StructType(
    [T.StructField("session_id", T.StringType(), False), T.StructField("row_id", T.LongType(), False)]
)

#: Append-only write log of the notes table.
NOTES_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("summary", T.StringType(), False),
        T.StructField("action_items", T.ArrayType(T.StringType())),
    ]
)

PCM_PACKETS = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("payload", T.BinaryType()),
        T.StructField("sample_format", T.StringType(), False),
        T.StructField("sample_rate", T.IntegerType(), False),
        T.StructField("n_channels", T.IntegerType(), False),
        T.StructField("eof", T.BooleanType(), False),
    ]
)

CHANNELS = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("device", T.StringType()),
        T.StructField("sample_rate", T.IntegerType(), False),
        T.StructField("n_channels", T.IntegerType(), False),
    ]
)

AUDIO_CHUNKS = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("device", T.StringType()),
        T.StructField("chunk_idx", T.LongType(), False),
        T.StructField("frame_start", T.LongType(), False),
        T.StructField("n_frames", T.IntegerType(), False),
        T.StructField("sample_rate", T.IntegerType(), False),
        T.StructField("n_channels", T.IntegerType(), False),
        T.StructField("samples", T.ArrayType(T.FloatType())),
    ]
)

CHUNK_RESPONSES = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("chunk_index", T.LongType(), False),
        T.StructField("start", T.DoubleType(), False),
        T.StructField("duration", T.DoubleType(), False),
        T.StructField("response", T.StringType()),
    ]
)

TRANSCRIPT_EVENTS = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("line", T.StringType()),
    ]
)

DEVICE_LISTINGS = T.StructType(
    [
        T.StructField("host", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("line_no", T.LongType(), False),
        T.StructField("line", T.StringType()),
    ]
)

DEVICE_SPECS = T.StructType(
    [
        T.StructField("host", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("device", T.StringType()),
        T.StructField("platform", T.StringType(), False),
        T.StructField("default_sample_rate", T.IntegerType(), False),
        T.StructField("default_channels", T.IntegerType(), False),
    ]
)

DEVICE_INVENTORY = T.StructType(
    [
        T.StructField("host", T.StringType(), False),
        T.StructField("index", T.LongType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("input_format", T.StringType(), False),
        T.StructField("channels", T.LongType()),
        T.StructField("sample_rate", T.LongType()),
        T.StructField("details", T.StringType()),
        T.StructField("line_no", T.LongType(), False),
    ]
)

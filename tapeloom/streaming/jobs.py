"""Streaming operators: rechunking, partial transcripts, event folds, metrics."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tapeloom.functions import codec, pcm
from tapeloom.functions.text import strip
from tapeloom.operators.ordered import PAGE_ROWS
from tapeloom.operators.transcripts import KEY, parse_responses
from tapeloom.sources import folders
from tapeloom.streaming.ordered_state import LATE, process_in_order

LOG = logging.getLogger(__name__)

#: Is given a micro-batch and its number.
Callback = Callable[[DataFrame, int], None]

_KEY_FIELDS = [T.StructField("session_id", T.StringType()), T.StructField("channel", T.StringType())]


def _fields(ddl: str) -> list[T.StructField]:
    types = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType,
             "binary": T.BinaryType, "boolean": T.BooleanType, "floats": lambda: T.ArrayType(T.FloatType())}
    return [T.StructField(n, types[t]()) for n, t in (part.split() for part in ddl.split(","))]


def packet_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Rows of a growing table folder, in arrival order of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def rechunk_stream(packets: DataFrame, chunk_frames: int, idle_ms: int | None = None) -> DataFrame:
    """PCM packets to chunks of ``chunk_frames`` frames as they fill up.

    Bytes short of a chunk wait in the state.  An ``eof`` packet drains them once, as
    a shorter chunk of whole frames; later packets are ignored.  A channel that is
    silent for ``idle_ms`` is drained the same way: waiting bytes, then the packets
    behind a gap, so nothing that arrived is lost; ``error`` of those chunks names
    the gap.  A channel that resumes goes on with the next chunk number; packets of a gap
    that was passed over are late rows.
    """
    output = T.StructType(
        _KEY_FIELDS
        + _fields("chunk_idx long,n_frames int,sample_rate int,n_channels int,samples floats,error string")
    )
    widths = {name: size for name, (size, _, _) in pcm.CAPTURE_FORMATS.items()}

    def cut(data: bytes, layout: tuple, first: int, last: bool) -> tuple[bytes, int, pd.DataFrame]:
        """Whole chunks of ``data`` (and with ``last`` a shorter one): the rest, the next number, the rows."""
        sample_format, rate, channels = layout
        frame = widths[sample_format] * channels
        size = frame * chunk_frames
        end = len(data) // frame * frame if last else len(data) // size * size
        pieces = [data[at : min(at + size, end)] for at in range(0, end, size)]
        rows = pd.DataFrame(
            {
                "chunk_idx": range(first, first + len(pieces)),
                "n_frames": [len(p) // frame for p in pieces],
                "sample_rate": rate,
                "n_channels": channels,
                "samples": [pcm.decode_bytes(p, sample_format) for p in pieces],
            }
        )
        return b"" if last else data[end:], first + len(pieces), rows

    def layout_of(rows: pd.DataFrame) -> tuple:
        row = rows.iloc[0]
        return row["sample_format"], int(row["sample_rate"]), int(row["n_channels"])

    def upto_eof(rows: pd.DataFrame) -> tuple[bytes, bool]:
        """The joined payloads up to the first closing packet, and whether there is one."""
        closing = np.flatnonzero(rows["eof"].to_numpy(dtype=bool))
        kept = rows["payload"].iloc[: closing[0] + 1] if len(closing) else rows["payload"]
        return b"".join(p for p in kept if p is not None), bool(len(closing))

    def step(state, rows):
        waiting, next_chunk, ended, *_ = state
        if ended:
            return state, None
        layout = layout_of(rows)
        data, ended = upto_eof(rows)
        rest, next_chunk, out = cut((waiting or b"") + data, layout, next_chunk, ended)
        return (rest, next_chunk, ended, *layout), out

    def close(state):
        waiting, next_chunk, ended, *layout = state
        if ended or layout[0] is None:
            return state, None
        rest, next_chunk, out = cut(waiting or b"", tuple(layout), next_chunk, True)
        return (rest, next_chunk, ended, *layout), out

    state = _fields("waiting binary,next_chunk long,ended boolean,sample_format string,sample_rate int,n_channels int")
    chunks = process_in_order(
        packets, KEY, "seq", state, (b"", 0, False, None, None, None), output, step, "packets", close, idle_ms
    )
    return chunks.select(
        *KEY,
        "chunk_idx",
        (F.col("chunk_idx") * chunk_frames).alias("frame_start"),
        "n_frames",
        "sample_rate",
        "n_channels",
        "samples",
        "error",
        *([LATE] if idle_ms is not None else []),
    )


def partials_stream(responses: DataFrame, page_rows: int = PAGE_ROWS, idle_ms: int | None = None) -> DataFrame:
    """One update per chunk response, in chunk order, as prefixes of the merge.

    The state is a handful of counters; texts and raw responses pass through and are
    not kept.  Of a channel silent for ``idle_ms`` the responses behind a gap are
    folded in order, their ``error`` names the gap; a channel that resumes goes on, and
    responses of a gap that was passed over are late rows.
    """
    parsed = parse_responses(responses).select(
        *KEY,
        "chunk_index",
        "duration",
        strip(F.col("text")).alias("appended"),
        F.size("segments").alias("own"),
        codec.segments_to_json(F.col("segments")).alias("segments_json"),
        "raw_response",
    )
    output = T.StructType(
        _KEY_FIELDS
        + _fields("part long,chunk_index long,start double,appended string,segments_json string,"
                  "raw_response string,text_length long,n_segments long,n_entries long,error string")
    )

    def step(state, rows):
        start, chars, filled, segments, entries = state
        added = rows["appended"].str.len().to_numpy()
        chars_now = chars + added.cumsum()
        filled_now = filled + (added > 0).cumsum()
        segments_now = segments + rows["own"].to_numpy().cumsum()
        entries_now = entries + np.arange(1, len(rows) + 1)
        # Durations are added one by one, as a running sum over all of them would.
        starts = np.add.accumulate(np.concatenate(([start], rows["duration"].to_numpy())))
        out = pd.DataFrame(
            {
                "part": rows["chunk_index"] // page_rows,
                "chunk_index": rows["chunk_index"],
                "start": starts[:-1],
                "appended": rows["appended"],
                "segments_json": rows["segments_json"],
                "raw_response": rows["raw_response"],
                "text_length": chars_now + np.maximum(filled_now - 1, 0),
                "n_segments": segments_now,
                "n_entries": entries_now,
            }
        )
        last = (float(starts[-1]), int(chars_now[-1]), int(filled_now[-1]), int(segments_now[-1]), int(entries_now[-1]))
        return last, out

    state = _fields("start double,chars long,filled long,segments long,entries long")
    partials = process_in_order(
        parsed, KEY, "chunk_index", state, (0.0, 0, 0, 0, 0), output, step, "responses", lambda state: (state, None), idle_ms
    )
    return partials.withColumn("segments", codec.segments_from_json(F.col("segments_json"))).drop("segments_json")


def events_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Fold event lines into partial texts; ends at a key's first stop line.

    The stop gives one more row, ``is_final``: the lengths of the whole text.  A key
    silent for ``idle_ms`` is closed in the same way, after the events behind a gap,
    whose ``error`` (and the closing row's) names the gap.  A key that resumes without a
    stop goes on, and is closed again with its new lengths; events of a gap that was passed
    over are late rows.
    """
    decoded = events.withColumn("event", codec.decode_event(F.col("line"))).select(
        *KEY, "seq", "event.is_stop", "event.piece", (strip(F.col("event.piece")) != "").alias("filled")
    )
    output = T.StructType(
        _KEY_FIELDS
        + _fields("seq long,position long,piece string,raw_end long,n_segments long,emitted boolean,is_final boolean,"
                  "error string")
    )

    folded = ["seq", "position", "piece", "raw_end", "n_segments", "emitted", "is_final"]

    def closing(seq: int, position: int, raw_end: int, segments: int) -> pd.DataFrame:
        return pd.DataFrame([(seq, position, None, raw_end, segments, False, True)], columns=folded)

    def step(state, rows):
        raw_end, segments, position, stopped, _ = state
        last_seq = int(rows["seq"].iloc[-1])
        if stopped:
            return (*state[:4], last_seq), None
        # Few rows a key: plain lists and one frame are a fraction of the cost of frame operations.
        seqs, stops = rows["seq"].tolist(), np.flatnonzero(rows["is_stop"].to_numpy(dtype=bool))
        upto = int(stops[0]) if len(stops) else len(rows)
        pieces, filled = rows["piece"].tolist(), rows["filled"].tolist()
        out = []
        for i in range(upto):
            if isinstance(pieces[i], str):
                raw_end, segments = raw_end + len(pieces[i]), segments + bool(filled[i])
                out.append((seqs[i], position, pieces[i], raw_end, segments, segments > 0, False))
                position += 1
        if len(stops):
            out.append((seqs[upto], position, None, raw_end, segments, False, True))
        frame = pd.DataFrame(dict(zip(folded, zip(*out, strict=True), strict=True))) if out else None
        return (raw_end, segments, position, bool(len(stops)), last_seq), frame

    def close(state):
        raw_end, segments, position, stopped, last_seq = state
        return state, None if stopped else closing(last_seq, position, raw_end, segments)

    state = _fields("raw_end long,segments long,position long,stopped boolean,last_seq long")
    return process_in_order(decoded, KEY, "seq", state, (0, 0, 0, False, -1), output, step, "events", close, idle_ms)


def live_frames(chunks: DataFrame) -> DataFrame:
    """Frames captured so far per channel; Spark adds up partials per task first."""
    return chunks.groupBy(*KEY).agg(F.sum(F.col("n_frames").cast("bigint")).alias("frames"))


def start(frame: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream's rows to ``path``; late rows go into a partition of their own."""
    if LATE in frame.columns:
        writer = frame.withColumn("is_late", F.col(LATE).isNotNull()).writeStream.partitionBy("is_late")
    else:
        writer = frame.writeStream
    writer = writer.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger).start()


def drain(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Work off everything that has arrived, append it to ``path`` and stop.

    Pausing is not running this; nothing is lost, because the next run on the
    same checkpoint goes on where the last one ended.
    """
    start(frame, path, checkpoint, availableNow=True).awaitTermination()


def on_time(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a stream with a timeout has given, without its late rows."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("is_late", T.BooleanType())])).parquet(path)
    return rows.where("NOT is_late").drop("is_late", LATE)


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Keys and numbers of rows that came for a gap after it had been passed over."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("is_late", T.BooleanType())])).parquet(path)
    return rows.where("is_late").select(*KEY, LATE)


def dead_letters(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that a delivery kept because its callback failed."""
    return sorted(int(n.removeprefix("batch=")) for n in folders.names(spark, path) if n.startswith("batch="))


def delivered_later(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that a replay has delivered."""
    return sorted(int(n) for n in folders.names(spark, f"{path}/done") if n.isdecimal())


def table_sink(path: str) -> Callback:
    """A callback that a batch may reach any number of times: each has a folder of its own and replaces it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def deliver(
    frame: DataFrame,
    callback: Callback,
    dead_letters: str,
    checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    """Hand each micro-batch to ``callback``; its errors never stop the stream.

    A batch whose callback fails is kept under ``dead_letters``, by batch number,
    so a repeated batch replaces itself.  ``replay`` delivers it later.
    """

    def guarded(batch: DataFrame, epoch: int) -> None:
        try:
            callback(batch, epoch)
        except Exception:  # callbacks must not break the stream
            LOG.exception("callback failed on batch %s", epoch)
            batch.write.mode("overwrite").parquet(f"{dead_letters}/batch={epoch}")

    return (
        frame.writeStream.foreachBatch(guarded)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def replay(spark: SparkSession, path: str, callback: Callback, schema: T.StructType | None = None) -> list[int]:
    """Deliver kept batches once more, in batch order; gives the numbers that went through.

    A batch that goes through is marked done and its letter is removed.  The first one that fails again stops
    the replay, so that no batch overtakes it; the next replay goes on there.  Between a
    callback and its mark a replay may be interrupted: the batch then comes again, under
    the same number, which a callback such as ``table_sink`` takes without a double row.
    """
    gone = []
    for epoch in dead_letters(spark, path):
        letter = f"{path}/batch={epoch}"
        reader = spark.read if schema is None else spark.read.schema(schema)
        try:
            callback(reader.parquet(letter), epoch)
        except Exception:  # kept for the next replay, like everything behind it
            LOG.exception("callback failed again on batch %s", epoch)
            break
        folders.write_text(spark, f"{path}/done/{epoch}", "")
        folders.remove(spark, letter)
        gone.append(epoch)
    return gone

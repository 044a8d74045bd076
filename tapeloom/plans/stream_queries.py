"""Streaming operators run over the given tables until everything is worked off."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators.ordered import ordinal
from tapeloom.plans import audio_queries, sql
from tapeloom.session import new_shared_path
from tapeloom.sources import audio_tables, folders, tables
from tapeloom.streaming import jobs

KEY = ["session_id", "channel"]


def _landed(frame, schema, label, *arrival):
    """Write a derived table as the folder a stream reads from, its files cut by order of ``arrival``.

    Recorders send as they record.  Files dealt by hash would bring a part of every key with every
    micro-batch, all of it behind holes.  The stream itself takes any order.
    """
    path = new_shared_path(frame.sparkSession, label)
    if arrival:
        frame = frame.repartitionByRange(*arrival).sortWithinPartitions(*arrival)
    frame.select(*[f.name for f in schema.fields]).write.parquet(path)
    return path


def _per_batch(spark, path, least=8):
    """Files of one micro-batch: a folder is worked off in about four, however many files it has."""
    return max(least, -(-len([n for n in folders.names(spark, path) if n.endswith(".parquet")]) // 4))


def _drained(spark, stream, label):
    path = new_shared_path(spark, label)
    jobs.drain(stream, path, new_shared_path(spark, f"{label}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


def _packets(spark, sf_dir):
    """Vector packets numbered 0, 1, 2, … per channel, with a closing packet."""
    packets = audio_tables.vector_packets(spark, sf_dir).withColumnRenamed("seq", "vec_id")
    numbered = ordinal(packets, KEY, "vec_id", "seq")
    last = packets.groupBy(*KEY, "sample_format", "sample_rate", "n_channels").agg(
        F.count("*").alias("seq")
    )
    closing = last.withColumn("payload", F.lit(b"")).withColumn("eof", F.lit(True))
    names = [f.name for f in schemas.PCM_PACKETS.fields]
    return numbered.select(*names).unionByName(closing.select(*names))


def stream_rechunk(spark, sf_dir):
    path = _landed(_packets(spark, sf_dir), schemas.PCM_PACKETS, "packets")
    stream = jobs.packet_stream(spark, path, schemas.PCM_PACKETS, _per_batch(spark, path))
    return audio_queries.chunk_digest(_drained(spark, jobs.rechunk_stream(stream, 50), "chunks"))


def stream_partials(spark, sf_dir):
    chunks = tables.chunk_responses(spark, sf_dir).withColumnRenamed("chunk_index", "given")
    numbered = ordinal(chunks, KEY, "given", "chunk_index")
    path = _landed(numbered, schemas.CHUNK_RESPONSES, "responses", *KEY, "given")
    stream = jobs.packet_stream(spark, path, schemas.CHUNK_RESPONSES, _per_batch(spark, path))
    partials = _drained(spark, jobs.partials_stream(stream), "partials")
    return partials.select(
        *KEY,
        "part",
        "chunk_index",
        F.round("start", 6).alias("start"),
        "appended",
        "text_length",
        "n_segments",
        "n_entries",
    )


def _folded(spark, sf_dir):
    lines = tables.transcript_events(spark, sf_dir).withColumnRenamed("seq", "event_id")
    numbered = ordinal(lines, KEY, "event_id", "seq")
    path = _landed(numbered, schemas.TRANSCRIPT_EVENTS, "events", "event_id")
    stream = jobs.packet_stream(spark, path, schemas.TRANSCRIPT_EVENTS, _per_batch(spark, path))
    return _drained(spark, jobs.events_stream(stream), "fold")


def stream_delta_fold(spark, sf_dir):
    folded = _folded(spark, sf_dir).filter("emitted")
    return folded.select("session_id", "seq", "piece", "raw_end", "n_segments")


def stream_delta_final(spark, sf_dir):
    """The closing record of every stopped channel of the stream."""
    return _folded(spark, sf_dir).filter("is_final").select("session_id", "seq", "raw_end", "n_segments")


def stream_live_frames(spark, sf_dir):
    chunks = audio_tables.vector_chunks(spark, sf_dir).select(
        *KEY, "chunk_idx", "n_frames", "sample_rate"
    )
    path = new_shared_path(spark, "live")
    chunks.write.parquet(path)
    stream = jobs.packet_stream(spark, path, chunks.schema, _per_batch(spark, path))
    out, dead = new_shared_path(spark, "frames"), new_shared_path(spark, "dead")

    def replace(batch, _epoch):
        batch.write.mode("overwrite").parquet(out)

    query = jobs.deliver(
        jobs.live_frames(stream),
        replace,
        dead,
        new_shared_path(spark, "live-checkpoint"),
        mode="complete",
    )
    query.awaitTermination()
    if jobs.dead_letters(spark, dead):
        raise RuntimeError(f"batches could not be delivered, they are kept in {dead}")
    return spark.read.schema("session_id string, channel string, frames bigint").parquet(out)


def stream_replayed(spark, sf_dir):
    """Chunk rows handed to a listener that is away for every second batch, then replayed to it."""
    chunks = audio_tables.vector_chunks(spark, sf_dir).select(*KEY, "chunk_idx", "n_frames", "sample_rate")
    path = new_shared_path(spark, "live")
    chunks.repartition(6, *KEY).write.parquet(path)
    out, dead = new_shared_path(spark, "updates"), new_shared_path(spark, "dead")
    listener, away = jobs.table_sink(out), {"now": True}

    def sometimes(batch, epoch):
        if away["now"] and epoch % 2:
            raise ConnectionError("nobody listens")
        listener(batch, epoch)

    stream = jobs.packet_stream(spark, path, chunks.schema, _per_batch(spark, path, least=1))
    jobs.deliver(stream, sometimes, dead, new_shared_path(spark, "replay-checkpoint")).awaitTermination()
    away["now"] = False
    jobs.replay(spark, dead, sometimes, chunks.schema)
    return jobs.live_frames(spark.read.schema(chunks.schema).parquet(out))


QUERIES = {
    "stream_replayed": stream_replayed,
    "stream_rechunk": stream_rechunk,
    "stream_partials": stream_partials,
    "stream_delta_fold": stream_delta_fold,
    "stream_delta_final": stream_delta_final,
    "stream_live_frames": stream_live_frames,
}

# Streams number their rows 0, 1, 2, … inside a key.
_DENSE_RESPONSES = """
numbered AS (SELECT * EXCLUDE (chunk_index),
    row_number() OVER (PARTITION BY session_id, channel ORDER BY chunk_index) - 1 AS chunk_index FROM parsed)"""
_DENSE_EVENTS = """
numbered AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq,
    length(piece) AS chars, trim(piece, """ + sql.WS + """) <> '' AS filled FROM decoded),
stops AS (SELECT session_id, min(seq) FILTER (is_stop) AS stop FROM numbered GROUP BY session_id),
live AS (SELECT n.* FROM numbered n JOIN stops s ON s.session_id = n.session_id
    WHERE n.piece IS NOT NULL AND (s.stop IS NULL OR n.seq < s.stop))"""

ORACLES = {
    "stream_rechunk": audio_queries.ORACLES["rechunk"],
    "stream_partials": sql.with_(
        sql.RESPONSES,
        _DENSE_RESPONSES,
        body=f"""SELECT session_id, channel, CAST(0 AS BIGINT) AS part, chunk_index, round(start, 6) AS start, appended,
          CAST(sum(length(appended)) OVER w + greatest(count(*) FILTER (appended <> '') OVER w - 1, 0) AS BIGINT) AS text_length,
          CAST(sum(n_own) OVER w AS BIGINT) AS n_segments, count(*) OVER w AS n_entries
        FROM (SELECT *, trim(text, {sql.WS}) AS appended, CASE WHEN shape IN (0, 2) THEN 2 ELSE 0 END AS n_own FROM numbered)
        WINDOW w AS (PARTITION BY session_id, channel ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)""",
    ),
    "stream_delta_fold": sql.with_(
        sql.events(),
        _DENSE_EVENTS,
        body="""SELECT * FROM (SELECT session_id, seq, piece, CAST(sum(chars) OVER w AS BIGINT) AS raw_end,
          count(*) FILTER (filled) OVER w AS n_segments FROM live
          WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE n_segments > 0""",
    ),
    "stream_delta_final": sql.with_(
        sql.events(),
        _DENSE_EVENTS,
        body="""SELECT s.session_id, s.stop AS seq, CAST(coalesce(sum(l.chars), 0) AS BIGINT) AS raw_end,
          count(*) FILTER (l.filled) AS n_segments
        FROM stops s LEFT JOIN live l ON l.session_id = s.session_id WHERE s.stop IS NOT NULL
        GROUP BY s.session_id, s.stop""",
    ),
    "stream_live_frames": """
        SELECT 'session-' || (label // 2) AS session_id, 'ch' || label AS channel,
          CAST(sum(len(embedding)) AS BIGINT) AS frames
        FROM embeddings GROUP BY label""",
}
ORACLES["stream_replayed"] = ORACLES["stream_live_frames"]

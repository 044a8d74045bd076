"""Captured audio: metrics, routing, sample arrays, splitting and mixing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom import providers
from tapeloom.functions import pcm
from tapeloom.functions.text import PLACEHOLDER_TEXT, path_stem
from tapeloom.operators import audio, store
from tapeloom.plans import fleet, sql
from tapeloom.session import new_shared_path
from tapeloom.sources import audio_tables as sources
from tapeloom.sources import tables, wav

# Small budget so that the captured orders need several upload chunks.
UPLOAD_BYTES = 4_000_000
CELL_FRAMES = 1024
HEARD_FRAMES = 150
HEARD_BYTES = 44 + 2 * HEARD_FRAMES
WAV_FRAMES = 1024


def _path():
    return F.concat(F.lit("rec/"), "session_id", F.lit("/raw/"), "channel", F.lit(".wav"))


def _metrics(spark, sf_dir):
    metrics = audio.channel_metrics(
        sources.order_channels(spark, sf_dir), sources.order_chunks(spark, sf_dir)
    )
    return metrics.withColumn("path", _path())


def _vector_metrics(spark, sf_dir):
    # Counts come straight from the table: the samples need not be placed first.
    blocks = sources.vectors(spark, sf_dir).select("session_id", "channel", F.size("samples").alias("n_frames"))
    return audio.channel_metrics(sources.vector_channels(spark, sf_dir), blocks)


def _ints(samples):
    return F.array_join(samples, ",")


def channel_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "session_id", "channel", "device", "sample_rate", "frames", "duration", "is_silent"
    )


def session_rollup(spark, sf_dir):
    rolled = audio.session_rollup(_metrics(spark, sf_dir), F.col("path"))
    return rolled.select(
        "session_id",
        "duration",
        "sample_rate",
        "channels",
        F.size("audio_paths").cast("bigint").alias("n_paths"),
        F.col("audio_paths")["5-LOW"].alias("low_path"),
    )


def target_selection(spark, sf_dir):
    sessions = store.compact_sessions(tables.session_log(spark, sf_dir))
    return audio.transcription_targets(sessions, _metrics(spark, sf_dir))


def mix_source_filter(spark, sf_dir):
    return audio.mix_sources(_metrics(spark, sf_dir)).select("session_id", "channel", "path")


def size_routing(spark, sf_dir):
    routed = audio.route_by_size(_metrics(spark, sf_dir), UPLOAD_BYTES)
    return routed.select("session_id", "channel", "n_bytes", "route")


def split_manifest(spark, sf_dir):
    manifest = audio.split_manifest(_metrics(spark, sf_dir), UPLOAD_BYTES)
    return manifest.select(
        "session_id",
        "channel",
        "chunk_index",
        "chunk_name",
        "frame_start",
        "n_frames",
        "start",
        "duration",
    )


def quantise(spark, sf_dir):
    return sources.vectors(spark, sf_dir).select("vec_id", _ints(pcm.quantise(F.col("samples"))).alias("pcm"))


def dequantise(spark, sf_dir):
    stored = sources.vectors(spark, sf_dir).select("vec_id", pcm.quantise(F.col("samples")).alias("stored"))

    def micro(samples):
        return _ints(F.transform(samples, lambda x: F.round(x.cast("double") * 1000000).cast("bigint")))

    return stored.select(
        "vec_id",
        micro(pcm.dequantise_file(F.col("stored"))).alias("from_file"),
        micro(pcm.dequantise_capture(F.col("stored"), "s16le")).alias("from_capture"),
    )


def downmix(spark, sf_dir):
    mono = pcm.downmix(F.col("samples"), F.lit(2))
    return sources.vectors(spark, sf_dir).select("vec_id", _ints(pcm.quantise(mono)).alias("pcm"))


def widen_channels(spark, sf_dir):
    have, wanted = F.lit(1), F.pmod("label", F.lit(3)).cast("int") + 1
    stored = pcm.quantise(pcm.widen(F.col("samples"), have, wanted))
    return sources.vectors(spark, sf_dir).select(
        "vec_id", _ints(stored).alias("pcm"), pcm.widen_error(have, wanted).alias("error")
    )


def rechunk(spark, sf_dir):
    chunks = audio.rechunk(sources.vector_packets(spark, sf_dir), F.lit(50))
    return chunk_digest(chunks)


def chunk_digest(chunks):
    """Chunk rows with their samples as exact 16-bit integers."""
    values = F.transform("samples", lambda x: (x.cast("double") * 32768).cast("int"))
    return chunks.select(
        "session_id",
        "channel",
        "chunk_idx",
        "frame_start",
        F.col("n_frames").cast("bigint").alias("n_frames"),
        _ints(values).alias("pcm"),
    )


def _rendered(frame, keys):
    return frame.select(
        *keys,
        "chunk_idx",
        "frame_start",
        F.col("n_frames").cast("bigint").alias("n_frames"),
        F.col("sample_rate").cast("bigint").alias("sample_rate"),
        _ints(pcm.quantise(F.col("samples"))).alias("pcm"),
    )


def resample(spark, sf_dir):
    chunks, metrics = sources.vector_chunks(spark, sf_dir), _vector_metrics(spark, sf_dir)
    return _rendered(audio.resample(chunks, metrics, 22050, CELL_FRAMES), ["session_id", "channel"])


def mix_down(spark, sf_dir):
    chunks, metrics = sources.vector_chunks(spark, sf_dir), _vector_metrics(spark, sf_dir)
    return _rendered(audio.mix_down(chunks, metrics, CELL_FRAMES), ["session_id"])


def wav_roundtrip(spark, sf_dir):
    """Recordings written as WAV files of limited length and read back."""
    folder = new_shared_path(spark, "wav")
    chunks = sources.vector_chunks(spark, sf_dir)
    # The write is the query's work; its report is only checked for failures.
    wav.write_wav(chunks, folder, WAV_FRAMES).write.format("noop").mode("overwrite").save()
    back = wav.wav_chunks(wav.wav_headers(spark, folder), 64, chunks_per_span=4)
    return back.select(
        "session_id",
        "channel",
        "chunk_idx",
        "frame_start",
        F.col("n_frames").cast("bigint").alias("n_frames"),
        _ints(F.transform("samples", lambda x: F.round(x.cast("double") * 32767).cast("int"))).alias("pcm"),
    )


def _echo(batch):
    """A stand-in backend: tells what it was given."""
    number = batch["chunk_index"].astype(str)
    spoken = batch["channel"] + " " + number + " " + batch["n_frames"].astype(str)
    return (
        '{"text": "' + spoken + '  ", "segments": [{"start": 0.0, "end": 1.0, "text": " ' + number + '"}]}'
    )


def provider_transcripts(spark, sf_dir):
    """All captured channels through a backend, chunk by chunk, and merged."""
    metrics = _metrics(spark, sf_dir)
    manifest = audio.split_manifest(metrics, UPLOAD_BYTES)
    return _merged(providers.transcribe(manifest, providers.Transcriber(_echo), metrics))


def _unreachable(batch):
    raise ConnectionError("no backend")


def ledger_transcripts(spark, sf_dir):
    """The same through a ledger of answers: a second run finds all of them there and calls nobody."""
    metrics, ledger = _metrics(spark, sf_dir), new_shared_path(spark, "ledger")
    manifest = audio.split_manifest(metrics, UPLOAD_BYTES)
    providers.transcribe(manifest, providers.Transcriber(_echo), metrics, ledger=ledger)
    return _merged(providers.transcribe(manifest, providers.Transcriber(_unreachable), metrics, ledger=ledger))


def _merged(merged):
    return merged.select(
        "session_id",
        "channel",
        "part",
        "text",
        F.size("segments").cast("bigint").alias("n_segments"),
        F.try_element_at("segments", F.lit(-1))["end"].alias("last_end"),
        F.get_json_object("raw_response", "$.text").alias("raw_text"),
    )


def _checksum(batch):
    """A stand-in backend that hears: tells the sum of its 16-bit samples."""
    sums = [int((s.clip(-1, 1) * np.float32(32767)).astype("int16").astype("int64").sum()) for s in batch["samples"]]
    return pd.Series([f'{{"text":"{len(s)} {total}"}}' for s, total in zip(batch["samples"], sums, strict=True)])


def provider_hears_audio(spark, sf_dir):
    """Upload chunks with their samples through a backend that adds them up."""
    chunks, metrics = sources.vector_chunks(spark, sf_dir), _vector_metrics(spark, sf_dir)
    manifest = audio.split_manifest(metrics.withColumn("path", _path()), HEARD_BYTES)
    heard = providers.answers(manifest, providers.Transcriber(_checksum, hears=True), chunks)
    return heard.select("session_id", "channel", "chunk_index", "frame_start", "text")


def mix_fallback_targets(spark, sf_dir):
    """One session lost a chunk: it falls back to its channels, all others are mixed as ever."""
    lost = (F.col("channel") == "ch0") & (F.col("chunk_idx") == 1)
    chunks = sources.vector_chunks(spark, sf_dir).filter(~lost)
    channels = sources.vector_channels(spark, sf_dir)
    metrics = audio.channel_metrics(channels, chunks).withColumn("path", _path())
    found = audio.mix_sources(metrics)
    errors = audio.mix_errors(chunks, found)
    mix = audio.mix_down(chunks, audio.mixable(found, errors), CELL_FRAMES)
    mixed = mix.groupBy("session_id").agg(F.sum(F.col("n_frames").cast("bigint")).alias("mix_frames"))
    path = F.when(F.col("mix_frames").isNotNull(), F.concat(F.lit("rec/"), "session_id", F.lit("/processed/mix.wav")))
    sessions = channels.select("session_id").distinct().join(mixed, "session_id", "left")
    sessions = sessions.select(F.col("session_id").alias("id"), path.alias("mix_path"))
    targets = audio.transcription_targets(sessions, metrics)
    return targets.join(mixed, "session_id", "left").join(errors, ["session_id", "channel"], "left")


def _count_lines(name, parts):
    lines = sum(part.count("\n") + 1 for part in parts)
    return providers.Note(f"{name}: {lines} lines", f"About {name}" if lines > 2 else None, [f"read {lines} lines", name])


def provider_notes(spark, sf_dir):
    sessions = store.compact_sessions(tables.session_log(spark, sf_dir))
    # Very short parts: the notes must not depend on the cut.
    found = providers.write_notes(sessions, tables.transcripts(spark, sf_dir), _count_lines, page_rows=2)
    return found.select("session_id", "title", "summary", F.array_join("action_items", "|").alias("items"))


def session_batch(spark, sf_dir):
    """The whole job on the vector recordings in two batches, read back from the store.

    The second batch records session-0 again and does not mix; its batch runs twice.
    """
    root = new_shared_path(spark, "fleet")
    channels, chunks = sources.vector_channels(spark, sf_dir), sources.vector_chunks(spark, sf_dir)
    requests = channels.groupBy(F.col("session_id").alias("id")).agg(
        F.concat(F.lit("Weekly "), F.min("channel")).alias("name"), F.lit(0.0).alias("created_at")
    )
    fleet.process_batch(spark, root, 1, requests, channels, chunks, cell_frames=CELL_FRAMES)
    again = requests.filter("id = 'session-0'")
    one, heard = channels.filter("session_id = 'session-0'"), chunks.filter("session_id = 'session-0'")
    for _ in range(2):
        fleet.process_batch(spark, root, 2, again, one, heard, mix_down=False)
    outcome = fleet.outcomes(spark, root).join(
        store.read_log(spark, root, "transcripts").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_rows")), "id"
    )
    return outcome.select(
        "n_rows",
        "id",
        "name",
        "duration",
        F.col("sample_rate").cast("bigint").alias("sample_rate"),
        path_stem(F.col("mix_path")).alias("mix"),
        F.size("audio_paths").cast("bigint").alias("n_paths"),
        "channel",
        "text",
        "title",
        "summary",
    )


def placeholder_previews(spark, sf_dir):
    """The update each target gets before its placeholder transcript."""
    sessions = store.compact_sessions(tables.session_log(spark, sf_dir))
    targets = audio.transcription_targets(sessions, _metrics(spark, sf_dir))
    previews = providers.placeholder_previews(providers.placeholder_transcripts(sessions, targets))
    return previews.select("session_id", "channel", "path", "text")


QUERIES = {
    "placeholder_previews": placeholder_previews,
    "wav_roundtrip": wav_roundtrip,
    "provider_transcripts": provider_transcripts,
    "ledger_transcripts": ledger_transcripts,
    "provider_notes": provider_notes,
    "session_batch": session_batch,
    "provider_hears_audio": provider_hears_audio,
    "mix_fallback_targets": mix_fallback_targets,
    "channel_metrics": channel_metrics,
    "session_rollup": session_rollup,
    "mix_source_filter": mix_source_filter,
    "target_selection": target_selection,
    "size_routing": size_routing,
    "split_manifest": split_manifest,
    "quantise": quantise,
    "dequantise": dequantise,
    "downmix": downmix,
    "widen_channels": widen_channels,
    "rechunk": rechunk,
    "resample": resample,
    "mix_down": mix_down,
}

_METRICS = """
metrics AS (
  SELECT c.session_id, c.channel, c.device, c.sample_rate, c.n_channels,
         coalesce(k.frames, 0) AS frames,
         CASE WHEN c.sample_rate = 0 THEN CAST(0 AS DOUBLE)
              ELSE coalesce(k.frames, 0) / CAST(c.sample_rate AS DOUBLE) END AS duration,
         'rec/' || c.session_id || '/raw/' || c.channel || '.wav' AS path
  FROM (SELECT 'session-' || c_custkey AS session_id, p.channel, c_mktsegment AS device,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 WHEN 'MACHINERY' THEN 44100 ELSE 16000 END AS sample_rate,
               c_nationkey % 2 + 1 AS n_channels
        FROM customer, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) p(channel)) c
  LEFT JOIN (SELECT 'session-' || o_custkey AS session_id, o_orderpriority AS channel,
                    CAST(sum(CAST(floor(o_totalprice * 10) AS BIGINT)) AS BIGINT) AS frames
             FROM orders GROUP BY ALL) k ON k.session_id = c.session_id AND k.channel = c.channel),
measured AS (SELECT *, (frames <= 0 OR duration <= 0) AS is_silent FROM metrics)"""

_SAMPLES = """
numbered AS (
  SELECT 'session-' || (label // 2) AS session_id, 'ch' || label AS channel, label, vec_id, embedding,
         CASE WHEN label % 2 = 0 THEN 16000 ELSE 22050 END AS rate,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_idx
  FROM embeddings),
samples AS (
  SELECT session_id, channel, vec_id, rate, chunk_idx, n,
         chunk_idx * 64 + n AS frame, CAST(embedding[n + 1] * CAST(4 AS FLOAT) AS FLOAT) AS x
  FROM numbered, (SELECT unnest(range(64)) AS n))"""


def quoted(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _quantised(x: str) -> str:
    one = "CAST(1 AS FLOAT)"
    return (
        f"CAST(trunc(CAST(greatest(-{one}, least({one}, CAST({x} AS FLOAT))) * CAST(32767 AS FLOAT) AS FLOAT)) AS INTEGER)"
    )


# Resampling frame by frame: output frame j reads the input at position p.
_RESAMPLED = (
    _SAMPLES
    + """,
lengths AS (
  SELECT session_id, channel, rate, count(*) AS len FROM samples GROUP BY ALL),
targets AS (
  SELECT *, CASE WHEN rate = 22050 THEN len
                 ELSE greatest(CAST(round_even(CAST(len AS DOUBLE) * 22050 / CAST(rate AS DOUBLE), 0) AS BIGINT), 1) END AS t
  FROM lengths),
positions AS (
  SELECT session_id, channel, rate, len, t, j,
         CASE WHEN t = 1 THEN CAST(0 AS DOUBLE) WHEN j = t - 1 THEN CAST(len - 1 AS DOUBLE)
              ELSE j * (CAST(len - 1 AS DOUBLE) / CAST(t - 1 AS DOUBLE)) END AS p
  FROM (SELECT *, unnest(range(t)) AS j FROM targets)),
resampled AS (
  SELECT p.session_id, p.channel, p.t, p.j,
         CAST((CAST(b.x AS DOUBLE) - CAST(a.x AS DOUBLE)) * (p.p - floor(p.p)) + CAST(a.x AS DOUBLE) AS FLOAT) AS x
  FROM positions p
  JOIN samples a ON a.channel = p.channel AND a.frame = CAST(floor(p.p) AS BIGINT)
  JOIN samples b ON b.channel = p.channel AND b.frame = least(CAST(floor(p.p) AS BIGINT) + 1, p.len - 1))"""
)

_ECHO = """CASE WHEN frames = 0 THEN '' WHEN frames <= mf THEN channel || ' 0 ' || frames || '  '
  ELSE array_to_string(list_transform(range((frames + mf - 1) // mf),
    lambda i: channel || ' ' || i || ' ' || least(mf, frames - i * mf)), chr(10)) END"""

ORACLES = {
    "wav_roundtrip": sql.with_(
        _SAMPLES,
        body=f"""SELECT session_id, channel, frame // 64 AS chunk_idx, min(frame) AS frame_start, count(*) AS n_frames,
          string_agg({_quantised('x')}, ',' ORDER BY frame) AS pcm
        FROM samples GROUP BY session_id, channel, frame // 64""",
    ),
    "provider_hears_audio": sql.with_(
        _SAMPLES,
        body=f"""SELECT session_id, channel, frame // {HEARD_FRAMES} AS chunk_index, min(frame) AS frame_start,
          count(*) || ' ' || sum({_quantised('x')}) AS text
        FROM samples GROUP BY session_id, channel, frame // {HEARD_FRAMES}""",
    ),
    "mix_fallback_targets": sql.with_(
        _RESAMPLED,
        body="""SELECT session_id, 'mix' AS channel, 'rec/' || session_id || '/processed/mix.wav' AS path,
          min(t) AS mix_frames, NULL AS error FROM targets WHERE session_id <> 'session-0' GROUP BY session_id
        UNION ALL
        SELECT session_id, channel, 'rec/session-0/raw/' || channel || '.wav', NULL,
          CASE channel WHEN 'ch0' THEN 'frames missing before 128' END FROM targets WHERE session_id = 'session-0'""",
    ),
    "provider_transcripts": sql.with_(
        _METRICS,
        body=f"""SELECT session_id, channel, CAST(0 AS BIGINT) AS part, {_ECHO} AS text,
          CAST((frames + mf - 1) // mf AS BIGINT) AS n_segments,
          CASE WHEN frames > 0 THEN 1 + CASE WHEN sample_rate = 0 THEN CAST(0 AS DOUBLE)
            ELSE ((frames + mf - 1) // mf - 1) * mf / CAST(sample_rate AS DOUBLE) END END AS last_end,
          nullif({_ECHO}, '') AS raw_text
        FROM (SELECT *, CAST(({UPLOAD_BYTES} - 44) // (n_channels * 2) AS BIGINT) AS mf FROM measured)""",
    ),
    "placeholder_previews": sql.with_(
        sql.SESSIONS,
        _METRICS,
        body=f"""SELECT id AS session_id, {quoted(providers.PLACEHOLDER_CHANNEL)} AS channel, path,
          printf({quoted(PLACEHOLDER_TEXT.split('. ')[0])}, name, regexp_extract(path, '[^/]+$')) AS text
        FROM (SELECT id, name, mix_path AS path FROM sessions WHERE mix_path IS NOT NULL
              UNION ALL
              SELECT s.id, s.name, m.path FROM measured m JOIN sessions s ON s.id = m.session_id
              WHERE s.mix_path IS NULL AND NOT m.is_silent)""",
    ),
    "provider_notes": sql.with_(
        sql.SESSIONS,
        sql.TRANSCRIPTS,
        body="""SELECT session_id, CASE WHEN n > 2 THEN 'About ' ELSE 'Notes for ' END || name AS title,
          name || ': ' || n || ' lines' AS summary, 'read ' || n || ' lines|' || name AS items
        FROM (SELECT session_id, length(p) - length(replace(p, chr(10), '')) + 1 AS n FROM (
              SELECT session_id, string_agg('[' || channel || '] ' || text, chr(10) ORDER BY row_id) AS p
              FROM transcripts WHERE text <> '' GROUP BY session_id)) JOIN sessions ON id = session_id""",
    ),
    "session_batch": sql.with_(
        _SAMPLES,
        # Session-0 is not mixed the second time: one transcript per channel, and the last one counts.
        body=f"""SELECT session_id AS id, name, duration, sample_rate,
          CASE WHEN session_id <> 'session-0' THEN 'mix' END AS mix, n_paths, 'mixed' AS channel,
          text, 'Notes for ' || name AS title, text AS summary,
          CASE WHEN session_id = 'session-0' THEN 1 + n_paths ELSE 1 END AS n_rows
        FROM (SELECT *, printf({quoted(PLACEHOLDER_TEXT)}, name,
                CASE WHEN session_id = 'session-0' THEN last || '.wav' ELSE 'mix.wav' END) AS text
              FROM (SELECT session_id, 'Weekly ' || min(channel) AS name, max(channel) AS last,
                           max(frames / CAST(rate AS DOUBLE)) AS duration,
                           CAST(max(rate) AS BIGINT) AS sample_rate, count(*) AS n_paths
                    FROM (SELECT session_id, channel, rate, count(*) AS frames FROM samples GROUP BY ALL) GROUP BY session_id))""",
    ),
    "channel_metrics": sql.with_(
        _METRICS,
        body="SELECT session_id, channel, device, sample_rate, frames, duration, is_silent FROM measured",
    ),
    "session_rollup": sql.with_(
        _METRICS,
        body="""SELECT session_id, max(duration) AS duration, max(sample_rate) AS sample_rate,
          max(n_channels) AS channels, count(*) AS n_paths,
          max(path) FILTER (channel = '5-LOW') AS low_path FROM measured GROUP BY session_id""",
    ),
    "mix_source_filter": sql.with_(
        _METRICS, body="SELECT session_id, channel, path FROM measured WHERE NOT is_silent"
    ),
    "target_selection": sql.with_(
        sql.SESSIONS,
        _METRICS,
        body="""SELECT id AS session_id, mix_path AS path,
          regexp_extract(mix_path, '([^/]+)\\.wav$', 1) AS channel FROM sessions WHERE mix_path IS NOT NULL
        UNION ALL
        SELECT m.session_id, m.path, m.channel FROM measured m JOIN sessions s ON s.id = m.session_id
        WHERE s.mix_path IS NULL AND NOT m.is_silent""",
    ),
    "size_routing": sql.with_(
        _METRICS,
        body=f"""SELECT session_id, channel, 44 + frames * n_channels * 2 AS n_bytes,
          CASE WHEN 44 + frames * n_channels * 2 > {UPLOAD_BYTES} THEN 'chunked' ELSE 'whole' END AS route
        FROM measured""",
    ),
    "split_manifest": sql.with_(
        _METRICS,
        body=f"""SELECT session_id, channel, i AS chunk_index,
          channel || '.chunk' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || '.wav' AS chunk_name,
          i * mf AS frame_start, least(mf, frames - i * mf) AS n_frames,
          CASE WHEN sample_rate = 0 THEN CAST(0 AS DOUBLE) ELSE i * mf / CAST(sample_rate AS DOUBLE) END AS start,
          CASE WHEN sample_rate = 0 THEN CAST(0 AS DOUBLE)
               ELSE least(mf, frames - i * mf) / CAST(sample_rate AS DOUBLE) END AS duration
        FROM (SELECT *, unnest(range((frames + mf - 1) // mf)) AS i FROM (
                SELECT *, CAST(({UPLOAD_BYTES} - 44) // (n_channels * 2) AS BIGINT) AS mf FROM measured))""",
    ),
    "quantise": sql.with_(
        _SAMPLES,
        body=f"SELECT vec_id, string_agg({_quantised('x')}, ',' ORDER BY n) AS pcm FROM samples GROUP BY vec_id",
    ),
    "dequantise": sql.with_(
        _SAMPLES,
        body=f"""SELECT vec_id,
          string_agg(CAST(round(CAST(CAST(q / CAST(32767 AS DOUBLE) AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT), ',' ORDER BY n) AS from_file,
          string_agg(CAST(round(CAST(CAST(q / CAST(32768 AS DOUBLE) AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT), ',' ORDER BY n) AS from_capture
        FROM (SELECT vec_id, n, {_quantised('x')} AS q FROM samples) GROUP BY vec_id""",
    ),
    "downmix": sql.with_(
        _SAMPLES,
        body=f"""SELECT vec_id, string_agg({_quantised('m')}, ',' ORDER BY i) AS pcm
        FROM (SELECT vec_id, n // 2 AS i, CAST(sum(CAST(x AS DOUBLE)) / 2 AS FLOAT) AS m FROM samples GROUP BY ALL)
        GROUP BY vec_id""",
    ),
    "widen_channels": sql.with_(
        _SAMPLES,
        body=f"""SELECT s.vec_id,
          CASE e.label % 3 WHEN 0 THEN string_agg({_quantised('x')}, ',' ORDER BY n)
               WHEN 1 THEN string_agg({_quantised('x')} || ',' || {_quantised('x')}, ',' ORDER BY n) END AS pcm,
          CASE e.label % 3 WHEN 2 THEN 'samples do not fit the channel layout' END AS error
        FROM samples s JOIN embeddings e ON e.vec_id = s.vec_id GROUP BY s.vec_id, e.label""",
    ),
    # Byte by byte: two bytes give a sample, two samples a frame, 50 frames a chunk.
    "rechunk": sql.with_(
        _SAMPLES,
        body="""SELECT session_id, channel, pos // 100 AS chunk_idx, pos // 100 * 50 AS frame_start,
          count(*) // 2 AS n_frames, string_agg(v, ',' ORDER BY pos) AS pcm
        FROM (
          SELECT session_id, channel, spot // 2 AS pos,
                 CASE WHEN sum(byte << (8 * (spot % 2))) >= 32768 THEN sum(byte << (8 * (spot % 2))) - 65536
                      ELSE sum(byte << (8 * (spot % 2))) END AS v
          FROM (
            SELECT session_id, channel, byte, row_number() OVER (PARTITION BY channel ORDER BY vec_id, n, half) - 1 AS spot,
                   count(*) OVER (PARTITION BY channel) // 4 * 4 AS kept
            FROM (SELECT session_id, channel, vec_id, n, half,
                         CASE half WHEN 0 THEN u & 255 ELSE u >> 8 END AS byte
                  FROM (SELECT *, (CAST(trunc(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(x AS DOUBLE))) * 32767) AS INTEGER) + 65536) % 65536 AS u FROM samples),
                       (SELECT unnest(range(2)) AS half))
)
          WHERE spot < kept GROUP BY ALL)
        GROUP BY ALL""",
    ),
    "resample": sql.with_(
        _RESAMPLED,
        body=f"""SELECT session_id, channel, j // {CELL_FRAMES} AS chunk_idx, j // {CELL_FRAMES} * {CELL_FRAMES} AS frame_start,
          count(*) AS n_frames, CAST(22050 AS BIGINT) AS sample_rate,
          string_agg({_quantised('x')}, ',' ORDER BY j) AS pcm
        FROM resampled GROUP BY ALL""",
    ),
    "mix_down": sql.with_(
        _RESAMPLED,
        body=f"""SELECT session_id, j // {CELL_FRAMES} AS chunk_idx, j // {CELL_FRAMES} * {CELL_FRAMES} AS frame_start,
          count(*) AS n_frames, CAST(22050 AS BIGINT) AS sample_rate,
          string_agg({_quantised('m')}, ',' ORDER BY j) AS pcm
        FROM (SELECT r.session_id, r.j, CAST(CAST(sum(CAST(r.x AS DOUBLE)) AS FLOAT) / CAST(count(*) AS FLOAT) AS FLOAT) AS m
              FROM resampled r JOIN (SELECT session_id, min(t) AS shortest FROM targets GROUP BY ALL) s
                ON s.session_id = r.session_id AND r.j < s.shortest
              GROUP BY r.session_id, r.j)
        GROUP BY ALL""",
    ),
}
ORACLES["ledger_transcripts"] = ORACLES["provider_transcripts"]

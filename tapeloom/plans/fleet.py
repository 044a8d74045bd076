"""The whole job over all finished sessions of a batch.

chunks → metrics → session rows and WAV files → mix → targets → upload chunks →
transcripts → notes.  Results needed more than once are written as tables under ``root``, a
folder the cluster shares, and read back: later steps start from files, so a
lost executor costs only its own tasks.  The logs of the store grow by one folder per
batch, and the batch is folded into snapshots: it reads and writes the buckets of its own
sessions, whatever the store holds besides.  Repeating a batch replaces its folders and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import answers, providers, schemas
from tapeloom.operators import audio, notes, store
from tapeloom.operators.buckets import BucketLog, Snapshot
from tapeloom.session import full_uri
from tapeloom.sources import wav

# Fixed value: largest upload that is sent in one piece.
MAX_UPLOAD_BYTES = 24 * 1024 * 1024

#: Jobs that run beside the main line of a batch.
BESIDE = 3

#: Frames of one recording file; a longer recording goes on in further files.
WAV_FRAMES = 1 << 26


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _log_rows(frame: DataFrame) -> DataFrame:
    present = set(frame.columns)
    return frame.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.SESSION_LOG.fields
        ]
    )


class Store:
    """The tables of all batches under one root: logs in buckets, and snapshots that each batch is folded into."""

    def __init__(self, spark: SparkSession, root: str):
        log = lambda name, schema, key: BucketLog(spark, root, name, schema, key)
        self.sessions = Snapshot(log("session_log", schemas.SESSION_LOG, "id"), store.last_writes)
        self.transcripts = log("transcripts", schemas.TRANSCRIPTS, "session_id")
        self.numbers = Snapshot(self.transcripts, store.last_numbers, "numbers", schemas.TRANSCRIPT_NUMBERS)
        self.notes = Snapshot(log("notes_log", schemas.NOTES_LOG, "session_id"), store.first_and_last_notes)


def sessions(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """Sessions after all batches, or the wanted ``id``s."""
    return store.compact_sessions(Store(spark, root).sessions.rows(wanted=wanted))


def outcomes(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """What the store holds of all sessions (or the wanted ``id``s), over all batches."""
    held = Store(spark, root)
    asked = None if wanted is None else wanted.select(F.col("id").alias("session_id"))
    noted = store.compact_notes(held.notes.rows(wanted=asked))
    return store.session_outcomes(sessions(spark, root, wanted), held.transcripts.rows(wanted=asked), noted)


def process_batch(
    spark: SparkSession,
    root: str,
    batch: int,
    requests: DataFrame,
    channels: DataFrame,
    chunks: DataFrame,
    transcriber: str | None = providers.PLACEHOLDER,
    summariser: str | None = providers.PLACEHOLDER,
    mix_down: bool = True,
    cell_frames: int = 16000,
    max_upload_bytes: int = MAX_UPLOAD_BYTES,
    wav_frames: int = WAV_FRAMES,
) -> dict[str, DataFrame]:
    """Process one batch of sessions; ``batch`` grows from run to run.

    ``requests`` holds ``id``, ``name`` and ``created_at`` of each session.  A session
    that cannot be mixed is reported under ``errors``; its channels are transcribed
    one by one, and no other session is touched.  A recording with a chunk that the backend
    does not answer is reported under ``failed`` and has no transcript in this batch; repeating the
    batch asks for such chunks only.

    What nothing else of the batch waits for (sound files, folds into snapshots) is written by jobs
    beside the others; all of them are done, or have raised, when this returns.
    """
    jobs: list[Future] = []
    with ThreadPoolExecutor(BESIDE) as pool:
        out = _processed(
            spark, root, batch, requests, channels, chunks, transcriber, summariser, mix_down, cell_frames,
            max_upload_bytes, wav_frames, lambda *call: jobs.append(pool.submit(*call)),
        )
    for job in jobs:
        job.result()
    return out


def _processed(
    spark: SparkSession,
    root: str,
    batch: int,
    requests: DataFrame,
    channels: DataFrame,
    chunks: DataFrame,
    transcriber: str | None,
    summariser: str | None,
    mix_down: bool,
    cell_frames: int,
    max_upload_bytes: int,
    wav_frames: int,
    beside: Callable[..., None],
) -> dict[str, DataFrame]:
    root = full_uri(spark, root).rstrip("/")
    held = Store(spark, root)
    here = f"{root}/batch={batch}"
    raw = F.concat(F.lit(f"{root}/"), "session_id", F.lit("/raw/"), "channel", F.lit(".wav"))
    metrics = _written(audio.channel_metrics(channels, chunks).withColumn("path", raw), f"{here}/channel_metrics")
    beside(_written, wav.write_wav(chunks, root, wav_frames), f"{here}/raw_files")

    rollup = audio.session_rollup(metrics, F.col("path")).withColumnRenamed("session_id", "id")
    saved = requests.join(rollup, "id").withColumn("seq", F.lit(2 * batch)).withColumn("op", F.lit(store.SAVE))
    # Update rows carry no session fields, so only the keys of this log are checked.
    writes = _log_rows(saved)

    out = {"metrics": metrics}
    mixed = mix = None
    if mix_down:
        sources = audio.mix_sources(metrics)
        out["errors"] = _written(audio.mix_errors(chunks, sources), f"{here}/mix_errors")
        good = audio.mixable(sources, out["errors"])
        mix = _written(audio.mix_down(chunks, good, cell_frames), f"{here}/mix_chunks").withColumns(
            {"channel": F.lit("mix"), "n_channels": F.lit(1)}
        )
        beside(_written, wav.write_wav(mix, root, wav_frames, "processed"), f"{here}/mix_files")
        mixed = mix.groupBy("session_id").agg(
            F.sum(F.col("n_frames").cast("bigint")).alias("frames"), F.max("sample_rate").alias("sample_rate")
        )
        mix_path = F.concat(F.lit(f"{root}/"), "session_id", F.lit("/processed/mix.wav"))
        mixed = _written(mixed.withColumn("path", mix_path).withColumn("n_channels", F.lit(1)), f"{here}/mixes")
        updates = mixed.select(
            F.lit(2 * batch + 1).alias("seq"),
            F.lit(store.UPDATE_MIX).alias("op"),
            F.col("session_id").alias("id"),
            F.col("path").alias("mix_path"),
        )
        writes = writes.unionByName(_log_rows(updates))
    held.sessions.log.append(writes, batch)
    held.sessions.fold(batch)

    current = sessions(spark, root, requests)
    out["sessions"] = current
    if transcriber is None:
        return out
    targets, ledger = audio.transcription_targets(current, metrics), None
    if transcriber == providers.PLACEHOLDER:
        results = providers.placeholder_transcripts(current, targets).withColumn("part", F.lit(0).cast("bigint"))
    else:
        sizes = metrics.select("path", "frames", "sample_rate", "n_channels")
        audible = chunks
        if mixed is not None:
            sizes = sizes.unionByName(mixed.select("path", "frames", "sample_rate", "n_channels"))
            columns = ["session_id", "channel", "frame_start", "n_frames", "n_channels", "samples"]
            audible = chunks.select(*columns).unionByName(mix.select(*columns))
        # A recording made again under its old name is another one to the ledger of answers.
        files = targets.join(sizes, "path").join(answers.contents(audible), ["session_id", "channel"], "left")
        # A file within the limit is one chunk; the split leaves it whole.
        manifest = audio.split_manifest(files, max_upload_bytes)
        ledger = f"{root}/answers/{transcriber}"
        results = providers.transcribe(manifest, providers.TRANSCRIBERS[transcriber], targets, audible, ledger=ledger)
        results = results.withColumn("path", F.col("channel"))
    # Answers are kept before they are numbered: no backend is called twice.
    results = _written(results, f"{here}/answers")
    if ledger is not None:
        out["failed"] = answers.failures(spark, ledger).join(targets, ["session_id", "channel"], "left_semi")
    # Numbers go on where the ledger says, which is read in the buckets of these sessions only.
    earlier = held.numbers.rows(before=batch, wanted=results.select("session_id"))
    rows = store.numbered_transcripts(results, ["path"], earlier).drop("path")
    held.transcripts.append(store.checked(rows, "transcripts"), batch)
    spoken = held.transcripts.rows([batch])
    beside(held.numbers.fold, batch)
    out["transcripts"] = spoken
    if summariser is None:
        return out
    # Results of one channel label replace each other: the last one written is noted.
    latest = store.latest_per_channel(spoken)
    if summariser == providers.PLACEHOLDER:
        written = notes.default_notes(current, latest)
    else:
        written = providers.write_notes(current, latest, providers.SUMMARISERS[summariser])
    rows = store.checked(written.withColumn("seq", F.lit(batch).cast("bigint")), "notes_log")
    held.notes.log.append(rows, batch)
    beside(held.notes.fold, batch)
    out["notes"] = store.compact_notes(held.notes.log.rows([batch]))
    return out

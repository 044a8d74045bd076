"""Pluggable transcription and notes backends, run as batch inference jobs.

A transcription backend is a function from a pandas batch of upload chunks to
their responses; it may ask for their samples.  A notes backend turns one session's
prompt, which comes in parts, into a ``Note``.  They run inside tasks over all
sessions at once.  The built-in ``placeholder`` backends are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import answers as answer_ledger
from tapeloom.functions import text
from tapeloom.operators import audio, notes, transcripts
from tapeloom.schemas import SEGMENTS
from tapeloom.session import fan_out


@dataclass(frozen=True)
class Note:
    """A notes document; without a title it gets the usual one."""

    summary: str
    title: str | None = None
    action_items: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Transcriber:
    """A transcription backend; with ``hears`` its batches carry ``samples``."""

    call: Callable[[pd.DataFrame], pd.Series]
    hears: bool = False


#: Called once per session with its name and the parts of its prompt, in order.
Summariser = Callable[[str, Iterator[str]], Note]

PLACEHOLDER = "placeholder"
# Fixed value: the channel every placeholder transcript is labelled with.
PLACEHOLDER_CHANNEL = "mixed"

TRANSCRIBERS: dict[str, Transcriber] = {}
SUMMARISERS: dict[str, Summariser] = {}


def register_transcriber(name: str, backend: Callable[[pd.DataFrame], pd.Series], hears: bool = False) -> None:
    TRANSCRIBERS[name] = Transcriber(backend, hears)


def register_summariser(name: str, backend: Summariser) -> None:
    SUMMARISERS[name] = backend


def placeholder_transcripts(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """One fixed-text transcript per target, all under one channel label."""
    named = sessions.select(F.col("id").alias("session_id"), "name")
    spoken = text.placeholder_text(F.col("name"), F.col("path"))
    return targets.join(named, "session_id").select(
        "session_id",
        F.lit(PLACEHOLDER_CHANNEL).alias("channel"),
        "path",
        spoken.alias("text"),
        F.array(
            F.struct(
                F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), spoken.alias("text")
            )
        )
        .cast(SEGMENTS)
        .alias("segments"),
        F.lit(None).cast("string").alias("raw_response"),
    )


def placeholder_previews(results: DataFrame) -> DataFrame:
    """The update before a placeholder's final result: its first sentence."""
    preview = text.preview_sentence(F.col("text"))
    rows = results.withColumn("text", preview).filter("text IS NOT NULL")
    untimed = F.lit(None).cast("double")
    segment = F.struct(untimed.alias("start"), untimed.alias("end"), F.col("text"))
    return rows.withColumn("segments", F.array(segment).cast(SEGMENTS))


def transcribe_chunks(
    manifest: DataFrame, backend: Transcriber, parallelism: int | None = None, ledger: str | None = None
) -> DataFrame:
    """Call the backend on every upload chunk; adds the ``response`` column.

    Chunks are spread over a fixed number of tasks by their own number, so the chunks
    of one long recording are worked on side by side.  Order comes back from
    ``chunk_index``.  A task may be repeated: without a ``ledger`` backends see a chunk
    again then, with one only chunks without an answer (which also adds ``error``).
    """
    if ledger is not None:
        asked = answer_ledger.ask(manifest, backend.call, ledger, parallelism=parallelism)
        return asked.drop("samples")
    keys = ["session_id", "channel", "chunk_index"]
    spread = manifest.repartition(fan_out(manifest.sparkSession, parallelism), *keys)
    kept = [f for f in manifest.schema.fields if f.name != "samples"]
    schema = T.StructType([*kept, T.StructField("response", T.StringType())])
    call = backend.call

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(response=call(batch))[schema.names]

    return spread.mapInPandas(answer, schema)


def answers(
    manifest: DataFrame,
    backend: Transcriber,
    chunks: DataFrame | None = None,
    parallelism: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """The read responses of all upload chunks; ``chunks`` holds the audio of a backend that hears."""
    given = _given(manifest, backend, chunks)
    return transcripts.parse_responses(transcribe_chunks(given, backend, parallelism, ledger))


def _given(manifest: DataFrame, backend: Transcriber, chunks: DataFrame | None) -> DataFrame:
    """What the backend is given of each upload chunk."""
    if not backend.hears:
        return manifest
    if chunks is None:
        raise ValueError("this backend needs the audio chunks")
    return audio.with_samples(manifest, chunks)


def transcribe(
    manifest: DataFrame,
    backend: Transcriber,
    targets: DataFrame | None = None,
    chunks: DataFrame | None = None,
    parallelism: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Transcripts of all recordings of a manifest, merged from their chunks.

    ``targets`` adds an empty transcript for each recording without chunks.  With a ``ledger`` (a shared folder)
    chunks that have an answer are not asked for again, and a recording with a chunk that
    has none gets no transcript: ``answers.failures`` lists it, a later run goes on from there.
    """
    if ledger is None:
        parsed = answers(manifest, backend, chunks, parallelism)
    else:
        given = _given(manifest, backend, chunks)
        asked, failed = answer_ledger.ask_and_tell(given, backend.call, ledger, parallelism=parallelism)
        parsed = transcripts.parse_responses(asked.drop("samples", "error"))
        if failed is not None:
            parsed = parsed.join(failed, transcripts.KEY, "left_anti")
    merged = transcripts.merge_chunks(parsed)
    return merged if targets is None else merged.unionByName(transcripts.empty_transcripts(targets, manifest))


def updates(parsed: DataFrame) -> DataFrame:
    """What a listener gets while recordings are transcribed: every update, and final records that differ."""
    partials = transcripts.running_partials(parsed).withColumn("has_text", F.lit(False))
    finals = transcripts.final_sizes(transcripts.merge_chunks(parsed))
    payload = ["text_length", "n_segments", "n_entries", "has_text"]
    return transcripts.emit_if_changed(partials, finals, transcripts.KEY, "chunk_index", payload)


def write_notes(
    sessions: DataFrame,
    spoken: DataFrame,
    backend: Summariser,
    parallelism: int | None = None,
    page_rows: int = notes.PAGE_ROWS,
) -> DataFrame:
    """Notes of every session with a transcript.

    The backend is called once per session and reads its prompt part by part, so a
    very long one is never one value and the result does not depend on the cut.  A
    session whose texts are all empty has one empty part.
    """
    heard = spoken.select("session_id").distinct()
    named = sessions.select(F.col("id").alias("session_id"), "name")
    prompts = heard.join(notes.prompts(spoken, page_rows), "session_id", "left").select(
        "session_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("prompt", F.lit("")).alias("prompt")
    )
    schema = pa.schema(
        [("session_id", pa.string()), ("name", pa.string()), ("title", pa.string()), ("summary", pa.string()),
         ("action_items", pa.list_(pa.string()))]
    )

    def write(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []

        def parts() -> Iterator[str]:
            for batch in batches:
                names.extend(batch.column("name").slice(0, 1).to_pylist())
                yield from batch.column("prompt").to_pylist()

        first = parts()
        opening = next(first)

        def whole() -> Iterator[str]:
            yield opening
            yield from first

        note = backend(names[0], whole())
        for _ in first:  # the group has to be read to its end
            pass
        row = {"session_id": key[0].as_py(), "name": names[0], "title": note.title, "summary": note.summary,
               "action_items": list(note.action_items)}
        yield pa.RecordBatch.from_pylist([row], schema=schema)

    # Sorted by part inside a partition: the groups below need no other order and keep it.
    tasks = fan_out(sessions.sparkSession, parallelism)
    asked = prompts.join(named, "session_id").repartition(tasks, "session_id")
    asked = asked.sortWithinPartitions("session_id", "part").select("session_id", "name", "prompt")
    ddl = "session_id string, name string, title string, summary string, action_items array<string>"
    written = asked.groupBy("session_id").applyInArrow(write, ddl)
    return written.select(
        "session_id", F.coalesce("title", text.notes_title(F.col("name"))).alias("title"), "summary", "action_items"
    )

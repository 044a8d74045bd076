"""WAV recordings as chunk tables, and chunk tables as WAV files.

Files are listed by Spark without reading them.  Tasks then read the short
headers, and each span of a file is read by its own task, so a recording of any
length is spread over the cluster and never held in one value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.pcm import FILE_SCALE, SAMPLE_BYTES, WAV_HEADER_BYTES
from tapeloom.functions.text import path_stem
from tapeloom.session import fan_out, full_uri

# Fixed value: format code of plain PCM samples.
PCM_CODE = 1

_HEADER = (
    "path string, data_start bigint, frames bigint, sample_rate int, n_channels int, sample_width int, error string"
)
_SPAN = "path string, chunk_idx bigint, frame_start bigint, n_frames int, sample_rate int, n_channels int, samples array<float>"


def _open(uri: str):
    # Hadoop writes local files as "file:/x"; Arrow wants "file:///x".
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    filesystem, name = pafs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(name)


def _header(path: str, length: int) -> dict:
    """Layout of one file, from its block headers only."""
    found = {"path": path, "data_start": None, "frames": 0, "sample_rate": 0, "n_channels": 0, "sample_width": 0}
    with _open(path) as file:
        head = file.read(12)
        if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
            return {**found, "error": "not a WAV file"}
        at = 12
        while at + 8 <= length:
            file.seek(at)
            block = file.read(8)
            if len(block) < 8:
                break
            name, size = struct.unpack("<4sI", block)
            if name == b"fmt ":
                head = file.read(16)
                if len(head) < 16 or size < 16:
                    return {**found, "error": "short format block"}
                code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head)
                found |= {"sample_rate": rate, "n_channels": channels, "sample_width": bits // 8}
                if code != PCM_CODE:
                    return {**found, "error": f"not PCM: format {code}"}
            if name == b"data":
                if found["n_channels"] < 1 and found["sample_width"]:
                    return {**found, "error": "no channels"}
                if found["sample_width"] != SAMPLE_BYTES:
                    return {**found, "error": f"sample width {found['sample_width']} is not 2"}
                kept = min(size, length - at - 8)
                frames = kept // (SAMPLE_BYTES * found["n_channels"])
                return {**found, "data_start": at + 8, "frames": frames, "error": None}
            at += 8 + size + size % 2
    return {**found, "error": "no samples"}


def wav_headers(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """One row per file: sample layout, or the reason it is rejected."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_header(p, int(n)) for p, n in zip(batch["path"], batch["length"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HEADER.split(", ")])

    return listed.mapInPandas(parse, _HEADER)


def rejected_files(headers: DataFrame) -> DataFrame:
    return headers.filter("error IS NOT NULL").select("path", "error")


#: A file of a long recording: its number, and the frame of the recording it begins with.
_PART = r"^(.*)\.chunk[0-9]{3,}\.at([0-9]+)$"


def wav_chunks(
    headers: DataFrame, chunk_frames: int, chunks_per_span: int = 64, tasks: int | None = None
) -> DataFrame:
    """Samples of all readable files, at most ``chunk_frames`` frames per row.

    ``session_id`` is the folder above ``raw`` or ``processed`` (or the file's own
    folder) and ``channel`` the file's stem.  The files of a recording written in
    several come back as one channel, at their frames; ``chunk_idx`` counts frames in
    steps of ``chunk_frames``, so files should begin at a multiple of it.
    """
    span_frames = chunk_frames * chunks_per_span
    stem = path_stem(F.col("path"))
    single = F.regexp_extract(stem, _PART, 2) == ""
    offset = F.when(single, F.lit(0)).otherwise(F.regexp_extract(stem, _PART, 2).try_cast("bigint"))
    good = headers.filter("error IS NULL AND frames > 0").withColumn("offset", offset.cast("bigint"))
    last = F.expr(f"(frames - 1) div {span_frames}")
    spans = good.withColumn("span", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    spans = spans.repartition(fan_out(headers.sparkSession, tasks), "path", "span")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                first = int(row.span) * span_frames
                count = min(span_frames, int(row.frames) - first)
                size = SAMPLE_BYTES * int(row.n_channels)
                with _open(row.path) as file:
                    file.seek(int(row.data_start) + first * size)
                    values = np.frombuffer(file.read(count * size), dtype="<i2").astype(np.float32)
                values /= np.float32(FILE_SCALE)
                begins = range(0, count, chunk_frames)
                at = int(row.offset) + first
                yield pd.DataFrame(
                    {
                        "path": row.path,
                        "chunk_idx": [(at + b) // chunk_frames for b in begins],
                        "frame_start": [at + b for b in begins],
                        "n_frames": [min(chunk_frames, count - b) for b in begins],
                        "sample_rate": row.sample_rate,
                        "n_channels": row.n_channels,
                        "samples": [values[b * row.n_channels : (b + chunk_frames) * row.n_channels] for b in begins],
                    }
                )

    folder = F.regexp_extract("path", r"([^/]+)/(?:(?:raw|processed)/)?[^/]+$", 1)
    return spans.mapInPandas(read, _SPAN).select(
        folder.alias("session_id"),
        F.when(single, stem).otherwise(F.regexp_extract(stem, _PART, 1)).alias("channel"),
        F.lit(None).cast("string").alias("device"),
        "chunk_idx",
        "frame_start",
        "n_frames",
        "sample_rate",
        "n_channels",
        "samples",
    )


def _file_bytes(samples: np.ndarray, rate: int, channels: int) -> bytes:
    clipped = np.clip(samples.astype(np.float32), np.float32(-1), np.float32(1))
    data = (clipped * np.float32(FILE_SCALE)).astype("<i2").tobytes()
    frame = channels * SAMPLE_BYTES
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sI",
        b"RIFF", WAV_HEADER_BYTES - 8 + len(data), b"WAVE", b"fmt ", 16, PCM_CODE, channels, rate,
        rate * frame, frame, 8 * SAMPLE_BYTES, b"data", len(data),
    )
    return head + data


def write_wav(chunks: DataFrame, folder: str, max_frames: int, below: str = "raw") -> DataFrame:
    """Write recordings as WAV files of at most ``max_frames`` frames each.

    Each file is put together by its own task from its chunks alone.  A longer
    recording becomes ``name.chunk000.at0.wav``, ``name.chunk001.at<frame>.wav`` and so
    on, which ``wav_chunks`` reads back as one channel.  Gives one row per file;
    repeated tasks replace their file.  Chunks on a border between files are cut.
    """
    root = full_uri(chunks.sparkSession, folder)
    end = F.col("frame_start") + F.col("n_frames")
    files = F.sequence(F.expr(f"frame_start div {max_frames}"), F.expr(f"(frame_start + n_frames - 1) div {max_frames}"))
    totals = chunks.groupBy("session_id", "channel").agg(F.max(end).alias("total"))
    pieces = (
        chunks.filter("n_frames > 0")
        .withColumn("part", F.explode(files))
        .withColumn("lo", F.greatest("frame_start", F.col("part") * max_frames))
        .withColumn("hi", F.least(end, (F.col("part") + 1) * max_frames))
        .withColumn(
            "samples",
            F.expr("slice(samples, cast((lo - frame_start) * n_channels + 1 as int), cast((hi - lo) * n_channels as int))"),
        )
        .select("session_id", "channel", "part", "lo", "sample_rate", "n_channels", "samples")
    )

    def save(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        session, channel, part, single = key
        group = group.sort_values("lo")
        first = group.iloc[0]
        name = f"{channel}.wav" if single else f"{channel}.chunk{part:03d}.at{first['lo']}.wav"
        uri = f"{root}/{session}/{below}/{name}"
        samples = np.concatenate(group["samples"].to_list())
        filesystem, target = pafs.FileSystem.from_uri(uri)
        filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(target) as out:
            out.write(_file_bytes(samples, int(first["sample_rate"]), int(first["n_channels"])))
        frames = len(samples) // int(first["n_channels"])
        return pd.DataFrame([(session, channel, part, uri, frames)], columns=["session_id", "channel", "part", "path", "frames"])

    single = F.col("total") <= max_frames
    keyed = pieces.join(totals.select("session_id", "channel", single.alias("single")), ["session_id", "channel"])
    return keyed.groupBy("session_id", "channel", "part", "single").applyInPandas(
        save, "session_id string, channel string, part bigint, path string, frames bigint"
    )

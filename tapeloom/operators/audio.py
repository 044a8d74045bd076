"""Audio chunk tables: metrics, targets, splitting, rechunking and mixing.

Samples stay in arrays, one row per chunk.  Totals read only ``n_frames``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import pcm
from tapeloom.functions.text import file_name, path_stem
from tapeloom.operators.ordered import Fold, running

KEY = ["session_id", "channel"]


def channel_metrics(channels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Frames, duration and silence of every configured channel.

    A channel is silent when nothing was captured; audio of zeros is not.
    """
    captured = chunks.groupBy(*KEY).agg(F.sum(F.col("n_frames").cast("bigint")).alias("captured"))
    frames = F.coalesce(F.col("captured"), F.lit(0)).cast("bigint")
    # Never broadcast: channels come from few bytes of file (a customer gives five), but fill a task's memory.
    counted = channels.hint("merge").join(captured, KEY, "left").withColumn("frames", frames).drop("captured")
    duration = F.when(F.col("sample_rate") == 0, F.lit(0.0)).otherwise(
        F.col("frames") / F.nullif(F.col("sample_rate"), F.lit(0)).cast("double")
    )
    timed = counted.withColumn("duration", duration)
    return timed.withColumn("is_silent", (F.col("frames") <= 0) | (F.col("duration") <= 0.0))


def session_rollup(metrics: DataFrame, path: Column) -> DataFrame:
    """Session fields from its channels; the map has one path per channel."""
    paths = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("channel"), path.alias("path")))))
    return metrics.groupBy("session_id").agg(
        F.max("duration").alias("duration"),
        F.max("sample_rate").alias("sample_rate"),
        F.max("n_channels").alias("channels"),
        paths.alias("audio_paths"),
    )


def mix_sources(metrics: DataFrame) -> DataFrame:
    """Channels that enter the mix; a session without any has no mix."""
    return metrics.filter(~F.col("is_silent") & F.col("path").isNotNull())


def transcription_targets(sessions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per session its mix, or else every channel that is not silent."""
    asked = sessions.select(F.col("id").alias("session_id"), "mix_path")
    sources = mix_sources(metrics).select(F.col("session_id").alias("source_id"), F.col("path").alias("raw_path"))
    # A session with a mix matches no channel and keeps its one row.
    matched = F.col("mix_path").isNull() & (F.col("session_id") == F.col("source_id"))
    return (
        asked.join(sources, matched, "left")
        .select("session_id", F.coalesce("mix_path", "raw_path").alias("path"))
        .filter("path IS NOT NULL")
        .withColumn("channel", path_stem(F.col("path")))
    )


def route_by_size(files: DataFrame, max_upload_bytes: int) -> DataFrame:
    """Mark files as sent whole or in chunks; exactly the limit is still whole."""
    size = pcm.wav_bytes(F.col("frames"), F.col("n_channels"))
    return files.withColumn("n_bytes", size).withColumn(
        "route", F.when(F.col("n_bytes") > max_upload_bytes, F.lit("chunked")).otherwise(F.lit("whole"))
    )


def split_plan(files: DataFrame, max_bytes: int) -> DataFrame:
    """Per file the frames of one upload chunk, or the reason it cannot be split."""
    frame_size = F.col("n_channels") * pcm.SAMPLE_BYTES
    budget = F.lit(max_bytes).cast("bigint") - pcm.WAV_HEADER_BYTES
    per_chunk = F.greatest(F.floor(budget / frame_size), F.lit(1))
    largest = F.least(F.col("frames"), per_chunk)
    error = (
        F.when(F.lit(max_bytes) <= 0, F.lit("budget is not positive"))
        .when(frame_size <= 0, F.lit("frame size is not positive"))
        .when(budget <= 0, F.lit("budget is smaller than a file header"))
        .when(
            (F.col("frames") > 0) & (pcm.wav_bytes(largest, F.col("n_channels")) > max_bytes),
            F.lit("one frame is larger than the budget"),
        )
    )
    return files.withColumn("error", error).withColumn(
        "max_frames", F.when(F.col("error").isNull(), per_chunk)
    )


def split_errors(files: DataFrame, max_bytes: int) -> DataFrame:
    return split_plan(files, max_bytes).filter("error IS NOT NULL")


def split_manifest(files: DataFrame, max_bytes: int) -> DataFrame:
    """Upload chunks of each file: name, frame range, start and duration.

    ``files`` holds ``path``, ``frames``, ``sample_rate`` and ``n_channels``.
    Starts follow from the chunk number, so no running sum is needed.
    """
    # Names are taken apart once per file, before a file becomes many rows.
    planned = (
        split_plan(files, max_bytes)
        .filter("error IS NULL AND frames > 0")
        .withColumn("__name", file_name(F.col("path")))
        .withColumn("__stem", path_stem(F.col("path")))
    )
    last = (F.ceil(F.col("frames") / F.col("max_frames")) - 1).cast("bigint")
    rows = planned.withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("chunk_index") * F.col("max_frames")
    rate = F.nullif(F.col("sample_rate"), F.lit(0))
    n_frames = F.least(F.col("max_frames"), F.col("frames") - start)
    suffix = F.substring("__name", F.length("__stem") + 1, F.length("__name"))
    number = F.col("chunk_index").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    name = F.concat("__stem", F.lit(".chunk"), padded, suffix)
    made = {"frames", "chunk_index", "chunk_name", "frame_start", "n_frames", "start", "duration", "is_whole"}
    return rows.select(
        *[c for c in files.columns if c not in made],
        "chunk_index",
        name.alias("chunk_name"),
        start.alias("frame_start"),
        n_frames.alias("n_frames"),
        F.coalesce(start / rate, F.lit(0.0)).alias("start"),
        F.coalesce(n_frames / rate, F.lit(0.0)).alias("duration"),
        (n_frames == F.col("frames")).alias("is_whole"),
    )


def rechunk(packets: DataFrame, chunk_frames: Column) -> DataFrame:
    """PCM packets to chunks of ``chunk_frames`` frames, in ``seq`` order.

    The byte offset of each packet cuts it into pieces on the chunk grid, and
    each chunk is put together from its pieces alone.  The last chunk may be
    shorter; an incomplete frame at the end is dropped.
    """
    frame_bytes = pcm.sample_width(F.col("sample_format")) * F.col("n_channels")
    sized = packets.filter(F.length("payload") > 0).select(
        *KEY,
        "seq",
        "payload",
        "sample_format",
        "sample_rate",
        "n_channels",
        frame_bytes.cast("bigint").alias("frame_bytes"),
        (frame_bytes * chunk_frames).cast("bigint").alias("chunk_bytes"),
        F.length("payload").cast("bigint").alias("n_bytes"),
    )
    placed = running(sized, KEY, "seq", {"first": Fold("sum", F.col("n_bytes"), inclusive=False)})
    end = F.col("first") + F.col("n_bytes")
    cells = F.sequence(F.expr("first div chunk_bytes"), F.expr("(first + n_bytes - 1) div chunk_bytes"))
    pieces = (
        placed.withColumn("chunk_idx", F.explode(cells))
        .withColumn("lo", F.greatest("first", F.col("chunk_idx") * F.col("chunk_bytes")))
        .withColumn("hi", F.least(end, (F.col("chunk_idx") + 1) * F.col("chunk_bytes")))
    )
    piece = F.expr("substring(payload, cast(lo - first + 1 as int), cast(hi - lo as int))")
    layout = ["sample_format", "sample_rate", "n_channels", "frame_bytes", "chunk_bytes"]
    gathered = pieces.groupBy(*KEY, "chunk_idx").agg(
        F.sort_array(F.collect_list(F.struct("lo", piece.alias("data")))).alias("pieces"),
        *[F.first(c).alias(c) for c in layout],
    )
    joined = gathered.withColumn("joined", join_bytes(F.col("pieces.data"))).withColumn(
        "n_frames", F.expr("cast(length(joined) div frame_bytes as int)")
    )
    whole = F.expr("substring(joined, 1, cast(n_frames * frame_bytes as int))")
    return joined.filter("n_frames > 0").select(
        *KEY,
        "chunk_idx",
        F.expr("chunk_idx * (chunk_bytes div frame_bytes)").alias("frame_start"),
        "n_frames",
        "sample_rate",
        "n_channels",
        pcm.decode_pcm(whole, F.col("sample_format")).alias("samples"),
    )


def join_bytes(parts: Column) -> Column:
    """Concatenate an array of binaries; a chunk has only a few pieces."""
    return F.aggregate(
        parts, F.lit(b""), lambda acc, part: F.concat(acc, part)
    )


_PIECE = "channel string, lo bigint, step double, length bigint, target bigint, n_channels int, same_rate boolean"


def _render_cell(cell_frames: int, wanted: list[str], schema: pa.Schema):
    """The numpy step for one output cell: resample each source, take the mean."""

    def render(table: pa.Table) -> pa.Table:
        table = table.sort_by([("channel", "ascending"), ("lo", "ascending")])
        rows = table.drop_columns(["piece"]).to_pylist()
        pieces = table.column("piece").combine_chunks()
        flat, bounds = pieces.values.to_numpy(zero_copy_only=False), pieces.offsets.to_numpy()
        cell = rows[0]["cell"]
        frames = np.arange(cell * cell_frames, min((cell + 1) * cell_frames, rows[0]["n_out"]))
        by_channel: dict[str, list[int]] = {}
        for i, row in enumerate(rows):
            by_channel.setdefault(row["channel"], []).append(i)
        if len(by_channel) != rows[0]["n_sources"]:
            raise ValueError(f"{len(by_channel)} of {rows[0]['n_sources']} sources reach cell {cell}")
        rendered = []
        for members in by_channel.values():
            source, base, expected = rows[members[0]], rows[members[0]]["lo"], rows[members[0]]["lo"]
            mono = []
            for i in members:
                values = flat[bounds[i] : bounds[i + 1]].astype(np.float32, copy=False)
                if rows[i]["n_channels"] > 1:
                    values = values.reshape(-1, rows[i]["n_channels"]).mean(axis=1)
                if rows[i]["lo"] != expected:
                    raise ValueError(f"frames missing before {rows[i]['lo']} in {source['channel']}")
                expected += len(values)
                mono.append(values)
            samples = np.concatenate(mono)
            reach = int(frames[0] * source["step"]), min(int(frames[-1] * source["step"]), source["length"] - 1)
            if base > reach[0] or base + len(samples) <= reach[1]:
                raise ValueError(f"frames missing in cell {cell} of {source['channel']}")
            if source["same_rate"]:
                rendered.append(samples[frames - base])
            else:
                rendered.append(
                    pcm.resample_at(
                        samples, base, frames, source["step"], source["length"], source["target"]
                    )
                )
        mixed = np.stack(rendered).mean(axis=0, dtype=np.float32)
        out = {name: [rows[0][name]] for name in wanted}
        out["chunk_idx"] = [cell]
        out["frame_start"] = [int(frames[0])]
        out["n_frames"] = [len(frames)]
        out["sample_rate"] = [rows[0]["target_rate"]]
        out["samples"] = [mixed]
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return render


def _render(chunks: DataFrame, plan: DataFrame, keys: list[str], cell_frames: int) -> DataFrame:
    """Cut chunks along the output cells that need them and render each cell.

    The samples are shuffled once, by (keys, cell); a cell holds ``cell_frames``
    output frames of each source, however long the recording is.
    """
    cells = F.lit(cell_frames).cast("bigint")
    joined = chunks.select(*KEY, "frame_start", "n_frames", "n_channels", "samples").join(plan, KEY)
    first, step = F.col("frame_start"), F.col("step")
    end = first + F.col("n_frames") - 1
    last_cell = F.floor((F.col("n_out") - 1) / cells)
    # One cell of slack on both sides; the exact frame range decides below.
    from_cell = F.greatest(F.floor((first - 1) / step / cells) - 1, F.lit(0))
    to_cell = F.least(F.floor(end / step / cells) + 1, last_cell)

    def needed(cell: Column) -> Column:
        last_out = F.least((cell + 1) * cells, F.col("n_out")) - 1
        return F.struct(
            cell.alias("cell"),
            F.greatest(first, F.floor(cell * cells * step) - 1).alias("lo"),
            F.least(end, F.floor(last_out * step) + 2).alias("hi"),
        )

    # Ranges are settled before the rows are multiplied, so that samples are
    # copied only for cells that take some.
    around = F.transform(F.sequence(from_cell.cast("bigint"), to_cell.cast("bigint")), needed)
    ranged = (
        joined.filter((F.col("n_frames") > 0) & (from_cell <= to_cell))
        .withColumn("range", F.explode(F.filter(around, lambda r: r["lo"] <= r["hi"])))
        .select(*joined.columns, "range.*")
    )
    piece = F.expr("slice(samples, cast((lo - frame_start) * n_channels + 1 as int), cast((hi - lo + 1) * n_channels as int))")
    inputs = ranged.select(
        *keys,
        *[c for c in KEY if c not in keys],
        "cell",
        "lo",
        "n_channels",
        "step",
        "length",
        "target",
        "same_rate",
        "n_out",
        "target_rate",
        "n_sources",
        piece.cast("array<float>").alias("piece"),
    )
    key_ddl = ", ".join(f"{k} string" for k in keys)
    ddl = f"{key_ddl}, chunk_idx bigint, frame_start bigint, n_frames int, sample_rate int, samples array<float>"
    schema = pa.schema(
        [pa.field(k, pa.string()) for k in keys]
        + [
            pa.field("chunk_idx", pa.int64()),
            pa.field("frame_start", pa.int64()),
            pa.field("n_frames", pa.int32()),
            pa.field("sample_rate", pa.int32()),
            pa.field("samples", pa.list_(pa.float32())),
        ]
    )
    return inputs.groupBy(*keys, "cell").applyInArrow(_render_cell(cell_frames, keys, schema), ddl)


def _plan(metrics: DataFrame, target_rate: Column) -> DataFrame:
    """Per channel: input length, output length and input frames per output frame."""
    plan = metrics.select(
        *KEY, F.col("frames").alias("length"), "sample_rate", target_rate.cast("int").alias("target_rate")
    ).withColumn("target", pcm.resampled_length(F.col("length"), F.col("sample_rate"), F.col("target_rate")))
    spread = (F.col("length") - 1) / F.greatest(F.col("target") - 1, F.lit(1)).cast("double")
    # A source cut to one frame reads frame 0 only; its step must not be zero.
    return plan.select(
        *KEY,
        "length",
        "target",
        "target_rate",
        (F.col("sample_rate") == F.col("target_rate")).alias("same_rate"),
        F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("step"),
    )


def resample(chunks: DataFrame, metrics: DataFrame, target_rate: int, cell_frames: int) -> DataFrame:
    """Every channel, downmixed, at ``target_rate`` by linear interpolation."""
    plan = _plan(metrics.filter(~F.col("is_silent")), F.lit(target_rate))
    return _render(
        chunks, plan.withColumns({"n_out": F.col("target"), "n_sources": F.lit(1)}), KEY, cell_frames
    )


#: Frames of a recording that one task checks for gaps.
_GAP_BLOCK = 1 << 22


def mix_errors(chunks: DataFrame, metrics: DataFrame) -> DataFrame:
    """(session_id, channel, error) of sources that cannot be mixed: frames missing, or captured twice.

    Reads frame positions only.  A session with an error has no mix; its channels
    stay targets of their own.
    """
    sources = metrics.filter(~F.col("is_silent")).select(*KEY)
    end = F.col("frame_start") + F.col("n_frames")
    # Chunks that begin at the same frame would not be ordered: they are counted as one, and are an error.
    placed = chunks.filter("n_frames > 0").groupBy(*KEY, "frame_start").agg(
        F.max("n_frames").cast("bigint").alias("n_frames"), F.count("*").alias("n")
    )
    seen = running(placed, KEY, "frame_start", {"before": Fold("max", end, inclusive=False)}, _GAP_BLOCK)
    gap = F.col("frame_start") - F.coalesce("before", F.lit(0))
    broken = seen.filter((gap != 0) | (F.col("n") > 1)).select(*KEY, "frame_start", gap.alias("gap"))
    first = broken.groupBy(*KEY).agg(
        F.min("frame_start").alias("at"), F.min_by("gap", "frame_start").alias("gap")
    )
    what = F.when(F.col("gap") > 0, F.lit("frames missing before ")).otherwise(F.lit("frames captured twice at "))
    return first.join(sources, KEY, "left_semi").select(*KEY, F.concat(what, F.col("at").cast("string")).alias("error"))


def mixable(metrics: DataFrame, errors: DataFrame) -> DataFrame:
    """Metrics of the sessions without a mix error."""
    return metrics.join(errors.select("session_id").distinct(), "session_id", "left_anti")


def mix_down(chunks: DataFrame, metrics: DataFrame, cell_frames: int) -> DataFrame:
    """One mono track per session: the mean of its channels that are not silent.

    All sources go to the highest sample rate and the mix ends with the
    shortest.  ``cell_frames`` is the chunk length of the result.
    """
    session = Window.partitionBy("session_id")
    sources = metrics.filter(~F.col("is_silent")).select(
        *KEY, "frames", "sample_rate", F.max("sample_rate").over(session).alias("rate")
    )
    plan = _plan(sources, F.col("rate"))
    shortest = {"n_out": F.min("target").over(session), "n_sources": F.count("*").over(session)}
    return _render(chunks, plan.withColumns(shortest), ["session_id"], cell_frames)


def with_samples(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Upload chunks with their ``samples``, cut from the captured chunks by frame range.

    Samples are shuffled once, by upload chunk; none is longer than the upload limit.
    """
    # The first chunk of a split recording has the full length of its chunks.
    widths = manifest.filter("chunk_index = 0").select(*KEY, F.col("n_frames").cast("bigint").alias("width"))
    held = chunks.filter("n_frames > 0").select(*KEY, "frame_start", "n_frames", "n_channels", "samples").join(widths, KEY)
    cells = F.sequence(F.expr("frame_start div width"), F.expr("(frame_start + n_frames - 1) div width"))
    cut = (
        held.withColumn("chunk_index", F.explode(cells))
        .withColumn("lo", F.greatest("frame_start", F.expr("chunk_index * width")))
        .withColumn("hi", F.least(F.expr("frame_start + n_frames"), F.expr("(chunk_index + 1) * width")))
    )
    piece = F.expr("slice(samples, cast((lo - frame_start) * n_channels + 1 as int), cast((hi - lo) * n_channels as int))")
    pieces = F.sort_array(F.collect_list(F.struct("lo", piece.alias("samples"))))
    gathered = cut.groupBy(*KEY, "chunk_index").agg(F.flatten(F.transform(pieces, lambda p: p["samples"])).alias("samples"))
    return manifest.join(gathered, [*KEY, "chunk_index"], "left")

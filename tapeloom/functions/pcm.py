"""Audio sample arrays: PCM scaling, channel layout and chunk arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Full scale of stored 16-bit audio, and per capture format the
# sample width in bytes, the little-endian sample type and the divisor.
FILE_SCALE = 32767.0
CAPTURE_FORMATS = {
    "f32le": (4, "<f4", 1.0),
    "s16le": (2, "<i2", 32768.0),
    "s32le": (4, "<i4", 2147483648.0),
}
WAV_HEADER_BYTES = 44
SAMPLE_BYTES = 2


def sample_width(sample_format: Column) -> Column:
    width = F.lit(None).cast("int")
    for name, (size, _, _) in CAPTURE_FORMATS.items():
        width = F.when(sample_format == name, size).otherwise(width)
    return width


def dequantise_file(values: Column) -> Column:
    """Stored 16-bit values to floats; -32768 comes out just below -1."""
    return F.transform(values, lambda v: (v / F.lit(FILE_SCALE)).cast("float"))


def dequantise_capture(values: Column, sample_format: str) -> Column:
    scale = CAPTURE_FORMATS[sample_format][2]
    return F.transform(values, lambda v: (v / F.lit(scale)).cast("float"))


def decode_bytes(data, sample_format: str) -> np.ndarray:
    """Captured bytes of one chunk to floats."""
    _, dtype, scale = CAPTURE_FORMATS[sample_format]
    values = np.frombuffer(data, dtype=dtype).astype(np.float32)
    return values if scale == 1.0 else values / np.float32(scale)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_pcm(payload: pa.Array, sample_format: pa.Array) -> pa.Array:
    """Captured bytes to floats, each row in its own capture format."""
    decoded = [decode_bytes(d.as_buffer(), f.as_py()) for d, f in zip(payload, sample_format)]
    offsets = np.cumsum([0] + [len(v) for v in decoded]).astype(np.int32)
    flat = np.concatenate(decoded) if decoded else np.empty(0, np.float32)
    return pa.ListArray.from_arrays(offsets, flat)


def quantise(samples: Column) -> Column:
    """Floats to stored 16-bit values: clip to one, scale, cut toward zero."""
    one, scale = F.lit(1.0).cast("float"), F.lit(FILE_SCALE).cast("float")
    return F.transform(
        samples, lambda x: (F.greatest(-one, F.least(one, x.cast("float"))) * scale).cast("smallint")
    )


def downmix(samples: Column, n_channels: Column) -> Column:
    """Mean over the channels of each interleaved frame."""
    frames = F.floor(F.size(samples) / n_channels).cast("int")

    def frame_mean(i: Column) -> Column:
        frame = F.slice(samples, i * n_channels + 1, n_channels)
        total = F.aggregate(frame, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return (total / n_channels).cast("float")

    many = F.when(
        frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), frame_mean)
    ).otherwise(F.array().cast("array<float>"))
    return F.when(n_channels == 1, samples.cast("array<float>")).otherwise(many)


def widen(samples: Column, n_channels: Column, wanted: Column) -> Column:
    """Repeat mono samples for a stereo writer; NULL for any other mismatch."""
    stereo = F.flatten(F.transform(samples, lambda x: F.array(x, x)))
    return F.when(n_channels == wanted, samples).when((n_channels == 1) & (wanted == 2), stereo)


def widen_error(n_channels: Column, wanted: Column) -> Column:
    fits = (n_channels == wanted) | ((n_channels == 1) & (wanted == 2))
    return F.when(~fits, F.lit("samples do not fit the channel layout"))


def wav_bytes(frames: Column, n_channels: Column) -> Column:
    """Size of a 16-bit WAV file."""
    return F.lit(WAV_HEADER_BYTES).cast("bigint") + frames * n_channels * SAMPLE_BYTES


def resampled_length(frames: Column, rate: Column, target_rate: Column) -> Column:
    """Frames after resampling: rounded half to even, one at least, 0 for none."""
    scaled = F.bround(frames.cast("double") * target_rate.cast("double") / rate.cast("double"), 0)
    return (
        F.when(frames == 0, F.lit(0))
        .when(rate == target_rate, frames)
        .otherwise(F.greatest(scaled.cast("bigint"), F.lit(1)))
        .cast("bigint")
    )


def chunk_frames(sample_rate: Column, chunk_seconds: Column, override: Column) -> Column:
    """Frames per capture chunk: the spec's own number, else from the seconds.

    Without seconds a chunk is a tenth of a second.
    """
    timed = F.floor(sample_rate * F.greatest(chunk_seconds, F.lit(0.001)))
    derived = F.when(chunk_seconds.isNull(), F.floor(sample_rate / 10)).otherwise(timed)
    return F.greatest(F.coalesce(override, derived).cast("bigint"), F.lit(1))


def resample_at(
    samples: np.ndarray, base: int, frames: np.ndarray, step: float, length: int, target: int
) -> np.ndarray:
    """Linear interpolation at output ``frames``; ``samples`` start at frame ``base``."""
    position = frames * step
    position[frames == target - 1] = length - 1 if target > 1 else 0
    left = np.floor(position).astype(np.int64)
    right = np.minimum(left + 1, length - 1)
    low = samples[left - base].astype(np.float64)
    high = samples[right - base].astype(np.float64)
    return ((high - low) * (position - left) + low).astype(np.float32)

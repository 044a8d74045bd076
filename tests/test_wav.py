import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators import pcm_tables
from tapeloom.sources import wav
from tests.test_audio import _ramp, _rows


def _write(path, data, rate=16000, channels=1, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(data)


def test_reading_files_and_rejecting_others(spark, tmp_path):
    stereo = np.random.default_rng(0).integers(-32768, 32767, 2 * 1003).astype("<i2")
    _write(tmp_path / "s1/raw/mic.wav", stereo.tobytes(), 22050, 2)
    _write(tmp_path / "s1/processed/mix.wav", b"")
    _write(tmp_path / "s2/raw/wide.wav", bytes(12), width=3)
    (tmp_path / "s2/raw/text.wav").write_text("no sound here")
    floats = b"RIFF" + struct.pack("<I4s4sIHHIIHH", 36, b"WAVE", b"fmt ", 16, 3, 1, 8000, 32000, 4, 32)
    (tmp_path / "s2/raw/float.wav").write_bytes(floats)
    headers = wav.wav_headers(spark, str(tmp_path))
    chunks = wav.wav_chunks(headers, 100, chunks_per_span=3).orderBy("frame_start").collect()
    assert {(c.session_id, c.channel, c.sample_rate, c.n_channels) for c in chunks} == {("s1", "mic", 22050, 2)}
    assert [c.n_frames for c in chunks] == [100] * 10 + [3] and [c.chunk_idx for c in chunks] == list(range(11))
    got = np.array([x for c in chunks for x in c.samples], np.float32)
    assert np.array_equal(got, stereo.astype(np.float32) / np.float32(32767))
    rejected = {r.path.rsplit("/", 1)[1]: r.error for r in wav.rejected_files(headers).collect()}
    assert set(rejected) == {"wide.wav", "text.wav", "float.wav"}
    assert "3" in rejected["wide.wav"]


def test_odd_block_before_the_samples(spark, tmp_path):
    samples = np.arange(5, dtype="<i2")
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    data = b"data" + struct.pack("<I", 10) + samples.tobytes()
    body = b"WAVE" + fmt + extra + data
    (tmp_path / "x.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    rows = wav.wav_chunks(wav.wav_headers(spark, str(tmp_path)), 8).collect()
    assert [round(x * 32767) for x in rows[0].samples] == [0, 1, 2, 3, 4]


def test_broken_headers_are_rows_not_failures(spark, tmp_path):
    def file(name, *blocks):
        body = b"WAVE" + b"".join(n + struct.pack("<I", len(d)) + d for n, d in blocks)
        (tmp_path / name).write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)

    plain = struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16)
    file("good.wav", (b"fmt ", plain), (b"data", bytes(4)))
    file("short.wav", (b"fmt ", plain[:6]))
    file("mute.wav", (b"fmt ", struct.pack("<HHIIHH", 1, 0, 8000, 0, 0, 16)), (b"data", bytes(4)))
    file("late.wav", (b"data", bytes(4)), (b"fmt ", plain))
    (tmp_path / "tiny.wav").write_bytes(b"RIFF\x04\0\0\0WAVEfm")
    headers = wav.wav_headers(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: (r.frames, r.error) for r in headers.collect()}
    assert found["good.wav"] == (2, None)
    assert {name for name, (_, error) in found.items() if error} == {"short.wav", "mute.wav", "late.wav", "tiny.wav"}
    assert wav.wav_chunks(headers, 8).count() == 1


def test_files_of_limited_length(spark, tmp_path):
    # Sixty-fourths: times 32767 they are exact, so the stored number is known.
    steps = [(i * 7) % 129 - 64 for i in range(800)]
    stored = [int(s * 32767 / 64) for s in steps]
    line = np.array(steps, np.float32) / 64
    rows = list(_rows("s", "mic", line, 8000, 70)) + list(_rows("s", "sys.chunk01", line[:300], 8000, 70))
    chunks = spark.createDataFrame(rows, schemas.AUDIO_CHUNKS)
    report = wav.write_wav(chunks.repartition(5), str(tmp_path), 300).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.frames) for r in report) == [
        ("mic.chunk000.at0.wav", 300),
        ("mic.chunk001.at300.wav", 300),
        ("mic.chunk002.at600.wav", 200),
        ("sys.chunk01.wav", 300),
    ]
    for i, begin in enumerate(range(0, 800, 300)):
        with wave.open(str(tmp_path / f"s/raw/mic.chunk00{i}.at{begin}.wav")) as f:
            assert (f.getnchannels(), f.getsampwidth(), f.getframerate()) == (1, 2, 8000)
            assert np.frombuffer(f.readframes(f.getnframes()), "<i2").tolist() == stored[begin : begin + 300]
    back = wav.wav_chunks(wav.wav_headers(spark, str(tmp_path)), 50, chunks_per_span=2, tasks=3).orderBy("frame_start").collect()
    whole = [c for c in back if c.channel == "mic"]
    assert [(c.chunk_idx, c.frame_start, c.n_frames) for c in whole] == [(i, 50 * i, 50) for i in range(16)]
    assert [round(x * 32767) for c in whole for x in c.samples] == stored
    assert {c.channel for c in back} == {"mic", "sys.chunk01"}


def test_spans_keep_their_tasks(spark, tmp_path):
    _write(tmp_path / "s/raw/long.wav", bytes(2 * 64 * 50))
    spans = wav.wav_chunks(wav.wav_headers(spark, str(tmp_path)), 8, chunks_per_span=2, tasks=20)
    used = {r.t for r in spans.select(F.spark_partition_id().alias("t")).collect()}
    assert len(used) > 14


def test_stored_chunk_table(spark, tmp_path):
    chunks = spark.createDataFrame(list(_rows("s", "mic", _ramp(-1.0, 1.0, 800), 8000, 100)), schemas.AUDIO_CHUNKS)
    laid_out = pcm_tables.for_writer(chunks, 2)
    pcm_tables.write_chunks(laid_out.drop("error"), f"file://{tmp_path}/pcm")
    assert (tmp_path / "pcm/session_id=s").is_dir()
    back = pcm_tables.stored_samples(spark.read.parquet(f"file://{tmp_path}/pcm"))
    assert back.filter("n_channels = 2 AND size(samples) = 2 * n_frames").count() == 8
    assert pcm_tables.for_writer(chunks.withColumn("n_channels", F.lit(2)), 1).filter("error IS NOT NULL").count() == 8

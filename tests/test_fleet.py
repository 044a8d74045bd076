import json

import numpy as np
import pandas as pd
import pytest

from tapeloom import providers, schemas
from tapeloom.operators import notes, store
from tapeloom.plans import fleet
from tests.test_audio import _ramp, _rows


def _inputs(spark):
    recordings = [
        ("both", "microphone", np.zeros(3200), 16000, 1),
        ("both", "system", _ramp(-0.8, 0.8, 4800), 16000, 1),
        ("half", "microphone", _ramp(0.5, 0.0, 800), 8000, 1),
        ("half", "system", np.empty(0), 16000, 1),
        ("none", "microphone", np.empty(0), 16000, 1),
    ]
    rows = [r for s, c, x, rate, n in recordings for r in _rows(s, c, x, rate, 1600, n)]
    channels = [(s, c, "dev", rate, n) for s, c, _, rate, n in recordings]
    requests = [(s, f"Meeting {s}", 1.0) for s in ("both", "half", "none")]
    return (
        spark.createDataFrame(requests, "id string, name string, created_at double"),
        spark.createDataFrame(channels, schemas.CHANNELS),
        spark.createDataFrame(rows, schemas.AUDIO_CHUNKS),
    )


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_placeholder_batch(spark, tmp_path):
    root = f"file://{tmp_path}"
    out = fleet.process_batch(spark, root, 1, *_inputs(spark), cell_frames=1600)
    sessions = _by(out["sessions"], "id")
    assert sessions["both"].mix_path.endswith("both/processed/mix.wav")
    assert sessions["half"].mix_path.endswith("half/processed/mix.wav")
    assert sessions["none"].mix_path is None
    assert sessions["both"].duration == 0.3 and sessions["half"].sample_rate == 16000
    assert set(sessions["half"].audio_paths) == {"microphone", "system"}
    spoken = _by(out["transcripts"], "session_id")
    assert set(spoken) == {"both", "half"}
    assert spoken["both"].channel == "mixed"
    assert spoken["both"].text.startswith("Dummy transcript for session 'Meeting both' from mix.wav. ")
    assert [s.start for s in spoken["both"].segments] == [None]
    found = _by(out["notes"], "session_id")
    assert found["both"].title == "Notes for Meeting both" and found["both"].summary == spoken["both"].text
    previews = providers.placeholder_previews(out["transcripts"]).collect()
    assert {p.text for p in previews} == {
        "Dummy transcript for session 'Meeting both' from mix.wav",
        "Dummy transcript for session 'Meeting half' from mix.wav",
    }


def test_unmixed_batch_targets_every_sounding_channel(spark, tmp_path):
    out = fleet.process_batch(spark, f"file://{tmp_path}", 1, *_inputs(spark), mix_down=False, summariser=None)
    texts = sorted((r.session_id, r.row_id, r.text.split(" from ")[1].split(".wav")[0]) for r in out["transcripts"].collect())
    assert texts == [("both", 1, "microphone"), ("both", 2, "system"), ("half", 1, "microphone")]


def _backend(batch: pd.DataFrame) -> pd.Series:
    rows = []
    for r in batch.itertuples():
        segment = {"start": 0.0, "end": r.duration, "text": f" seg {r.chunk_index} "}
        rows.append(json.dumps({"text": f" part {r.chunk_index} ", "segments": [segment]}))
    return pd.Series(rows)


@pytest.mark.parametrize("limit", [44 + 2 * 1000, 10**6])
def test_backend_over_split_and_whole_files(spark, tmp_path, limit):
    providers.register_transcriber("test", _backend)
    providers.register_summariser("test", lambda name, parts: providers.Note("\n".join(parts).upper(), f"On {name}", ["call back"]))
    out = fleet.process_batch(
        spark, f"file://{tmp_path}", 3, *_inputs(spark), transcriber="test", summariser="test",
        mix_down=False, max_upload_bytes=limit,
    )
    rows = {(r.session_id, r.channel): r for r in out["transcripts"].collect()}
    mic = rows["both", "microphone"]
    if limit == 10**6:
        assert mic.text == " part 0 " and json.loads(mic.raw_response)["text"] == " part 0 "
    else:
        assert mic.text == "part 0\npart 1\npart 2\npart 3"
        assert [round(s.start, 6) for s in mic.segments] == [0.0, 0.0625, 0.125, 0.1875]
        assert [s.text for s in mic.segments] == [f"seg {i}" for i in range(4)]
    found = _by(out["notes"], "session_id")
    assert found["both"].summary.startswith("[MICROPHONE] ") and "[SYSTEM] " in found["both"].summary
    assert (found["half"].title, found["half"].action_items) == ("On Meeting half", ["call back"])


def _lengths(batch: pd.DataFrame) -> pd.Series:
    return pd.Series([f"{c} {len(x)} {float(np.sum(x)):.3f}" for c, x in zip(batch["channel"], batch["samples"], strict=True)])


def test_a_backend_hears_mixes_and_raw_channels(spark, tmp_path):
    providers.register_transcriber("hears", _lengths, hears=True)
    for batch, mixed in ((1, True), (2, False)):
        out = fleet.process_batch(
            spark, f"file://{tmp_path}", batch, *_inputs(spark), transcriber="hears", summariser=None, mix_down=mixed, cell_frames=1600
        )
        heard = sorted((r.session_id, r.text) for r in out["transcripts"].collect())
        if mixed:
            # The mix ends with its shortest source; the line of "half" sums up to half its frames times its first value.
            assert [(s, t.split()[:2]) for s, t in heard] == [("both", ["mix", "3200"]), ("half", ["mix", "800"])]
            assert abs(float(heard[1][1].split()[2]) - 200) < 0.01
        else:
            assert [t.split()[:2] for _, t in heard] == [["microphone", "3200"], ["system", "4800"], ["microphone", "800"]]


def test_recordings_exist_where_the_session_says(spark, tmp_path):
    out = fleet.process_batch(spark, str(tmp_path), 1, *_inputs(spark), cell_frames=1600, wav_frames=2000, transcriber=None)
    files = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.wav"))
    assert "half/raw/microphone.wav" in files and "half/processed/mix.wav" in files
    assert [f for f in files if f.startswith("both/raw/s")] == [f"both/raw/system.chunk00{i}.at{2000 * i}.wav" for i in range(3)]
    session = _by(out["sessions"], "id")["half"]
    assert session.mix_path == f"file://{tmp_path}/half/processed/mix.wav"
    assert session.audio_paths["microphone"] == f"file://{tmp_path}/half/raw/microphone.wav"


def test_one_broken_session_keeps_its_channels(spark, tmp_path):
    requests, channels, chunks = _inputs(spark)
    broken = chunks.filter("NOT (session_id = 'both' AND channel = 'system' AND chunk_idx = 1)")
    out = fleet.process_batch(spark, f"file://{tmp_path}", 1, requests, channels, broken, cell_frames=1600)
    assert [tuple(r) for r in out["errors"].collect()] == [("both", "system", "frames missing before 3200")]
    sessions = _by(out["sessions"], "id")
    assert sessions["both"].mix_path is None and sessions["half"].mix_path.endswith("mix.wav")
    said = sorted((r.session_id, r.text.split(" from ")[1].split(". ")[0]) for r in out["transcripts"].collect())
    assert said == [("both", "microphone.wav"), ("both", "system.wav"), ("half", "mix.wav")]
    # Both transcripts carry one channel label: the last one written is noted.
    assert "from system.wav" in _by(out["notes"], "session_id")["both"].summary


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = fleet.process_batch(spark, root, 1, *_inputs(spark), cell_frames=1600)
    before = {k: sorted(map(str, v.collect())) for k, v in first.items()}
    again = fleet.process_batch(spark, root, 1, *_inputs(spark), cell_frames=1600)
    assert {k: sorted(map(str, v.collect())) for k, v in again.items()} == before
    assert sorted(map(str, store.read_log(spark, root, "transcripts").collect())) == before["transcripts"]
    later = fleet.process_batch(spark, root, 2, *_inputs(spark), mix_down=False)
    assert {r.mix_path for r in later["sessions"].collect()} == {None}
    everything = store.read_log(spark, root, "transcripts")
    assert sorted((r.session_id, r.row_id) for r in everything.collect()) == [("both", 1), ("both", 2), ("both", 3), ("half", 1), ("half", 2)]
    outcome = fleet.outcomes(spark, root, spark.createDataFrame([("half",)], "id string")).collect()
    assert [(r.id, r.channel, r.text.split(" from ")[1].split(". ")[0]) for r in outcome] == [("half", "mixed", "microphone.wav")]


def _spoken(spark, rows):
    return spark.createDataFrame(
        [(i + 1, i + 1, 0, s, c, t, [], None) for i, (s, c, t) in enumerate(rows)], schemas.TRANSCRIPTS
    )


def test_notes_of_empty_texts(spark):
    spoken = _spoken(spark, [("s", "a", ""), ("s", "b", "")])
    sessions = spark.createDataFrame([("s", "N")], "id string, name string")
    assert notes.default_notes(sessions, spoken).collect()[0].summary == "\n"
    asked = providers.write_notes(sessions, spoken, lambda name, parts: providers.Note(str(list(parts)))).collect()[0]
    assert (asked.title, asked.summary, asked.action_items) == ("Notes for N", "['']", [])


@pytest.mark.parametrize("page_rows", [1, 3, 1000])
def test_notes_do_not_depend_on_the_cut_of_the_prompt(spark, page_rows):
    spoken = _spoken(spark, [("s", "a", f"line {i}") for i in range(20)] + [("t", "b", "one")])
    sessions = spark.createDataFrame([("s", "N"), ("t", "M")], "id string, name string")
    calls = providers.write_notes(
        sessions, spoken, lambda name, parts: providers.Note("\n".join(parts), None, [name]), page_rows=page_rows
    )
    found = _by(calls, "session_id")
    assert found["s"].summary == "\n".join(f"[a] line {i}" for i in range(20)) and found["t"].summary == "[b] one"
    # A backend may stop reading early.
    early = providers.write_notes(sessions, spoken, lambda name, parts: providers.Note(next(parts)[:10]), page_rows=page_rows)
    assert _by(early, "session_id")["s"].summary == "[a] line 0"


def test_updates_of_a_transcription(spark):
    manifest = spark.createDataFrame(
        [("s", "mic", i, 0.0, 1.0) for i in range(3)] + [("t", "mic", 0, 0.0, 1.0)],
        "session_id string, channel string, chunk_index bigint, start double, duration double",
    )
    backend = providers.Transcriber(lambda batch: batch["session_id"].map({"s": "word", "t": " "}))
    seen = providers.updates(providers.answers(manifest, backend)).collect()
    assert sorted((r.session_id, r.is_final, r.text_length, r.n_entries) for r in seen) == [
        ("s", False, 4, 1), ("s", False, 9, 2), ("s", False, 14, 3), ("s", True, 14, 3), ("t", False, 0, 1)
    ]
    with pytest.raises(ValueError):
        providers.answers(manifest, providers.Transcriber(_lengths, hears=True))

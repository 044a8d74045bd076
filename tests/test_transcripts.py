import json

import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import codec
from tapeloom.operators import notes, store, transcripts


def _chunks(spark, rows):
    return spark.createDataFrame(rows, schemas.CHUNK_RESPONSES)


#: What is said in three chunks of uneven length.
SPOKEN = ["The tide is low.", "Boats wait", "until noon"]
LENGTHS = [2.25, 0.5, 4.0]


def _answer(i, text=None):
    """A response with one timed segment in the middle of its chunk."""
    text = SPOKEN[i % 3] if text is None else text
    return json.dumps({"text": text, "segments": [{"start": 0.125, "end": 0.375, "text": f" remark {i} "}]})


def _parsed(spark, rows):
    return transcripts.parse_responses(transcripts.with_offsets(_chunks(spark, rows)))


def test_three_chunks_merge(spark):
    rows = [("s", "mic", i, -1.0, LENGTHS[i], _answer(i)) for i in (2, 0, 1)]
    row = transcripts.merge_chunks(_parsed(spark, rows)).collect()[0]
    assert row.text == "The tide is low.\nBoats wait\nuntil noon"
    assert [(s.start, s.end, s.text) for s in row.segments] == [
        (0.125, 0.375, "remark 0"), (2.375, 2.625, "remark 1"), (2.875, 3.125, "remark 2")
    ]
    raw = json.loads(row.raw_response)
    assert list(raw) == ["chunks", "text"] and raw["text"] == row.text
    assert [(c["start"], c["duration"]) for c in raw["chunks"]] == [(0.0, 2.25), (2.25, 0.5), (2.75, 4.0)]
    assert [c["text"] for c in raw["chunks"]] == SPOKEN
    assert raw["chunks"][2]["raw_response"] == json.loads(_answer(2))


def test_blank_texts_null_times_and_missing_responses(spark):
    untimed = json.dumps({"text": " a ", "segments": [{"start": None, "end": 2, "text": " x "}]})
    rows = [
        ("s", "mic", 0, 0.0, 1.5, None),
        ("s", "mic", 1, 0.0, 1.5, " \n "),
        ("s", "mic", 2, 0.0, 1.5, untimed),
    ]
    row = transcripts.merge_chunks(_parsed(spark, rows)).collect()[0]
    assert row.text == "a"
    assert [tuple(s) for s in row.segments] == [(None, 5.0, "x")]
    chunks = json.loads(row.raw_response)["chunks"]
    assert [c["text"] for c in chunks] == ["", " \n ", " a "]
    assert "raw_response" not in chunks[0] and chunks[1]["raw_response"] == {"text": " \n "}


def test_all_blank_has_no_raw_text_and_no_chunks_gives_empty(spark):
    parsed = _parsed(spark, [("s", "mic", 0, 0.0, 1.0, "  ")])
    row = transcripts.merge_chunks(parsed).collect()[0]
    assert row.text == "" and "text" not in json.loads(row.raw_response)
    targets = spark.createDataFrame([("s", "mic"), ("s", "sys")], "session_id string, channel string")
    empty = transcripts.empty_transcripts(targets, parsed).collect()
    assert [(r.channel, r.part, r.text, r.segments, r.raw_response) for r in empty] == [("sys", 0, "", [], None)]


def test_a_recording_sent_whole_keeps_text_and_response(spark):
    parsed = _parsed(spark, [("s", "mic", 0, 0.0, 1.0, '{"text": " as sent "}')]).withColumn("is_whole", F.lit(True))
    row = transcripts.merge_chunks(parsed).collect()[0]
    assert (row.text, row.raw_response) == (" as sent ", '{"text": " as sent "}')


TEXTS = ["one", " ", "two  ", "", "three", "four", "\n", "five"]


@pytest.mark.parametrize("page_rows", [1, 2, 3, 100])
def test_partials_are_prefixes_of_the_whole(spark, page_rows):
    rows = [("s", "mic", i, 0.0, 1.0, _answer(i, t)) for i, t in enumerate(TEXTS)]
    parsed = _parsed(spark, rows)
    merged = transcripts.merge_chunks(parsed, page_rows)
    pages = [p for _, p in sorted((r.part, r) for r in merged.collect())]
    whole = "\n".join(p.text for p in pages if p.text)
    assert whole == "one\ntwo\nthree\nfour\nfive"
    partials = transcripts.running_partials(parsed, page_rows)
    sizes = {r.chunk_index: r for r in partials.collect()}
    full = {}
    for r in transcripts.partial_texts(partials, merged).collect():
        full.setdefault(r.chunk_index, []).append(r)
    assert len(full) == len(TEXTS)
    for i in range(len(TEXTS)):
        parts = sorted(full[i], key=lambda r: r.part)
        said = "\n".join(t.strip() for t in TEXTS[: i + 1] if t.strip())
        assert "\n".join(p.text for p in parts if p.text) == said == whole[: sizes[i].text_length]
        assert [s.text for p in parts for s in p.segments] == [f"remark {n}" for n in range(i + 1)]
        assert (sizes[i].n_segments, sizes[i].n_entries) == (i + 1, i + 1)
        entries = [c for p in parts for c in json.loads(p.raw_response)["chunks"]]
        assert [c["text"] for c in entries] == TEXTS[: i + 1] and [c["start"] for c in entries] == list(range(i + 1))
        assert "text" not in json.loads(parts[-1].raw_response)


def _rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def _log(spark, transcripts_given):
    """A transcripts log: (session, channel, texts of the parts, segments of the parts), in write order."""
    rows, row_id = [], 0
    for session, channel, texts, segments in transcripts_given:
        first = row_id + 1
        for part, text in enumerate(texts):
            row_id += 1
            rows.append((row_id, first, part, session, channel, text, segments[part] if segments else [], None))
    return spark.createDataFrame(rows, schemas.TRANSCRIPTS).repartition(3)


@pytest.mark.parametrize("page_rows", [1, 2, 3])
def test_pages_show_nowhere(spark, page_rows):
    """Everything made from a merged transcript is the same for any page length."""
    rows = [("s", c, i, 0.0, 1.0, _answer(i, t)) for c, shift in (("b", 0), ("a", 3)) for i, t in enumerate(TEXTS[shift:])]
    rows += [("s", "quiet", i, 0.0, 1.0, " ") for i in range(5)]
    parsed = _parsed(spark, rows)
    results = []
    for size, pieces in ((page_rows, 2), (1000, 1000)):
        new = store.numbered_transcripts(transcripts.merge_chunks(parsed, size), ["channel"])
        assert [r.part for r in new.orderBy("row_id").collect()][0] == 0
        latest = store.latest_per_channel(new)
        texts = {}
        for r in latest.orderBy("part").collect():
            texts.setdefault(r.channel, []).append(r.text)
        joined = lambda df, name, gap: gap.join(r[name] for r in df.orderBy("part").collect())
        results.append((
            {c: "\n".join(t for t in parts if t) for c, parts in texts.items()},
            joined(transcripts.render_sessions(latest, pieces), "content", ""),
            joined(notes.combined_texts(latest, pieces), "combined", "\n"),
            joined(notes.prompts(latest, pieces), "prompt", "\n"),
            notes.summaries(latest).first().summary,
            _rows_of(transcripts.final_sizes(transcripts.merge_chunks(parsed, size)), "channel", "text_length", "n_segments", "n_entries", "has_text"),
        ))
    assert results[0] == results[1]
    assert results[1][1].startswith("[a]\n    0.12-  0.38s  remark 0\n") and results[1][1].endswith("[quiet]")
    assert results[1][2] == "three\nfour\nfive\none\ntwo\nthree\nfour\nfive\n"
    assert results[1][3] == "[a] three\nfour\nfive\n[b] one\ntwo\nthree\nfour\nfive"


def test_a_shorter_new_transcript_leaves_no_old_parts(spark):
    log = _log(spark, [("s", "mic", ["x", "y", "z"], None), ("s", "mic", ["new", "again"], None), ("t", "mic", ["only"], None)])
    assert _rows_of(store.latest_per_channel(log), "session_id", "part", "text") == [("s", 0, "new"), ("s", 1, "again"), ("t", 0, "only")]


def test_numbers_go_on_where_the_log_ends(spark):
    log = _log(spark, [("s", "mic", ["x", "y"], None)])
    new = transcripts.merge_chunks(_parsed(spark, [(s, "mic", i, 0.0, 1.0, _answer(i)) for s in "st" for i in range(3)]), 2)
    got = store.numbered_transcripts(new, ["channel"], log)
    assert _rows_of(got, "session_id", "part", "row_id", "transcript_id") == [("s", 0, 3, 3), ("s", 1, 4, 3), ("t", 0, 1, 1), ("t", 1, 2, 1)]


def test_offsets_add_up_earlier_durations(spark):
    rows = [("s", c, i, 0.0, d, None) for c in ("a", "b") for i, d in enumerate([1.0, 0.5, 2.0])]
    got = transcripts.with_offsets(_chunks(spark, rows)).orderBy("channel", "chunk_index").collect()
    assert [r.start for r in got] == [0.0, 1.0, 1.5] * 2


def test_only_a_repeating_final_record_is_held_back(spark):
    rows = [("s", 1, "a", None), ("s", 2, "a", None), ("s", 3, "a", 1), ("t", 1, "x", None), ("u", 1, None, None), ("v", 1, "b", 2)]
    updates = spark.createDataFrame(rows, "session_id string, seq bigint, text string, n int")
    finals = spark.createDataFrame(
        [("s", "a", 1), ("t", "x", 0), ("u", None, None), ("v", "c", 2), ("w", "", None)], "session_id string, text string, n int"
    )
    got = transcripts.emit_if_changed(updates, finals, ["session_id"], "seq", ["text", "n"]).collect()
    assert sorted((r.session_id, r.seq) for r in got if not r.is_final) == [("s", 1), ("s", 2), ("s", 3), ("t", 1), ("u", 1), ("v", 1)]
    assert sorted((r.session_id, r.seq, r.text, r.n) for r in got if r.is_final) == [("t", None, "x", 0), ("v", None, "c", 2), ("w", None, "", None)]


def _event(**fields):
    return "data: " + json.dumps(fields)


EVENT_LINES = [
    ": opening remark",
    "",
    _event(type="transcript.text.delta", delta="\t"),
    _event(type="transcript.text.delta", delta=" Sea"),
    "retry: 50",
    _event(type="transcript.text.delta", delta=""),
    'data: {"type":"transcript.text.delta","delta":"lost"} behind',
    "data: [1]",
    _event(type="transcript.text.delta", delta="weed\n"),
    "data:[DONE]",
    "data: {cut",
    _event(type="transcript.text.done", text="Kelp"),
    _event(type="response.completed"),
    _event(type="transcript.text.delta", delta="after the end"),
]


def test_event_fold(spark):
    rows = [("s", "mic", i, line) for i, line in enumerate(EVENT_LINES)]
    events = spark.createDataFrame(rows, schemas.TRANSCRIPT_EVENTS)
    folded = transcripts.fold_events(events)
    whole = transcripts.folded_texts(folded, page_rows=2).orderBy("part").collect()
    raw = "".join(r.raw_text for r in whole)
    updates = folded.filter("emitted").orderBy("seq").collect()
    assert [raw[: r.raw_end].strip() for r in updates] == ["Sea", "Seaweed", "Seaweed\nKelp"]
    assert [r.n_segments for r in updates] == [1, 2, 3]
    assert [(r.position, r.emitted) for r in folded.orderBy("seq").collect()][0] == (0, False)


CLOSINGS = [
    (None, "Seaweed\nKelp", [], None),
    ('{"text":" Algae "}', " Algae ", [], '{"text":" Algae "}'),
    ('{"segments":[{"start":1,"text":" k "}]}', "Seaweed\nKelp", [(1.0, None, "k")], '{"segments":[{"start":1,"text":" k "}]}'),
    ('{"text":null}', "Seaweed\nKelp", [], '{"text":null}'),
    ("no object", "Seaweed\nKelp", [], None),
    ('["Algae"]', "Seaweed\nKelp", [], None),
]


@pytest.mark.parametrize("page_rows", [1, 2, 100])
@pytest.mark.parametrize("response, text, segments, raw", CLOSINGS)
def test_final_record(spark, page_rows, response, text, segments, raw):
    rows = [("s", "mic", i, line) for i, line in enumerate(EVENT_LINES)]
    folded = transcripts.fold_events(spark.createDataFrame(rows, schemas.TRANSCRIPT_EVENTS))
    closings = spark.createDataFrame([("s", "mic", response), ("t", "mic", response)], "session_id string, channel string, response string")
    found = transcripts.final_records(folded, closings, page_rows).orderBy("part").collect()
    parts = [r for r in found if r.session_id == "s"]
    assert "".join(r.text for r in parts) == text
    assert [tuple(s) for r in parts for s in r.segments] == segments
    assert [r.raw_response for r in parts if r.raw_response] == ([raw] if raw else [])
    silent = [r for r in found if r.session_id == "t"]
    assert [r.text for r in silent] == [text if response and "Algae" in response and response[0] == "{" else ""]


@pytest.mark.parametrize("stop", [" data: [done] ", 'data: {"type":"response.completed"}'])
def test_stop_lines(spark, stop):
    rows = [("s", "mic", 0, stop), ("s", "mic", 1, _event(type="transcript.text.delta", delta="x"))]
    assert transcripts.fold_events(spark.createDataFrame(rows, schemas.TRANSCRIPT_EVENTS)).count() == 0


RESPONSES = [
    (None, "", [], None),
    ("plain words", "plain words", [], {"text": "plain words"}),
    ("", "", [], None),
    ('{"text": null}', "", [], {"text": None}),
    ('{"text": "a", "segments": "none"}', "a", [], {"text": "a", "segments": "none"}),
    (
        '{"text": " a ", "segments": [" s ", 5, null, true, {"text": " t ", "start": 1, "end": "2.5"}, {"start": 0}]}',
        " a ",
        [(None, None, "s"), (None, None, "5"), (None, None, ""), (None, None, "True"), (1.0, 2.5, "t"), (0.0, None, "")],
        None,
    ),
    ('{"text": 7}', "7", [], {"text": 7}),
    ("[1, 2]", "[1, 2]", [], {"text": "[1, 2]"}),
    ('{"text": "a"} tail', '{"text": "a"} tail', [], {"text": '{"text": "a"} tail'}),
    ('{"text": "a"},{"text": "b"}', '{"text": "a"},{"text": "b"}', [], {"text": '{"text": "a"},{"text": "b"}'}),
    ("{broken", "{broken", [], {"text": "{broken"}),
]


@pytest.mark.parametrize("response, text, segments, raw", RESPONSES)
def test_response_shapes(spark, response, text, segments, raw):
    df = spark.createDataFrame([(response,)], "response string")
    got = df.select(codec.normalise_response(F.col("response")).alias("r")).collect()[0].r
    assert got.text == text
    assert [tuple(s) for s in got.segments] == segments
    if raw is not None or response in (None, ""):
        assert (json.loads(got.raw_response) if got.raw_response else None) == raw


def test_stored_json_edges(spark):
    df = spark.sql("SELECT '' AS empty, CAST(NULL AS STRING) AS missing, '{}' AS nothing, '{\"a\": 1}' AS object")
    row = df.select(
        codec.segments_from_json(F.col("empty")).alias("a"),
        codec.segments_from_json(F.col("missing")).alias("b"),
        codec.items_from_json(F.col("empty")).alias("c"),
        codec.raw_to_store(F.col("nothing")).alias("d"),
        codec.raw_to_store(F.col("object")).alias("e"),
        F.to_json(codec.raw_from_store(F.col("object"))).alias("f"),
        codec.raw_from_store(F.col("empty")).isNull().alias("g"),
        codec.paths_to_json(F.lit(None).cast("map<string,string>")).alias("h"),
    ).collect()[0]
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h) == ([], [], [], None, '{"a": 1}', '{"a":1}', True, "{}")


def test_rendering(spark):
    log = _log(spark, [
        ("s", "b", ["  all \n"], [[(0.0, 1.125, "x"), (None, 2.0, "y")]]),
        ("s", "a", [" only "], None),
        ("s", "c", [""], None),
    ])
    row = transcripts.render_sessions(log).collect()[0]
    assert (row.part, row.content) == (0, "[a]\n  only\n\n[b]\n    0.00-  1.12s  x\n  y\n  Full text:\n    all\n\n[c]")


@pytest.mark.parametrize("texts", [[""], ["", ""], ["x" * 279], ["x" * 280], ["x" * 281], ["a"] * 400, [""] * 600 + ["z"], ["a" * 279, "b"]])
def test_summary_of_many_texts(spark, texts):
    df = _log(spark, [("s", "c", [t], None) for t in texts])
    combined = "\n".join(texts)
    expected = combined[:280] + ("..." if len(combined) > 280 else "") or "No transcript available."
    assert notes.summaries(df).collect()[0].summary == expected
    pages = notes.combined_texts(df, page_rows=100).orderBy("part").collect()
    assert "\n".join(p.combined for p in pages) == combined

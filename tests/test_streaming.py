"""Streams end up where their batch twins do: any order, any restarts."""

import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import schemas
from tapeloom.operators import audio, transcripts
from tapeloom.plans import stream_queries
from tapeloom.streaming import jobs, ordered_state
from tapeloom.streaming.ordered_state import InOrder
from tests.test_transcripts import EVENT_LINES, _answer


class Feed:
    """A folder a stream reads, filled step by step."""

    def __init__(self, spark, root, schema):
        self.spark, self.schema = spark, schema
        self.source, self.sink, self.checkpoint = (f"file://{root}/{n}" for n in ("in", "out", "checkpoint"))
        self.add([])

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, operator, files=None):
        stream = operator(jobs.packet_stream(self.spark, self.source, self.schema, files))
        jobs.drain(stream, self.sink, self.checkpoint)
        return self.spark.read.schema(stream.schema).parquet(self.sink)


def _packets(data, cuts, channel="mic", n_channels=2):
    rows, at = [], 0
    for seq, size in enumerate(cuts):
        rows.append(("s", channel, seq, data[at : at + size], "s16le", 48000, n_channels, False))
        at += size
    rows.append(("s", channel, len(cuts), b"", "s16le", 48000, n_channels, True))
    return rows


def _samples(df):
    return [(r.chunk_idx, r.frame_start, r.n_frames, list(r.samples)) for r in df.orderBy("chunk_idx").collect()]


def test_one_block_of_three_channels(spark, tmp_path):
    feed = Feed(spark, tmp_path, schemas.PCM_PACKETS)
    frames = [[8192, -8192, 0], [24576, -24576, 4096], [-16384, 16384, 1]]
    data = np.array(frames, "<i2").tobytes()
    feed.add(_packets(data, [11, 7], n_channels=3))
    rows = feed.run(lambda s: jobs.rechunk_stream(s, 2)).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.n_frames, r.n_channels, r.error) for r in rows] == [(0, 2, 3, None), (1, 1, 3, None)]
    assert [x for r in rows for x in r.samples] == [v / 32768 for frame in frames for v in frame]


@pytest.mark.parametrize("seed", [1, 2])
def test_rechunk_with_restarts_and_disorder(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = np.random.default_rng(seed).integers(-32768, 32767, 101).astype("<i2").tobytes() + b"!"
    cuts = []
    while sum(cuts) < len(data):
        cuts.append(min(rng.randrange(1, 23), len(data) - sum(cuts)))
    packets = _packets(data, cuts)
    shuffled = packets[:]
    rng.shuffle(shuffled)
    feed = Feed(spark, tmp_path, schemas.PCM_PACKETS)
    third = len(shuffled) // 3
    # Each run is a stop and a restart on the same checkpoint; some packets come twice.
    for part in (shuffled[:third], shuffled[third : 2 * third] + shuffled[:2], shuffled[2 * third :] + packets[:3]):
        feed.add(part)
        got = feed.run(lambda s: jobs.rechunk_stream(s, 5), files=1)
    batch = audio.rechunk(spark.createDataFrame(packets, schemas.PCM_PACKETS), F.lit(5))
    assert _samples(got) == _samples(batch)


def test_nothing_after_the_end(spark, tmp_path):
    feed = Feed(spark, tmp_path, schemas.PCM_PACKETS)
    data = bytes(24)
    packets = _packets(data, [20])
    feed.add(packets + [("s", "mic", 2, bytes(40), "s16le", 48000, 2, False)])
    got = feed.run(lambda s: jobs.rechunk_stream(s, 2))
    assert [r.n_frames for r in got.orderBy("chunk_idx").collect()] == [2, 2, 1]


@pytest.mark.parametrize("page_rows", [3, 100])
def test_partials_equal_batch(spark, tmp_path, page_rows):
    texts = ["one", " ", "two", "", "três 😀", "four"]
    rows = [("s", "mic", i, 0.0, 0.5 + i, _answer(i, t)) for i, t in enumerate(texts)]
    feed = Feed(spark, tmp_path, schemas.CHUNK_RESPONSES)
    for part in (rows[3:5], rows[:2], rows[2:3] + rows[5:]):
        feed.add(part)
        got = feed.run(lambda s: jobs.partials_stream(s, page_rows))
    chunks = spark.createDataFrame(rows, schemas.CHUNK_RESPONSES)
    parsed = transcripts.parse_responses(transcripts.with_offsets(chunks))
    names = ["part", "chunk_index", "appended", "text_length", "n_segments", "n_entries"]
    batch = transcripts.running_partials(parsed, page_rows)
    assert sorted(got.select(*names).collect()) == sorted(batch.select(*names).collect())
    starts = {r.chunk_index: r.start for r in got.collect()}
    assert starts == {r.chunk_index: r.start for r in parsed.collect()}
    assert all(r.segments[0].text == f"remark {r.chunk_index}" for r in got.collect())
    assert {r.chunk_index: r.raw_response for r in got.collect()} == {r.chunk_index: r.raw_response for r in parsed.collect()}


def test_event_fold_equals_batch(spark, tmp_path):
    rows = [(s, "mic", i, line) for s in ("a", "b") for i, line in enumerate(EVENT_LINES)]
    feed = Feed(spark, tmp_path, schemas.TRANSCRIPT_EVENTS)
    for part in (rows[::3], rows[2::3], rows[1::3]):
        feed.add(part)
        got = feed.run(jobs.events_stream)
    batch = transcripts.fold_events(spark.createDataFrame(rows, schemas.TRANSCRIPT_EVENTS))
    updates = got.filter("NOT is_final").select(*batch.columns)
    assert sorted(updates.collect()) == sorted(batch.collect())
    closing = got.filter("is_final").select("session_id", "seq", "raw_end", "n_segments").collect()
    last = batch.groupBy("session_id").agg(F.max("raw_end").alias("raw_end"), F.max("n_segments").alias("n")).collect()
    assert sorted(map(tuple, closing)) == sorted((r.session_id, 12, r.raw_end, r.n) for r in last)


class _Value:
    def __init__(self, log):
        self.held, self.log = None, log

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = tuple(value)
        self.log.append(sum(len(v) if isinstance(v, bytes | bytearray) else 8 for v in value))


class _Map(dict):
    def __init__(self, log):
        self.log = log

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value
        self.log.append(sum(len(v) if isinstance(v, bytes | bytearray) else 8 for v in value))

    def removeKey(self, key):
        del self[key]

    def keys(self):
        return iter(list(super().keys()))

    def iterator(self):
        return iter(list(self.items()))


class _Handle:
    """The state of one key, as a stream would keep it; ``written`` counts the bytes of its updates."""

    def __init__(self):
        self.written, self.timers = [], []

    def getValueState(self, _name, _schema):
        return _Value(self.written)

    def getMapState(self, _name, _key, _value):
        return _Map(self.written)

    def registerTimer(self, at):
        self.timers.append(at)


class _Clock:
    now = 1_000_000

    def getCurrentProcessingTimeInMs(self):
        return self.now


class _Key:
    """One key of an ordered stream, driven by hand: no clock is waited for."""

    def __init__(self, operator, *args, idle_ms=1000):
        caught = {}

        def catch(stream, keys, order, state, initial, output, step, what, close=None, idle_ms=None):
            columns = [c for c in stream.columns if c not in keys]
            names = [*(f.name for f in output.fields), "late"]
            caught["fold"] = InOrder(order, columns, T.StructType(state), initial, names, step, what, close, idle_ms)
            raise LookupError

        kept, jobs.process_in_order = jobs.process_in_order, catch
        try:
            with pytest.raises(LookupError):
                operator(*args, idle_ms=idle_ms)
        finally:
            jobs.process_in_order = kept
        self.fold, self.handle, self.clock = caught["fold"], _Handle(), _Clock()
        self.fold.init(self.handle)

    def send(self, rows, names=None):
        rows = pd.DataFrame(rows, columns=["session_id", "channel", *self.fold.columns] if names is None else names)
        self.handle.written.clear()
        return self._rows(self.fold.handleInputRows(("s", "mic"), iter([rows]), self.clock))

    def quiet(self, ms=1000):
        """Time passes; timers that are due fire."""
        self.clock.now += ms
        due, self.handle.timers[:] = [t for t in self.handle.timers if t <= self.clock.now], [
            t for t in self.handle.timers if t > self.clock.now
        ]
        return [r for _ in due for r in self._rows(self.fold.handleExpiredTimer(("s", "mic"), self.clock, None))]

    def _rows(self, frames):
        out = [f for f in frames if len(f)]
        assert all(list(f.columns) == self.fold.names for f in out)
        return pd.concat(out, ignore_index=True).astype(object).where(lambda x: x.notna(), None).to_dict("records") if out else []


def _only(rows, *names):
    return [[r[n] for n in names] for r in rows]


def _packet_row(seq, size, eof=False):
    return ("s", "mic", seq, bytes(size), "s16le", 8000, 1, eof)


def test_an_idle_channel_is_drained_with_its_held_packets(spark):
    key = _Key(jobs.rechunk_stream, spark.createDataFrame([], schemas.PCM_PACKETS), 2)
    assert _only(key.send([_packet_row(0, 5), _packet_row(1, 2)]), "n_frames") == [[2]]
    assert _only(key.send([_packet_row(4, 4), _packet_row(6, 3)]), "n_frames") == []
    drained = key.quiet()
    assert _only(drained, "chunk_idx", "n_frames") == [[1, 2], [2, 2], [3, 1]]
    assert {r["error"] for r in drained} == {"packets missing before 4"}
    # Packets of the gaps come after all, some twice: each is late once; others are repeats.
    late = key.send([_packet_row(n, 2) for n in (3, 2, 3, 5, 4, 1)])
    assert _only(late, "late", "error", "n_frames") == [[n, "packets came late", None] for n in (2, 3, 5)]
    assert key.send([_packet_row(3, 2)]) == []
    quiet = _Key(jobs.rechunk_stream, spark.createDataFrame([], schemas.PCM_PACKETS), 2)
    assert quiet.send([_packet_row(1, 4)]) == []
    assert _only(quiet.quiet(), "n_frames", "error") == [[2, "packets missing before 1"]]
    assert _only(quiet.send([_packet_row(0, 2)]), "late") == [[0]]


def test_an_idle_channel_resumes_with_the_next_chunk(spark):
    key = _Key(jobs.rechunk_stream, spark.createDataFrame([], schemas.PCM_PACKETS), 2)
    assert _only(key.send([_packet_row(0, 6), _packet_row(2, 2)]), "chunk_idx", "n_frames", "error") == [[0, 2, None]]
    assert _only(key.quiet(), "chunk_idx", "n_frames", "error") == [[1, 2, "packets missing before 2"]]
    assert _only(key.send([_packet_row(3, 4)]), "chunk_idx", "n_frames", "error") == [[2, 2, None]]
    assert key.quiet() == []


def test_a_timer_waits_for_a_key_that_is_still_heard_of(spark):
    key = _Key(jobs.rechunk_stream, spark.createDataFrame([], schemas.PCM_PACKETS), 2)
    key.send([_packet_row(0, 2)])
    assert key.quiet(900) == []
    key.send([_packet_row(1, 1)])
    assert key.quiet(900) == [] and len(key.handle.timers) == 1
    assert _only(key.quiet(200), "n_frames") == [[1]] and key.handle.timers == []


@pytest.mark.parametrize("block", [1, 4, 64])
def test_state_written_grows_with_the_rows_of_a_batch(spark, monkeypatch, block):
    """While packet 0 is missing nothing that waits is written again, however much it is."""
    monkeypatch.setattr(ordered_state, "BLOCK", block)
    key = _Key(jobs.rechunk_stream, spark.createDataFrame([], schemas.PCM_PACKETS), 10**6, idle_ms=None)
    written = []
    for batch in range(60):
        assert key.send([_packet_row(1 + 10 * batch + i, 100) for i in range(10)]) == []
        written.append(sum(key.handle.written))
    assert sum(written[40:]) <= 1.3 * sum(written[:20]) and max(written) < (10 + block) * 1500
    assert len(key.fold.waiting) == -(-601 // block) - (block == 1)
    out = key.send([_packet_row(0, 100), _packet_row(601, 0, True)])
    assert _only(out, "n_frames") == [[601 * 50]] and len(key.fold.waiting) == 0


def test_any_order_gives_the_rows_in_order(spark, monkeypatch):
    monkeypatch.setattr(ordered_state, "BLOCK", 4)
    rng = random.Random(7)
    for _ in range(30):
        key = _Key(jobs.events_stream, spark.createDataFrame([], schemas.TRANSCRIPT_EVENTS))
        rows = [("s", "mic", i, False, "x" * (i % 3 + 1), True) for i in range(50)]
        sent = rows + rng.choices(rows, k=20)
        rng.shuffle(sent)
        got = []
        while sent:
            n = rng.randrange(1, 12)
            part, sent = sent[:n], sent[n:]
            got += key.send(part)
        assert [r["seq"] for r in got] == list(range(50)) and len(key.fold.waiting) == 0
        assert got[-1]["raw_end"] == sum(len(r[4]) for r in rows)
    # Whatever is missing at the end is passed over, and late when it comes.
    key = _Key(jobs.events_stream, spark.createDataFrame([], schemas.TRANSCRIPT_EVENTS))
    gone = {3, 4, 17, 30}
    got = key.send([r for r in rows if r[2] not in gone]) + key.quiet()
    assert [r["seq"] for r in got if not r["is_final"]] == [i for i in range(50) if i not in gone]
    assert _only(key.send([rows[i] for i in (30, 4, 2, 17)]), "late") == [[4], [17], [30]]
    assert _only(key.send([rows[3], rows[30]]), "late") == [[3]] and len(key.fold.passed) == 0


def test_a_stream_lands_in_the_order_of_arrival(spark):
    """A key that is heard of for a while lies in a file or two, so few micro-batches touch it."""
    rows = [(f"s{i // 50}", "mic", i % 50, "x", i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "session_id string, channel string, seq bigint, line string, event_id bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = stream_queries._landed(frame.repartition(8, "seq"), schemas.TRANSCRIPT_EVENTS, "events", "event_id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    seen = spark.read.parquet(path).selectExpr("session_id", "input_file_name() AS file").distinct()
    assert seen.select("file").distinct().count() > 4
    assert seen.groupBy("session_id").count().where("count > 2").count() == 0


def test_an_idle_event_stream_is_closed(spark):
    key = _Key(jobs.events_stream, spark.createDataFrame([], schemas.TRANSCRIPT_EVENTS))
    out = key.send([("s", "mic", 0, False, "ab", True), ("s", "mic", 1, False, None, None)])
    assert _only(out, "seq", "raw_end", "n_segments") == [[0, 2, 1]]
    assert _only(key.quiet(), "seq", "raw_end", "n_segments", "is_final") == [[1, 2, 1, True]]


def test_idle_partials_give_what_waits_and_go_on(spark):
    key = _Key(jobs.partials_stream, spark.createDataFrame([], schemas.CHUNK_RESPONSES))
    row = lambda i: ("s", "mic", i, 0.5, "ab", 1, "[]", "{}")
    shown = "chunk_index", "start", "text_length", "n_entries", "error"
    assert _only(key.send([row(0), row(3), row(2)]), *shown) == [[0, 0.0, 2, 1, None]]
    lost = "responses missing before 2"
    assert _only(key.quiet(), *shown) == [[2, 0.5, 5, 2, lost], [3, 1.0, 8, 3, lost]]
    assert _only(key.send([row(3), row(4)]), *shown) == [[4, 1.5, 11, 4, None]]
    assert key.quiet() == []
    assert _only(key.send([row(5), row(1)]), "late", *shown) == [
        [1, None, None, None, None, "responses came late"], [None, 5, 2.0, 14, 5, None]
    ]


def test_idle_events_give_what_waits_and_go_on(spark):
    key = _Key(jobs.events_stream, spark.createDataFrame([], schemas.TRANSCRIPT_EVENTS))
    row = lambda i, stop=False: ("s", "mic", i, stop, None if stop else "ab", True)
    shown = "seq", "position", "raw_end", "is_final", "error"
    assert _only(key.send([row(0), row(2), row(3)]), *shown) == [[0, 0, 2, False, None]]
    lost = "events missing before 2"
    assert _only(key.quiet(), *shown) == [[2, 1, 4, False, lost], [3, 2, 6, False, lost], [3, 3, 6, True, lost]]
    assert _only(key.send([row(4)]), *shown) == [[4, 3, 8, False, None]]
    assert _only(key.quiet(), *shown) == [[4, 4, 8, True, None]]
    assert key.send([row(6, stop=True)]) == []
    assert _only(key.quiet(), *shown) == [[6, 4, 8, True, "events missing before 6"]]
    assert key.send([row(7)]) == [] and key.quiet() == []


def test_a_running_stream_gives_late_rows_apart(spark, tmp_path):
    """An always-on query over a real source: a timeout passes a gap over, its packet comes later."""
    feed = Feed(spark, tmp_path, schemas.PCM_PACKETS)
    stream = jobs.rechunk_stream(jobs.packet_stream(spark, feed.source, feed.schema), 2, idle_ms=1500)
    query = jobs.start(stream, feed.sink, feed.checkpoint, processingTime="500 milliseconds")

    def wait(ready):
        until = time.time() + 60
        while not ready() and time.time() < until:
            assert query.exception() is None
            time.sleep(0.5)
        assert ready()

    def chunks():
        rows = jobs.on_time(spark, feed.sink, stream.schema).collect()
        return sorted((r.chunk_idx, r.n_frames, r.error) for r in rows)

    try:
        feed.add([_packet_row(0, 4), _packet_row(2, 6)])
        lost = "packets missing before 2"
        wait(lambda: os.path.isdir(f"{tmp_path}/out/is_late=false"))
        wait(lambda: chunks() == [(0, 2, None), (1, 2, lost), (2, 1, lost)])
        query.stop()
        query = jobs.start(stream, feed.sink, feed.checkpoint, processingTime="500 milliseconds")  # a restart keeps the gap
        feed.add([_packet_row(1, 2), _packet_row(2, 6), _packet_row(3, 4)])
        wait(lambda: len(chunks()) == 4)
    finally:
        query.stop()
    assert chunks()[3] == (3, 2, None)
    assert [tuple(r) for r in jobs.late_rows(spark, feed.sink, stream.schema).collect()] == [("s", "mic", 1)]


def test_only_streams_with_a_timeout_have_late_rows(spark, tmp_path):
    for operator, schema in ((lambda s, **k: jobs.rechunk_stream(s, 5, **k), schemas.PCM_PACKETS), (jobs.events_stream, schemas.TRANSCRIPT_EVENTS)):
        stream = jobs.packet_stream(spark, f"file://{tmp_path}", schema)
        assert operator(stream, idle_ms=1000).columns == [*operator(stream).columns, "late"]
    with pytest.raises(ValueError, match="close"):
        ordered_state.process_in_order(stream, jobs.KEY, "seq", [], (), schema, None, "rows", idle_ms=5)


def test_live_frames_after_pause(spark, tmp_path):
    schema = "session_id string, channel string, n_frames int"
    source, checkpoint, out = (f"file://{tmp_path}/{n}" for n in ("in", "checkpoint", "out"))
    seen = {}

    def keep(batch, _epoch):
        seen.update({(r.session_id, r.channel): r.frames for r in batch.collect()})

    for rows in ([("s", "mic", 5)], [("s", "mic", 7), ("s", "sys", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.deliver(jobs.live_frames(stream), keep, out, checkpoint, "update").awaitTermination()
    assert seen == {("s", "mic"): 12, ("s", "sys"): 1}


def test_failing_callbacks_leave_dead_letters(spark, tmp_path):
    source, checkpoint, dead = (f"file://{tmp_path}/{n}" for n in ("in", "checkpoint", "dead"))
    spark.range(6).repartition(3).write.parquet(source)
    good = []

    def callback(batch, epoch):
        if epoch == 1:
            raise RuntimeError("broken")
        good.append(batch.count())

    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.deliver(stream, callback, dead, checkpoint).awaitTermination()
    lost = spark.read.parquet(dead)
    assert sum(good) + lost.count() == 6 and {r.batch for r in lost.collect()} == {1}
    assert jobs.dead_letters(spark, dead) == [1]


def test_letters_are_replayed_in_order_without_double_rows(spark, tmp_path):
    """A callback fails twice, the second time after it has written; then it goes through."""
    source, checkpoint, dead, out = (f"file://{tmp_path}/{n}" for n in ("in", "checkpoint", "dead", "out"))
    spark.range(8).repartition(4).write.parquet(source)
    sink, tries = jobs.table_sink(out), []

    def callback(batch, epoch):
        tries.append(epoch)
        if epoch in (1, 2) and tries.count(epoch) == 1:
            raise RuntimeError("away")
        sink(batch, epoch)
        if epoch == 1 and tries.count(1) == 2:
            raise RuntimeError("lost after writing")

    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.deliver(stream, callback, dead, checkpoint).awaitTermination()
    assert jobs.dead_letters(spark, dead) == [1, 2] and len(tries) == 4
    # The first letter fails once more: the second does not overtake it.
    assert jobs.replay(spark, dead, callback) == [] and jobs.dead_letters(spark, dead) == [1, 2]
    assert jobs.replay(spark, dead, callback) == [1, 2] and tries[4:] == [1, 1, 2]
    assert jobs.dead_letters(spark, dead) == [] and jobs.delivered_later(spark, dead) == [1, 2]
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))
    assert jobs.replay(spark, dead, callback) == [] and len(tries) == 7


def test_dead_letters_are_found(spark, tmp_path):
    assert jobs.dead_letters(spark, f"file://{tmp_path}/none") == []
    (tmp_path / "dead" / "batch=3").mkdir(parents=True)
    assert jobs.dead_letters(spark, f"file://{tmp_path}/dead") == [3]

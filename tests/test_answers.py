import gzip
import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom import answers, providers
from tapeloom.plans import fleet
from tests.test_fleet import _inputs

MANIFEST = "session_id string, channel string, chunk_index bigint, start double, duration double"


def _manifest(spark, sessions=("a", "b"), chunks=5):
    rows = [(s, "mic", i, 0.0, 1.0) for s in sessions for i in range(chunks)]
    return spark.createDataFrame(rows, MANIFEST)


def _backend(folder, broken=(), whole_task=None):
    """Writes a line for every chunk that it is asked for; some chunks it cannot do."""

    def call(batch: pd.DataFrame) -> pd.Series:
        out = []
        for r in batch.itertuples():
            with open(f"{folder}/calls", "a") as log:
                log.write(f"{r.session_id}{r.chunk_index}\n")
            if (r.session_id, r.chunk_index) in broken:
                raise ValueError(f"cannot hear {r.session_id}{r.chunk_index}")
            out.append(json.dumps({"text": f"said {r.session_id}{r.chunk_index}"}))
        if whole_task and not os.path.exists(whole_task):
            open(whole_task, "w").close()
            os._exit(1)  # the worker dies before the task has given anything
        return pd.Series(out, index=batch.index)

    return call


def _calls(folder):
    path = f"{folder}/calls"
    lines = open(path).read().split() if os.path.exists(path) else []
    if lines:
        os.truncate(path, 0)
    return sorted(lines)


def _answers(df):
    return sorted((r.session_id, r.chunk_index, r.response, r.error) for r in df.collect())


def test_only_chunks_without_an_answer_are_asked_for(spark, tmp_path):
    ledger, manifest = f"{tmp_path}/ledger", _manifest(spark)
    first = _answers(answers.ask(manifest, _backend(tmp_path, {("a", 2)}), ledger, attempts=2, parallelism=2))
    assert [r for r in first if r[3]] == [("a", 2, None, "ValueError: cannot hear a2")]
    assert [r[2] for r in first if not r[3]] == [f'{{"text": "said {s}{i}"}}' for s in "ab" for i in range(5) if (s, i) != ("a", 2)]
    assert set(_calls(tmp_path)) == {f"{s}{i}" for s in "ab" for i in range(5)}
    assert [tuple(r) for r in answers.failures(spark, ledger).collect()] == [("a", "mic", 2, "ValueError: cannot hear a2", 2)]
    # The next run pays for the failed chunk and a new one.
    more = manifest.unionByName(_manifest(spark, ("c",), 1))
    second = _answers(answers.ask(more, _backend(tmp_path), ledger))
    assert _calls(tmp_path) == ["a2", "c0"] and len(second) == 11 and not [r for r in second if r[3]]
    assert answers.failures(spark, ledger).count() == 0
    assert _answers(answers.ask(more, _backend(tmp_path), ledger)) == second and _calls(tmp_path) == []


def test_one_bad_chunk_costs_its_batch_once(spark, tmp_path):
    manifest = _manifest(spark, ("a",), 6)
    answers.ask(manifest, _backend(tmp_path, {("a", 3)}), f"{tmp_path}/ledger", attempts=3, parallelism=1).collect()
    calls = _calls(tmp_path)
    assert calls.count("a3") == 1 + 3 and all(calls.count(f"a{i}") <= 2 for i in range(6) if i != 3)


def test_answers_of_a_task_that_died_are_found_again(spark, tmp_path, monkeypatch):
    """The first batch of a task is answered, the second kills it; the repeated run asks for the second only."""
    ledger, died = f"{tmp_path}/ledger", f"{tmp_path}/died"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        manifest = _manifest(spark, ("a",), 6)
        seen = _backend(tmp_path)

        def fails_later(batch):
            if os.path.exists(died):
                return seen(batch)
            if os.path.exists(f"{tmp_path}/calls"):
                open(died, "w").close()
                os._exit(1)
            return seen(batch)

        with pytest.raises(Exception, match="(?i)worker|crashed|exit"):
            answers.ask(manifest, fails_later, ledger, parallelism=1).collect()
        before = _calls(tmp_path)
        assert len(before) == 3
        got = _answers(answers.ask(manifest, fails_later, ledger, parallelism=1))
        assert len(got) == 6 and sorted(before + _calls(tmp_path)) == [f"a{i}" for i in range(6)]
        assert not os.path.exists(f"{ledger}/open")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_answers_of_a_call_are_one_file(spark, tmp_path):
    """A run's small files grow with its calls, not with its chunks; a line torn by a dying task is asked for again."""
    ledger = f"{tmp_path}/ledger"
    backend = _backend(tmp_path)

    def call(batch):
        seen = sum(len(names) for _, _, names in os.walk(f"{ledger}/open"))
        with open(f"{tmp_path}/files", "a") as log:
            log.write(f"{seen}\n")
        return backend(batch)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        answers.ask(_manifest(spark, ("a",), 60), call, ledger, parallelism=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [int(n) for n in open(f"{tmp_path}/files").read().split()] == [0, 1, 2]
    # A run that died: one whole line, one torn.
    again, folder = f"{tmp_path}/again", f"{tmp_path}/again/open/dead/0"
    rows = spark.read.parquet(f"{ledger}/runs").where("chunk_index < 2").orderBy("chunk_index").toJSON().collect()
    os.makedirs(folder)
    with open(f"{folder}/x.json", "w") as torn:
        torn.write(rows[0] + "\n" + rows[1][:-12])
    _calls(tmp_path)
    got = _answers(answers.ask(_manifest(spark, ("a",), 2), backend, again, parallelism=1))
    assert _calls(tmp_path) == ["a1"] and [r[2] for r in got] == ['{"text": "said a0"}', '{"text": "said a1"}']


def test_other_contents_are_asked_for(spark, tmp_path):
    ddl = MANIFEST + ", samples array<float>"
    make = lambda x: spark.createDataFrame([("a", "mic", 0, 0.0, 1.0, [x, 0.5])], ddl)
    for x, want in ((0.25, ["a0"]), (0.25, []), (0.75, ["a0"])):
        answers.ask(make(x), _backend(tmp_path), f"{tmp_path}/ledger").collect()
        assert _calls(tmp_path) == want
    rows = [("a", "mic", i * 4, 4, [float(i)] * 4) for i in range(5)]
    chunks = spark.createDataFrame(rows, "session_id string, channel string, frame_start bigint, n_frames int, samples array<float>")
    one = answers.contents(chunks).collect()
    assert answers.contents(chunks.repartition(3)).collect() == one
    assert answers.contents(chunks.where("frame_start > 0")).collect() != one


def test_a_batch_goes_on_where_its_backend_failed(spark, tmp_path):
    broken = {("both", 1)}
    providers.register_transcriber("flaky", lambda batch: _backend(tmp_path, broken)(batch))
    run = lambda: fleet.process_batch(
        spark, f"file://{tmp_path}/root", 1, *_inputs(spark), transcriber="flaky", summariser=None, mix_down=False,
        max_upload_bytes=44 + 2 * 1000,
    )
    out = run()
    assert {(r.session_id, r.channel) for r in out["transcripts"].collect()} == {("half", "microphone")}
    failed = sorted((r.session_id, r.channel, r.chunk_index) for r in out["failed"].collect())
    assert failed == [("both", "microphone", 1), ("both", "system", 1)]
    _calls(tmp_path)
    broken = set()
    providers.register_transcriber("flaky", _backend(tmp_path))
    out = run()
    assert _calls(tmp_path) == ["both1", "both1"] and out["failed"].count() == 0
    said = {(r.session_id, r.channel): r.text for r in out["transcripts"].collect()}
    assert said["both", "microphone"] == "\n".join(f"said both{i}" for i in range(4)) and len(said) == 3


def test_journals_are_packed(spark, tmp_path):
    """What a run keeps until it commits is some bytes an answer, not its whole text and digest."""
    ledger, backend = f"{tmp_path}/ledger", _backend(tmp_path)

    def call(batch):
        found = [f"{at}/{name}" for at, _, names in os.walk(f"{ledger}/open") for name in names]
        with open(f"{tmp_path}/bytes", "a") as log:
            log.write(f"{sum(os.path.getsize(path) for path in found)}\n")
        return backend(batch)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        answers.ask(_manifest(spark, ("a",), 600), call, ledger, parallelism=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first, second = (int(n) for n in open(f"{tmp_path}/bytes").read().split())
    assert first == 0 and 0 < second < 60 * 300


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = blocks.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_chunks_meet_the_ledger_in_one_shuffle(spark, tmp_path):
    """A second run finds all answers: one shuffle of chunks and answers that is merged from; the jobs inside leave none."""
    ledger, manifest = f"{tmp_path}/ledger", _manifest(spark, ("a", "b", "c"), 30)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    backend = providers.Transcriber(_backend(tmp_path))
    wanted = {s: "\n".join(f"said {s}{i}" for i in range(30)) for s in "abc"}
    for calls in (90, 0):
        before = _shuffle_files(spark)
        merged = providers.transcribe(manifest, backend, ledger=ledger)
        until = time.time() + 20
        while _shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.2)
        assert not _shuffle_files(spark) - before
        assert {r.session_id: r.text for r in merged.collect()} == wanted and len(_calls(tmp_path)) == calls
        final = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning") == 1
    assert spark.conf.get(setting) == was


def test_a_failed_chunk_keeps_all_parts_of_its_recording_back(spark, tmp_path):
    backend = providers.Transcriber(_backend(tmp_path, {("a", 4099)}))
    manifest = _manifest(spark, ("a",), 4100).unionByName(_manifest(spark, ("b",), 2))
    merged = providers.transcribe(manifest, backend, parallelism=4, ledger=f"{tmp_path}/ledger")
    assert [(r.session_id, r.part, r.text) for r in merged.collect()] == [("b", 0, "said b0\nsaid b1")]
    merged = providers.transcribe(manifest, providers.Transcriber(_backend(tmp_path)), ledger=f"{tmp_path}/ledger")
    assert sorted((r.session_id, r.part, r.text.count("\n")) for r in merged.collect()) == [("a", 0, 4095), ("a", 1, 3), ("b", 0, 1)]


def test_ledgers_with_whole_digests_and_plain_journals_still_answer(spark, tmp_path):
    ledger, manifest = f"{tmp_path}/ledger", _manifest(spark, ("a",), 6)
    whole = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(manifest.columns)])), 256)
    said = F.concat(F.lit("old "), F.col("chunk_index").cast("string"))
    rows = manifest.select(
        *answers.KEY, whole.alias("digest"), said.alias("response"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("calls")
    )
    rows.where("chunk_index < 2").write.parquet(f"{ledger}/runs/run=old")
    os.makedirs(f"{ledger}/open/dead/3")
    os.makedirs(f"{ledger}/open/dead/4")
    with open(f"{ledger}/open/dead/3/x.json", "w") as journal:
        journal.write("\n".join(rows.where("chunk_index IN (2, 3)").toJSON().collect()))
    got = _answers(answers.ask(manifest, _backend(tmp_path), ledger))
    assert _calls(tmp_path) == ["a4", "a5"]
    assert [r[2] for r in got] == [*(f"old {i}" for i in range(4)), *(f'{{"text": "said a{i}"}}' for i in (4, 5))]


def test_whole_lines_of_a_torn_packed_journal_are_kept(spark, tmp_path):
    ledger, again, manifest = f"{tmp_path}/ledger", f"{tmp_path}/again", _manifest(spark, ("a",), 200)
    answers.ask(manifest, _backend(tmp_path), ledger, parallelism=1).collect()
    lines = spark.read.parquet(f"{ledger}/runs").orderBy("chunk_index").drop("run").toJSON().collect()
    os.makedirs(f"{again}/open/dead/0")
    with open(f"{again}/open/dead/0/x.json.gz", "wb") as torn:
        torn.write(gzip.compress("\n".join(lines).encode(), 1)[:-400])
    with open(f"{again}/open/dead/0/y.json.gz", "wb") as torn:
        torn.write(b"")
    _calls(tmp_path)
    got = _answers(answers.ask(manifest, _backend(tmp_path), again))
    assert got == _answers(answers.ask(manifest, _backend(tmp_path), ledger))
    assert 0 < len(_calls(tmp_path)) < 100


def test_chunks_that_come_twice_or_without_a_key(spark, tmp_path):
    """A chunk that comes twice gives two rows, in every run; one without a whole key is asked for and gives none."""
    ledger, once = f"{tmp_path}/ledger", _manifest(spark, ("a",), 3)
    twice = once.unionByName(once)
    unkeyed = once.limit(1).withColumn("channel", F.lit(None).cast("string")).withColumn("session_id", F.lit("n"))
    for calls in (["a0", "a0", "a1", "a1", "a2", "a2", "n0"], ["n0"], ["n0"]):
        got = _answers(answers.ask(twice.unionByName(unkeyed), _backend(tmp_path), ledger, parallelism=1))
        assert _calls(tmp_path) == calls
        assert [r[:3] for r in got] == [("a", i, f'{{"text": "said a{i}"}}') for i in (0, 0, 1, 1, 2, 2)]

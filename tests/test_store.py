import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators import store


def _save(seq, ident, name, created, mix=None):
    return (seq, "save", ident, name, created, 1.0, 16000, 1, {"mic": f"{ident}.wav"}, mix)


def _update(seq, ident, mix):
    return (seq, "update_mix_path", ident, None, None, None, None, None, None, mix)


def _log(spark, rows):
    nullable = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SESSION_LOG)
    return spark.createDataFrame(rows, nullable)


@pytest.mark.parametrize("partitions", [1, 8])
def test_session_log_compaction(spark, partitions):
    log = _log(
        spark,
        [
            _save(1, "a", "first", 1.0),
            _update(2, "a", "a/mix.wav"),
            _update(3, "a", "a/mix2.wav"),
            _save(1, "b", "first", 2.0, "b/old.wav"),
            _update(2, "b", "b/mix.wav"),
            _save(3, "b", "again", 3.0),
            _update(1, "c", "lost.wav"),
            _save(2, "c", "late", 4.0),
            _update(1, "d", "never saved"),
            _save(1, "e", "empty", 5.0, ""),
        ],
    ).repartition(partitions)
    rows = {r.id: (r.name, r.created_at, r.mix_path) for r in store.compact_sessions(log).collect()}
    assert rows == {
        "a": ("first", 1.0, "a/mix2.wav"),
        "b": ("again", 3.0, None),
        "c": ("late", 4.0, None),
        "e": ("empty", 5.0, None),
    }


def test_notes_keep_the_first_identity(spark):
    rows = [
        (1, "harbour", "Morning", "Two boats", ["a"]),
        (2, "harbour", "Evening", "Five boats", ["b"]),
        (3, "orphan", "Other", "Text", None),
    ]
    log = spark.createDataFrame(rows, "seq bigint, session_id string, title string, summary string, action_items array<string>")
    got = sorted(tuple(r) for r in store.compact_notes(log).collect())
    assert got == [
        (1, "harbour", "Evening", "Five boats", ["b"]),
        (3, "orphan", "Other", "Text", []),
    ]


def test_listing_order_limit_and_ties(spark):
    log = _log(spark, [_save(1, i, i, t) for i, t in (("a", 1.0), ("c", 2.0), ("b", 2.0), ("d", 0.5))])
    sessions = store.compact_sessions(log)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(store.list_sessions(sessions)) == ["b", "c", "a", "d"]
    assert ids(store.list_sessions(sessions, 2)) == ["b", "c"]
    assert ids(store.list_sessions(sessions, 0)) == []
    assert ids(store.list_sessions(sessions, -1)) == ["b", "c", "a", "d"]
    assert ids(store.newest_session(sessions)) == ["b"]
    plan = store.list_sessions(sessions, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_tables_are_created_once_and_appended(spark, tmp_path):
    root = str(tmp_path)
    spark.sql("CREATE DATABASE IF NOT EXISTS loom LOCATION '" + root + "/db'")
    for _ in range(2):
        store.bootstrap(spark, f"file://{root}", "loom")
    notes = spark.createDataFrame([(1, "s", "t", "x", ["a"])], schemas.NOTES_LOG)
    store.append(notes, f"file://{root}", "notes_log")
    store.append(notes.withColumn("seq", F.lit(2)), f"file://{root}", "notes_log")
    spark.catalog.refreshTable("loom.notes_log")
    assert spark.table("loom.notes_log").count() == 2
    assert store.read_log(spark, f"file://{root}", "notes_log").count() == 2
    broken = notes.withColumn("title", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="title is NULL"):
        store.append(broken, f"file://{root}", "notes_log")
    spark.sql("DROP DATABASE loom CASCADE")


def test_key_audit_reports_each_rule(spark):
    sessions = spark.createDataFrame([("a",), ("b",)], "id string")
    notes = spark.createDataFrame(
        [("a", "t"), ("a", None), ("x", "t"), ("x", "t"), (None, "t")], "session_id string, title string"
    )
    found = store.key_audit(
        "notes", notes, ["session_id", "title"], "session_id", [("session_id", "sessions", sessions, "id")]
    )
    assert sorted((r.rule, r.key, r.n_rows) for r in found.collect()) == [
        ("not_null", "session_id", 1),
        ("not_null", "title", 1),
        ("references sessions", "x", 2),
        ("unique", "a", 2),
        ("unique", "x", 2),
    ]


def test_lookups_take_wanted_ids_once(spark):
    rows = [(2, 2, 0, "a", "mic", "again"), (1, 1, 0, "a", "mic", "first"), (1, 1, 0, "b", "mic", "other"), (1, 1, 0, "c", "mic", "no")]
    table = spark.createDataFrame(rows, "row_id bigint, transcript_id bigint, part bigint, session_id string, channel string, text string")
    wanted = spark.createDataFrame([("b",), ("a",), ("a",), ("zz",)], "session_id string")
    found = [(r.row_id, r.session_id) for r in store.fetch_transcripts(table, wanted).collect()]
    assert found == [(1, "a"), (1, "b"), (2, "a")]
    latest = {r.session_id: r.text for r in store.latest_per_channel(table).collect()}
    assert latest == {"a": "again", "b": "other", "c": "no"}


def test_outcomes_keep_sessions_without_results(spark):
    sessions = spark.createDataFrame([("a",), ("b",)], "id string")
    spoken = spark.createDataFrame(
        [(1, 1, 0, "a", "mic", "x"), (2, 2, 0, "a", "mic", "y"), (3, 2, 1, "a", "mic", "y2"), (4, 4, 0, "a", "sys", "z")],
        "row_id bigint, transcript_id bigint, part bigint, session_id string, channel string, text string",
    ).withColumn("segments", F.array())
    notes = spark.createDataFrame([("a", "t", "s")], "session_id string, title string, summary string")
    for few in (False, True):
        out = store.session_outcomes(sessions, spoken, notes.withColumn("action_items", F.array()), few)
        got = sorted((r.id, r.channel or "", r.part or 0, r.text or "", r.title or "") for r in out.collect())
        assert got == [("a", "mic", 0, "y", "t"), ("a", "mic", 1, "y2", "t"), ("a", "sys", 0, "z", "t"), ("b", "", 0, "", "")]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    root = f"file://{tmp_path}"
    store.bootstrap_folder(spark, root, "notes_log")
    assert store.read_log(spark, root, "notes_log", before=9).count() == 0
    for batch, seqs in ((1, [1, 2]), (2, [3]), (1, [4])):
        notes = spark.createDataFrame([(n, "s", "t", "x", ["a"]) for n in seqs], schemas.NOTES_LOG)
        store.append(notes, root, "notes_log", batch)
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(store.read_log(spark, root, "notes_log")) == [3, 4]
    assert seqs(store.read_log(spark, root, "notes_log", before=2)) == [4]
    assert seqs(store.read_log(spark, root, "notes_log", only=2)) == [3]

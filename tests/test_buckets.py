import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators import store
from tapeloom.operators.buckets import BucketLog, Index, KeptLog, Snapshot, Versions
from tapeloom.operators.key_audit import KeyAudit, Rules
from tapeloom.plans import fleet, snapshot_queries
from tapeloom.sources import folders

LOG = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SESSION_LOG)


def _write(rng, seq, ident):
    if rng.random() < 0.4:
        return (seq, "update_mix_path", ident, None, None, None, None, None, None, rng.choice(["m", "", None]))
    return (seq, "save", ident, f"n{seq}", float(seq), 1.0, 16000, 1, {"mic": ident}, rng.choice(["x", "", None]))


def _snapshot(spark, root, n_buckets=16):
    return Snapshot(BucketLog(spark, root, "session_log", schemas.SESSION_LOG, "id", n_buckets), store.last_writes)


def _plain(df):
    return sorted(map(str, store.compact_sessions(df).collect()))


def _opened(df):
    """Buckets and folders of the files that a read opens."""
    return {int(re.search(r"bucket=(\d+)", f)[1]) for f in df.inputFiles()}


def _batch(spark, log, rows, n):
    log.append(spark.createDataFrame(rows, LOG), n)


def test_a_folded_history_is_the_compacted_log(spark, tmp_path):
    rng = random.Random(1)
    snapshot = _snapshot(spark, f"file://{tmp_path}")
    written, seq = {}, 0
    # Batch 2 comes again, with other rows, after batch 3.
    for n, size in ((1, 40), (2, 5), (3, 12), (2, 8), (4, 0), (5, 3)):
        rows = []
        for _ in range(size):
            seq += 1
            rows.append(_write(rng, seq, f"s{rng.randrange(25)}"))
        written[n] = rows
        _batch(spark, snapshot.log, rows, n)
        snapshot.fold(n)
        everything = spark.createDataFrame([r for part in written.values() for r in part], LOG)
        assert _plain(snapshot.rows()) == _plain(everything)
    earlier = spark.createDataFrame(written[1], LOG)
    assert _plain(snapshot.rows(before=2)) == _plain(earlier)
    assert max(r[0] for r in snapshot.rows().groupBy("id", "op").count().select("count").collect()) == 1


def test_a_batch_reads_and_writes_only_its_buckets(spark, tmp_path):
    snapshot = _snapshot(spark, f"file://{tmp_path}")
    rng = random.Random(2)
    _batch(spark, snapshot.log, [_write(rng, i, f"s{i}") for i in range(300)], 1)
    snapshot.fold(1)
    before = snapshot.manifest()
    _batch(spark, snapshot.log, [_write(rng, 1000, "s7"), _write(rng, 1001, "s8")], 2)
    keys = spark.createDataFrame([("s7",), ("s8",)], "id string")
    mine = snapshot.wanted(keys)
    read = []
    compact = snapshot.compact
    snapshot.compact = lambda rows: (read.append(_opened(rows)), compact(rows))[1]
    assert snapshot.fold(2) == mine and len(mine) < 3 < len(before)
    assert read == [set(mine)]
    after = snapshot.manifest()
    assert {b for b in after if after[b] != before[b]} == set(mine)
    assert set(snapshot.touched(f"{snapshot.path}/{after[mine[0]]}")) == set(mine)


def test_lookups_open_the_wanted_buckets_only(spark, tmp_path):
    snapshot = _snapshot(spark, f"file://{tmp_path}", n_buckets=32)
    rng = random.Random(3)
    for n in (1, 2):
        _batch(spark, snapshot.log, [_write(rng, 1000 * n + i, f"s{i}") for i in range(400)], n)
        snapshot.fold(n)
    few = spark.createDataFrame([("s3",), ("s4",), ("s3",), ("zz",), (None,)], "id string")
    many = spark.createDataFrame([(f"s{i}",) for i in range(0, 60, 2)], "id string")
    for source in (snapshot, snapshot.log):
        for wanted in (few, many):
            ids = {r[0] for r in wanted.collect()}
            found = source.rows(wanted=wanted)
            assert _opened(found) <= set(source.wanted(wanted))
            assert _plain(found) == _plain(source.rows().where(F.col("id").isin([i for i in ids if i])))
        plan = source.rows(wanted=few)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[In\(id, ", plan), plan
        assert len(_opened(source.rows(wanted=few))) <= 4 < len(_opened(source.rows()))
    none = spark.createDataFrame([], "id string")
    assert snapshot.rows(wanted=none).count() == 0


def test_files_of_a_bucket_are_sorted_and_have_bloom_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    snapshot = _snapshot(spark, f"file://{tmp_path}", n_buckets=2)
    rng = random.Random(4)
    _batch(spark, snapshot.log, [_write(rng, i, f"s{hash((i, 'x'))}") for i in range(3000)], 1)
    paths = [str(p) for p in tmp_path.rglob("*.parquet")]
    assert {p.split("bucket=")[1][0] for p in paths} == {"0", "1"}
    for path in paths:
        ids = pq.read_table(path, columns=["id"], partitioning=None)["id"].to_pylist()
        assert ids == sorted(ids)
    # The filter stands between the column chunks and the footer: the same file without it is smaller.
    spark.read.parquet(paths[0]).coalesce(1).write.parquet(f"file://{tmp_path}/plain")
    other = next((tmp_path / "plain").glob("*.parquet"))
    assert os.path.getsize(paths[0]) > other.stat().st_size + 1000


def test_the_number_of_buckets_stays(spark, tmp_path):
    first = _snapshot(spark, f"file://{tmp_path}", n_buckets=5)
    assert _snapshot(spark, f"file://{tmp_path}", n_buckets=9).n_buckets == first.n_buckets == 5


def test_old_versions_are_removed_when_asked(spark, tmp_path):
    snapshot = _snapshot(spark, f"file://{tmp_path}", n_buckets=4)
    rng = random.Random(5)
    for n in range(4):
        _batch(spark, snapshot.log, [_write(rng, 100 * n + i, f"s{i}") for i in range(20)], n)
        snapshot.fold(n)
    want, kept = _plain(snapshot.rows()), _plain(snapshot.rows(before=3))
    assert len(snapshot.expire(keep=2)) == 2
    assert _plain(snapshot.rows()) == want and _plain(snapshot.rows(before=3)) == kept
    assert snapshot.numbers() == [2, 3] and snapshot.expire(keep=2) == []


def test_versions_replace_whole_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "k string, v bigint")
    held = Versions(spark, f"file://{tmp_path}/v", rows.schema, "k", 8)
    assert held.rows().count() == 0
    held.replace(rows, range(8), 1)
    gone = held.wanted(rows.where("v = 3"))
    held.replace(rows.where("false"), gone, 2)
    left = {r["v"] for r in held.rows().collect()}
    assert 3 not in left and len(left) < 40 and held.rows(before=2).count() == 40


def test_notes_keep_first_and_last(spark):
    ddl = "seq bigint, session_id string, title string, summary string, action_items array<string>"
    rows = [(4, "a", "t4", "s4", None), (2, "a", "t2", "s2", ["x"]), (9, "a", "t9", "s9", ["y"]), (5, "b", "t5", "s5", [])]
    log = spark.createDataFrame(rows, ddl)
    kept = store.first_and_last_notes(log)
    assert sorted((r["session_id"], r["seq"]) for r in kept.collect()) == [("a", 2), ("a", 9), ("b", 5)]
    assert sorted(map(str, store.compact_notes(kept).collect())) == sorted(map(str, store.compact_notes(log).collect()))


NOTES = "seq bigint, session_id string, title string, summary string, action_items array<string>"


def _index(spark, root, n_buckets=16):
    return Index(KeptLog(spark, root, "notes_log", schemas.NOTES_LOG, "session_id", n_buckets), store.first_and_last_notes, "seq")


def _notes(rng, seqs, n_sessions=25, mark=""):
    ident = lambda: rng.choice([None, *(f"s{i}" for i in range(n_sessions))])
    return [(seq, ident(), f"t{seq}{mark}", f"text {seq}", [f"i{seq}"]) for seq in seqs]


def _noted(df):
    return sorted(map(str, store.compact_notes(df).collect()))


def test_an_index_reads_what_a_snapshot_holds(spark, tmp_path):
    rng = random.Random(6)
    index, written, seq = _index(spark, f"file://{tmp_path}"), {}, 0
    # Batch 2 comes again, with other rows, after batch 3.
    for n, size in ((1, 40), (2, 5), (3, 12), (2, 8), (4, 0), (5, 3)):
        written[n], seq = _notes(rng, rng.sample(range(seq, seq + 100), size)), seq + 50
        before = _noted(index.whole())
        index.log.append(spark.createDataFrame(written[n], NOTES), n)
        # An appended batch is seen when it is folded; one that replaces another, too.
        assert _noted(index.whole()) == before
        index.fold(n)
        rows = [r for part in written.values() for r in part]
        assert _noted(index.whole()) == _noted(spark.createDataFrame(rows, NOTES))
    assert _noted(index.whole(before=2)) == _noted(spark.createDataFrame(written[1], NOTES))
    few = [("s3",), ("s4",), ("s3",), ("zz",), (None,)]
    for keys in (few, [(f"s{i}",) for i in range(0, 25, 2)], []):
        wanted = spark.createDataFrame(keys, "session_id string")
        known = {k for (k,) in keys if k}
        found = index.whole(wanted=wanted)
        assert _noted(found) == _noted(spark.createDataFrame([r for r in rows if r[1] in known], NOTES))
        assert _opened(found) <= set(index.wanted(wanted))
    plan = index.whole(wanted=spark.createDataFrame(few, "session_id string"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PushedFilters: \[In\(session_id, ", plan)) == 2, plan
    want, folders_before = _noted(index.whole()), set(folders.names(spark, index.log.path))
    assert any(n.startswith("batch=2-") for n in index.expire())
    assert _noted(index.whole()) == want
    assert len([n for n in folders_before if n.startswith("batch=")]) == 6
    assert len([n for n in folders.names(spark, index.log.path) if n.startswith("batch=")]) == 5


def test_a_kept_log_reads_plain_batches(spark, tmp_path):
    plain = BucketLog(spark, f"file://{tmp_path}", "notes_log", schemas.NOTES_LOG, "session_id")
    plain.append(spark.createDataFrame([(1, "a", "t", "x", [])], NOTES), 3)
    log = _index(spark, f"file://{tmp_path}").log
    log.append(spark.createDataFrame([(2, "b", "t", "y", [])], NOTES), 4)
    assert log.batches() == [3, 4] and sorted(r["seq"] for r in log.rows().collect()) == [1, 2]
    log.append(spark.createDataFrame([(5, "c", "t", "z", [])], NOTES), 3)
    assert log.batches() == [3, 4] and sorted(r["seq"] for r in log.rows().collect()) == [2, 5]
    assert log.expire() == ["batch=3"]


def test_a_history_of_notes_writes_its_texts_once_a_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    texts = [rng.randbytes(15_000).hex() for _ in range(120)]
    docs = [(i, text, "en", f"src{i % 3}", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"file://{tmp_path}/documents.parquet"
    )
    turns = [(i, 0, "user", "hi") for i in range(0, 120, 4)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"file://{tmp_path}/conversations.parquet"
    )
    monkeypatch.setattr(snapshot_queries, "new_shared_path", lambda spark, label: f"file://{tmp_path}/shared")
    found = snapshot_queries.snapshot_notes_lookup(spark, f"file://{tmp_path}").collect()
    assert sorted((r["session_id"], r["summary"]) for r in found) == sorted((f"session-{i}", texts[i]) for i, _, _, _ in turns)
    # All are one batch, which comes twice; no fold writes them again.
    stored = sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*.parquet"))
    given = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").rglob("*.parquet"))
    assert stored < 2.9 * given


def _full_audit(spark, docs, labels):
    labelled = spark.createDataFrame(labels, "doc_id bigint")
    found = store.key_audit(
        "docs", spark.createDataFrame(docs, "doc_id bigint, size bigint"), ["doc_id", "size"], "size",
        [("doc_id", "labels", labelled, "doc_id")],
    )
    return sorted(map(str, (tuple(r) for r in found.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_after_any_batches_is_the_full_audit(spark, tmp_path, seed):
    rng = random.Random(seed)
    rules = {"docs": Rules(("doc_id", "size"), "size", [("doc_id", "labels", "doc_id")]), "labels": Rules()}
    audit = KeyAudit(spark, f"file://{tmp_path}", rules, n_buckets=8)
    maybe = lambda n: rng.choice([None, *range(n)])
    docs, labels = {}, {}
    for n in (1, 2, 3, 2, 4):
        docs[n] = [(maybe(30), maybe(40)) for _ in range(rng.randrange(12))]
        labels[n] = [(maybe(30),) for _ in range(rng.randrange(8))]
        audit.apply(
            n,
            {
                "docs": spark.createDataFrame(docs[n], "doc_id bigint, size bigint"),
                "labels": spark.createDataFrame(labels[n], "doc_id bigint"),
            },
        )
        want = _full_audit(spark, sum(docs.values(), []), sum(labels.values(), []))
        assert sorted(map(str, (tuple(r) for r in audit.findings().collect()))) == want


def test_an_audit_looks_at_touched_buckets_only(spark, tmp_path):
    rules = {"docs": Rules(("doc_id",), None, [("doc_id", "labels", "doc_id")]), "labels": Rules()}
    audit = KeyAudit(spark, f"file://{tmp_path}", rules, n_buckets=16)
    ids = lambda numbers: spark.createDataFrame([(i,) for i in numbers], "doc_id bigint")
    audit.apply(1, {"docs": ids(range(200)), "labels": ids(range(100))})
    before = audit.findings_by_bucket.manifest()
    seen = []
    found = audit._found
    audit._found = lambda counts: (seen.append(_opened(counts)), found(counts))[1]
    touched = audit.apply(2, {"docs": ids([]), "labels": ids([150])})
    assert len(touched) == 1 and seen == [set(touched)]
    after = audit.findings_by_bucket.manifest()
    assert {b for b in before if after.get(b) != before[b]} <= set(touched)
    assert audit.findings().count() == 99


def test_a_fleet_batch_leaves_other_buckets_alone(spark, tmp_path):
    from tests.test_fleet import _inputs

    requests, channels, chunks = _inputs(spark)
    root = f"file://{tmp_path}"
    fleet.process_batch(spark, root, 1, requests, channels, chunks, cell_frames=1600)
    held = fleet.Store(spark, root)
    before = {name: getattr(held, name).manifest() for name in ("sessions", "numbers", "notes")}
    one = "session_id = 'half'"
    fleet.process_batch(spark, root, 2, requests.where("id = 'half'"), channels.where(one), chunks.where(one), cell_frames=1600)
    for name, old in before.items():
        now = getattr(held, name).manifest()
        assert sum(now[b] != old.get(b) for b in now) == 1, name
    wanted = spark.createDataFrame([("half",)], "id string")
    assert [r["id"] for r in fleet.sessions(spark, root, wanted).collect()] == ["half"]
    assert folders.names(spark, f"{root}/nothing") == [] and folders.read_text(spark, f"{root}/nothing") is None

"""The session store batch by batch: bucketed logs, folded snapshots, ledgers and audits.

Every query replays its whole table as a history of batches, one of them twice, and
gives what one pass over the whole table gives: the SQL twins know no batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators import store
from tapeloom.operators.buckets import BucketLog, Index, KeptLog, Snapshot
from tapeloom.operators.key_audit import KeyAudit, Rules
from tapeloom.plans import sql, store_queries
from tapeloom.session import new_shared_path
from tapeloom.sources import tables

BATCHES = 3


def _replayed(snapshot: Snapshot, rows: DataFrame, batch_of: Column) -> Snapshot:
    """Append and fold the rows batch by batch, then the second batch once more."""
    rows = rows.withColumn("__batch", batch_of)
    for batch in [*range(BATCHES), 1]:
        snapshot.log.append(rows.where(F.col("__batch") == batch), batch)
        snapshot.fold(batch)
    return snapshot


def _sessions(spark: SparkSession, sf_dir: str) -> Snapshot:
    log = BucketLog(spark, new_shared_path(spark, "store"), "session_log", schemas.SESSION_LOG, "id")
    # By time: 1992 and 1993, 1994 and 1995, and the rest.
    year = F.year(F.date_from_unix_date((F.col("seq") / 10**12).cast("int")))
    batch = F.least(F.greatest(F.floor((year - 1992) / 2), F.lit(0)), F.lit(BATCHES - 1))
    return _replayed(Snapshot(log, store.last_writes), tables.session_log(spark, sf_dir), batch)


def _notes(spark: SparkSession, sf_dir: str, session: Column) -> Index:
    log = KeptLog(spark, new_shared_path(spark, "store"), "notes_log", schemas.NOTES_LOG, "session_id")
    # By length: the first and the last write of a session may come in any batch.
    length = F.length("summary")
    batch = F.when(length < 1000, 2).when(length < 2500, 0).otherwise(1)
    index = Index(log, store.first_and_last_notes, "seq")
    _replayed(index, tables.notes_log(spark, sf_dir, session), batch)
    return index


def snapshot_sessions(spark, sf_dir):
    """Sessions after a history of saves and mix updates, read from the folded snapshot."""
    return store_queries.flat(store.compact_sessions(_sessions(spark, sf_dir).rows()))


def snapshot_session_lookup(spark, sf_dir):
    """The wanted sessions, from their buckets only."""
    wanted = tables.transcripts(spark, sf_dir).select(F.col("session_id").alias("id"))
    return store_queries.flat(store.compact_sessions(_sessions(spark, sf_dir).rows(wanted=wanted)))


def snapshot_notes(spark, sf_dir):
    notes = store.compact_notes(_notes(spark, sf_dir, F.col("source")).whole())
    return notes.withColumn("action_items", F.array_join("action_items", ","))


def snapshot_notes_lookup(spark, sf_dir):
    """Notes of the wanted sessions, from their buckets only."""
    session = F.concat(F.lit("session-"), F.col("doc_id").cast("string"))
    wanted = tables.transcripts(spark, sf_dir).select("session_id")
    found = store.compact_notes(_notes(spark, sf_dir, session).whole(wanted=wanted))
    return found.select("session_id", "title", "summary", F.size("action_items").cast("bigint").alias("n_items"))


def _turn_batch() -> Column:
    return F.least(F.floor(F.pmod("row_id", F.lit(1000)) / 3), F.lit(BATCHES - 1))


def clustered_transcripts(spark, sf_dir):
    """All transcript rows of the wanted sessions, from clustered batches."""
    log = BucketLog(spark, new_shared_path(spark, "store"), "transcripts", schemas.TRANSCRIPTS, "session_id")
    rows = tables.transcripts(spark, sf_dir).withColumn("__batch", _turn_batch())
    for batch in range(BATCHES):
        log.append(store.checked(rows.where(F.col("__batch") == batch), "transcripts"), batch)
    sessions = store.compact_sessions(tables.session_log(spark, sf_dir))
    wanted = sessions.filter("mix_path IS NOT NULL").select(F.col("id").alias("session_id"))
    found = log.rows(wanted=wanted).orderBy("row_id", "session_id")
    return found.select("row_id", "session_id", "channel", "text")


def ledger_numbers(spark, sf_dir):
    """Turns appended in batches; each batch numbers its rows from the ledger of last numbers."""
    log = BucketLog(spark, new_shared_path(spark, "store"), "transcripts", schemas.TRANSCRIPTS, "session_id")
    numbers = Snapshot(log, store.last_numbers, "numbers", schemas.TRANSCRIPT_NUMBERS)
    turns = tables.transcripts(spark, sf_dir).withColumn("__batch", _turn_batch())
    turns = turns.withColumn("turn", F.pmod("row_id", F.lit(1000))).drop("row_id", "transcript_id")
    for batch in [*range(BATCHES), BATCHES - 1]:
        new = turns.where(F.col("__batch") == batch)
        earlier = numbers.rows(before=batch, wanted=new.select("session_id"))
        log.append(store.checked(store.numbered_transcripts(new, ["turn"], earlier), "transcripts"), batch)
        numbers.fold(batch)
    return log.rows().select("session_id", "row_id", "transcript_id", "channel", "text")


def audit_batches(spark, sf_dir):
    """The key audit of documents and labels, kept up to date over batches of both."""
    audit = KeyAudit(
        spark,
        new_shared_path(spark, "audit"),
        {
            "documents": Rules(("doc_id", "text", "lang", "source", "n_chars"), "n_chars", [("doc_id", "labels", "doc_id")]),
            "labels": Rules(),
        },
    )
    docs, labels = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    length = F.coalesce("n_chars", F.lit(0))
    batch = F.when(length < 1000, 0).when(length < 2500, 1).otherwise(2)
    docs, labels = docs.withColumn("__batch", batch), labels.withColumn("__batch", F.coalesce(2 * F.col("quality"), F.lit(0)))
    for n in [*range(BATCHES), 1]:
        audit.apply(n, {"documents": docs.where(F.col("__batch") == n), "labels": labels.where(F.col("__batch") == n)})
    return audit.findings()


QUERIES = {
    "snapshot_sessions": snapshot_sessions,
    "snapshot_session_lookup": snapshot_session_lookup,
    "snapshot_notes": snapshot_notes,
    "snapshot_notes_lookup": snapshot_notes_lookup,
    "clustered_transcripts": clustered_transcripts,
    "ledger_numbers": ledger_numbers,
    "audit_batches": audit_batches,
}

ORACLES = {
    "snapshot_sessions": store_queries.ORACLES["session_mix_update"],
    "snapshot_session_lookup": store_queries.ORACLES["session_lookup"],
    "snapshot_notes": store_queries.ORACLES["notes_keyed_upsert"],
    "snapshot_notes_lookup": store_queries.ORACLES["notes_lookup"],
    "clustered_transcripts": store_queries.ORACLES["transcript_scan"],
    "ledger_numbers": sql.with_(
        sql.TRANSCRIPTS,
        body="""SELECT session_id, n AS row_id, n AS transcript_id, channel, text FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY row_id) AS n FROM transcripts)""",
    ),
    "audit_batches": store_queries.ORACLES["key_audit"],
}

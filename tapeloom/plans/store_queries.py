"""Session store: upserts, lookups, listings, outcomes and key audit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import codec
from tapeloom.operators import store
from tapeloom.plans import sql
from tapeloom.session import new_shared_path
from tapeloom.sources import tables

_SESSION = ["id", "name", "created_at", "duration", "sample_rate", "channels"]


def flat(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        *_SESSION,
        F.col("audio_paths")["microphone"].alias("microphone_path"),
        F.col("audio_paths")["system"].alias("system_path"),
        "mix_path",
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.compact_sessions(tables.session_log(spark, sf_dir))


def store_bootstrap(spark, sf_dir):
    """A new store: its tables made twice, filled from the given tables, and read back by name."""
    location, database = new_shared_path(spark, "store"), f"loom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{location}/database'")
    for _ in range(2):
        store.bootstrap(spark, location, database)
    logs = {
        "session_log": tables.session_log(spark, sf_dir),
        "transcripts": tables.transcripts(spark, sf_dir),
        "notes_log": tables.notes_log(spark, sf_dir, F.col("source")),
    }
    counted = []
    for name, rows in logs.items():
        store.append(rows, location, name)
        spark.catalog.refreshTable(f"{database}.{name}")
        read = spark.table(f"{database}.{name}")
        counted.append(
            read.agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("table"), F.lit(",".join(read.columns)).alias("columns"), "n_rows"
            )
        )
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def session_replace_upsert(spark, sf_dir):
    log = tables.session_log(spark, sf_dir).filter(F.col("op") == store.SAVE)
    return flat(store.compact_sessions(log))


def session_mix_update(spark, sf_dir):
    return flat(_sessions(spark, sf_dir))


def notes_keyed_upsert(spark, sf_dir):
    notes = store.compact_notes(tables.notes_log(spark, sf_dir, F.col("source")))
    return notes.select(
        "row_id",
        "session_id",
        "title",
        "summary",
        F.array_join("action_items", ",").alias("action_items"),
    )


def transcript_append(spark, sf_dir):
    first = tables.transcripts(spark, sf_dir)
    again = first.withColumn("row_id", F.col("row_id") + F.lit(10**12))
    return (
        store.append_transcripts(first, again)
        .groupBy("session_id", "channel")
        .agg(
            F.count("*").alias("n_rows"),
            F.max("row_id").alias("last_row"),
            F.sum(F.length("text")).alias("n_chars"),
        )
    )


def session_lookup(spark, sf_dir):
    wanted = tables.transcripts(spark, sf_dir).select(F.col("session_id").alias("id"))
    return flat(store.lookup(_sessions(spark, sf_dir), wanted, "id"))


def transcript_scan(spark, sf_dir):
    wanted = _sessions(spark, sf_dir).filter("mix_path IS NOT NULL").select(F.col("id").alias("session_id"))
    found = store.fetch_transcripts(tables.transcripts(spark, sf_dir), wanted)
    return found.select("row_id", "session_id", "channel", "text")


def notes_lookup(spark, sf_dir):
    session = F.concat(F.lit("session-"), F.col("doc_id").cast("string"))
    notes = store.compact_notes(tables.notes_log(spark, sf_dir, session))
    wanted = tables.transcripts(spark, sf_dir)
    found = store.lookup(notes, wanted, "session_id")
    return found.select("session_id", "title", "summary", F.size("action_items").cast("bigint").alias("n_items"))


def list_sessions_topk(spark, sf_dir):
    return flat(store.list_sessions(_sessions(spark, sf_dir), 10))


def list_sessions_all(spark, sf_dir):
    return flat(store.list_sessions(_sessions(spark, sf_dir)))


def _outcome(sessions: DataFrame, spark, sf_dir, few: bool = False) -> DataFrame:
    session = F.concat(F.lit("session-"), F.col("doc_id").cast("string"))
    notes = store.compact_notes(tables.notes_log(spark, sf_dir, session))
    outcome = store.session_outcomes(sessions, tables.transcripts(spark, sf_dir), notes, few)
    return outcome.select("id", "name", "mix_path", "channel", "text", "title", "summary")


def session_outcome(spark, sf_dir):
    return _outcome(_sessions(spark, sf_dir), spark, sf_dir)


def newest_outcome(spark, sf_dir):
    return _outcome(store.newest_session(_sessions(spark, sf_dir)), spark, sf_dir, few=True)


def latest_per_channel(spark, sf_dir):
    latest = store.latest_per_channel(tables.transcripts(spark, sf_dir))
    return latest.select("session_id", "channel", "row_id", "text")


def key_audit(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    labels = tables.table(spark, sf_dir, "labels")
    return store.key_audit(
        "documents",
        docs,
        ["doc_id", "text", "lang", "source", "n_chars"],
        unique="n_chars",
        references=[("doc_id", "labels", labels, "doc_id")],
    )


def json_roundtrip(spark, sf_dir):
    """Session paths to JSON text and back, one row per entry."""
    stored = tables.session_log(spark, sf_dir).select(
        "seq", codec.paths_to_json(F.col("audio_paths")).alias("stored")
    )
    return stored.select("seq", F.explode(codec.paths_from_json(F.col("stored"))).alias("channel", "path"))


def json_segments_roundtrip(spark, sf_dir):
    """Segments and action items to JSON text and back, times NULL or kept."""
    stored = tables.transcripts(spark, sf_dir).select(
        "row_id",
        codec.segments_to_json(F.col("segments")).alias("segments"),
        codec.items_to_json(F.array("channel", "session_id")).alias("items"),
    )
    return stored.select(
        "row_id",
        F.explode(codec.segments_from_json(F.col("segments"))).alias("segment"),
        codec.items_from_json(F.col("items")).alias("items"),
    ).select(
        "row_id",
        F.col("segment.start").alias("seg_start"),
        F.col("segment.end").alias("seg_end"),
        F.col("segment.text").alias("text"),
        F.array_join("items", "|").alias("items"),
    )


def json_raw_roundtrip(spark, sf_dir):
    """Raw responses to the store and back; an empty object is stored as NULL."""
    empty = F.col("event_type") == "error"
    raw = F.when(empty, F.lit("{ }")).when(F.col("event_type") != "view", F.col("props"))
    stored = tables.table(spark, sf_dir, "events").select("event_id", codec.raw_to_store(raw).alias("stored"))
    back = codec.raw_from_store(F.col("stored"))
    return stored.select(
        "event_id", F.col("stored").isNull().alias("is_null"), F.try_variant_get(back, "$.k", "bigint").alias("k")
    )


QUERIES = {
    "store_bootstrap": store_bootstrap,
    "json_raw_roundtrip": json_raw_roundtrip,
    "session_replace_upsert": session_replace_upsert,
    "session_mix_update": session_mix_update,
    "notes_keyed_upsert": notes_keyed_upsert,
    "transcript_append": transcript_append,
    "session_lookup": session_lookup,
    "transcript_scan": transcript_scan,
    "notes_lookup": notes_lookup,
    "list_sessions_topk": list_sessions_topk,
    "list_sessions_all": list_sessions_all,
    "session_outcome": session_outcome,
    "newest_outcome": newest_outcome,
    "latest_per_channel": latest_per_channel,
    "key_audit": key_audit,
    "json_roundtrip": json_roundtrip,
    "json_segments_roundtrip": json_segments_roundtrip,
}

_LATEST = """
latest AS (
  SELECT * FROM transcripts
  QUALIFY row_number() OVER (PARTITION BY session_id, channel ORDER BY row_id DESC) = 1)"""

_DOC_NOTES = """
notes AS (
  SELECT 'session-' || doc_id AS session_id, 'Notes for ' || lang AS title, text AS summary
  FROM documents)"""

_OUTCOME = """
SELECT s.id, s.name, s.mix_path, t.channel, t.text, n.title, n.summary
FROM {sessions} s LEFT JOIN latest t ON t.session_id = s.id LEFT JOIN notes n ON n.session_id = s.id"""

ORACLES = {
    "store_bootstrap": """
        SELECT 'session_log' AS "table", count(*) AS n_rows, 'seq,op,id,name,created_at,duration,sample_rate,' ||
          'channels,audio_paths,mix_path' AS columns FROM orders
        UNION ALL
        SELECT 'transcripts', count(*), 'row_id,transcript_id,part,session_id,channel,text,segments,raw_response' FROM conversations
        UNION ALL
        SELECT 'notes_log', count(*), 'seq,session_id,title,summary,action_items' FROM documents""",
    "json_raw_roundtrip": """
        SELECT event_id, event_type IN ('error', 'view') AS is_null,
          CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
        FROM events""",
    "session_replace_upsert": sql.with_(
        sql.SESSION_LOG,
        sql.SAVES,
        body="SELECT * EXCLUDE (seq, op, mix_path), nullif(mix_path, '') AS mix_path FROM saves",
    ),
    "session_mix_update": sql.with_(sql.SESSIONS, body="SELECT * FROM sessions"),
    "notes_keyed_upsert": """
        SELECT min(doc_id) AS row_id, source AS session_id,
               'Notes for ' || arg_max(lang, doc_id) AS title,
               arg_max(text, doc_id) AS summary,
               arg_max(lang, doc_id) || ',' || source AS action_items
        FROM documents GROUP BY source""",
    "transcript_append": """
        SELECT 'session-' || conv_id AS session_id, role AS channel, 2 * count(*) AS n_rows,
               max(conv_id * 1000 + turn) + 1000000000000 AS last_row,
               CAST(2 * sum(length(text)) AS BIGINT) AS n_chars
        FROM conversations GROUP BY conv_id, role""",
    "session_lookup": sql.with_(
        sql.SESSIONS,
        body="SELECT * FROM sessions WHERE id IN (SELECT 'session-' || conv_id FROM conversations)",
    ),
    "transcript_scan": sql.with_(
        sql.SESSIONS,
        sql.TRANSCRIPTS,
        body="""SELECT row_id, session_id, channel, text FROM transcripts
        WHERE session_id IN (SELECT id FROM sessions WHERE mix_path IS NOT NULL) ORDER BY row_id""",
    ),
    "notes_lookup": sql.with_(
        _DOC_NOTES,
        body="""SELECT session_id, title, summary, CAST(2 AS BIGINT) AS n_items FROM notes
        WHERE session_id IN (SELECT 'session-' || conv_id FROM conversations)""",
    ),
    "list_sessions_topk": sql.with_(
        sql.SESSIONS, body="SELECT * FROM sessions ORDER BY created_at DESC, id LIMIT 10"
    ),
    "list_sessions_all": sql.with_(
        sql.SESSIONS, body="SELECT * FROM sessions ORDER BY created_at DESC, id"
    ),
    "session_outcome": sql.with_(
        sql.SESSIONS, sql.TRANSCRIPTS, _LATEST, _DOC_NOTES, body=_OUTCOME.format(sessions="sessions")
    ),
    "newest_outcome": sql.with_(
        sql.SESSIONS,
        sql.TRANSCRIPTS,
        _LATEST,
        _DOC_NOTES,
        body=_OUTCOME.format(sessions="(SELECT * FROM sessions ORDER BY created_at DESC, id LIMIT 1)"),
    ),
    "latest_per_channel": sql.with_(
        sql.TRANSCRIPTS, _LATEST, body="SELECT session_id, channel, row_id, text FROM latest"
    ),
    "key_audit": """
        SELECT 'documents' AS "table", 'unique' AS rule, CAST(n_chars AS VARCHAR) AS key, count(*) AS n_rows
        FROM documents GROUP BY n_chars HAVING count(*) > 1
        UNION ALL
        SELECT 'documents', 'references labels', CAST(doc_id AS VARCHAR), count(*)
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id
        UNION ALL
        SELECT 'documents', 'not_null', key, n_rows FROM (
          SELECT 'doc_id' AS key, count(*) - count(doc_id) AS n_rows FROM documents
          UNION ALL SELECT 'text', count(*) - count(text) FROM documents
          UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents
          UNION ALL SELECT 'source', count(*) - count(source) FROM documents
          UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM documents) WHERE n_rows > 0""",
    "json_roundtrip": sql.with_(
        sql.SESSION_LOG,
        body="""SELECT seq, 'microphone' AS channel, microphone_path AS path FROM session_log
        UNION ALL SELECT seq, 'system', system_path FROM session_log""",
    ),
    "json_segments_roundtrip": sql.with_(
        sql.TRANSCRIPTS,
        body="SELECT row_id, seg_start, seg_end, text, channel || '|' || session_id AS items FROM transcripts",
    ),
}

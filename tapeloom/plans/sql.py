"""Shared SQL text of the twins: the data model as common table expressions."""

from __future__ import annotations

from tapeloom.functions.text import WHITESPACE

#: A SQL string literal holding every white-space character.
WS = "'" + WHITESPACE + "'"

SESSION_LOG = """
session_log AS (
  SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 1000000000000 + o_orderkey AS seq,
         CASE WHEN o_orderstatus = 'P' THEN 'update_mix_path' ELSE 'save' END AS op,
         'session-' || o_custkey AS id,
         'meeting ' || o_orderpriority AS name,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 AS DOUBLE) AS created_at,
         o_totalprice / CAST(1000 AS DOUBLE) AS duration,
         CASE o_orderpriority WHEN '1-URGENT' THEN 48000 WHEN '2-HIGH' THEN 44100 ELSE 16000 END AS sample_rate,
         CAST(o_orderkey % 2 + 1 AS INTEGER) AS channels,
         'rec/' || o_orderkey || '/raw/microphone.wav' AS microphone_path,
         'rec/' || o_orderkey || '/raw/system.wav' AS system_path,
         CASE WHEN o_orderstatus = 'P' THEN 'rec/' || o_orderkey || '/processed/mix.wav'
              WHEN o_orderstatus = 'F' THEN 'rec/' || o_orderkey || '/processed/old.wav'
              WHEN o_orderkey % 2 = 0 THEN '' END AS mix_path
  FROM orders)"""

SAVES = """
saves AS (
  SELECT * FROM session_log WHERE op = 'save'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""

SESSIONS = (
    SESSION_LOG
    + ","
    + SAVES
    + """,
updates AS (
  SELECT id, seq, mix_path FROM session_log WHERE op = 'update_mix_path'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
sessions AS (
  SELECT s.* EXCLUDE (seq, op, mix_path),
         CASE WHEN u.seq IS NOT NULL THEN u.mix_path ELSE nullif(s.mix_path, '') END AS mix_path
  FROM saves s LEFT JOIN updates u ON u.id = s.id AND u.seq > s.seq)"""
)

TRANSCRIPTS = """
transcripts AS (
  SELECT conv_id * 1000 + turn AS row_id, 'session-' || conv_id AS session_id, role AS channel, text,
         CASE WHEN turn % 2 = 0 THEN CAST(0 AS DOUBLE) END AS seg_start,
         CASE WHEN turn % 2 = 0 THEN length(text) / CAST(16 AS DOUBLE) END AS seg_end
  FROM conversations)"""

# The response shapes, already read: text plus up to two segments.  Shapes 1 and 3
# have a text only; 8 is a blank text and 9 no response at all, chunks behind a third of the turns.
RESPONSES = f"""
responses AS (
  SELECT 'session-' || conv_id AS session_id, role AS channel, 2 * turn AS chunk_index,
         length(text) / CAST(16 AS DOUBLE) AS duration, text AS spoken, (conv_id + turn) % 4 AS shape
  FROM conversations
  UNION ALL
  SELECT 'session-' || conv_id, role, 2 * turn + 1, CAST(0.5 AS DOUBLE), '', 8 + turn % 2
  FROM conversations WHERE (conv_id + turn) % 3 = 0),
parsed AS (
  SELECT *,
         CASE shape WHEN 1 THEN '  ' || spoken WHEN 8 THEN '  ' || chr(10) || ' ' ELSE spoken END AS text,
         coalesce(sum(duration) OVER (PARTITION BY session_id, channel ORDER BY chunk_index
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM responses),
segments AS (
  SELECT session_id, channel, chunk_index, 0 AS n, start AS chunk_start,
         CASE shape WHEN 0 THEN CAST(0 AS DOUBLE) END AS seg_start,
         CASE shape WHEN 0 THEN duration / 2 END AS seg_end,
         trim(CASE shape WHEN 0 THEN substring(spoken, 1, CAST(length(spoken) // 2 AS INTEGER)) ELSE spoken END, {WS}) AS text
  FROM parsed WHERE shape IN (0, 2)
  UNION ALL
  SELECT session_id, channel, chunk_index, 1 AS n, start,
         CASE shape WHEN 2 THEN CAST(1 AS DOUBLE) END, NULL, trim(spoken, {WS})
  FROM parsed WHERE shape IN (0, 2))"""


def events(stops: bool = True) -> str:
    """Events as decoded lines: stop flag and appended piece."""
    stop = "event_type = 'signup'" if stops else "false"
    return f"""
decoded AS (
  SELECT 'user-' || user_id AS session_id, event_id AS seq, {stop} AS is_stop,
         CASE event_type
           WHEN 'click' THEN CASE WHEN k % 5 = 0 THEN '  ' ELSE ' w' || k END
           WHEN 'purchase' THEN 'done' || k || ' ' END AS piece
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body

"""Device inventories, recommended specs and spec audits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapeloom.functions import device, pcm
from tapeloom.operators import devices
from tapeloom.plans import sql
from tapeloom.session import fan_out
from tapeloom.sources import device_tables as sources
from tapeloom.sources import tables

_INVENTORY = ["host", "index", "name", "input_format", "channels", "sample_rate", "details", "line_no"]


def device_inventory_dshow(spark, sf_dir):
    return devices.by_index(devices.dshow_inventory(sources.listings(spark, sf_dir, "windows"))).select(*_INVENTORY)


def device_inventory_avfoundation(spark, sf_dir):
    found = devices.avfoundation_inventory(sources.listings(spark, sf_dir, "darwin"))
    return devices.by_index(found).select(*_INVENTORY)


def device_inventory_pulse(spark, sf_dir):
    return devices.by_index(devices.pulse_inventory(sources.listings(spark, sf_dir, "linux"))).select(*_INVENTORY)


def recommended_specs(spark, sf_dir):
    lines = sources.listings(spark, sf_dir, "windows")
    for platform in ("darwin", "linux"):
        lines = lines.unionByName(sources.listings(spark, sf_dir, platform))
    found = devices.with_recommended_spec(devices.inventory(lines))
    return found.select("host", "input_format", "line_no", "recommended")


def device_values(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").withColumn("value", F.expr(sources.DEVICE_VALUE))
    return orders.select(
        "o_orderkey",
        device.normalise_value(F.col("value")).alias("device"),
        device.is_disabled(F.col("value")).alias("is_disabled"),
    )


def device_specs(spark, sf_dir):
    return devices.parse_specs(sources.specs(spark, sf_dir), tasks=fan_out(spark)).select(
        "host",
        "channel",
        "input_format",
        "input_target",
        "sample_rate",
        "channels",
        "sample_format",
        "chunk_frames",
        F.array_join("args_before_input", "|").alias("args_before"),
        F.array_join("args_after_input", "|").alias("args_after"),
        "error",
    )


def device_specs_by_index(spark, sf_dir):
    """Bare device numbers resolved through the host's own inventory."""
    found = devices.dshow_inventory(sources.listings(spark, sf_dir, "windows"))
    return devices.parse_specs(sources.index_specs(spark, sf_dir), found, fan_out(spark)).select(
        "host", "channel", "input_format", "input_target", "error"
    )


def chunk_frames(spark, sf_dir):
    parsed = devices.parse_specs(sources.specs(spark, sf_dir), tasks=fan_out(spark)).filter("error IS NULL")
    seconds = F.pmod(F.col("channel").cast("bigint"), F.lit(3)) * 0.25
    frames = pcm.chunk_frames(F.col("sample_rate"), seconds, F.col("chunk_frames"))
    return parsed.select("host", "channel", frames.alias("chunk_frames"))


QUERIES = {
    "device_inventory_dshow": device_inventory_dshow,
    "device_inventory_avfoundation": device_inventory_avfoundation,
    "device_inventory_pulse": device_inventory_pulse,
    "recommended_specs": recommended_specs,
    "device_values": device_values,
    "device_specs": device_specs,
    "device_specs_by_index": device_specs_by_index,
    "chunk_frames": chunk_frames,
}


# The listing formats are defined once; the twin's engine has no flag for Unicode classes.
ALTERNATIVE, QUOTED, BRACKETED = (
    re.sub(r"\(\?([is]?)U?(s?)\)", lambda m: f"(?{m[1]}{m[2]})" if m[1] + m[2] else "", pattern)
    for pattern in (devices.ALTERNATIVE_NAME, devices.QUOTED_NAME, devices.BRACKETED_DEVICE)
)


def _lines(platform: str, name: str) -> str:
    return f"""
{name}_lines AS (
  SELECT host, line_no, payload, lower(payload) AS lowered FROM (
    SELECT 'host-' || user_id AS host, event_id AS line_no,
           trim(CASE WHEN instr(line, ']') > 0 THEN substring(line, instr(line, ']') + 1) ELSE line END, {sql.WS}) AS payload
    FROM (SELECT *, {sources.LISTING_LINES[platform]} AS line
          FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))
  WHERE payload <> '')"""


def _sections(name: str, title: str) -> str:
    return f"""
{name}_marked AS (
  SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY host ORDER BY line_no ROWS UNBOUNDED PRECEDING), false) AS in_audio
  FROM (SELECT *, CASE WHEN contains(lowered, '{title} audio devices') THEN true
                       WHEN contains(lowered, '{title} video devices') THEN false END AS header FROM {name}_lines))"""


_DSHOW = (
    _lines("windows", "dshow")
    + ","
    + _sections("dshow", "directshow")
    + rf""",
dshow_named AS (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_no) = 1 AS is_first FROM (
    SELECT host, line_no, regexp_extract(payload, '{QUOTED}', 1) AS name,
           nullif(regexp_extract(payload, '{ALTERNATIVE}', 1), '') AS alternative,
           in_audio OR contains(lowered, '(audio') AS counts
    FROM dshow_marked WHERE header IS NULL AND regexp_matches(payload, '"[^"]+"'))
  WHERE counts),
dshow_opened AS (
  SELECT host, line_no, name, row_number() OVER (PARTITION BY host ORDER BY line_no) - 1 AS index
  FROM dshow_named WHERE alternative IS NULL OR is_first),
dshow_details AS (
  SELECT m.host, d.index, arg_max(m.alternative, m.line_no) AS details
  FROM (SELECT host, line_no, nullif(regexp_extract(payload, '{ALTERNATIVE}', 1), '') AS alternative
        FROM dshow_marked WHERE header IS NULL) m
  ASOF JOIN dshow_opened d ON m.host = d.host AND m.line_no > d.line_no
  WHERE m.alternative IS NOT NULL GROUP BY ALL),
dshow AS (
  SELECT o.host, o.index, o.name, 'dshow' AS input_format, CAST(NULL AS BIGINT) AS channels,
         CAST(NULL AS BIGINT) AS sample_rate, t.details, o.line_no
  FROM dshow_opened o LEFT JOIN dshow_details t ON t.host = o.host AND t.index = o.index)"""
)

_AVFOUNDATION = (
    _lines("darwin", "av")
    + ","
    + _sections("av", "avfoundation")
    + rf""",
avfoundation AS (
  SELECT host, CAST(regexp_extract(payload, '{BRACKETED}', 1) AS BIGINT) AS index,
         trim(regexp_extract(payload, '{BRACKETED}', 2), {sql.WS}) AS name, 'avfoundation' AS input_format,
         CAST(NULL AS BIGINT) AS channels, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS VARCHAR) AS details, line_no
  FROM av_marked WHERE header IS NULL AND in_audio AND regexp_matches(payload, '^\[[0-9]+\]\s*.+'))"""
)

_PULSE = (
    _lines("linux", "pulse")
    + r""",
pulse_placed AS (
  SELECT *, count(*) FILTER (sources OR opener <> '') OVER w AS grp,
         count(*) FILTER (sources) OVER w AS n_sources, count(*) FILTER (starts_with(lowered, 'sinks')) OVER w AS n_sinks
  FROM (SELECT *, starts_with(lowered, 'sources') AS sources,
               regexp_extract(payload, '^(?i:source\s*#[0-9]+|[0-9]+:\s*.+)') AS opener FROM pulse_lines)
  WINDOW w AS (PARTITION BY host ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
pulse_attributes AS (
  SELECT host, grp, line_no, opener <> '' AS opens,
         nullif(regexp_extract(opener, '^(?i:source\s*#)?([0-9]+)', 1), '') AS index,
         nullif(regexp_extract(opener, '^[0-9]+:\s*(.+)', 1), '') AS given,
         CASE WHEN opener = '' THEN nullif(regexp_extract(payload, '^(?i)name:\s*(.*)$', 1), '') END AS raw,
         CASE WHEN opener = '' THEN nullif(regexp_extract(payload, '^(?i)description:\s*(.*)$', 1), '') END AS description,
         CASE WHEN opener = '' THEN nullif(regexp_extract(payload, '^(?i:sample spec:).*?([0-9]+)ch', 1), '') END AS spec_channels,
         CASE WHEN opener = '' THEN nullif(regexp_extract(payload, '^(?i:sample spec:).*?([0-9]+)(?i:hz)', 1), '') END AS spec_rate,
         CASE WHEN opener = '' THEN nullif(regexp_extract(payload, '^(?i:channels:)\s*([0-9]+)', 1), '') END AS plain_channels
  FROM pulse_placed WHERE n_sources > 0 AND n_sinks = 0 AND NOT sources),
pulse_devices AS (
  SELECT host, max(index) AS index, min(line_no) FILTER (opens) AS line_no, max(given) AS given,
         arg_min(raw, line_no) FILTER (raw IS NOT NULL) AS first_raw,
         arg_max(raw, line_no) FILTER (raw IS NOT NULL) AS last_raw,
         arg_max(description, line_no) FILTER (description IS NOT NULL) AS description,
         arg_max(spec_channels, line_no) FILTER (spec_channels IS NOT NULL) AS spec_channels,
         arg_max(spec_rate, line_no) FILTER (spec_rate IS NOT NULL) AS spec_rate,
         arg_min(plain_channels, line_no) FILTER (plain_channels IS NOT NULL) AS plain_channels
  FROM pulse_attributes GROUP BY host, grp HAVING max(index) IS NOT NULL),
pulse AS (
  SELECT host, CAST(index AS BIGINT) AS index, name, 'pulse' AS input_format,
         CAST(coalesce(spec_channels, plain_channels) AS BIGINT) AS channels, CAST(spec_rate AS BIGINT) AS sample_rate,
         CASE WHEN raw <> name THEN raw END AS details, line_no
  FROM (SELECT *, coalesce(description, given, first_raw, '') AS name, coalesce(last_raw, given) AS raw FROM pulse_devices))"""
)

# Per device text of SPEC_DEVICE: what a right reading of it gives.
_SPECS = f"""
WITH specs AS (
  SELECT *, o_orderkey % 20 AS n, 'host-' || o_custkey AS host, CAST(o_orderkey AS VARCHAR) AS channel FROM orders)
SELECT host, channel,
  CASE WHEN n IN (0, 2, 8, 12, 13, 18) THEN 'pulse' WHEN n IN (3, 4, 14) THEN 'dshow' WHEN n = 5 THEN 'alsa' WHEN n = 15 THEN 'avfoundation' END AS input_format,
  CASE n WHEN 0 THEN 'src_' || o_custkey WHEN 2 THEN 'default_' || o_custkey WHEN 3 THEN 'audio="Mic'
    WHEN 4 THEN 'audio=Loop ' || o_custkey WHEN 5 THEN 'hw/' || o_custkey WHEN 8 THEN 'x' || o_custkey
    WHEN 12 THEN 'my%20dev' || o_custkey WHEN 13 THEN 'x' || o_custkey WHEN 14 THEN 'audio=Desk ' || o_custkey
    WHEN 15 THEN '' || o_custkey WHEN 18 THEN 'x' || o_custkey END AS input_target,
  CAST(CASE n WHEN 0 THEN 48000 WHEN 4 THEN 44100 WHEN 8 THEN 32000 ELSE CASE WHEN n IN (2, 3, 5, 12, 13, 14, 15, 18) THEN 16000 END END AS BIGINT) AS sample_rate,
  CAST(CASE WHEN n IN (0, 2) THEN 2 WHEN n IN (3, 4, 5, 8, 12, 13, 14, 15, 18) THEN 1 END AS BIGINT) AS channels,
  CASE WHEN n = 0 THEN 's16le' WHEN n IN (2, 3, 4, 5, 8, 12, 13, 14, 15, 18) THEN 'f32le' END AS sample_format,
  CAST(CASE n WHEN 4 THEN 11025 WHEN 5 THEN 512 WHEN 13 THEN 1 WHEN 18 THEN 1 END AS BIGINT) AS chunk_frames,
  CASE WHEN n = 12 THEN '-a|b|c|-thread-queue-size|' || o_custkey WHEN n IN (0, 2, 3, 4, 5, 8, 13, 14, 15, 18) THEN '' END AS args_before,
  CASE WHEN n = 12 THEN '-x-y' WHEN n IN (0, 2, 3, 4, 5, 8, 13, 14, 15, 18) THEN '' END AS args_after,
  CASE n WHEN 1 THEN 'unknown option: unexpected' WHEN 6 THEN 'unknown option: sample_rate' WHEN 7 THEN 'invalid sample_rate: abc'
    WHEN 9 THEN 'channels is not positive' WHEN 10 THEN 'unknown sample format' WHEN 11 THEN 'no device identifier'
    WHEN 16 THEN 'sample_rate is not positive' WHEN 17 THEN 'no input format' WHEN 19 THEN 'no device given' END AS error
FROM specs"""

ORACLES = {
    "device_inventory_dshow": sql.with_(_DSHOW, body="SELECT * FROM dshow ORDER BY host, index"),
    "device_inventory_avfoundation": sql.with_(
        _AVFOUNDATION, body="SELECT * FROM avfoundation ORDER BY host, index, line_no"
    ),
    "device_inventory_pulse": sql.with_(_PULSE, body="SELECT * FROM pulse ORDER BY host, index, line_no"),
    "recommended_specs": sql.with_(
        _DSHOW,
        _AVFOUNDATION,
        _PULSE,
        body="""SELECT host, input_format, line_no, CASE input_format
            WHEN 'dshow' THEN 'dshow:audio="' || coalesce(details, name) || '"'
            WHEN 'avfoundation' THEN 'avfoundation:' || index
            ELSE 'pulse:' || nullif(coalesce(details, name), '') END AS recommended
        FROM (SELECT * FROM dshow UNION ALL SELECT * FROM avfoundation UNION ALL SELECT * FROM pulse)""",
    ),
    "device_values": f"""
        SELECT o_orderkey,
          CASE WHEN n < 3 THEN ':disabled:' WHEN n = 6 THEN 'mic ' || o_custkey END AS device, n < 3 AS is_disabled
        FROM (SELECT *, o_orderkey % 8 AS n FROM orders)""",
    "device_specs": _SPECS,
    "device_specs_by_index": sql.with_(
        _DSHOW,
        body="""SELECT e.host, CAST(e.event_id AS VARCHAR) AS channel, 'dshow' AS input_format,
          'audio=' || coalesce(d.name, CAST(k AS VARCHAR)) AS input_target, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT *, 'host-' || user_id AS host, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
        LEFT JOIN dshow d ON d.host = e.host AND d.index = e.k""",
    ),
    "chunk_frames": f"""
        SELECT host, channel, coalesce(chunk_frames, greatest(CAST(floor(sample_rate *
          greatest((CAST(channel AS BIGINT) % 3) * CAST(0.25 AS DOUBLE), CAST(0.001 AS DOUBLE))) AS BIGINT), 1)) AS chunk_frames
        FROM ({_SPECS}) WHERE error IS NULL""",
}

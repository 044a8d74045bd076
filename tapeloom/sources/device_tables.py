"""Device logs over the given tables.

The CASE texts below are read by Spark and by the SQL twins alike, so both see
the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.tables import table

LISTING_LINES = {
    "windows": """CASE event_type
        WHEN 'signup' THEN CASE WHEN k < 4 THEN '[dshow @ 0x1] DirectShow audio devices' ELSE '[dshow @ 0x1] DirectShow video devices (some)' END
        WHEN 'click' THEN concat('[dshow @ 0x1]  "Mic ', k, '"')
        WHEN 'purchase' THEN concat('[dshow @ 0x1]  "Line ', k, '" (audio)')
        WHEN 'view' THEN concat('[dshow @ 0x1]     Alternative name "@dev_', event_id, '"')
        ELSE CASE WHEN k < 3 THEN '' WHEN k < 6 THEN 'Error opening input' ELSE '[dshow @ 0x1] ' END END""",
    "darwin": """CASE event_type
        WHEN 'signup' THEN CASE WHEN k < 5 THEN '[AVFoundation @ 0x9] AVFoundation audio devices:' ELSE '[AVFoundation @ 0x9] AVFoundation video devices:' END
        WHEN 'click' THEN concat('[AVFoundation @ 0x9] [', k, '] Mic ', event_id)
        WHEN 'purchase' THEN concat('[AVFoundation @ 0x9]  [', k, ']   Line ', event_id, '  ')
        WHEN 'view' THEN '[AVFoundation @ 0x9] no index here'
        ELSE '' END""",
    "linux": """CASE event_type
        WHEN 'signup' THEN CASE WHEN k = 0 THEN '[pulse] Sinks:' WHEN k < 6 THEN '[pulse] Sources:' ELSE '[pulse]   State: IDLE' END
        WHEN 'click' THEN concat('[pulse]  ', k, ': Device ', event_id)
        WHEN 'purchase' THEN concat('[pulse] Source #', k)
        WHEN 'view' THEN CASE k % 4
            WHEN 0 THEN concat('[pulse]   Name: raw', event_id)
            WHEN 1 THEN concat('[pulse]   Description: Desc ', event_id)
            WHEN 2 THEN concat('[pulse]   Sample spec: s16le ', k + 1, 'ch ', k * 1000 + 8000, 'Hz')
            ELSE concat('[pulse]   Channels: ', k, ' (plain)') END
        ELSE '[pulse]     Flags: DECIBEL_VOLUME' END""",
}

SPEC_DEVICE = """CASE o_orderkey % 20
    WHEN 0 THEN concat('pulse:src_', o_custkey, '?sample_rate=48000&channels=2&sample_fmt=S16LE')
    WHEN 1 THEN concat('pulse:dev', o_custkey, '?unexpected=1')
    WHEN 2 THEN concat('default_', o_custkey, '?channels=2')
    WHEN 3 THEN concat('dshow:audio="Mic #', o_custkey, '"')
    WHEN 4 THEN concat('dshow:audio="Loop ', o_custkey, '"?chunk_ms=250&sample_rate=44100')
    WHEN 5 THEN concat('alsa://hw/', o_custkey, '?chunk_frames=512&chunk_ms=100')
    WHEN 6 THEN concat('pulse:x', o_custkey, '?sample_rate=')
    WHEN 7 THEN concat('pulse:x', o_custkey, '?sample_rate=abc&channels=zz')
    WHEN 8 THEN concat('pulse:x', o_custkey, '?sample_rate=8000&sample_rate=+32_000&&=v')
    WHEN 9 THEN concat('pulse:x', o_custkey, '?channels=0')
    WHEN 10 THEN concat('pulse:x', o_custkey, '?sample_fmt=u8')
    WHEN 11 THEN 'pulse:?channels=1'
    WHEN 12 THEN concat('  PULSE:my%20dev', o_custkey, '?args=-a+b%20c&opt_thread_queue_size=', o_custkey, '&out_flag_x_y  ')
    WHEN 13 THEN concat('pulse:x', o_custkey, '?chunk_frames=-5')
    WHEN 14 THEN concat('audio=Desk ', o_custkey)
    WHEN 15 THEN concat('', o_custkey)
    WHEN 16 THEN concat('pulse:x', o_custkey, '?sample_rate=-1')
    WHEN 17 THEN '   '
    WHEN 18 THEN concat('pulse:x', o_custkey, '?chunk_ms=0.01')
    ELSE NULL END"""

#: Orders 2 run on linux, 14 on windows, 15 on darwin.
SPEC_PLATFORM = "CASE WHEN o_orderkey % 20 = 2 THEN 'linux' WHEN o_orderkey % 20 = 14 THEN 'windows' ELSE 'darwin' END"

DEVICE_VALUE = """CASE o_orderkey % 8
    WHEN 0 THEN ' Skip ' WHEN 1 THEN 'OFF' WHEN 2 THEN ':disabled:' WHEN 3 THEN 'Default'
    WHEN 4 THEN ' auto' WHEN 5 THEN '   ' WHEN 6 THEN concat('  mic ', o_custkey, ' ') ELSE NULL END"""


def listings(spark: SparkSession, sf_dir: str, platform: str) -> DataFrame:
    """Events as listing lines; the user is the host."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
        F.lit(platform).alias("platform"),
        F.col("event_id").alias("line_no"),
        F.expr(LISTING_LINES[platform]).alias("line"),
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as configured capture devices."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("host-"), F.col("o_custkey").cast("string")).alias("host"),
        F.col("o_orderkey").cast("string").alias("channel"),
        F.expr(SPEC_DEVICE).alias("device"),
        F.expr(SPEC_PLATFORM).alias("platform"),
        F.lit(16000).alias("default_sample_rate"),
        F.lit(1).alias("default_channels"),
    )


def index_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bare device numbers of windows hosts."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
        F.col("event_id").cast("string").alias("channel"),
        F.col("k").cast("string").alias("device"),
        F.lit("windows").alias("platform"),
        F.lit(16000).alias("default_sample_rate"),
        F.lit(1).alias("default_channels"),
    )

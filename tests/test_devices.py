import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import device, pcm
from tapeloom.operators import devices


def _listing(spark, platform, text, host="h"):
    rows = [(host, platform, i, line) for i, line in enumerate(text.strip("\n").split("\n"))]
    return spark.createDataFrame(rows, schemas.DEVICE_LISTINGS).repartition(4)


def _rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in devices.by_index(df).collect()]


# One section per kind, names in quotes, a second name on the line below.
DSHOW = """
[in#0 @ 7f] DirectShow video devices
[in#0 @ 7f]  "Ceiling Eye"
[in#0 @ 7f]     Alternative name "@eye"
[in#0 @ 7f] DirectShow audio devices
[in#0 @ 7f]  "Boundary Plate [left] (v2)"
[in#0 @ 7f]     alternative Name: "@plate-07"
[in#0 @ 7f]  "Line Return"
"""

# No sections: every name carries its kind.
DSHOW_TAGGED = """
[in#0 @ 80] "Gooseneck №1" (audio)
[in#0 @ 80]   Alternative name "@goose"
[in#0 @ 80] "Door Camera" (video)
[in#0 @ 80] "Taça ao vivo (audio)" (audio, video)
[in#0 @ 80]   Alternative name "@cup-a"
[in#0 @ 80]   Alternative name "@cup-b"
nothing more to list
"""


def test_dshow(spark):
    got = _rows(devices.dshow_inventory(_listing(spark, "windows", DSHOW)), "index", "name", "details")
    assert got == [(0, "Boundary Plate [left] (v2)", "@plate-07"), (1, "Line Return", None)]
    got = _rows(devices.dshow_inventory(_listing(spark, "windows", DSHOW_TAGGED)), "index", "name", "details")
    assert got == [(0, "Gooseneck №1", "@goose"), (1, "Taça ao vivo (audio)", "@cup-b")]


def test_dshow_alternative_name_first(spark):
    text = '[x] DirectShow audio devices\n[x] Alternative name "@first"\n[x] Alternative name "@its detail"\n[x] "Mic"'
    got = _rows(devices.dshow_inventory(_listing(spark, "windows", text)), "index", "name", "details")
    assert got == [(0, "@first", "@its detail"), (1, "Mic", None)]


def test_avfoundation(spark):
    text = """
[list] AVFoundation audio devices:
[list] [12] Balcony pair
[list] [4] Podium
[list] AVFoundation video devices:
[list] [0] Balcony view
[list] AVFoundation audio devices:
[list] [5]   Tape return
"""
    got = _rows(devices.avfoundation_inventory(_listing(spark, "darwin", text)), "index", "name")
    assert got == [(4, "Podium"), (5, "Tape return"), (12, "Balcony pair")]


def test_pulse(spark):
    text = """
[srv] 3: named too early
[srv] Sources of this host
[srv] 11: Hall left
[srv]     Sample spec: float32le 1ch 96000Hz
[srv]     State: idle
[srv] Source #8
[srv]     Description: Stage box
[srv]     Name: in.stage
[srv]     Name: in.stage.b
[srv]     Channels: 16 in use
[srv] Source #2
[srv]     Name: in.plain
[srv] 30: Hall right
[srv]     Channels: 3
[srv]     Sample spec: s16le 2ch
[srv] Sources, second list
[srv]     Description: of no source
[srv] Source #9
[srv] Sinks of this host
[srv] 1: a sink
[srv] Sources:
[srv] 77: too late
"""
    got = _rows(devices.pulse_inventory(_listing(spark, "linux", text)), "index", "name", "channels", "sample_rate", "details")
    assert got == [
        (2, "in.plain", None, None, None),
        (8, "Stage box", 16, None, "in.stage.b"),
        (9, "", None, None, None),
        (11, "Hall left", 1, 96000, None),
        (30, "Hall right", 2, None, None),
    ]


def test_hosts_do_not_mix(spark):
    both = _listing(spark, "windows", DSHOW, "a").unionByName(_listing(spark, "windows", DSHOW_TAGGED, "b"))
    got = _rows(devices.dshow_inventory(both), "host", "index", "name")
    assert got == [
        ("a", 0, "Boundary Plate [left] (v2)"), ("a", 1, "Line Return"), ("b", 0, "Gooseneck №1"), ("b", 1, "Taça ao vivo (audio)")
    ]


SPECS = [
    (
        "pulse:in.stage?channels=6&sample_fmt=S32LE&sample_rate=96000&args=-fragment_size 960 -wallclock",
        "any",
        dict(input_format="pulse", input_target="in.stage", sample_rate=96000, channels=6, sample_format="s32le", args_before_input=["-fragment_size", "960", "-wallclock"]),
    ),
    ("pulse:in.stage?colour=red", "any", dict(error="unknown option: colour", input_format=None)),
    ("in.hall?channels=3", "linux", dict(input_format="pulse", input_target="in.hall", channels=3, sample_rate=16000)),
    ("5", "windows", dict(input_format="dshow", input_target="audio=Line Return")),
    ("31", "windows", dict(input_format="dshow", input_target="audio=31")),
    ('dshow:audio="@plate\\x_{07}"', "windows", dict(input_target="audio=@plate\\x_{07}")),
    ('audio="A ""b"" c"', "windows", dict(input_target='audio=A ""b"" c')),
    ("3", "darwin", dict(input_format="avfoundation", input_target="3")),
    ("mic", "darwin", dict(error="no input format")),
    ("", "linux", dict(error="no device given")),
    (None, "linux", dict(error="no device given")),
    ("   ", "linux", dict(error="no input format")),
    ("pulse:", "any", dict(error="no device identifier")),
    ("pulse:x?chunk_ms=500", "any", dict(chunk_frames=8000)),
    ("pulse:x?chunk_ms=500&sample_rate=8000", "any", dict(chunk_frames=4000)),
    ("pulse:x?chunk_ms=-1", "any", dict(chunk_frames=1)),
    ("pulse:x?chunk_ms=x", "any", dict(error="invalid chunk_ms: x")),
    ("pulse:x?chunk_frames=0", "any", dict(chunk_frames=1)),
    ("pulse:x?channels=1.5", "any", dict(error="invalid channels: 1.5")),
    ("pulse:x?sample_rate=1&sample_rate=bad&sample_rate=2", "any", dict(error="invalid sample_rate: bad")),
    ("pulse:x?args='open", "any", dict(error="unbalanced quotes")),
    ("pulse:x?args=", "any", dict(error="unknown option: args")),
    (
        "pulse:x?opt_a_b=1&flag_c=9&opt_d&out_opt_e=%2Bf&out_flag_g&out_args='two words' -h",
        "any",
        dict(args_before_input=["-a-b", "1", "-c", "-d"], args_after_input=["-e", "+f", "-g", "two words", "-h"]),
    ),
    ("pulse:x?&&=only&sample_fmt=S32LE", "any", dict(sample_format="s32le", error=None)),
    ("alsa://hw/0#cut?sample_rate=1", "any", dict(input_format="alsa", input_target="hw/0", sample_rate=16000)),
    ("pulse:a%zz?opt_x=%zz+y", "any", dict(input_target="a%zz", args_before_input=["-x", "%zz y"])),
]


def test_specs(spark):
    rows = [("h", str(i), spec, platform, 16000, 1) for i, (spec, platform, _) in enumerate(SPECS)]
    listed = spark.createDataFrame(
        [("h", 5, "Line Return", "dshow", None, None, None, 4), ("other", 31, "Elsewhere", "dshow", None, None, None, 1)],
        schemas.DEVICE_INVENTORY,
    )
    got = {r.channel: r for r in devices.parse_specs(spark.createDataFrame(rows, schemas.DEVICE_SPECS), listed).collect()}
    assert len(got) == len(SPECS)
    for i, (spec, _, expected) in enumerate(SPECS):
        assert {k: got[str(i)][k] for k in expected} == expected, spec


def test_chunk_frames(spark):
    df = spark.createDataFrame([(16000, 0.5, None), (16000, 0.0, None), (100, 0.001, None), (16000, 0.5, 12), (16000, 0.5, 0), (44100, None, None), (5, None, None)], "r int, s double, o int")
    got = [r[0] for r in df.select(pcm.chunk_frames(F.col("r"), F.col("s"), F.col("o"))).collect()]
    assert got == [8000, 16, 1, 12, 1, 4410, 1]


VALUES = [(None, None), ("", None), ("  ", None), (" Skip ", ":disabled:"), ("NONE", ":disabled:"), (":disabled:", ":disabled:"), ("Auto", None), ("default", None), (" mic 1 ", "mic 1")]


def test_device_values(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(VALUES)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(device.normalise_value(F.col("v"))).collect()]
    assert got == [expected for _, expected in VALUES]


RECOMMENDED = [
    ("dshow", 0, "Mic", "@alt", 'dshow:audio="@alt"'),
    ("DShow ", 0, "Mic", "AUDIO=x", 'dshow:audio="x"'),
    ("dshow", 0, 'A "b" c', None, 'dshow:audio="A \\"b\\" c"'),
    ("dshow", 0, "", "  ", None),
    ("avfoundation", 3, "x", None, "avfoundation:3"),
    ("avfoundation", None, "x", None, None),
    ("pulse", 0, "Nice", " raw ", "pulse:raw"),
    ("pulse", 0, "Nice", "", "pulse:Nice"),
    ("pulse", 0, None, None, None),
    ("alsa", 0, "hw:0", None, "alsa:hw:0"),
    (None, 0, "x", None, None),
]


@pytest.mark.parametrize("kind, index, name, details, expected", RECOMMENDED)
def test_recommended_spec(spark, kind, index, name, details, expected):
    df = spark.createDataFrame([(kind, index, name, details)], "k string, i int, n string, d string")
    got = df.select(device.recommended_spec(F.col("k"), F.col("i"), F.col("n"), F.col("d"))).collect()[0][0]
    assert got == expected

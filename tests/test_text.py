import pathlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions import text


def _apply(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


SPACES = "".join(chr(c) for c in range(0x10FFFF) if chr(c).isspace())


def test_whitespace_table_is_complete():
    assert sorted(text.WHITESPACE) == sorted(SPACES)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab.é" + SPACES), max_size=12), min_size=40, max_size=60))
def test_strip_words_and_preview_like_python(spark, values):
    assert _apply(spark, values, text.strip) == [v.strip() for v in values]
    assert _apply(spark, values, text.rstrip) == [v.rstrip() for v in values]
    assert _apply(spark, values, text.word_count) == [len(v.split()) for v in values]
    assert _apply(spark, values, text.preview_sentence) == [v.split(". ")[0].strip() or None for v in values]


def test_path_stem_like_pathlib(spark):
    paths = ["a/b/mix.wav", "a/.hidden", "x.tar.gz", "noext", "a/b.", "a/..b", "dir.v2/file", "é.ü.wav"]
    assert _apply(spark, paths, text.path_stem) == [pathlib.PurePosixPath(p).stem for p in paths]
    assert _apply(spark, paths, text.file_name) == [pathlib.PurePosixPath(p).name for p in paths]


def test_summary_cuts_code_points(spark):
    values = ["", "\n", "x" * 279, "é" * 280, "😀" * 281]
    assert _apply(spark, values, text.summarise) == [
        "No transcript available.",
        "\n",
        "x" * 279,
        "é" * 280,
        "😀" * 280 + "...",
    ]


def test_two_decimals_round_like_python(spark):
    rng = random.Random(5)
    values = [0.0, 0.125, 1.005, 2.675, 12.345, 26.625, 99.995, 999.995, 1234567.125, -1.125, -0.001]
    values += [rng.randrange(10**7) / 1000 for _ in range(2000)]
    values += [rng.randrange(10**6) / 8 for _ in range(500)]
    assert _apply(spark, values, text.seconds, "double") == [f"{v:6.2f}" for v in values]

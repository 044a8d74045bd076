"""Running values over blocks equal a plain loop, for any block size."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.ordered import Fold, joined_pages, ordinal, running


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for key, size in (("hot", 300), ("warm", 20), ("one", 1)):
        for seq in rng.sample(range(size * 3), size):
            rows.append((key, seq, rng.randrange(10), rng.choice([None, True, False])))
    rng.shuffle(rows)
    return rows


def _expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        total, before, last, first, top = 0, 0, None, None, None
        for _, seq, value, flag in sorted(r for r in rows if r[0] == key):
            before, total = total, total + value
            last = flag if flag is not None else last
            first = flag if first is None else first
            top = value if top is None else max(top, value)
            out[key, seq] = (total, before, last, first, top)
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 64, 4096])
@pytest.mark.parametrize("partitions", [1, 8])
def test_running_equals_loop(spark, block_rows, partitions):
    rows = _rows(block_rows)
    df = spark.createDataFrame(rows, "key string, seq bigint, value int, flag boolean").repartition(partitions)
    folds = {
        "total": Fold("sum", F.col("value")),
        "before": Fold("sum", F.col("value"), inclusive=False),
        "last": Fold("last", F.col("flag")),
        "first": Fold("first", F.col("flag")),
        "top": Fold("max", F.col("value")),
    }
    got = running(df, ["key"], "seq", folds, block_rows).collect()
    assert {(r.key, r.seq): (r.total, r.before, r["last"], r["first"], r.top) for r in got} == _expected(rows)


def test_ordinal_is_dense(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "key string, seq bigint, value int, flag boolean")
    got = ordinal(df, ["key"], "seq", "n", block_rows=5).collect()
    for key in ("hot", "warm", "one"):
        ordered = [r.n for r in sorted((r for r in got if r.key == key), key=lambda r: r.seq)]
        assert ordered == list(range(len(ordered)))


def test_pages_hold_everything_in_order(spark):
    df = spark.range(95).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.col("id").cast("string").alias("t"))
    pages = joined_pages(df, ["key"], "at", F.col("t"), "\n", "text", page_rows=10).orderBy("part").collect()
    assert len(pages) == 10
    assert "\n".join(p.text for p in pages) == "\n".join(str(i) for i in range(95))

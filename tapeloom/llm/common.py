"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import new_shared_path

#: White space that separates words: space and U+0009 to U+000D, nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: One column that holds an input row whole, so that no input name can clash.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct column; extra columns keep any name they have."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def field(name: str) -> Column:
    return F.col(f"{ROW}.`{name}`")


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The input columns again, some of them replaced by new values."""
    return df.select(*[replaced.get(c, field(c)).alias(c) for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: inside ``body`` it is a variable, never a repeated expression.

    A column that a lambda names is computed again for every element when the
    optimizer merges projections; a bound variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text in order; none for an empty or NULL text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), "")


def windows(items: Column, size: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body(items, i)`` for the first index of every window of ``size`` items; empty if there is none."""
    return let(
        items,
        lambda xs: F.when(
            F.size(xs) >= size,
            F.transform(F.sequence(F.lit(0), F.size(xs) - size), lambda i: body(xs, i)),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def window_hashes(items: Column, size: int) -> Column:
    """A 64-bit hash of every window of ``size`` values."""
    return windows(items, size, lambda xs, i: F.xxhash64(*[F.get(xs, i + j) for j in range(size)]))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame) -> DataFrame:
    """A table of short rows in no more partitions than the cluster has cores: it is written as few files."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def small_batches(spark: SparkSession, rows: int = 128) -> None:
    """Bound Arrow batches by rows: texts may be long, and a batch lies in memory whole.

    A smaller setting of the session stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))

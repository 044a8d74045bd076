"""Small files and listings of shared folders, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, sorted; none where there is no such folder."""
    files, folder = _at(spark, path)
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file whole; None where there is none."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file under another name and move it into place."""
    files, place = _at(spark, path)
    _, beside = _at(spark, f"{path}.new")
    stream = files.create(beside, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    files.delete(place, False)
    files.rename(beside, place)


def make(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)

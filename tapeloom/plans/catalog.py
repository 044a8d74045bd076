"""All registered queries and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.plans import audio_queries, device_queries, snapshot_queries, store_queries, stream_queries, text_queries
from tapeloom.session import ship_package

_AREAS = [store_queries, snapshot_queries, text_queries, audio_queries, device_queries, stream_queries]

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {name: _shipped(fn) for area in _AREAS for name, fn in area.QUERIES.items()}
ORACLES: dict[str, str] = {name: text for area in _AREAS for name, text in area.ORACLES.items()}

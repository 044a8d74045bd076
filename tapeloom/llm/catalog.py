"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import (
    attention_mil,
    bpe,
    html_blocks,
    mixing,
    one_permutation,
    order_minhash,
    periodic_runs,
    robust_quality,
    secrets,
    simhash,
    source_audit,
    token_counts,
    warc,
)
from tapeloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: list[Query] = [
    bpe.op1_bpe_round_trip,
    mixing.op5_source_mix,
    order_minhash.op2_order_minhash,
    robust_quality.op10_robust_quality,
    secrets.op3_secret_scan,
    attention_mil.op6_attention_quality,
    html_blocks.op7_html_main_text,
    token_counts.op9_token_counts,
    warc.op4_warc_round_trip,
    simhash.op8_simhash_near_dedup,
    periodic_runs.op11_periodic_runs,
    source_audit.op12_source_audit,
    one_permutation.op13_minhash_near_dedup,
]


def _shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {query.__name__: _shipped(query) for query in _QUERIES}
ORACLES: dict[str, str] = {
    "op4_warc_round_trip": warc.ORACLE,
    "op5_source_mix": mixing.ORACLE,
    "op3_secret_scan": secrets.ORACLE,
    "op12_source_audit": source_audit.ORACLE,
    "op13_minhash_near_dedup": one_permutation.ORACLE,
}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, line_dedup, periodic_runs, pii, quality, quotes, secret_scan, sentencepiece_codec, substring_dedup, turn_repair, warc, wrapper_induction

MODULES = (decontamination, jaccard_join, warc, quality, quotes, line_dedup, substring_dedup, sentencepiece_codec, secret_scan, pii, periodic_runs, turn_repair, wrapper_induction)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

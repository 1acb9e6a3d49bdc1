"""The queries ``opN_<name>`` and their SQL; each query module adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as _q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.ORACLES)

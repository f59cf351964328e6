"""Every query of the library outside the training-data operators, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("timeline", "scoring", "intervals", "aggregates", "joins", "texts", "sequences", "decisions", "kernels", "refine", "search", "restore", "continuity", "discovery", "coarse", "cuts", "hints", "matches", "retime", "segmenting")


def _each():
    for name in MODULES:
        yield importlib.import_module(f"chronoweave.queries.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for module in _each() for k, v in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for module in _each() for k, v in module.ORACLES.items()}

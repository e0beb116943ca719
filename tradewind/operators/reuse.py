"""Rows that one plan reads several times, computed once."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame


def computed_once(df: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use(df)``, for which the rows of ``df`` are computed once, however often the plan of the result reads them.

    They are kept in memory and on disk of the executors from the first read on (partitions that are lost are
    computed again from their lineage) until the result is no longer referenced. No job runs while the plan is built. A frame that is
    derived from the result, and outlives it, computes the rows again where it needs them.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    result = use(kept)

    def release() -> None:
        try:
            kept.unpersist()
        except (Py4JError, OSError, AttributeError):  # the session has ended, and its blocks with it
            pass

    weakref.finalize(result, release).atexit = False
    return result

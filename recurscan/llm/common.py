"""Small helpers of the corpus operators; their tables are written by recurscan.scratch."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import tables, written

__all__ = ["documents", "mix", "own_columns", "small_batches", "tables", "tidied", "written"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most that many rows, unless the session sets a number itself: texts can be long, and a batch is held in
    full on both sides. Results are lazy, so the setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(rows))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 values (wraps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def own_columns(keep: tuple[str, ...], made: tuple[str, ...]) -> list[str]:
    """The kept columns that do not have the name of one of the results': where they clash, the results win."""
    return [c for c in dict.fromkeys(keep) if c not in made]


def tidied(run):
    """run over Arrow batches, and memory given back to the system at its end: Python workers live on for later tasks."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not every C library has it
                pass

    return inner

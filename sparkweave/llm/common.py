"""What several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkweave.functions.scratch import passing, scratch, shared_dir, stored

__all__ = ["SPACE", "SPACE_RUN", "passing", "runs", "scratch", "shared_dir", "stored", "table", "tidied", "tidy"]

#: ASCII white space; words are the runs between it.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one table at a time, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        begin = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[begin]:
                continue
            part = batch.slice(begin, i - begin)
            if held and rows[begin] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            held_key = rows[begin]
            begin = i
    if held:
        yield pa.Table.from_batches(held)


def tidy() -> None:
    """Give back memory that isn't used any more: Python workers stay for later tasks, and so would all that they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def tidied(kernel: Callable) -> Callable:
    """A kernel over batches that tidies up behind it."""

    @wraps(kernel)
    def run(*batches):
        try:
            yield from kernel(*batches)
        finally:
            tidy()

    return run

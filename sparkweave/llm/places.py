"""Values for rows of stored tables, found by file and row.

To drop or sort the rows of a table of texts, a join would shuffle every text. Here the rows' values go,
by file and row, to small files in the shared folder, and the task that reads a part of the table looks
up the values of that part: texts don't move. Deletion vectors of table formats work alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, tidy

#: Rows of a file that are looked up together, as a power of two: a task that reads a file split of ordinary
#: size makes a few requests, not one for every batch.
CHUNK_BITS = 16
BUCKET_ROWS, LEAST_BUCKETS = 1 << 16, 64


def scanned(docs: DataFrame, name: str = "scanned") -> tuple[DataFrame, Column, Column]:
    """The table, the path of a row's file and its number there.

    What isn't a plain scan of Parquet files, or lists a file more than once, is stored first: file and row
    must tell every row from all others.
    """
    for table in (docs, None):
        table = table if table is not None else stored(docs, name)
        plan = table._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRelation":
            continue
        told = table.metadataColumn("_metadata")
        if "row_index" not in table.select(told).schema[0].dataType.names:
            continue
        given = plan.relation().location().rootPaths()
        roots = [given.apply(i).toString().rstrip("/") for i in range(given.size())]
        if len(set(roots)) == len(roots) and not any(set(roots) & set(_above(r)) for r in roots):
            return table, told["file_path"], told["row_index"]
    raise ValueError("rows of stored tables must have numbers")


def _above(path: str) -> list[str]:
    """The folders that a path lies in."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts))]


def located(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The table, a hash of a row's file and its number there; both together are unique."""
    table, path, row = scanned(docs, "located")
    return table, F.xxhash64(path), row


def numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The table and the number of each row in the order in which it was written: by file name and row.

    The driver holds one number a file.
    """
    table, path, row = scanned(docs, "numbered")
    sizes = table.select(path.alias("file")).groupBy("file").count().orderBy("file").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["file"], at))
        at += r["count"]
    begun = F.create_map(*(F.lit(x) for pair in starts for x in pair)) if starts else F.create_map(F.lit(""), F.lit(0))
    return table, begun[path].cast("long") + row


class Values:
    """Whole numbers, one in each of these columns, for some rows of a table."""

    def __init__(self, spark: SparkSession, name: str, columns: tuple[str, ...] = ("value",)):
        self.path, self.buckets, self.columns = scratch(spark, name), LEAST_BUCKETS, columns

    def write(self, found: DataFrame) -> Values:
        """Rows (file, row, columns), one for a file and row; best of a stored table, as they are counted first."""
        self.buckets = max(LEAST_BUCKETS, -(-found.count() // BUCKET_ROWS))
        chunk = F.shiftright("row", CHUNK_BITS)
        keyed = found.select("file", chunk.alias("chunk"), "row", *(F.col(c).cast("long") for c in self.columns), self._bucket(F.col("file"), F.col("row")).alias("bucket"))
        keyed.repartition("bucket").write.partitionBy("bucket").parquet(self.path)
        return self

    def _bucket(self, file: Column, row: Column) -> Column:
        return F.pmod(F.xxhash64(file, F.shiftright(row, CHUNK_BITS)), F.lit(self.buckets)).cast("int")

    def of(self, file: Column, row: Column) -> Column:
        """The row's value, or a struct if there are several columns; null if it has none."""
        path, names = self.path, list(self.columns)

        def batch(bucket: np.ndarray, files: np.ndarray, numbers: np.ndarray, seen: list) -> pa.Array:
            out, none = np.zeros((len(names), len(files)), np.int64), np.ones(len(files), bool)
            chunks = numbers >> CHUNK_BITS
            begins = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (chunks[1:] != chunks[:-1])]) if len(files) else []
            for begin, end in zip(begins, [*begins[1:], len(files)], strict=True):
                key = (int(bucket[begin]), int(files[begin]), int(chunks[begin]))
                if not seen or seen[0] != key:
                    seen[:] = [key, _chunk(path, names, *key)]
                rows = seen[1][0]
                if len(rows):
                    spot = np.minimum(np.searchsorted(rows, numbers[begin:end]), len(rows) - 1)
                    out[:, begin:end], none[begin:end] = seen[1][1:, spot], rows[spot] != numbers[begin:end]
            if len(names) == 1:
                return pa.array(out[0], mask=none)
            return pa.StructArray.from_arrays([pa.array(x) for x in out], names, mask=pa.array(none))

        @F.arrow_udf("long" if len(names) == 1 else "struct<" + ", ".join(f"{c}: long" for c in names) + ">")
        def values(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            seen: list = []
            for columns in batches:
                yield batch(*(c.to_numpy() for c in columns), seen)
            tidy()

        return values(self._bucket(file, row), file, row)


def _chunk(path: str, names: list[str], bucket: int, file: int, chunk: int) -> np.ndarray:
    """The numbers of the chunk's rows, ascending, and beneath them their values."""
    store, at = pyarrow.fs.FileSystem.from_uri(path)
    parts = [np.empty((1 + len(names), 0), np.int64)]
    for f in store.get_file_info(pyarrow.fs.FileSelector(f"{at}/bucket={bucket}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as held:
                table = pyarrow.parquet.ParquetFile(held).read(["file", "chunk", "row", *names], use_threads=False)
            told = np.array([table.column(c).to_numpy() for c in table.column_names])
            parts.append(told[2:, (told[0] == file) & (told[1] == chunk)])
    told = np.concatenate(parts, axis=1)
    return told[:, np.argsort(told[0])]

"""Best-fit packing with conflicts.

Documents go into bins of a fixed number of tokens. Open bins stand in the order of what is left in
them and carry bitmaps of the sources and duplicate clusters inside; from the tightest bin that would
hold a document the search goes on to the next until one has neither in its bitmaps. Shards of a bounded
number of documents, dealt by a hash or as runs of a given order, are packed each on its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN, stored, tidy

CAPACITY = 4096
SHARD_ROWS = 8192
ALIKE = 64  # rows that no column tells apart go to one shard in such numbers


def n_tokens(text: Column) -> Column:
    """Words and one separator."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 1).otherwise(F.size(F.split(trimmed, SPACE_RUN)) + 1).cast("long")


def pack(items: list[tuple[int, int, object, object]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack (key, size, source, cluster); gives (key, piece, bin, offset, size) for each piece.

    Larger items come first, and of equal ones the smaller key. What exceeds the capacity is cut: full
    pieces take a bin each and the rest is packed. A source and a cluster come once in a bin.
    """
    copies = Counter(c for _, _, _, c in items)
    source_bits: dict = {}
    cluster_bits: dict = {}
    bins: list[tuple[int, int]] = []  # (left, bin), ascending
    inside: dict[int, tuple[int, int]] = {}
    out, made = [], 0
    rests = []
    for key, size, source, cluster in items:
        piece, at = 0, 0
        while size - at > capacity:
            out.append((key, piece, made, 0, capacity))
            made, piece, at = made + 1, piece + 1, at + capacity
        rests.append((at - size, key, piece, source, cluster))
    rests.sort(key=lambda r: r[:3])
    least = -rests[-1][0] if rests else 0
    for minus, key, piece, source, cluster in rests:
        size = -minus
        s = source_bits.setdefault(source, 1 << len(source_bits))
        c = cluster_bits.setdefault(cluster, 1 << len(cluster_bits)) if copies[cluster] > 1 else 0
        at = bisect_left(bins, (size, -1))
        while at < len(bins):
            sources, clusters = inside[bins[at][1]]
            if not (sources & s or clusters & c):
                break
            at += 1
        if at < len(bins):
            left, number = bins.pop(at)
            sources, clusters = inside[number]
        else:
            left, number, sources, clusters = capacity, made, 0, 0
            made += 1
        out.append((key, piece, number, capacity - left, size))
        if left - size >= least:
            insort(bins, (left - size, number))
            inside[number] = (sources | s, clusters | c)
        else:
            inside.pop(number, None)
    return out


def _packed(capacity: int):
    def shard(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        table = table.sort_by([(c, "ascending") for c in ("locator", "id", "size", "source", "cluster")])
        ids = table.column("id").to_pylist()
        items = list(zip(range(len(ids)), *(table.column(c).to_pylist() for c in ("size", "source", "cluster")), strict=True))
        packed = pack(items, capacity)
        # bins are numbered by the first of their documents
        first: dict[int, int] = {}
        for k, _, b, _, _ in packed:
            first[b] = min(first.get(b, k), k)
        turn = {b: i for i, b in enumerate(sorted(first, key=lambda b: (first[b], b)))}
        found = [(ids[k], piece, (number << 32) + turn[b], at, size) for k, piece, b, at, size in packed]
        names = ["id", "piece", "bin_id", "bin_offset", "n_tokens"]
        tidy()
        return pa.table([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names)

    return shard


def best_fit(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, shard_rows: int = SHARD_ROWS, order: Column | None = None
) -> DataFrame:
    """One row per piece of a document: id, piece, bin_id, bin_offset, n_tokens.

    A bin holds no two documents of a duplicate cluster (by default: of equal text but for white space)
    and no two of a source, so a source with a large share of the documents leaves bins part empty. Null
    and empty texts are one separator long; a null source is a source; null ids pass through; repeated rows are packed each, in
    different bins; longer texts than a bin are cut into pieces and kept whole; an empty table gives
    none; other columns are dropped whatever their names. The result rests on the rows alone, not on how they
    lie: shards are dealt by a hash of id, text and source, and of rows alike in these by their count.

    With ``order``, numbers from 0 up without gaps, a shard is a run of it and bins are numbered along it.
    """
    own = cluster if cluster is not None else F.xxhash64(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " "))
    items = docs.select(F.col(id_col).cast("long").alias("id"), n_tokens(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), own.alias("cluster"), (F.xxhash64(id_col, text_col, source_col) if order is None else order).alias("locator"))
    items = stored(items, "packing-items")
    n = items.count()
    shards = max(1, -(-n // shard_rows))
    if order is None:  # rows alike would all meet in one shard
        alike = F.floor(F.row_number().over(Window.partitionBy("locator").orderBy("id", "size", "source", "cluster")) / ALIKE)
        shard = F.pmod(F.xxhash64("locator", alike), F.lit(shards))
    else:
        shard = F.floor(F.col("locator") / shard_rows)
    dealt = items.select("locator", "id", "size", "source", "cluster", shard.alias("shard"))
    packed = dealt.groupBy("shard").applyInArrow(_packed(capacity), "id long, piece long, bin_id long, bin_offset long, n_tokens long")
    return packed.withColumnRenamed("id", id_col)

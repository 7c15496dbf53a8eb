"""Mixing sources to target weights by proportionate-fair scheduling.

A source's documents form blocks. In the ideal mixture every source that has blocks left gives parts of them at
a rate in proportion to its weight. Block j is released at the slot in which the ideal mixture begins with it, and
due by the end of that in which it ends; at every slot the released block with the earliest deadline is placed. No
source is then ever a whole block ahead of or behind its ideal share, also when others have run out.

Weights are whole numbers. Whenever a unit of weight has given a whole number of blocks, all sources have, so what
is placed by then is settled and the slots from one such time to another are a piece that is scheduled independently
of all others: blocks, slots and ranks are distributed tables. Weights without a common measure make long pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice
from math import ceil, gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import passing, stored
from .places import Values, located

BLOCK = 16  # documents
PERIOD = 1 << 16  # slots in a piece, as near as the weights allow
TEMPERATURE = 0.5
#: The names, weights and sizes of the sources go to the driver and every task, at most so many of them.
MOST_SOURCES = 100_000
BUCKET_ROWS = 1 << 12  # about so many documents of a source are ranked together


def exact_weights(weights: list) -> list[int]:
    """The least whole numbers in exactly the proportion of the weights; floats are what they are written as."""
    exact = [Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    least = gcd(*whole) or 1
    return [w // least for w in whole]


class Plan:
    """The ideal mixture of sources with so many blocks and such weights, and the schedule of any piece of it.

    Its clock is what a unit of weight has given; slots are a function of it.
    """

    def __init__(self, blocks: list[int], weights: list, period: int = PERIOD):
        self.blocks, self.weights = blocks, exact_weights(weights)
        order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], self.weights[s]))
        self.ends = [Fraction(blocks[s], self.weights[s]) for s in order]  # when sources run out
        self.given = [0, *accumulate(blocks[s] for s in order)]  # blocks of those that have
        self.weight = list(accumulate((self.weights[s] for s in reversed(order)), initial=0))[::-1]  # of the others
        self.firsts, self.begins, self.steps, self.pieces, at = [], [], [], 0, 0
        for end, weight in zip(self.ends, self.weight, strict=False):
            if (last := ceil(end)) > at:
                step = -(-period // weight)
                self.firsts.append(self.pieces)
                self.begins.append(at)
                self.steps.append((step, last))
                self.pieces, at = self.pieces - (at - last) // step, last

    def slots(self, blocks: int, weight: int) -> tuple[int, int]:
        """The slots until a source of this weight has given so many blocks, as a fraction."""
        i = bisect_left(self.ends, Fraction(blocks, weight))
        return self.given[i] * weight + blocks * self.weight[i], weight

    def window(self, source: int, block: int) -> tuple[int, int]:
        """The slots from the first to before the second are open to the block."""
        n, d = self.slots(block, self.weights[source])
        m, _ = self.slots(block + 1, self.weights[source])
        return n // d, -(-m // d)

    def piece(self, number: int) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot) of every slot of a piece, by earliest deadline first."""
        i = bisect_right(self.firsts, number) - 1
        step, last = self.steps[i]
        begin = self.begins[i] + (number - self.firsts[i]) * step
        end = min(last, begin + step)
        waiting: list[tuple[int, int, int, int]] = []  # release, deadline, source, block
        ready: list[tuple[int, int, int]] = []

        def wait(s: int, j: int) -> None:
            if j < min(self.blocks[s], self.weights[s] * end):
                release, due = self.window(s, j)
                heapq.heappush(waiting, (release, due, s, j))

        for s, w in enumerate(self.weights):
            wait(s, w * begin)
        for t in range(self.slots(begin, 1)[0], self.slots(end, 1)[0]):
            while waiting and waiting[0][0] <= t:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            due, s, j = heapq.heappop(ready)
            if due <= t:
                raise AssertionError("a deadline was missed")
            yield s, j, t
            wait(s, j + 1)


def schedule(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, also: dict[str, Column] | None = None) -> DataFrame:
    """(id, source, block, slot, position, and the columns ``also``) for every row.

    Without weights a source's weight is its number of rows to the power TEMPERATURE, rounded. Rows of a source come
    in the order of a hash of the id (then the id; of rows alike, any order); ``block`` rows form a block and
    the last one may be smaller. Null sources are one source, null ids are ranked like others, repeated
    rows count each, an empty table gives none. A source without a weight above 0 raises ValueError, and so do
    more than MOST_SOURCES sources.
    """
    spark, more = docs.sparkSession, list(also or {})
    keyed = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *(c.alias(n) for n, c in (also or {}).items()))
    counts = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = sorted(((r.source, r.n) for r in counts), key=lambda r: (r[0] is None, r[0]))
    missing = [s for s, _ in counts if weights is not None and not weights.get(s, 0) > 0]
    if missing:
        raise ValueError(f"no weight for the sources {sorted(map(str, missing))[:5]}")
    plan = Plan([-(-n // block) for _, n in counts], [max(1, round(n**TEMPERATURE)) if weights is None else weights[s] for s, n in counts], period)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                placed = plan.piece(number)
                while part := list(islice(placed, 1 << 16)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], ["sid", "block", "slot"])

    slots = spark.range(0, plan.pieces, 1, max(1, min(plan.pieces, 10_000))).mapInArrow(pieces, "sid long, block long, slot long")
    hashed = lambda seed: F.xxhash64("source", F.lit(seed))
    names = spark.createDataFrame([(s, i, -(-n // BUCKET_ROWS)) for i, (s, n) in enumerate(counts)], "source string, sid long, buckets long")
    apart = next(k for k in range(100) if names.select(hashed(k)).distinct().count() == len(counts))  # so that a hash tells the sources apart
    known = keyed.withColumn("key", hashed(apart)).join(F.broadcast(names.select(hashed(apart).alias("key"), "sid", "buckets")), "key").drop("key")
    known = known.withColumn("order", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1))
    # a bucket is a range of the order, so a row's rank in its source is that in the bucket after all of those before
    bucket = F.shiftright(F.shiftright("order", 31) * F.col("buckets"), 32)
    known = known.withColumn("bucket", F.shiftleft("sid", 40) + bucket).drop("buckets")
    sizes = known.groupBy("sid", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("order", "id", *more))
    placed = known.withColumn("rank", rank).join(before, "bucket").withColumn("place", F.col("before") + F.col("rank") - 1)
    placed = placed.select("id", "source", F.expr(f"shiftleft(sid, 40) + place div {block}").alias("key"), F.expr(f"place div {block}").alias("block"), F.expr(f"place % {block}").alias("position"), *more)
    return placed.join(slots.select((F.shiftleft("sid", 40) + F.col("block")).alias("key"), "slot"), "key").select("id", "source", "block", "slot", "position", *more)


def mix(docs: DataFrame, weights: dict | None = None, **settings) -> DataFrame:
    """One row per document in its place of the mixture: id, source, block, slot, position in the block."""
    return schedule(docs, weights, **settings).withColumnRenamed("id", settings.get("id_col", "doc_id"))


def in_order(docs: DataFrame, weights: dict | None = None, **settings) -> DataFrame:
    """The documents, with all their columns, sorted into the order of the mixture; texts move once, for the sort.

    Nulls, repeated rows and empty tables are as in ``schedule``.
    """
    docs, file, row = located(docs)
    spots = Values(docs.sparkSession, "mixing-places")
    with passing(docs.sparkSession):
        places = schedule(docs, weights, **settings, also={"file": file, "row": row})
        value = F.col("slot") * settings.get("block", BLOCK) + F.col("position")
        spots.write(stored(places.select("file", "row", value.alias("value")), "mixing-slots"))
    return docs.orderBy(spots.of(file, row))

"""Similarity join on word n-grams with Bayesian pruning of candidates.

Texts with equal sets of n-grams are one class. Classes that agree on a band of MinHash values meet in
a bucket. There, pairs compare their MinHash values a few at a time and are dropped as soon as the
posterior probability that their Jaccard similarity reaches the threshold falls below a tolerance
(uniform prior; Chakrabarti and Parthasarathy's BayesLSH). What is left joins classes into clusters, and
within each cluster every pair is verified exactly. Buckets and clusters beyond a block's size are dealt
out as pairs of blocks, so no task holds more than two blocks and no pair is ever a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.skew import joined
from sparkweave.operators.components import stars

from .common import passing, runs, stored, tidied
from .places import Values, located

U = np.uint64


@dataclass(frozen=True)
class Config:
    n: int = 5  # words
    over: int = 4  # the threshold is over / under
    under: int = 5
    bands: int = 25
    band_rows: int = 5
    values: int = 128  # MinHash values compared, 16 bits of each
    steps: tuple[int, ...] = (16, 32, 64, 96, 128)
    tolerance: float = 1e-5
    block: int = 1024
    seed: int = 11

    @property
    def threshold(self) -> float:
        return self.over / self.under


def least_matches(config: Config) -> list[int]:
    """For each step, the fewest matches with which a pair stays: P(J >= t | m of k agree) >= tolerance."""
    t, found = config.threshold, []
    for k in config.steps:
        below, m = 0.0, -1
        while below < config.tolerance:  # the posterior is Beta(m + 1, k - m + 1); its upper tail at t is a binomial sum
            m += 1
            below += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        found.append(m)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * U(2) + U(1)


def shingles(data: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a whole text; a text of fewer words has one, of no words none."""
    words = (data or b"").split()
    if not words:
        return np.empty(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, words), np.uint64, len(words))
    factors = _odd(n, 5)
    if len(h) < n:
        x = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            x = _mixed(x + h[k : k + 1] * factors[k])
        return x
    x = h[: len(h) - n + 1] * factors[0]
    for k in range(1, n):
        x = x + h[k : len(h) - n + 1 + k] * factors[k]
    return np.unique(_mixed(x))


def _signatures(config: Config):
    factors, offsets = _odd(config.values, config.seed), _odd(config.values, config.seed + 1)
    key_factors = _odd(config.band_rows, config.seed + 2)
    used = config.bands * config.band_rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, keys, values = [], [], []
            for data in batch.column("data"):
                x = shingles(data.as_py(), config.n)
                cls.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                if not len(x):
                    keys.append([])
                    values.append(b"")
                    continue
                low = np.full(config.values, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(x), 512):
                    low = np.minimum(low, (x[at : at + 512, None] * factors + offsets).min(0))
                band = (low[:used].reshape(config.bands, config.band_rows) * key_factors).sum(1, dtype=np.uint64)
                keys.append(_mixed(band + np.arange(config.bands, dtype=np.uint64)).view(np.int64))
                values.append((low & U(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("file"), batch.column("row"), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.binary())],
                ["id", "file", "row", "cls", "keys", "vals"],
            )

    return rows


class _Union:
    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, members: np.ndarray) -> None:
        """All these are one from now on."""
        roots = np.unique(self.root[members])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def _linked(config: Config):
    """For each bucket (or pair of a bucket's blocks), each class with the least one it is connected to."""
    least = least_matches(config)

    def rows(batches):
        for group in runs(batches, ["key", "i", "j"]):
            names = group.column("cid").to_numpy()
            values = np.frombuffer(b"".join(group.column("vals").to_pylist()), np.uint16).reshape(len(names), config.values)
            block = group.column("block").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            order = np.argsort(names)
            names, values, block = names[order], values[order], block[order]
            union = _Union(len(names))
            for p in range(len(names) - 1 if i == j else len(names)):
                other = np.flatnonzero(union.root != union.root[p])
                other = other[other > p] if i == j else other[block[other] == j] if block[p] == i else other[:0]
                if not len(other):
                    continue
                same, begin = np.zeros(len(other), int), 0
                for end, need in zip(config.steps, least, strict=True):
                    same = same + (values[other, begin:end] == values[p, begin:end]).sum(1)
                    stay = same >= need
                    other, same, begin = other[stay], same[stay], end
                    if not len(other):
                        break
                if len(other):
                    union.join(np.append(other, p))
            hung = union.root != np.arange(len(names))
            if hung.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[union.root[hung]])], ["u", "v"])

    return rows


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every set in a with every set in b."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a]).reshape(len(a), len(b))
    sets = [*a, *b]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = (np.cumsum(shared) - 1)[place][shared[place]]
    owner = owner[shared[np.searchsorted(np.unique(flat), flat)]]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(place, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[low:high], place[low:high] - at] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out.astype(np.int64)


def _verified(config: Config):
    """For each cluster (or pair of its blocks), each class with its links there and the least one it is linked to."""

    def rows(batches):
        for group in runs(batches, ["comp", "i", "j"]):
            names, order = np.unique(group.column("cid").to_numpy(), return_index=True)
            copies, block = group.column("copies").to_numpy()[order], group.column("block").to_numpy()[order]
            sets = [shingles(group.column("data")[k].as_py(), config.n) for k in order.tolist()]
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            size = np.array([len(s) for s in sets])
            common = overlaps([sets[k] for k in left], [sets[k] for k in right])
            link = config.under * common >= config.over * (size[left][:, None] + size[right][None, :] - common)
            link &= left[:, None] != right[None, :]
            union, texts, docs = _Union(len(names)), np.zeros(len(names), int), np.zeros(len(names), int)
            for at, p in enumerate(left):
                linked = right[link[at]]
                if len(linked):
                    texts[p] += len(linked)
                    docs[p] += copies[linked].sum()
                    if i != j:
                        texts[linked] += 1
                        docs[linked] += copies[p]
                    union.join(np.append(linked, p))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, names[union.root], texts, docs)], ["cid", "root", "texts", "docs"])

    return rows


def _dealt(rows: DataFrame, key: str, size: Column, block: int) -> DataFrame:
    """Deal each key's rows to the pairs of its blocks; a key of up to one block has the pair (0, 0) alone."""
    blocks = F.ceil(size / block).cast("int")
    own = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config | None = None) -> DataFrame:
    """One row per document: id, class_id, n_links, n_text_links, copies.

    Two documents are linked when the Jaccard similarity of their sets of n-grams reaches the threshold.
    class_id is the least id among the documents that links connect; n_links counts linked documents,
    n_text_links linked other sets of n-grams; copies counts documents of the same set, itself included.
    Words are runs of bytes other than ASCII white space; a text of fewer than n words has itself as its
    only n-gram; null and empty texts have none and are copies of each other. Null ids count as rows and
    come after other ids. Repeated rows are copies. An empty table gives none; other columns are dropped
    whatever their names. A pair at the threshold misses all buckets with a chance of 5e-5 and a true
    pair is pruned with about the tolerance; both fall fast above it.
    """
    docs, file, row = located(docs)
    return _join(docs, file, row, id_col, text_col, config or Config()).select(F.col("id").alias(id_col), "class_id", "n_links", "n_text_links", "copies")


def _join(docs: DataFrame, file: Column, row: Column, id_col: str, text_col: str, c: Config) -> DataFrame:
    """The rows of join(), with file and row and those of the class's first document.

    A class is a set of n-grams; its number ``cid`` is that of its first document among the signatures.
    Signatures are looked up where they lie; only those that meet others in a bucket are shuffled.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), file.alias("file"), row.alias("row"), data)
    signed = plain.mapInArrow(tidied(_signatures(c)), "id long, file long, row long, cls binary, keys array<long>, vals binary")
    signed = stored(signed.withColumn("num", F.monotonically_increasing_id()), "ngram-signatures")
    n, met_most = signed.count(), c.bands * signed.count()
    # documents of equal sets
    ranked = F.struct(F.col("id").isNull().alias("none"), "id", "num")
    several = stored(signed.groupBy("cls").agg(F.min(ranked)["num"].alias("cid"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "ngram-copies")
    again = Values(spark, "ngram-again", ("cid", "copies"))
    again.write(stored(joined(signed.select("cls", "file", "row"), several, "cls", "copies", n).select("file", "row", "cid", "copies"), "ngram-again-rows"))
    told = signed.withColumn("again", again.of(F.col("file"), F.col("row"))).withColumn("cid", F.coalesce("again.cid", "num"))
    own = stored(told.select("id", "file", "row", "cid", F.coalesce("again.copies", F.lit(1)).alias("copies"), *(F.when(F.col("cid") == F.col("num"), F.col(x)).alias(x) for x in ("keys", "vals"))), "ngram-own")
    classes = own.where("vals IS NOT NULL")
    # classes that meet in a bucket; one with the same members as another one adds nothing
    met = classes.select(F.explode("keys").alias("key"), "cid")
    sizes = stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "ngram-sizes")
    met = stored(joined(met, sizes, "key", "size", met_most), "ngram-met")
    once = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cid")).alias("a"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("b"))
    once = stored(once.groupBy("size", "a", "b").agg(F.min("key").alias("key")).select("key", "size"), "ngram-buckets")
    wanted = Values(spark, "ngram-meeting").write(stored(met.select("cid").distinct().select(*_place("cid"), F.lit(0).alias("value")), "ngram-meeting-rows"))
    known = classes.where(wanted.of(*_place("cid")).isNotNull()).select("cid", "vals")
    candidates = _dealt(joined(met.select("key", "cid"), once, "key", "size", met_most).join(known, "cid"), "key", F.col("size"), c.block)
    near = stars(candidates.select("key", "i", "j", "block", "cid", "vals").mapInArrow(tidied(_linked(c)), "u long, v long"))
    near = stored(near.withColumnsRenamed({"node": "cid", "component": "comp"}), "ngram-near")
    sizes = stored(near.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "ngram-comps")
    # the text of a class is that of its first document; no other texts move, and these once
    members = joined(near, sizes, "comp", "size", n).join(classes.select("cid", "file", "row", "copies"), "cid")
    wanted = Values(spark, "ngram-wanted", ("comp", "size", "cid", "copies"))
    wanted.write(stored(members.select("file", "row", "comp", "size", "cid", "copies"), "ngram-members"))
    texts = docs.select(wanted.of(file, row).alias("own"), data).where("own IS NOT NULL").select("own.*", "data")
    checked = _dealt(texts, "comp", F.col("size"), c.block).select("comp", "i", "j", "block", "cid", "copies", "data")
    checked = stored(checked.mapInArrow(tidied(_verified(c)), "cid long, root long, texts long, docs long"), "ngram-verified")
    linked = stored(stars(checked.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "cid", "component": "root"}), "ngram-linked")
    counts = checked.groupBy("cid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    firsts = linked.join(classes.select("cid", "id", "file", "row"), "cid").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cid", "file", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
    found = joined(linked, stored(firsts, "ngram-firsts"), "root", "size", n).select("cid", "first").join(counts, "cid")
    of_class = classes.select("cid", "copies", F.struct(F.col("id").isNull().alias("none"), "id", "cid", "file", "row").alias("itself")).join(found, "cid", "left")
    first = F.coalesce("first", "itself")
    of_class = of_class.select(
        "cid", "copies", first["id"].alias("class_id"), first["file"].alias("first_file"), first["row"].alias("first_row"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return joined(own.select("id", "file", "row", "cid"), stored(of_class, "ngram-classes"), "cid", "copies", n).drop("cid")


def _place(number: str) -> tuple[Column, Column]:
    """The part of the table and the row there that a number of monotonically_increasing_id stands for."""
    return F.shiftright(number, 33).alias("file"), F.col(number).bitwiseAND(F.lit((1 << 33) - 1)).alias("row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config | None = None) -> DataFrame:
    """Of each group that links connect the row with the least id, with all its columns; of rows with that id one."""
    docs, file, row = located(docs)
    gone = Values(docs.sparkSession, "ngram-gone")
    with passing(docs.sparkSession):
        found = _join(docs, file, row, id_col, text_col, config or Config())
        dropped = found.where("file <> first_file OR row <> first_row").select("file", "row", F.lit(0).alias("value"))
        gone.write(stored(dropped, "ngram-dropped"))
    return docs.where(gone.of(file, row).isNull())

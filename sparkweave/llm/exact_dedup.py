"""Exact duplicates by a stateful stream.

Rows enter a log of (locator, id, digest), the locator being a file and a row in it. A stream over the log keeps, in RocksDB state on disk and
without expiry, for each digest the locator and id of the row that stays and the number of rows. Every
row that hits a digest already there is then checked against the group's bytes; digests whose texts
differ are keyed by the whole text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.skew import joined

from .common import SPACE_RUN, passing, scratch, stored
from .places import Values, scanned

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of at least this share of all rows, and of HOT_LEAST rows, are checked in SALTS parts; they are 1 / HOT_SHARE at most.
HOT_SHARE, HOT_LEAST, SALTS = 0.002, 1000, 64
BATCH_BYTES = 256 << 30
#: Native memory of the state on one executor, all its partitions together.
STATE_MB = 96


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _state(log: DataFrame, folder: str, kept: str, batch_bytes: int) -> DataFrame:
    """(digest, first, n) of every digest, from the state after the stream has taken what is new in the log's folder."""
    spark, partitions = log.sparkSession.newSession(), "spark.sql.shuffle.partitions"
    spark.conf.set(partitions, log.sparkSession.conf.get(partitions))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # state files take the room of what is in them, not a reserve for each of many partitions
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # a partition's state is on disk between batches, so executors hold no native memory for those that aren't worked on
    spark.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MB))
    # nulls last, then the least id, then the row's place in the log
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("run"), F.col("locator"), F.col("file"), F.col("row"))).alias("first")
    seen = spark.readStream.schema(log.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(folder).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
    run = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", kept).trigger(availableNow=True).start()
    run.awaitTermination()
    state = spark.read.format("statestore").load(kept)
    names = state.schema["value"].dataType.names
    value = {n: F.col("value")[n] for n in names}
    found = state.select(F.col("key")["digest"].alias("digest"), value[names[-2]].alias("first"), value[names[-1]].alias("n"))
    return stored(found.select("digest", F.col("first")["id"].alias("keep_id"), *(F.col("first")[c].alias(f"keep_{c}") for c in ("run", "locator", "file", "row")), "n"), "dedup-groups")


def _differing(docs: DataFrame, file: Column, row: Column, rows: Callable[..., DataFrame], log: DataFrame, groups: DataFrame, count: int, run: int, text_col: str, known: DataFrame | None) -> DataFrame:
    """Digests in whose group two texts differ, by the bytes of every row of every group of two or more; only their texts move.

    Of earlier runs it is the text of the row that stays, which is read where its locator says; ``known`` has their files.
    """
    hot = F.col("n") >= max(HOT_LEAST, int(count * HOT_SHARE))
    salt = F.when(hot, F.pmod(F.xxhash64("locator"), F.lit(SALTS))).otherwise(0).alias("value")
    several = stored(groups.where("n > 1").select("digest", "n"), "dedup-several")
    shared = Values(log.sparkSession, "dedup-shared").write(stored(joined(log, several, "digest", "n", count).select("file", "row", salt), "dedup-spots"))
    salted = shared.of(file, row)
    texts = rows(docs.where(salted.isNotNull()), salted.alias("salt"))
    earlier = groups.where(F.col("keep_run") < run).join(several, "digest", "left_semi").join(log.select("digest").distinct(), "digest", "left_semi")
    paths = [r.path for r in known.join(earlier.select(F.col("keep_file").alias("file")).distinct(), "file").select("path").distinct().collect()] if known is not None else []
    if paths:
        told = log.sparkSession.read.parquet(*paths).select(F.xxhash64("_metadata.file_path").alias("keep_file"), F.col("_metadata.row_index").alias("keep_row"), normalised(F.col(text_col)).alias("text"))
        old = earlier.select("digest", "keep_file", "keep_row").join(told, ["keep_file", "keep_row"]).select("digest", F.lit(0).cast("long").alias("salt"), "text")
        texts = texts.select("digest", "salt", "text").unionByName(old)
    ends = [F.min("text").alias("low"), F.max("text").alias("high")]
    part = texts.groupBy("digest", "salt").agg(*ends)
    return part.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest")


def _groups(docs: DataFrame, path: Column, row: Column, id_col: str, text_col: str, digest: Callable[[Column], Column], batch_bytes: int, state: str | None = None) -> DataFrame:
    """The rows of groups(), with the columns file and row."""
    spark, file = docs.sparkSession, F.xxhash64(path)
    home = state or scratch(spark, "dedup")
    run, total, known = 0, 0, None
    if state:
        if (before := _written(spark, f"{home}/log")) is not None:
            run, total = before.agg(F.coalesce(F.max("run") + 1, F.lit(0)), F.count(F.lit(1))).first()
            known = _written(spark, f"{home}/files")
        docs.select(file.alias("file"), path.alias("path")).distinct().write.mode("append").parquet(f"{home}/files")

    def rows(of: DataFrame, *more: Column) -> DataFrame:
        plain = of.select(*more, F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"))
        return plain.withColumns({"digest": digest(F.col("text")), "sha": sha256(F.col("text"))})

    def log_of(r: DataFrame, name: str) -> DataFrame:
        r = r.select(F.lit(run).alias("run"), F.monotonically_increasing_id().alias("locator"), "id", "digest", "sha", "file", "row")
        r.write.mode("append").parquet(f"{home}/{name}")
        return spark.read.schema(r.schema).parquet(f"{home}/{name}").where(F.col("run") == run)

    every = rows(docs, file.alias("file"), row.alias("row"))
    log = log_of(every, "log")
    count = log.count()
    if not count:
        return log.select("id", "digest", "sha", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "file", "row")
    found = _state(log, f"{home}/log", f"{home}/state", batch_bytes)
    clash = stored(_differing(docs, file, row, rows, log, found, count + total, run, text_col, known), "dedup-clash")
    if not clash.isEmpty():
        if run:
            raise ValueError("texts of several runs differ and have the same digest; keep state with a stronger one")
        marked = clash.withColumn("clash", F.lit(True))
        log = log_of(every.join(marked, "digest", "left").withColumn("digest", F.when(F.col("clash"), F.concat(F.lit("text:"), "text")).otherwise(F.col("digest"))), "log-of-texts")
        found = _state(log, f"{home}/log-of-texts", f"{home}/state-of-texts", batch_bytes)
    own = (F.col("run") == F.col("keep_run")) & (F.col("locator") == F.col("keep_locator"))
    return joined(log, found.drop("keep_file", "keep_row"), "digest", "n", count + total).select("id", "digest", "sha", "keep_id", F.col("n").alias("group_size"), own.alias("kept"), "file", "row")


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    return spark.read.parquet(path)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES, state: str | None = None) -> DataFrame:
    """One row per document: id, digest, sha, keep_id, group_size, kept.

    Texts are equal when they are identical after each run of ASCII white space became one space; null
    counts as empty. The row with the least id stays; null ids come last; of rows alike in id and text,
    one stays. An empty table gives no rows; other columns are dropped whatever their names. Rows move
    as (locator, id, digest); texts of groups move once, for the check of bytes, large groups in parts.

    The stream takes the log in batches of about ``batch_bytes``. With a folder for ``state`` log and state stay there,
    and the rows of later calls also hit those of earlier ones, whose tables must still be where they were: keep_id and
    group_size are then those of all rows so far, and a later row with a less id takes the place of the one that stayed.
    """
    docs, path, row = scanned(docs)
    return _groups(docs, path, row, id_col, text_col, digest, batch_bytes, state).drop("file", "row")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows alike in id and text, one. Nulls and empty tables as in ``groups``."""
    docs, path, row = scanned(docs)
    file = F.xxhash64(path)
    gone = Values(docs.sparkSession, "dedup-gone")
    with passing(docs.sparkSession):
        found = _groups(docs, path, row, id_col, text_col, sha256, BATCH_BYTES)
        gone.write(stored(found.where("NOT kept").select("file", "row", F.lit(0).alias("value")), "dedup-dropped"))
    return docs.where(gone.of(file, row).isNull())

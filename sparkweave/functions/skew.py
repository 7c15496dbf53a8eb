"""Joins that no single key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many rows on, and from a 1 / HOT_KEYS part of all rows: there are at most HOT_KEYS of them.
HOT_LEAST, HOT_KEYS = 512, 2000
SALTS = 64


def joined(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """The inner join on a key that is unique in ``values``, whose column ``size`` counts the key's rows.

    ``total`` is at least the sum of the sizes. The hot keys, at most HOT_KEYS, come to the driver; their rows are
    dealt to SALTS parts, each with a copy of the key's values. The join is by sorting: a broadcast table takes
    a whole memory page of every executor, however small it is, and many of them would add up.
    """
    most = max(HOT_LEAST, total // HOT_KEYS)
    hot = [r[0] for r in values.where(F.col(size) > most).select(key).collect()]
    if not hot:
        return rows.join(values.hint("merge"), key)
    salt = F.when(F.col(key).isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    every = F.when(F.col(size) > most, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    salted = values.select("*", F.explode(every).alias("_salt")).hint("merge")
    return rows.withColumn("_salt", salt).join(salted, [key, "_salt"]).drop("_salt")

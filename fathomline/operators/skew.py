"""A left join that a hot key can't overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least one in so many rows of the left side: there are at most so many hot keys, whatever the size.
HOT_SHARE = 1000
#: Keys with fewer rows than this are never hot.
HOT_ROWS = 20_000


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left LEFT JOIN right, where right has one row per key.

    Rows with hot keys meet a broadcast of the at most HOT_SHARE rows of right that have those keys, the rest are
    shuffled, and rows with a null in a key go past the join, as they match nothing. Small inputs (fewer than HOT_ROWS
    rows) are joined plainly. Either table may be empty.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    whole, nulls = left.where(known), left.where(~known)
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys]
    least = max(HOT_ROWS, left.count() // HOT_SHARE + 1)
    hot = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    tag = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    tagged = whole.join(tag, keys, "left")
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    a = tagged.where(F.col("_hot")).drop("_hot").join(few, keys, "left")
    b = tagged.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, "left")
    return a.unionByName(b).unionByName(nulls.select("*", *extra))

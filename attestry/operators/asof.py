"""As-of join: each event with the version that was in force at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(events: DataFrame, versions: DataFrame, at: str = "at", since: str = "since", value: str = "version", bucket: str = "day") -> DataFrame:
    """events with a further column `value`: of the versions that began at or before the event, the one that began last.

    Both sides are cut into time buckets; within a bucket a window carries the last version on, and what an earlier bucket left in
    force comes from a table of one row for each bucket.  So no side is broadcast, no pair is made that is not a result, and a
    bucket is a task's at most.  Events before the first version have null; events without a time have the newest
    version.  Of versions that begin at once, the larger value counts.  Versions without a time are never in force.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    e = events.select(F.col(at).alias("t"), F.lit(1).alias("kind"), held.alias("row"), F.lit(None).cast(versions.schema[value].dataType).alias("v"))
    v = versions.filter(F.col(since).isNotNull()).select(F.col(since).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(e.schema["row"].dataType).alias("row"), F.col(value).alias("v"))
    both = e.unionByName(v).withColumn("b", F.date_trunc(bucket, "t"))
    within = Window.partitionBy("b").orderBy("t", "kind", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("v", F.last("v", ignorenulls=True).over(within)).filter("kind = 1")
    # one row for each bucket: what stood at its end, and from that what stood before it
    ends = both.filter("t IS NOT NULL").groupBy("b").agg(F.max(F.when(F.col("kind") == 0, F.struct("t", "v"))).alias("last"))
    before = ends.select("b", F.last("last", ignorenulls=True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    newest = v.agg(F.max(F.struct("t", "v")).alias("newest")).select(F.col("newest")["v"])
    timed = seen.filter("t IS NOT NULL").join(before, "b", "left").select("row", F.coalesce("v", F.col("before")["v"]).alias("v"))
    untimed = seen.filter("t IS NULL").select("row", newest.scalar().alias("v"))
    return timed.unionByName(untimed).select("row.*", F.col("v").alias(value))

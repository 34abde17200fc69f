"""Metric history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.fixed_values import ROLLUP_DEFAULT, ROLLUP_RULES


def rollup(
    points: DataFrame,
    step: int,
    width: int,
    rules=ROLLUP_RULES,
    default=ROLLUP_DEFAULT,
) -> DataFrame:
    """``(name, bucket, value)`` of points ``(name, value, ts, seq)``.

    Time is cut into slots of ``step`` seconds, where the last arrival counts, and into
    buckets of ``width`` seconds. The name selects the function over the slots of a bucket
    and the share of slots that must be filled; with fewer the value is null. The sums of
    cumulative counters are taken as they come.

    Both levels aggregate by (name, time), so one busy name is spread over its slots.
    """
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))

    def floored(t: Column, size: int) -> Column:
        return t - F.pmod(t, F.lit(size))

    slots = points.groupBy("name", floored(epoch, step).alias("slot")).agg(
        F.max_by("value", "seq").alias("value")
    )
    buckets = slots.groupBy("name", floored(F.col("slot"), width).alias("bucket")).agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum("value").alias("sum"),
        F.avg("value").alias("avg"),
        F.count("value").alias("_filled"),
    )
    kind, needed = default
    value, share = F.col(kind), F.lit(needed)
    for pattern, function, xff in reversed(list(rules)):
        matches = F.col("name").rlike(pattern)
        value = F.when(matches, F.col(function)).otherwise(value)
        share = F.when(matches, F.lit(xff)).otherwise(share)
    enough = F.col("_filled") / F.lit(width / step) >= share
    return buckets.select("name", "bucket", F.when(enough, value).alias("value"))

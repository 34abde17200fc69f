"""Metric names and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.fixed_values import METRIC_PREFIX
from pagelake.functions.text import fmt_g


def metric_name(key: Column, spider: Column, prefix: str = METRIC_PREFIX) -> Column:
    """Dotted metric name; the spider is left out where it is null."""
    return F.when(spider.isNull(), F.concat(F.lit(f"{prefix}."), key)).otherwise(
        F.concat(F.lit(f"{prefix}.spider."), spider, F.lit("."), key)
    )


def metric_line(name: Column, value: Column, ts: Column | None = None) -> Column:
    """``name value epoch``; the epoch is now where no time is given, the line null
    without a name or a value."""
    moment = F.current_timestamp() if ts is None else F.coalesce(ts, F.current_timestamp())
    return F.concat(name, F.lit(" "), fmt_g(value), F.lit(" "), F.unix_timestamp(moment).cast("string"))

"""Metric points as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.metrics import metric_line


def metric_lines(points: DataFrame) -> DataFrame:
    """One ``line`` per point ``(name, value, ts)`` that has a name and a value."""
    return points.where("name is not null and value is not null").select(metric_line(F.col("name"), F.col("value"), F.col("ts")).alias("line"))


def write_metric_lines(points: DataFrame, path: str, mode: str = "append") -> None:
    """The lines as text, each followed by an empty line."""
    metric_lines(points).write.mode(mode).option("lineSep", "\n\n").text(path)

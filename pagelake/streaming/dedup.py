"""Duplicate filter on a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelake.operators.frontier import with_fingerprint


def dedup_stream(reqs: DataFrame, time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Requests whose fingerprint has not come before.

    With ``time`` and ``watermark`` the state of a fingerprint is dropped once the stream
    has moved on by the watermark; without, it is kept for the whole run. The checkpoint
    of the query carries the state over a restart.
    """
    marked = with_fingerprint(reqs)
    if watermark is None:
        return marked.dropDuplicates(["fp"])
    return marked.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["fp"])

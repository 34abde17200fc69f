"""Membership tests between a batch and a large table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_keys(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` values of ``batch`` that occur in ``table``.

    The big table is the streamed side of a semi join, so a batch below the broadcast
    threshold is matched in the scan of ``table`` without shuffling it. A large batch makes
    both sides shuffle on ``key`` once; Spark decides from the sizes.
    """
    wanted = batch.select(key).distinct()
    return table.select(key).join(wanted, key, "left_semi").distinct()


def not_in(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose ``key`` does not occur in ``table``."""
    return batch.join(known_keys(batch, table, key), key, "left_anti").select(*batch.columns)

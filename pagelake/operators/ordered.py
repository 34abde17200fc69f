"""Running values over keys that may hold a third of all rows.

A window over a whole hot key would sort it in one task. Here each key is cut into buckets
of its unique sequence number: a bucket of width ``w`` holds at most ``w`` rows, whatever
the key. Bucket totals are summed with map-side combine, run up over the buckets of a key
in the same way, and joined back to windows that stay inside one bucket, on the same
partitioning: rows are shuffled once. A bucket is named by a struct, which equals another
with the same nulls, so null keys need no test of their own. After two levels
of the default width, the whole range of a bigint is at most 2**23 totals per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_WIDTH = 1 << 20

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, tuple[str, Column]],
    lead: list[tuple[str, bool]] = (),
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """``df`` with one running value per entry of ``values``: name -> (sum|max|min, input).

    Rows of a key are taken by the ``lead`` columns (name, descending?) and then by
    ``seq``, which must be unique.
    """
    return _running(df, keys, seq, values, lead, width, levels=2, last=0)


def _running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, tuple[str, Column]],
    lead: list[tuple[str, bool]],
    width: int,
    levels: int,
    last: int,
) -> DataFrame:
    """Values over the rows up to this one (``last`` 0) or before it (``last`` -1)."""
    bucket = f"_bucket{levels}"
    inputs = {f"_in{levels}_{n}": v for n, (_, v) in values.items()}
    bucketed = df.withColumn(bucket, F.floor(F.col(seq) / width).cast("bigint")).withColumns(inputs)
    group = [*keys, *[name for name, _ in lead], bucket]

    def over(window, prefix: str) -> dict[str, Column]:
        return {
            n: _AGGREGATES[kind](f"{prefix}{levels}_{n}").over(window)
            for n, (kind, _) in values.items()
        }

    totals = bucketed.groupBy(*group).agg(
        *[_AGGREGATES[k](f"_in{levels}_{n}").alias(f"_all{levels}_{n}") for n, (k, _) in values.items()]
    )
    if levels > 1:
        above = {n: (kind, F.col(f"_all{levels}_{n}")) for n, (kind, _) in values.items()}
        earlier = _running(totals, keys, bucket, above, lead, width, levels - 1, last=-1)
    else:
        in_key = [F.col(n).desc() if down else F.col(n).asc() for n, down in lead]
        ordered = W.partitionBy(*keys).orderBy(*in_key, bucket)
        earlier = totals.withColumns(over(ordered.rowsBetween(W.unboundedPreceding, -1), "_all"))
    before = earlier.select(
        F.struct(*group).alias(f"_b{levels}_group"),
        *[F.col(n).alias(f"_before{levels}_{n}") for n in values],
    )
    mine, theirs = f"_group{levels}", f"_b{levels}_group"
    inside = W.partitionBy(mine).orderBy(seq).rowsBetween(W.unboundedPreceding, last)
    local = bucketed.withColumn(mine, F.struct(*group)).withColumns(
        {f"_local{levels}_{n}": c for n, c in over(inside, "_in").items()}
    )
    return local.join(before, F.col(mine) == F.col(theirs)).select(
        *df.columns,
        *[
            _combined(kind, F.col(f"_before{levels}_{n}"), F.col(f"_local{levels}_{n}")).alias(n)
            for n, (kind, _) in values.items()
        ],
    )


def _combined(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull() & local.isNull(), None).otherwise(
            F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    return F.greatest(before, local) if kind == "max" else F.least(before, local)


def rank_in_key(
    df: DataFrame,
    keys: list[str],
    seq: str,
    out: str,
    lead: list[tuple[str, bool]] = (),
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """``df`` with the 1-based place of each row in its key."""
    return running(df, keys, seq, {out: ("sum", F.lit(1).cast("bigint"))}, lead, width)

"""The stored book records, in both profiles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.fixed_values import SHARD_KEYS
from pagelake.operators.records import fill_defaults, insert_unique, stamp


#: Folders of the book table, and the column that names them.
NAME_BUCKETS = 64
BUCKET = "name_bucket"


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def name_bucket(name: Column, buckets: int = NAME_BUCKETS) -> Column:
    """The folder of the book table that records of a name are in; a null name has one too."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def stored_names(spark: SparkSession, path: str, batch: DataFrame, name: str = "book_name", buckets: int = NAME_BUCKETS) -> DataFrame | None:
    """The stored records that could share a name with ``batch``: those in its buckets.

    The buckets of the batch, at most ``buckets`` numbers, become a partition filter, so other
    folders are not even listed as input; names sorted inside files leave out row groups.
    """
    stored = read_if_present(spark, path)
    if stored is None:
        return None
    asked = [r[0] for r in batch.select(name_bucket(F.col(name), buckets)).distinct().collect()]
    return stored.where(F.col(BUCKET).isin(asked))


def write_book_detail(
    items: DataFrame, path: str, now: Column | None = None, order: str = "seq", buckets: int = NAME_BUCKETS
) -> DataFrame:
    """A3: append records under the unique (book_name, author) rule; returns what was refused.

    ``record_id`` is the generated id of each stored record. The table lies in ``buckets`` folders
    by a hash of the name, so a batch reads only the folders that its own names can be in; a large
    store wants more of them, and every call the same number. A bucket's new records are written by as many
    tasks as the session has shuffle partitions, by name and id, so no hot name meets in one.
    """
    stored = stored_names(items.sparkSession, path, items, buckets=buckets)
    inserted, refused = insert_unique(items, stored, order=order)
    shaped = stamp(fill_defaults(inserted, "single"), now).withColumn(BUCKET, name_bucket(F.col("book_name"), buckets))
    (
        shaped.repartitionByRange(BUCKET, "book_name", "record_id")
        .sortWithinPartitions(BUCKET, "book_name")
        .write.mode("append")
        .partitionBy(BUCKET)
        .parquet(path)
    )
    return refused


def write_book_detail_sharded(
    items: DataFrame,
    path: str,
    shards: int | None = None,
    keys: tuple[str, ...] = SHARD_KEYS,
    now: Column | None = None,
) -> None:
    """A4: append records in ranges of ``keys``, under one folder per day.

    There are ``shards`` ranges (``fixed_values.SHARDS`` for a small store), or else as
    many as the session has shuffle partitions, merged where they turn out small.
    The record id ends the range key, so that many records with one time and name still
    spread over all shards. Sorted files let a reader skip by their min and max values.
    """
    shaped = stamp(fill_defaults(items, "sharded"), now)
    ordered = [*keys, "record_id"]
    ranges = [F.col(c) for c in ordered] if shards is None else [shards, *ordered]
    (
        shaped.withColumn("update_date", F.to_date("update_time"))
        .repartitionByRange(*ranges)
        .sortWithinPartitions("update_date", *ordered)
        .write.mode("append")
        .partitionBy("update_date")
        .parquet(path)
    )

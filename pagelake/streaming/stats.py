"""Live statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.functions.metrics import metric_name
from pagelake.operators.stats import RUN, fold_runs, followed_by, merge_spiders
from pagelake.session import delete, names_in
from pagelake.sources.metric_lines import write_metric_lines

COMPACT_EVERY = 16
_SUMMARY = ["inc_value", "max_value", "min_value", "set_value"]
_STATE = ", ".join(f"{c} bigint" for c in [*_SUMMARY, *RUN])
_STATE = f"key string, {_STATE}, first_seq bigint, last_seq bigint, ts timestamp"


def _whole_ops(ops: DataFrame) -> DataFrame:
    """Operations with all columns that folds read; without ``op``, all count as ``inc``."""
    columns = {"op": F.lit("inc"), "start": F.lit(0).cast("bigint"), "spider": F.lit(None).cast("string")}
    return ops.withColumns({n: c for n, c in columns.items() if n not in ops.columns})


def _summary(ops: DataFrame) -> DataFrame:
    """Per key the four plain values, the run of its operations, their first and last numbers, and the newest time."""
    value = F.col("value").cast("bigint")
    counted = ops.groupBy("key").agg(
        F.sum(value).alias("inc_value"),
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
        F.max_by(value, "seq").alias("set_value"),
        F.min("seq").cast("bigint").alias("first_seq"),
        F.max("seq").cast("bigint").alias("last_seq"),
        F.max("ts").cast("timestamp").alias("ts"),
    )
    return counted.join(fold_runs(ops.where("value is not null")), "key", "left")


def running_stats(ops: DataFrame) -> DataFrame:
    """Per key the sum, largest, smallest and last value of ``(seq, key, op, value, ts)``, and
    ``value``: what all its operations, of any kinds and in order, leave (as ``fold_ops``).

    A counter that does not exist begins at the ``start`` (0 without that column) of its first
    ``inc``. Without ``op``, all count as ``inc``. Operations without a value change nothing.
    """
    return _summary(_whole_ops(ops)).select("key", *_SUMMARY, F.col("absent").alias("value"), "ts")


def windowed_stats(ops: DataFrame, watermark: str, width: str) -> DataFrame:
    """The same per window of ``ts``; a window closes when the watermark passes it."""
    value = F.col("value").cast("bigint")
    grouped = ops.withWatermark("ts", watermark).groupBy(F.window("ts", width), "key")
    return grouped.agg(
        F.sum(value).alias("inc_value"),
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
        F.max_by(value, "seq").alias("set_value"),
    )


def stats_stream(
    ops: DataFrame, path: str, checkpoint: str, lines: str = "keys", compact_every: int = COMPACT_EVERY, **trigger
) -> StreamingQuery:
    """Start a query that keeps the state of every key under ``path`` and writes metric lines.

    A key's state is the run of all its operations so far, whatever their kinds. ``path/state`` is
    one table of versions: a batch folds its own operations into one run per key and adds these,
    without reading what is there; each ``compact_every``-th batch folds all runs of a key into one,
    after which the versions before are deleted as soon as that batch is known to be complete. A
    key's runs, at most ``compact_every`` + 1, follow each other by the numbers of their first operations, so
    batches may come in any order between two compactions; ranges of numbers must not overlap.
    A batch that runs again after a failure overwrites its own version.

    ``path/lines`` gets a line per batch and changed key, or, with ``lines="operations"``, one per
    operation, under the name of its spider and with the value after it (as ``merge_spiders``).
    """

    def push(batch: DataFrame, number: int) -> None:
        push_batch(batch, number, path, lines, compact_every)

    writer = ops.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def push_batch(batch: DataFrame, number: int, path: str, lines: str = "keys", compact_every: int = COMPACT_EVERY) -> None:
    """Put one batch of operations behind the state that the batches before it left."""
    spark = batch.sparkSession
    ops = _whole_ops(batch).persist()
    try:
        # a compacted version is final once a later batch runs
        complete = max(0, number - 1) // compact_every * compact_every
        for name in names_in(spark, f"{path}/state"):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) < complete:
                delete(spark, f"{path}/state/{name}")
        versions = _versions(spark, path)
        earlier = versions.where((F.col("batch") >= complete) & (F.col("batch") < number)).drop("batch")
        own = f"{path}/state/batch={number}"
        if number % compact_every:
            _summary(ops).write.mode("overwrite").parquet(own)
        else:
            _folded(earlier.unionByName(_summary(ops))).write.mode("overwrite").parquet(own)
        touched = earlier.join(ops.select("key").distinct(), "key", "left_semi")
        if lines == "operations":
            known = _folded(touched).select("key", F.col("absent").alias("value"))
            points = merge_spiders(ops.where("value is not null"), prior=known).select("name", "value", "ts")
        else:
            stored = _versions(spark, path).where(F.col("batch") == number).drop("batch")
            if number % compact_every:
                now = _folded(touched.unionByName(stored))
            else:
                now = stored.join(ops.select("key").distinct(), "key", "left_semi")
            points = now.select(metric_name(F.col("key"), F.lit(None)).alias("name"), F.col("absent").alias("value"), "ts")
        write_metric_lines(points, f"{path}/lines/batch={number}", "overwrite")
    finally:
        ops.unpersist()


def _versions(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{_STATE}, batch bigint"
    if not names_in(spark, f"{path}/state"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/state")


def _folded(versions: DataFrame) -> DataFrame:
    """One run per key, from its few runs in the order of their first operations."""
    runs = F.collect_list(F.when(F.col("a").isNotNull(), F.struct(F.col("first_seq").alias("seq"), *RUN)))
    grouped = versions.groupBy("key").agg(
        F.sum("inc_value").alias("inc_value"),
        F.max("max_value").alias("max_value"),
        F.min("min_value").alias("min_value"),
        F.max_by("set_value", F.when(F.col("set_value").isNotNull(), F.col("last_seq"))).alias("set_value"),
        F.sort_array(runs).alias("_runs"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.max("ts").alias("ts"),
    )
    run = F.aggregate(F.slice("_runs", 2, F.size("_runs")), F.get("_runs", F.lit(0)), followed_by)
    rows = grouped.withColumn("_run", run)
    return rows.select("key", *_SUMMARY, *[f"_run.{c}" for c in RUN], "first_seq", "last_seq", "ts")


def latest_stats(spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The state of each key that ``stats_stream`` has kept, with the value it stands for."""
    versions = _versions(spark, path)
    compacted = versions.where(F.col("batch") % compact_every == 0).agg(F.max("batch").alias("_last"))
    current = versions.join(compacted, F.col("batch") >= F.coalesce("_last", F.lit(0))).drop("batch", "_last")
    return _folded(current).select("key", *_SUMMARY, F.col("absent").alias("value"), "ts")

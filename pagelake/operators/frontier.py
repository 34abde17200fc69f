"""Requests: identity, dedup, order, batches and what is still pending.

Request tables have ``seq`` (arrival number, unique), ``url``, ``method``, ``body``,
``kind``, ``priority``, ``dont_filter`` and ``depth``; operators use only those they name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake import fixed_values as fixed
from pagelake.functions.urls import fingerprint, netloc
from pagelake.operators.ordered import rank_in_key


def with_fingerprint(reqs: DataFrame) -> DataFrame:
    """Requests with their identity ``fp``."""
    method = F.col("method") if "method" in reqs.columns else None
    body = F.col("body") if "body" in reqs.columns else None
    return reqs.withColumn("fp", fingerprint(F.col("url"), method, body))


def dedup_batch(reqs: DataFrame, key: str = "fp", order: str = "seq") -> DataFrame:
    """The first arrival of each key.

    An aggregate with map-side combine, so a request repeated in a third of all rows is
    one row per task before the shuffle.
    """
    rest = [c for c in reqs.columns if c != key]
    first = reqs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(key, "_first.*").select(*reqs.columns)


def unseen(reqs: DataFrame, seen: DataFrame) -> DataFrame:
    """D3: requests whose ``fp`` is not in ``seen``; append their fp to it afterwards."""
    return reqs.join(seen.select("fp"), "fp", "left_anti").select(*reqs.columns)


def enqueue(reqs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted requests, fingerprints to add to seen)``.

    ``dont_filter`` requests are always accepted and never recorded as seen.
    """
    bypass = F.coalesce(F.col("dont_filter"), F.lit(False))
    tested = unseen(dedup_batch(reqs.where(~bypass)), seen)
    return reqs.where(bypass).unionByName(tested), tested.select("fp")


def unique_requests(reqs: DataFrame) -> DataFrame:
    """Requests of a sorted-set queue: only fully identical ones collapse, ``seq`` aside."""
    fields = [c for c in reqs.columns if c != "seq"]
    return reqs.groupBy(*fields).agg(F.min("seq").alias("seq")).select(*reqs.columns)


def priority_order() -> list:
    return [F.col("priority").desc(), F.col("url").asc(), F.col("method").asc()]


def order_priority(reqs: DataFrame) -> DataFrame:
    """Highest priority first, then URL and method."""
    return unique_requests(reqs).orderBy(*priority_order(), "seq")


def order_fifo(reqs: DataFrame) -> DataFrame:
    """Oldest first."""
    return reqs.orderBy(F.col("seq").asc())


def order_lifo(reqs: DataFrame) -> DataFrame:
    """Newest first."""
    return reqs.orderBy(F.col("seq").desc())


def next_batch(
    reqs: DataFrame,
    n: int = fixed.BATCH_SIZE,
    per_host: int = fixed.BATCH_PER_HOST,
    order: list | None = None,
) -> DataFrame:
    """The next ``n`` requests, at most ``per_host`` of one host.

    Each task keeps its best ``per_host`` rows of a host before the shuffle, so a host with
    a third of all requests sends only a few rows.
    """
    order = [*(order or priority_order()), F.col("seq").asc()]
    hosted = reqs.withColumn("host", netloc(F.col("url")))
    place = F.row_number().over(W.partitionBy("host").orderBy(*order))
    capped = hosted.withColumn("_place", place).where(F.col("_place") <= per_host).drop("_place")
    return capped.orderBy(*order).limit(n)


def politeness_slots(reqs: DataFrame, delay: int = fixed.DELAY_SECONDS) -> DataFrame:
    """``slot``: earliest start of each request in seconds, one request per host and delay.

    Higher priority goes first, then arrival.
    """
    hosted = reqs.withColumn("host", netloc(F.col("url")))
    ranked = rank_in_key(hosted, ["host"], "seq", "_rank", lead=[("priority", True)])
    return ranked.withColumn("slot", (F.col("_rank") - 1) * delay).drop("_rank")


def pending(enqueued: DataFrame, dequeued: DataFrame, key: str = "seq") -> DataFrame:
    """Requests queued but not handed out."""
    return enqueued.join(dequeued.select(key), key, "left_anti").select(*enqueued.columns)


def pending_state(queue: DataFrame) -> DataFrame:
    """``(pending, has_pending)``; a crawl resumes when ``has_pending``."""
    return queue.agg(F.count("*").alias("pending")).withColumn(
        "has_pending", F.col("pending") > 0
    )


def close_queue(queue: DataFrame, seen: DataFrame, persist: bool) -> tuple[DataFrame, DataFrame]:
    """What the next run starts from: both tables when persisting, else empty ones."""
    if persist:
        return queue, seen
    return queue.where(F.lit(False)), seen.where(F.lit(False))


def depth_priority(reqs: DataFrame, k: int = 0, depth_limit: int = 0) -> DataFrame:
    """Requests within ``depth_limit`` (0 = none), priority lowered by depth times ``k``."""
    kept = reqs.where(F.col("depth") <= depth_limit) if depth_limit else reqs
    if not k:
        return kept
    return kept.withColumn("priority", F.col("priority") - F.col("depth") * k)

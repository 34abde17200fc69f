"""Records through their stages into the book table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagelake.operators.media import attach_cover, attach_file, candidate_urls, first_success
from pagelake.operators.records import none_reason

Stage = Callable[[DataFrame], DataFrame]
KEPT = "kept"


def run_stages(items: DataFrame, stages: list[tuple[str, Stage]]) -> DataFrame:
    """all records with ``dropped_at``, the stage that dropped them, and its ``reason``; null for kept ones.

    A stage gives back its rows, with a column ``reason`` if it drops any: those where it is not null.
    A dropped record rides along to the end, and no later stage changes its outcome, so
    the plan holds the input, and every join of a stage, once. What a stage adds to
    records that were dropped before it has no meaning.
    """
    nothing = F.lit(None).cast("string")
    rows = items.withColumns({"dropped_at": nothing, "_reason": nothing})
    for name, stage in stages:
        rows = stage(rows)
        if "reason" in rows.columns:
            here = F.col("dropped_at").isNull() & F.col("reason").isNotNull()
            rows = rows.withColumns(
                {
                    "_reason": F.when(here, F.col("reason")).otherwise(F.col("_reason")),
                    "dropped_at": F.when(here, F.lit(name)).otherwise(F.col("dropped_at")),
                }
            ).drop("reason")
    return rows.withColumnRenamed("_reason", "reason")


def kept_rows(staged: DataFrame) -> DataFrame:
    """The records that no stage dropped, without their outcome."""
    return staged.where(F.col("dropped_at").isNull()).drop("dropped_at", "reason")


def dropped_rows(staged: DataFrame) -> DataFrame:
    """``(original_url, stage, reason)`` of the records that a stage dropped."""
    lost = staged.where(F.col("dropped_at").isNotNull())
    return lost.select("original_url", F.col("dropped_at").alias("stage"), "reason")


def store_stages(staged: DataFrame, path: str, stages: list[tuple[str, Stage]]) -> tuple[DataFrame, dict[str, int]]:
    """the staged records in one write, a folder per outcome; read back, and their numbers by outcome.

    The numbers are observed while writing. Readers of one outcome open its folder alone.
    """
    names = [name for name, _ in stages]
    if KEPT in names or len(set(names)) < len(names):
        raise ValueError(f"stages need names of their own, none of them {KEPT}")
    seen = Observation()
    counts = [F.count_if(F.col("dropped_at").isNull()).alias(KEPT)]
    counts += [F.count_if(F.col("dropped_at") == name).alias(name) for name in names]
    outcome = F.coalesce("dropped_at", F.lit(KEPT)).alias("outcome")
    named = staged.observe(seen, *counts).select("*", outcome)
    named.write.partitionBy("outcome").parquet(path)
    return staged.sparkSession.read.schema(named.schema).parquet(path), dict(seen.get)


def reason_column(column: str) -> Stage:
    """A stage that drops the records for which ``column`` names a reason."""
    return lambda items: items.withColumnRenamed(column, "reason")


def book_stages(images: DataFrame, outcomes: DataFrame, cover_base: str) -> list[tuple[str, Stage]]:
    """The stages of a book record, in order: whole, file, cover, drop without file.

    Candidates of files come from the page URL and the links of records alone; they are taken before the
    cover is joined, so that join stands in the plan once. The two do not depend on each other.
    """

    def file(items: DataFrame) -> DataFrame:
        open_ones = items.where(F.col("dropped_at").isNull())
        return attach_file(items, first_success(candidate_urls(open_ones), outcomes))

    return [
        ("parse", reason_column("reject")),
        ("file", file),
        ("cover", lambda items: attach_cover(items, images, cover_base)),
        ("drop-none", lambda items: items.withColumn("reason", none_reason(items))),
    ]


def success_report(staged: DataFrame) -> DataFrame:
    """F8: ``(original_url, status)``: ``SUCCESS`` for kept records, the reason for others."""
    status = F.when(F.col("dropped_at").isNull(), F.lit("SUCCESS")).otherwise(F.col("reason"))
    return staged.select("original_url", status.alias("status"))


def status_counts(report: DataFrame) -> DataFrame:
    """F8: ``(status, n)``."""
    return report.groupBy("status").agg(F.count("*").alias("n"))

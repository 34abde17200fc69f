"""Pages to frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.urls import fingerprint, netloc
from pagelake.operators.extract import extract_links, resolved
from pagelake.operators.frontier import dedup_batch


def frontier_requests(pages: DataFrame) -> DataFrame:
    """One request per distinct page that ``pages(page_id, url, html)`` link to.

    Arrival order is page, then position in the page.
    """
    found = resolved(extract_links(pages, keep=("page_id",)))
    return dedup_batch(
        found.select(
            F.struct("page_id", "pos").alias("seq"),
            "src_url",
            "url",
            netloc(F.col("url")).alias("host"),
            fingerprint(F.col("url")).alias("fp"),
        )
    )


def host_frontier(pages: DataFrame) -> DataFrame:
    """Flagship: links found per host, and how many distinct pages they name."""
    links = resolved(extract_links(pages))
    per_page = links.select(fingerprint(F.col("url")).alias("fp"), netloc(F.col("url")).alias("host"))
    once = per_page.groupBy("fp", "host").agg(F.count("*").alias("n"))
    return once.groupBy("host").agg(
        F.count("*").alias("n_pages"), F.sum("n").alias("n_links")
    )

"""Which URLs a crawl reaches from its seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagelake.functions.urls import canonical_url
from pagelake.operators.membership import not_in
from pagelake.session import discard, new_path, written

def crawl_reach(seeds: DataFrame, links: DataFrame, max_depth: int = 0) -> DataFrame:
    """``(url, depth, via)`` of every URL reached from ``seeds(url)``.

    ``links(src_url, url, kind)``: ``list`` pages are followed further, ``detail`` pages
    are not. Each URL counts once, at its smallest depth; among links of one round a
    ``list`` link comes before a ``detail`` link, then the smallest source. ``max_depth`` 0
    means no limit.

    A followed page that only one page links to is reached exactly one link after that one, so
    whole trees of such pages (a long chain of listing pages above all) are settled by pointer
    doubling: each keeps a pointer to an ancestor and its distance, and takes over its ancestor's
    pointer until that leads to a page with several sources or a seed. Breadth-first rounds go
    over those pages alone, in order of depth; a last pass over the links gives every page its
    depth and source. A chain of n pages takes log2(n) rounds instead of n.

    Every round is a table in the shared folder, deleted once the next ones do not read it, and
    brings back two numbers. Joins against links leave a page with a third of all links to the
    skew join of adaptive execution.
    """
    spark = seeds.sparkSession
    edges = written(
        links.select(
            canonical_url(F.col("src_url")).alias("_from"),
            "src_url",
            canonical_url(F.col("url")).alias("_page"),
            "url",
            "kind",
        ),
        "links",
    )
    start = seeds.select(canonical_url(F.col("url")).alias("_page"), "url")
    pointers = _ancestors(edges, start)
    jumps = written(_jumps(edges, start, pointers), "jumps")
    settled = _settled(start, jumps, max_depth)
    followed = settled.where("followed").select("_page", "depth")
    below = followed.withColumnRenamed("_page", "_ancestor").join(pointers, "_ancestor")
    sources = followed.unionByName(below.select("_page", (F.col("depth") + F.col("distance")).alias("depth")))
    if max_depth:
        sources = sources.where(F.col("depth") < max_depth)
    found = edges.join(sources.withColumnRenamed("_page", "_from"), "_from").select(
        "_page", "url", (F.col("depth") + 1).alias("depth"), F.col("src_url").alias("via"), "kind"
    )
    seeded = start.select(
        "_page",
        "url",
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("string").alias("via"),
        F.lit("list").alias("kind"),
    )
    listed_first = F.when(F.col("kind") == "list", 0).otherwise(1)
    first = F.min(F.struct("depth", listed_first.alias("_late"), "via", "url"))
    reached = seeded.unionByName(found).groupBy("_page").agg(first.alias("_f"))
    result = written(reached.select("_f.url", F.col("_f.depth").cast("int").alias("depth"), "_f.via"), "reached")
    for table in (edges, pointers, jumps, settled):
        discard(table)
    return result

def _ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(_page, _ancestor, distance)`` of pages with one source that a ``list`` link leads to; the ancestor has several sources or is a seed. Cycles that
    nothing leads into keep an ancestor of their own and are never reached."""
    sources = edges.groupBy("_page").agg(
        F.min("_from").alias("_ancestor"), F.max("_from").alias("_last"), F.max(F.col("kind") == "list").alias("_listed")
    )
    single = sources.where("_listed and _ancestor = _last and _ancestor <> _page").select(
        "_page", "_ancestor", F.lit(1).cast("bigint").alias("distance")
    )
    seen = Observation()
    pointers = written(not_in(single, start, "_page").observe(seen, F.count(F.lit(1)).alias("n")), "pointers")
    longest, rounds = seen.get["n"], 0
    while 1 << rounds < longest:
        onward = pointers.select(
            F.col("_page").alias("_ancestor"), F.col("_ancestor").alias("_next"), F.col("distance").alias("_more")
        )
        seen = Observation()
        doubled = pointers.join(onward, "_ancestor", "left").select(
            "_page",
            F.coalesce("_next", "_ancestor").alias("_ancestor"),
            (F.col("distance") + F.coalesce("_more", F.lit(0))).alias("distance"),
            F.col("_next").isNotNull().alias("_moved"),
        )
        table = written(doubled.observe(seen, F.count_if("_moved").alias("n")).drop("_moved"), "pointers")
        discard(pointers)
        pointers, rounds = table, rounds + 1
        if not seen.get["n"]:
            break
    return pointers

def _jumps(edges: DataFrame, start: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(_from, _page, any_depth, list_depth)``: how far the pages that rounds go over lie apart."""
    walked = edges.where("kind = 'list'").select("_page").distinct()
    targets = not_in(not_in(walked, pointers, "_page"), start, "_page")
    own = pointers.select(F.col("_page").alias("_from"), "_ancestor", "distance")
    met = edges.join(targets, "_page", "left_semi").join(own, "_from", "left")
    away = F.coalesce("distance", F.lit(0)) + 1
    return met.groupBy(F.coalesce("_ancestor", "_from").alias("_from"), "_page").agg(
        F.min(away).alias("any_depth"), F.min(F.when(F.col("kind") == "list", away)).alias("list_depth")
    )

def _settled(start: DataFrame, jumps: DataFrame, max_depth: int) -> DataFrame:
    """``(_page, depth, followed)`` of seeds and pages with several sources, in order of depth.

    A page is followed if a ``list`` link is among those that reach it first.
    """
    spark = start.sparkSession
    base = new_path(spark, "settled")
    zero = F.lit(0).cast("bigint")
    waiting = written(start.select("_page").distinct().select("_page", zero.alias("any_depth"), zero.alias("list_depth")), "waiting")
    depth = 0
    while True:
        due = waiting.where(F.col("any_depth") == depth)
        now = due.select("_page", F.col("any_depth").alias("depth"), (F.col("list_depth") == F.col("any_depth")).alias("followed"))
        now = now.fillna(False, "followed")
        folder = f"{base}/round={depth}"
        now.write.parquet(folder)
        now = spark.read.schema(now.schema).parquet(folder)
        settled = spark.read.schema(now.schema).parquet(base)
        settled.stored_at = base
        steps = jumps.withColumnRenamed("_page", "_to").join(
            now.where("followed").select(F.col("_page").alias("_from"), "depth"), "_from"
        )
        arrivals = not_in(
            steps.select(
                F.col("_to").alias("_page"),
                (F.col("depth") + F.col("any_depth")).alias("any_depth"),
                (F.col("depth") + F.col("list_depth")).alias("list_depth"),
            ),
            settled,
            "_page",
        )
        later = waiting.where(F.col("any_depth") > depth).unionByName(arrivals)
        later = later.groupBy("_page").agg(F.min("any_depth").alias("any_depth"), F.min("list_depth").alias("list_depth"))
        seen = Observation()
        table = written(later.observe(seen, F.min("any_depth").alias("next")), "waiting")
        discard(waiting)
        waiting, depth = table, seen.get["next"]
        if depth is None or (max_depth and depth > max_depth):
            discard(waiting)
            return settled

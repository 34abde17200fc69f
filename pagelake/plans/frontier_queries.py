"""Queries over requests: dedup, order, batches, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import frontier as fr
from pagelake.operators.reach import crawl_reach
from pagelake.session import new_path, table_stream
from pagelake.streaming.dedup import dedup_stream


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def order_requests(orders: DataFrame) -> DataFrame:
    """A request per order: the customer is the host, the priority its first digit."""
    rank = F.substring("o_orderpriority", 1, 1)
    url = F.concat(
        F.lit("http://c"), F.col("o_custkey").cast("string"), F.lit(".example.org/"),
        F.lower("o_orderstatus"), F.lit("?r="), rank, F.lit("&a=1#"), F.col("o_orderkey").cast("string"),
    )
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        url.alias("url"),
        F.lit("GET").alias("method"),
        F.lit(None).cast("binary").alias("body"),
        F.lit("list").alias("kind"),
        rank.cast("int").alias("priority"),
        (F.col("o_totalprice") > 300000).alias("dont_filter"),
        (F.year("o_orderdate") - 1990).alias("depth"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return fr.with_fingerprint(order_requests(_read(spark, sf, "orders")))


_REQUESTS_SQL = """
reqs as (
  select o_orderkey as seq, 'c' || o_custkey || '.example.org' as host,
         'http://c' || o_custkey || '.example.org/' || lower(o_orderstatus) || '?r=' ||
           o_orderpriority[1:1] || '&a=1#' || o_orderkey as url,
         sha1('GEThttp://c' || o_custkey || '.example.org/' || lower(o_orderstatus) || '?a=1&r=' ||
           o_orderpriority[1:1]) as fp,
         cast(o_orderpriority[1:1] as bigint) as priority,
         o_totalprice > 300000 as dont_filter,
         cast(year(o_orderdate) - 1990 as bigint) as depth,
         o_orderstatus, o_orderdate
  from orders)
"""


def _early(spark, sf):
    """Fingerprints seen before: those of requests up to 1995."""
    old = _read(spark, sf, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return fr.with_fingerprint(order_requests(old)).select("fp").distinct()


def fingerprints(spark, sf):
    return requests(spark, sf).select("seq", "url", "fp")


def first_documents(spark, sf):
    docs = _read(spark, sf, "documents").select(F.md5("text").alias("fp"), F.col("doc_id").alias("seq"), "source")
    return fr.dedup_batch(docs)


def first_requests(spark, sf):
    return fr.dedup_batch(requests(spark, sf).select("fp", "seq", "url"))


def new_documents(spark, sf):
    """Texts that no English document has."""
    docs = _read(spark, sf, "documents").select(
        F.md5("text").alias("fp"), F.col("doc_id").alias("seq"), "lang"
    )
    return fr.unseen(docs, docs.where("lang = 'en'"))


def accepted(spark, sf):
    taken, _ = fr.enqueue(requests(spark, sf), _early(spark, sf))
    return taken.select("seq", "url", "dont_filter")


def recorded(spark, sf):
    return fr.enqueue(requests(spark, sf), _early(spark, sf))[1]


def _queue(spark, sf):
    """Requests without their fragment, so that some are fully identical."""
    plain = F.regexp_extract("url", "^([^#]*)", 1)
    return order_requests(_read(spark, sf, "orders")).withColumn("url", plain)


def _view(ordered):
    return ordered.select("seq", "url", F.col("priority").cast("bigint").alias("priority"))


def by_priority(spark, sf):
    return _view(fr.order_priority(_queue(spark, sf)))


def oldest_first(spark, sf):
    return _view(fr.order_fifo(order_requests(_read(spark, sf, "orders"))))


def newest_first(spark, sf):
    return _view(fr.order_lifo(order_requests(_read(spark, sf, "orders"))))


def batch(spark, sf):
    chosen = fr.next_batch(_queue(spark, sf))
    return chosen.select("seq", "url", "host", F.col("priority").cast("bigint").alias("priority"))


def slots(spark, sf):
    placed = fr.politeness_slots(order_requests(_read(spark, sf, "orders")))
    return placed.select("seq", "host", "slot")


def waiting(spark, sf):
    queue = order_requests(_read(spark, sf, "orders"))
    done = _read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seq"))
    return fr.pending(queue, done)


def pending(spark, sf):
    return waiting(spark, sf).select("seq", "url")


def pending_state(spark, sf):
    return fr.pending_state(waiting(spark, sf))


def by_depth(spark, sf):
    lowered = fr.depth_priority(order_requests(_read(spark, sf, "orders")), k=2, depth_limit=6)
    return lowered.select(
        "seq", F.col("priority").cast("bigint").alias("priority"), F.col("depth").cast("bigint").alias("depth")
    )


def deduplicated_stream(spark, sf):
    """Fingerprints let through by the streaming filter; each once, as in the batch."""
    target, checkpoint = new_path(spark, "dedup"), new_path(spark, "dedup-state")
    source = table_stream(spark, f"{sf}/orders.parquet")
    query = (
        dedup_stream(order_requests(source))
        .select("fp")
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(target)
    )
    query.awaitTermination()
    return spark.read.parquet(target)


def _geography(spark, sf):
    """Links from region to nation, to customer and supplier, and from customer to order."""

    def name(kind, column):
        return F.concat(F.lit(f"http://geo.example.org/{kind}/"), F.col(column).cast("string"))

    def links(table, source, target, kind):
        return _read(spark, sf, table).select(
            name(*source).alias("src_url"), name(*target).alias("url"), F.lit(kind).alias("kind")
        )

    nations = links("nation", ("r", "n_regionkey"), ("n", "n_nationkey"), "list")
    customers = links("customer", ("n", "c_nationkey"), ("c", "c_custkey"), "list")
    suppliers = links("supplier", ("n", "s_nationkey"), ("s", "s_suppkey"), "detail")
    orders = links("orders", ("c", "o_custkey"), ("o", "o_orderkey"), "detail")
    back = links("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "list")
    edges = nations.unionByName(customers).unionByName(suppliers).unionByName(orders).unionByName(back)
    seeds = _read(spark, sf, "region").select(name("r", "r_regionkey").alias("url"))
    return seeds, edges


def reach(spark, sf):
    seeds, edges = _geography(spark, sf)
    return crawl_reach(seeds, edges).select("url", F.col("depth").cast("bigint").alias("depth"), "via")


_REACH_SQL = """
with recursive edges as (
  select 'r/' || n_regionkey as src, 'n/' || n_nationkey as dst, true as more from nation
  union all select 'n/' || c_nationkey, 'c/' || c_custkey, true from customer
  union all select 'n/' || s_nationkey, 's/' || s_suppkey, false from supplier
  union all select 'c/' || o_custkey, 'o/' || o_orderkey, false from orders
  union all select 'c/' || c_custkey, 'n/' || c_nationkey, true from customer),
walk as (
  select 'r/' || r_regionkey as url, cast(0 as bigint) as depth, cast(null as varchar) as via, true as more
  from region
  union
  select e.dst, w.depth + 1, w.url, e.more from walk w join edges e on e.src = w.url
  where w.more and w.depth < 4),
ranked as (
  select *, row_number() over (partition by url order by depth, via) as rn from walk)
select 'http://geo.example.org/' || url as url, depth, 'http://geo.example.org/' || via as via
from ranked where rn = 1
"""

QUERIES = {
    "fingerprint": (fingerprints, f"with {_REQUESTS_SQL} select seq, url, fp from reqs"),
    "dedup_documents": (
        first_documents,
        """
        select md5(text) as fp, min(doc_id) as seq, arg_min(source, doc_id) as source
        from documents group by 1
        """,
    ),
    "dedup_requests": (
        first_requests,
        f"with {_REQUESTS_SQL} select fp, min(seq) as seq, arg_min(url, seq) as url from reqs group by fp",
    ),
    "unseen": (
        new_documents,
        """
        select md5(text) as fp, doc_id as seq, lang from documents
        where md5(text) not in (select md5(text) from documents where lang = 'en')
        """,
    ),
    "enqueue": (
        accepted,
        f"""
        with {_REQUESTS_SQL}, firsts as (
          select min(seq) as seq from reqs where not dont_filter
            and fp not in (select fp from reqs where o_orderdate < timestamp '1996-01-01')
          group by fp)
        select seq, url, dont_filter from reqs where dont_filter or seq in (select seq from firsts)
        """,
    ),
    "enqueue_recorded": (
        recorded,
        f"""
        with {_REQUESTS_SQL}
        select distinct fp from reqs where not dont_filter
          and fp not in (select fp from reqs where o_orderdate < timestamp '1996-01-01')
        """,
    ),
    "order_priority": (
        by_priority,
        f"""
        with {_REQUESTS_SQL}, plain as (
          select seq, regexp_extract(url, '^([^#]*)', 1) as url, priority, dont_filter, depth from reqs)
        select min(seq) as seq, url, priority from plain group by url, priority, dont_filter, depth
        """,
    ),
    "order_fifo": (oldest_first, f"with {_REQUESTS_SQL} select seq, url, priority from reqs"),
    "order_lifo": (newest_first, f"with {_REQUESTS_SQL} select seq, url, priority from reqs"),
    "next_batch": (
        batch,
        f"""
        with {_REQUESTS_SQL}, plain as (
          select seq, regexp_extract(url, '^([^#]*)', 1) as url, host, priority from reqs),
        placed as (
          select *, row_number() over (partition by host order by priority desc, url, seq) as rn from plain)
        select seq, url, host, priority from placed where rn <= 8
        order by priority desc, url, seq limit 16
        """,
    ),
    "politeness_slots": (
        slots,
        f"""
        with {_REQUESTS_SQL}
        select seq, host, row_number() over (partition by host order by priority desc, seq) - 1 as slot
        from reqs
        """,
    ),
    "pending": (pending, f"with {_REQUESTS_SQL} select seq, url from reqs where o_orderstatus <> 'F'"),
    "pending_state": (
        pending_state,
        "select count(*) as pending, count(*) > 0 as has_pending from orders where o_orderstatus <> 'F'",
    ),
    "depth_priority": (
        by_depth,
        f"with {_REQUESTS_SQL} select seq, priority - depth * 2 as priority, depth from reqs where depth <= 6",
    ),
    "dedup_stream": (deduplicated_stream, f"with {_REQUESTS_SQL} select distinct fp from reqs"),
    "crawl_reach": (reach, _REACH_SQL),
}

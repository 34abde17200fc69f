"""Queries over records and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake import fixed_values as fixed
from pagelake.operators import media as md

NOW = "2001-08-02 00:00:00"


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _text(column):
    return F.col(column).cast("string")


def line_items(spark, sf) -> DataFrame:
    """A record per order line with two download rows that share a URL, and an empty one."""
    line = F.concat_ws(
        "-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey")
    )
    by_part = F.concat(F.lit("http://p.example.org/"), _text("l_partkey"), F.lit(".zip"))
    by_supplier = F.concat(F.lit("http://s.example.org/"), _text("l_suppkey"), F.lit(".rar"))

    def row(*urls):
        blank = F.lit(None).cast("string")
        return F.struct(
            F.array(*urls).cast("array<string>").alias("url"),
            blank.alias("progress"),
            blank.alias("update_time"),
            F.array(blank, blank).alias("source_site"),
        )

    downloads = F.when(
        F.col("l_linestatus") == "F", F.array(row(), row(by_supplier), row(by_part, by_supplier))
    ).otherwise(F.array(row(by_part, by_supplier), row(by_part)))
    return _read(spark, sf, "lineitem").select(
        F.concat(F.lit("http://books.example.org/"), line).alias("original_url"),
        downloads.alias("book_download"),
    )


_ITEMS_SQL = """
items as (
  select 'http://books.example.org/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' ||
           l_suppkey as original_url,
         case when l_linestatus = 'F' then 'http://s.example.org/' || l_suppkey || '.rar'
              else 'http://p.example.org/' || l_partkey || '.zip' end as first,
         case when l_linestatus = 'F' then 'http://p.example.org/' || l_partkey || '.zip'
              else 'http://s.example.org/' || l_suppkey || '.rar' end as second
  from lineitem),
cands as (
  select original_url, cast(0 as bigint) as pos, first as url from items
  union all select original_url, 1, second from items)
"""


def outcomes(spark, sf) -> DataFrame:
    """One outcome per URL: a part is good by its size, a supplier by its balance."""
    parts = _read(spark, sf, "part").select(
        F.concat(F.lit("http://p.example.org/"), _text("p_partkey"), F.lit(".zip")).alias("url"),
        (F.col("p_size") > 25).alias("ok"),
    )
    suppliers = _read(spark, sf, "supplier").select(
        F.concat(F.lit("http://s.example.org/"), _text("s_suppkey"), F.lit(".rar")).alias("url"),
        (F.col("s_acctbal") > 4000).alias("ok"),
    )
    both = parts.unionByName(suppliers)
    return both.withColumn("key", F.when(F.col("ok"), F.concat(F.lit("k_"), F.sha1("url")))).withColumn(
        "checksum", F.when(F.col("ok"), F.md5("url"))
    )


_OUTCOMES_SQL = """
outcomes as (
  select 'http://p.example.org/' || p_partkey || '.zip' as url, p_size > 25 as ok from part
  union all
  select 'http://s.example.org/' || s_suppkey || '.rar', s_acctbal > 4000 from supplier)
"""


def candidates(spark, sf):
    found = md.candidate_urls(line_items(spark, sf))
    return found.select("original_url", F.col("pos").cast("bigint").alias("pos"), "url")


def _order_candidates(spark, sf):
    """The lines of an order as its candidates; a line's place is its number, part and supplier."""
    return _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("original_url"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.concat(F.lit("http://p.example.org/"), _text("l_partkey"), F.lit(".zip")).alias("url"),
    )


_ORDER_CANDIDATES_SQL = """
cands as (
  select l_orderkey as original_url, 'http://p.example.org/' || l_partkey || '.zip' as url,
         l_linenumber, l_partkey, l_suppkey,
         -- equal lines have one place
         rank() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos
  from lineitem),
tried as (select c.*, o.ok from cands c join outcomes o using (url))
"""


def chosen_files(spark, sf):
    found = md.first_success(_order_candidates(spark, sf), outcomes(spark, sf))
    orders = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("original_url"))
    return md.attach_file(orders, found)


def tried(spark, sf):
    found = md.attempts(_order_candidates(spark, sf), outcomes(spark, sf))
    return found.select(
        "original_url",
        "url",
        *[F.col(f"pos.{c}").cast("bigint").alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")],
    )


def captures(spark, sf) -> DataFrame:
    """A response per event; its type, user and value decide how the fetch went."""
    kind, user = F.col("event_type"), F.col("user_id")
    url = F.concat(F.lit("http://f.example.org/"), _text("event_id"))
    status = F.when(kind == "error", F.when(F.col("value") > 20, 404)).otherwise(200)
    body = F.when(F.col("value") < 10, F.lit("")).otherwise(F.col("props")).cast("binary")
    content_type = F.when(kind == "view", "text/html").when(
        kind == "click", F.when(F.col("value") > 50, "text/plain; charset=gbk").otherwise("text/plain")
    ).when(kind == "signup", "application/zip")
    headers = F.map_filter(
        F.create_map(
            F.lit("Content-Type"), content_type,
            F.lit("Content-Disposition"), F.when(F.col("value") > 30, 'attachment; filename="a.txt"'),
        ),
        lambda _, v: v.isNotNull(),
    )
    ending = F.when(F.col("value") > 20, ".zip").otherwise(".php")
    return _read(spark, sf, "events").select(
        "event_id",
        F.concat(url, ending).alias("url"),
        status.alias("status"),
        headers.alias("headers"),
        body.alias("body"),
        F.when(user > 75, F.array(F.lit("cached"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


_CLASSIFIED_SQL = """
classified as (
  select *, case when reason in ('cached', 'downloaded')
                 then case when value > 30 then 'a.txt' else event_id || '.zip' end end as chosen
  from (
    select event_id, value, props,
         case when event_type = 'error' and value <= 20 then 'Error downloading'
              when event_type = 'error' then 'download-error'
              when value < 10 then 'empty-content'
              when event_type in ('view', 'purchase') then 'invalid-content_type'
              when event_type = 'click' and value > 50 then 'invalid-content_type'
              when value <= 20 then 'noaccess-filename'
              when user_id > 75 then 'cached' else 'downloaded' end as reason,
         'http://f.example.org/' || event_id || case when value > 20 then '.zip' else '.php' end as url
    from events))
"""


def fetch_reasons(spark, sf):
    found = md.classify_fetch(captures(spark, sf))
    return found.select("event_id", "reason", "ok", F.when(F.col("ok"), F.col("filename")).alias("filename"))


def media_results(spark, sf):
    found = md.classify_fetch(captures(spark, sf))
    return md.media_results(found).select("url", "ok", "key", "checksum", "reason")


def allowed_types(spark, sf):
    types = captures(spark, sf).select("event_id", F.col("headers")["Content-Type"].alias("content_type"))
    return types.withColumn("allowed", md.allowed_type(F.col("content_type")))


def fresh_files(spark, sf):
    """Customers ask for a file dated by their last order."""
    wanted = _read(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    files = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.max("o_orderdate").cast("timestamp").alias("upload_date"),
        F.md5(F.max("o_orderkey").cast("string")).alias("checksum"),
    )
    now = F.lit(NOW).cast("timestamp")
    return md.freshness(wanted, files, now)


def _stored_files(spark, sf):
    return _read(spark, sf, "lineitem").select(
        F.concat_ws("/", _text("l_orderkey"), _text("l_linenumber")).alias("key"),
        F.concat(_text("l_partkey"), F.lit(".txt")).alias("filename"),
    )


def valid_files(spark, sf):
    return md.valid_store_keys(_stored_files(spark, sf))[0]


def broken_keys(spark, sf):
    return md.valid_store_keys(_stored_files(spark, sf))[1]


def fetch_plan(spark, sf):
    """Files are dated for parts of small size, and half of the suppliers are fetched already."""
    items = line_items(spark, sf)
    age = F.timestamp_add("DAY", -(F.col("p_size")), F.lit(NOW).cast("timestamp"))
    files = _read(spark, sf, "part").select(
        F.concat(
            F.lit("p.example.org_"),
            F.sha1(F.concat(F.lit("http://p.example.org/"), _text("p_partkey"), F.lit(".zip"))),
        ).alias("key"),
        age.alias("upload_date"),
        F.lit("c").alias("checksum"),
    )
    captured = outcomes(spark, sf).where(F.col("url").startswith("http://s.")).select("url", "ok")
    return md.fetch_plan(items, files, captured, F.lit(NOW).cast("timestamp")).select("url")


def covers(spark, sf):
    """The cover of an order is the picture of its customer."""
    picture = F.concat(F.lit("http://i.example.org/"), _text("o_custkey"), F.lit(".jpg"))
    items = _read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("original_url"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(picture).alias("book_covor_image_url"),
    )
    images = _read(spark, sf, "customer").select(
        F.concat(F.lit("http://i.example.org/"), _text("c_custkey"), F.lit(".jpg")).alias("url"),
        (F.col("c_acctbal") > 0).alias("ok"),
        F.concat(F.lit("full/"), _text("c_custkey"), F.lit(".jpg")).alias("path"),
        (F.col("c_nationkey") * 10).alias("width"),
        F.lit(100).alias("height"),
    )
    return md.attach_cover(items, images, "/srv/covers", min_width=50, min_height=50)


def _stored_covers(spark, sf) -> DataFrame:
    """Covers of customers with an odd key, stored as many days ago as their nation's number times three."""
    url = F.concat(F.lit("http://i.example.org/"), _text("c_custkey"), F.lit(".jpg"))
    return _read(spark, sf, "customer").where("c_custkey % 2 = 1").select(
        md.blob_key(url).alias("key"),
        url.alias("url"),
        F.timestamp_add("DAY", -(F.col("c_nationkey") * 3), F.lit(NOW).cast("timestamp")).alias("upload_date"),
        F.lit("c").alias("checksum"),
        F.concat(F.lit("old/"), _text("c_custkey"), F.lit(".jpg")).alias("path"),
        F.lit(100).alias("width"),
        F.lit(100).alias("height"),
    )


def _pictured_orders(spark, sf) -> DataFrame:
    picture = F.concat(F.lit("http://i.example.org/"), _text("o_custkey"), F.lit(".jpg"))
    return _read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("original_url"), picture.alias("book_covor_image_url")
    )


def cover_plan(spark, sf):
    """Covers of all orders that are not stored, or stored too long ago."""
    now = F.lit(NOW).cast("timestamp")
    return md.cover_plan(_pictured_orders(spark, sf), _stored_covers(spark, sf), now).select("url", "state")


def reused_covers(spark, sf):
    """Covers of orders from the store where they are fresh, else from this run, which had them for rich customers."""
    now = F.lit(NOW).cast("timestamp")
    stored = _stored_covers(spark, sf)
    rich = _read(spark, sf, "customer").where("c_acctbal > 0")
    url = F.concat(F.lit("http://i.example.org/"), _text("c_custkey"), F.lit(".jpg")).alias("url")
    path = F.concat(F.lit("new/"), _text("c_custkey"), F.lit(".jpg")).alias("path")
    had = rich.select(url, F.lit(True).alias("ok"), path, F.lit(100).alias("width"), F.lit(100).alias("height"))
    images = had.join(md.cover_plan(_pictured_orders(spark, sf), stored, now).select("url"), "url", "left_semi")
    items = md.attach_cover(_pictured_orders(spark, sf), md.reused_covers(images, stored, now), "/srv/covers")
    return items.select("original_url", "book_covor_image_path")


def status_counts(spark, sf):
    return md.media_status_counts(md.classify_fetch(captures(spark, sf)), media="bookfile")


QUERIES = {
    "candidate_urls": (candidates, f"with {_ITEMS_SQL} select original_url, pos, url from cands"),
    "first_success": (
        chosen_files,
        f"""
        with {_OUTCOMES_SQL}, {_ORDER_CANDIDATES_SQL}, best as (
          select original_url, arg_min(url, pos) as url from tried where ok group by 1)
        select o_orderkey as original_url, 'k_' || sha1(url) as book_file_id, url as book_file_url
        from orders left join best on original_url = o_orderkey
        """,
    ),
    "attempts": (
        tried,
        f"""
        with {_OUTCOMES_SQL}, {_ORDER_CANDIDATES_SQL}, firsts as (
          select *, min(case when ok then pos end) over (partition by original_url) as first_ok from tried)
        select original_url, url, cast(l_linenumber as bigint) as l_linenumber, l_partkey, l_suppkey
        from firsts where first_ok is null or pos <= first_ok
        """,
    ),
    "classify_fetch": (
        fetch_reasons,
        f"""
        with {_CLASSIFIED_SQL}
        select event_id, reason, reason in ('cached', 'downloaded') as ok, chosen as filename from classified
        """,
    ),
    "media_results": (
        media_results,
        f"""
        with {_CLASSIFIED_SQL}
        select url, chosen is not null as ok,
               case when chosen is not null then 'f.example.org_' || sha1(url) end as key,
               case when chosen is not null then md5(props) end as checksum, reason
        from classified
        """,
    ),
    "allowed_type": (
        allowed_types,
        """
        with typed as (
          select event_id,
                 case when event_type = 'view' then 'text/html'
                      when event_type = 'click' and value > 50 then 'text/plain; charset=gbk'
                      when event_type = 'click' then 'text/plain'
                      when event_type = 'signup' then 'application/zip' end as content_type
          from events)
        select event_id, content_type, coalesce(content_type in ('text/plain', 'application/zip'), false) as allowed
        from typed
        """,
    ),
    "freshness": (
        fresh_files,
        f"""
        with files as (
          select o_custkey as key, max(o_orderdate) as d, md5(cast(max(o_orderkey) as varchar)) as c
          from orders group by 1)
        select c_custkey as key,
               case when d is null then 'missing'
                    when epoch(timestamp '{NOW}') - epoch(d) > 30 * 86400 then 'stale'
                    else 'uptodate' end as state,
               case when epoch(timestamp '{NOW}') - epoch(d) <= 30 * 86400 then c end as checksum
        from customer left join files on key = c_custkey
        """,
    ),
    "valid_store_keys": (
        valid_files,
        """
        select l_orderkey || '/' || l_linenumber as key, any_value(l_partkey) || '.txt' as filename
        from lineitem group by l_orderkey, l_linenumber having count(*) = 1
        """,
    ),
    "broken_store_keys": (
        broken_keys,
        """
        select l_orderkey || '/' || l_linenumber as key, count(*) as n_files
        from lineitem group by l_orderkey, l_linenumber having count(*) > 1
        """,
    ),
    "fetch_plan": (
        fetch_plan,
        f"""
        with {_ITEMS_SQL}, known as (
          select 'http://p.example.org/' || p_partkey || '.zip' as url, p_size <= 30 as fresh,
                 cast(null as boolean) as ok from part
          union all
          select 'http://s.example.org/' || s_suppkey || '.rar', false, s_acctbal > 4000 from supplier),
        joined as (select c.*, k.fresh, k.ok, k.fresh or coalesce(k.ok, false) as usable
                   from cands c join known k using (url)),
        firsts as (select *, min(case when usable then pos end) over (partition by original_url) as usable_at from joined)
        select distinct url from firsts where not fresh and ok is null and (usable_at is null or pos < usable_at)
        """,
    ),
    "attach_cover": (
        covers,
        """
        select o_orderkey as original_url,
               case when o_orderstatus = 'P' then '' else 'http://i.example.org/' || o_custkey || '.jpg' end
                 as book_covor_image_url,
               case when o_orderstatus <> 'P' and c_acctbal > 0 and c_nationkey * 10 >= 50
                    then '/srv/covers/full/' || c_custkey || '.jpg' else '' end as book_covor_image_path
        from orders left join customer on c_custkey = o_custkey
        """,
    ),
    "cover_plan": (
        cover_plan,
        """
        select distinct 'http://i.example.org/' || o_custkey || '.jpg' as url,
               case when c_custkey is null then 'missing' else 'stale' end as state
        from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 1
        where c_custkey is null or c_nationkey * 3 > 30
        """,
    ),
    "reused_covers": (
        reused_covers,
        """
        select o_orderkey as original_url,
               case when c_custkey % 2 = 1 and c_nationkey * 3 <= 30 then '/srv/covers/old/' || o_custkey || '.jpg'
                    when c_acctbal > 0 then '/srv/covers/new/' || o_custkey || '.jpg' else '' end
                 as book_covor_image_path
        from orders left join customer on c_custkey = o_custkey
        """,
    ),
    "media_status_counts": (
        status_counts,
        f"""
        with {_CLASSIFIED_SQL}
        select 'bookfile_file_count' as key, count(*) as value from classified where chosen is not null
        union all
        select 'bookfile_file_status_count/' || reason, count(*) from classified
        where chosen is not null group by reason
        """,
    ),
}

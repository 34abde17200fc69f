"""Queries over pages: capture, links, records, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.text import remove_entities
from pagelake.functions.urls import (
    canonical_url,
    clean_url,
    fingerprint,
    from_cache_url,
    netloc,
    resolve_url,
    to_cache_url,
    url_key,
)
from pagelake.fixed_values import CACHE_PREFIX
from pagelake.operators import extract as ex
from pagelake.plans.crawl import frontier_requests, host_frontier
from pagelake.session import new_path, table_stream
from pagelake.sources.blobs import with_store_path
from pagelake.sources.captures import captures_from_pages, seeds

_LINKS_SQL = r"""
links as (
  select url as src_url, page_id, unnest(l) as href, unnest(t) as text,
         cast(generate_subscripts(l, 1) - 1 as bigint) as pos
  from (select url, page_id,
               regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>([^<]*)', 1) as l,
               regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>([^<]*)', 2) as t
        from pages))
"""
_ROOT_SQL = "regexp_extract(src_url, '^([a-z]+://[^/?#]*)', 1)"
_NETLOC_SQL = "regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1)"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def _summary(captures: DataFrame) -> DataFrame:
    return captures.select(
        "url",
        F.col("status").cast("bigint").alias("status"),
        "encoding",
        F.octet_length("body").cast("bigint").alias("n_bytes"),
        F.md5("body").alias("body_md5"),
    )


_CAPTURES_SQL = """
select url, cast(200 as bigint) as status, 'utf-8' as encoding,
       cast(octet_length(encode(html)) as bigint) as n_bytes, md5(html) as body_md5
from pages
"""


def captures(spark, sf):
    return _summary(captures_from_pages(pages(spark, sf)))


def captures_stream(spark, sf):
    """The same rows read as a stream, run until no input is left."""
    target, checkpoint = new_path(spark, "captures"), new_path(spark, "captures-state")
    source = table_stream(spark, f"{sf}/pages.parquet")
    query = (
        _summary(captures_from_pages(source))
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(target)
    )
    query.awaitTermination()
    return spark.read.parquet(target)


def seed_requests(spark, sf):
    found = seeds(spark, pages(spark, sf).select("url"))
    return found.select(
        "url",
        "method",
        "kind",
        F.col("priority").cast("bigint").alias("priority"),
        "dont_filter",
        F.col("depth").cast("bigint").alias("depth"),
    )


def links(spark, sf):
    return ex.extract_links(pages(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


def links_in_containers(spark, sf):
    found = ex.container_links(pages(spark, sf))
    return found.select("src_url", F.col("pos").cast("bigint").alias("pos"), "href", "text", "cls", "outer_cls")


def next_links(spark, sf):
    """The nav list has no div around it, so the label alone decides."""
    return ex.next_link(ex.extract_links(pages(spark, sf)), text="the", outer_cls=None)


def detail_links(spark, sf):
    found = ex.detail_links(ex.extract_links(pages(spark, sf)), cls_part=None)
    return found.withColumn("pos", F.col("pos").cast("bigint"))


def first_elements(spark, sf):
    html = F.col("html")
    return pages(spark, sf).select(
        "url",
        ex.select_first(html, "title").alias("title"),
        ex.select_first(html, "h1").alias("heading"),
        ex.select_first(html, "div", cls="ad").alias("ad"),
        ex.select_first(html, "html", attribute="lang").alias("lang"),
        ex.select_first(html, "div", cls="none").alias("absent"),
    )


#: Tasks that parse the pages made from orders, whatever their number: a file of one row group
#: would leave all parsing to one task. Several for a core, so that few cores wait for the last ones.
PARSE_TASKS = 96


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """The few columns that the made pages show, dealt to ``PARSE_TASKS`` tasks."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    shown = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return shown.repartition(PARSE_TASKS, "o_orderkey")


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A listing page per order: one link on, one detail link, one empty, one outside."""
    orders = _orders(spark, sf)
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    following = (F.col("o_orderkey") + 1).cast("string")
    onward = F.concat(
        F.lit('<a href="list_0.html">上一页</a><a href=" list_'), following, F.lit('.html ">下一页</a>')
    )
    html = F.concat(
        F.lit('<div class="k2"><div>'),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(onward),
        F.lit('</div></div><div class="sousuolist x"><a href="/book_'),
        key,
        F.lit(".html?a=1&amp;b="),
        customer,
        F.lit('">A</a></div><div class="sousuolist"><a href="">empty</a></div>'),
        F.lit('<!-- <a href="/not">no</a> --><p>open<br><div class="other"><a href="/else">e</a></div>'),
    )
    url = F.concat(F.lit("http://books.example.org/list_"), key, F.lit(".html"))
    return orders.select(url.alias("url"), html.alias("html"))


def listing(spark, sf):
    return ex.listing_requests(listing_pages(spark, sf))


_LISTING_SQL = """
select 'http://books.example.org/list_' || o_orderkey || '.html' as src_url,
       'http://books.example.org/list_' || (o_orderkey + 1) || '.html' as url, 'list' as kind
from orders where o_orderstatus <> 'P'
union all
select 'http://books.example.org/list_' || o_orderkey || '.html',
       'http://books.example.org/book_' || o_orderkey || '.html?a=1&b=' || o_custkey, 'detail'
from orders
"""


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A detail page per order; its status decides which parts are missing."""
    orders = _orders(spark, sf)
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    status, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    anchor = F.concat(F.lit('<div><a href="http://f.org/'), customer, F.lit('.rar">1</a></div>'))
    other = F.concat(F.lit('<div><a href="http://f.org/'), rank, F.lit('.rar">2</a></div>'))
    cells = F.concat(
        F.lit('<div class="xiazai_xiao head"><div>header</div></div><div class="xiazai_xiao">'),
        anchor,
        other,
        F.lit("<div>done "),
        rank,
        F.lit("</div><div>"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("</div>"),
        F.when((status == "O") & (rank == "5"), F.lit("")).otherwise(
            F.lit('<div><a href="http://s.org/">Site &amp; Co</a></div>')
        ),
        F.lit("</div>"),
    )
    html = F.concat(
        F.lit('<html><body><p>intro<div class="zizida">Book '),
        key,
        F.lit("</div>"),
        F.when((status == "F") & (rank == "1"), F.lit("")).otherwise(
            F.concat(F.lit('<div class="xiaoxiao">12345 '), F.col("o_orderpriority"), F.lit(" </div>"))
        ),
        F.when((status == "P") & (rank == "2"), F.lit("")).otherwise(
            F.concat(F.lit('<div class="lili">\n '), key, F.lit(" &lt;text&gt; <b>bold</b></div>"))
        ),
        F.when(rank == "3", F.lit("")).otherwise(
            F.concat(F.lit('<div class="hong"><img src="http://h.org/'), customer, F.lit('.jpg"></div>'))
        ),
        cells,
    )
    url = F.concat(F.lit("http://books.example.org/book_"), key, F.lit(".html"))
    return orders.select(url.alias("url"), html.alias("html"))


_DETAIL_SQL = """
detail as (
  select 'http://books.example.org/book_' || o_orderkey || '.html' as original_url,
         'Book ' || o_orderkey as book_name,
         o_orderpriority as author,
         o_orderkey || ' <text>' as book_description,
         case when rank <> '3' then 'http://h.org/' || o_custkey || '.jpg' end as book_covor_image_url,
         case when o_orderstatus = 'F' and rank = '1' then 'no-author'
              when o_orderstatus = 'P' and rank = '2' then 'no-description'
              when o_orderstatus = 'O' and rank = '5' then 'short-download-row' end as reason,
         case when cast(o_custkey as varchar) = rank then 'http://f.org/' || rank || '.rar'
              else 'http://f.org/' || o_custkey || '.rar,http://f.org/' || rank || '.rar' end as urls,
         'done ' || rank as progress,
         strftime(o_orderdate, '%Y-%m-%d') as update_time,
         'Site & Co,http://s.org/' as source_site
  from (select *, o_orderpriority[1:1] as rank from orders))
"""


def details(spark, sf):
    whole, _ = ex.split_rejects(ex.extract_detail(detail_pages(spark, sf)))
    return whole.select(
        "original_url",
        "book_name",
        F.array_join("author", ",").alias("author"),
        "book_description",
        "book_covor_image_url",
    )


def downloads(spark, sf):
    whole, _ = ex.split_rejects(ex.extract_detail(detail_pages(spark, sf)))
    row = whole.select("original_url", F.explode("book_download").alias("d"))
    return row.select(
        "original_url",
        F.array_join("d.url", ",").alias("urls"),
        F.col("d.progress").alias("progress"),
        F.col("d.update_time").alias("update_time"),
        F.array_join("d.source_site", ",").alias("source_site"),
    )


def rejects(spark, sf):
    return ex.split_rejects(ex.extract_detail(detail_pages(spark, sf)))[1]


def clean_urls(spark, sf):
    """Links padded with the characters that cleaning takes off, and with an entity."""
    found = ex.extract_links(pages(spark, sf))
    dirty = F.concat(F.lit(" \t\"'"), "href", F.lit("?a=1&amp;b=2'\n "))
    return found.select(
        "src_url",
        F.col("pos").cast("bigint").alias("pos"),
        clean_url(F.col("src_url"), dirty).alias("url"),
    )


def resolved_urls(spark, sf):
    """Each link against its page in every form of reference."""
    found = ex.extract_links(pages(spark, sf))
    word = F.expr("substring(href, 2)")
    forms = {
        "rooted": F.col("href"),
        "schemeless": F.concat(F.lit("//other.example.org"), F.col("href")),
        "absolute": F.concat(F.lit("ftp://other.example.org/"), word),
        "query": F.concat(F.lit("?q="), word),
        "fragment": F.concat(F.lit("#"), word),
        "beside": F.concat(F.lit("./"), word, F.lit("/../z")),
        "above": F.concat(F.lit("../../../../"), word),
        "empty": F.lit(""),
    }
    return found.select(
        "src_url",
        F.col("pos").cast("bigint").alias("pos"),
        *[resolve_url(F.col("src_url"), ref).alias(name) for name, ref in forms.items()],
    )


_RESOLVED_SQL = f"""
with {_LINKS_SQL}, parts as (
  select src_url, pos, href, href[2:] as word, {_ROOT_SQL} as root,
         regexp_extract(src_url, '^([^?#]*)', 1) as place,
         regexp_extract(src_url, '^([^?#]*/)', 1) as dir
  from links)
select src_url, pos, root || href as rooted,
       regexp_extract(src_url, '^([a-z]+:)', 1) || '//other.example.org' || href as schemeless,
       'ftp://other.example.org/' || word as absolute,
       place || '?q=' || word as query,
       regexp_extract(src_url, '^([^#]*)', 1) || '#' || word as fragment,
       dir || 'z' as beside,
       root || '/' || word as above,
       src_url as empty
from parts
"""


def url_parts(spark, sf):
    url = F.col("url")
    return pages(spark, sf).select(
        "url",
        netloc(url).alias("netloc"),
        url_key(url, "/").alias("path_key"),
        url_key(url, "_").alias("blob_key"),
        canonical_url(url).alias("canonical"),
        fingerprint(url).alias("fp"),
    )


_CANONICAL_SQL = r"""
case when regexp_extract(url, '^[^?#]*\?([^#]*)', 1) = '' then regexp_extract(url, '^([^?#]*)', 1)
     else regexp_extract(url, '^([^?#]*)', 1) || '?' ||
          array_to_string(list_sort(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')), '&')
end
"""


def cache_urls(spark, sf):
    """URLs of the biggest site sent to the page cache, and back."""
    cached = to_cache_url(F.col("url"), ["blog.tionsh.example.net"])
    moved = cached != F.col("url")
    return pages(spark, sf).select(
        "url", cached.alias("cached"), from_cache_url(cached, moved).alias("back")
    )


def entities(spark, sf):
    return pages(spark, sf).select(
        "url",
        F.md5(remove_entities(F.col("html"))).alias("text_md5"),
        remove_entities(ex.select_first(F.col("html"), "title")).alias("title"),
    )


_ENTITIES_SQL = r"""
replace(replace(replace(replace({0}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')
"""


def store_paths(spark, sf):
    found = pages(spark, sf).select("url", F.col("url").alias("book_file_url"))
    return with_store_path(found, "/srv/books/").select("url", "book_file")


def frontier(spark, sf):
    return frontier_requests(pages(spark, sf)).select("src_url", "url", "host", "fp")


QUERIES = {
    "host_frontier": (
        lambda spark, sf: host_frontier(pages(spark, sf)),
        f"""
        with {_LINKS_SQL}, urls as (
          select {_ROOT_SQL} || trim(href, chr(9) || chr(13) || chr(10) || ' ''"') as url from links),
        once as (select url, count(*) as n from urls group by url)
        select {_NETLOC_SQL.format('url')} as host, count(*) as n_pages, cast(sum(n) as bigint) as n_links
        from once group by 1
        """,
    ),
    "frontier_requests": (
        frontier,
        f"""
        with {_LINKS_SQL}, urls as (
          select src_url, page_id, pos, {_ROOT_SQL} || href as url from links),
        numbered as (
          select *, row_number() over (partition by url order by page_id, pos) as rn from urls)
        select src_url, url, {_NETLOC_SQL.format('url')} as host, sha1('GET' || url) as fp
        from numbered where rn = 1
        """,
    ),
    "captures": (captures, _CAPTURES_SQL),
    "captures_stream": (captures_stream, _CAPTURES_SQL),
    "seed_requests": (
        seed_requests,
        """
        select url, 'GET' as method, 'list' as kind, cast(0 as bigint) as priority,
               true as dont_filter, cast(0 as bigint) as depth
        from pages
        """,
    ),
    "extract_links": (links, f"with {_LINKS_SQL} select src_url, pos, href, text from links"),
    "container_links": (
        links_in_containers,
        f"""
        with {_LINKS_SQL} select src_url, pos, href, {_ENTITIES_SQL.format('text')} as text,
               cast(null as varchar) as cls, cast(null as varchar) as outer_cls
        from links
        """,
    ),
    "next_link": (
        next_links,
        f"with {_LINKS_SQL} select src_url, arg_min(href, pos) as href from links where text = 'the' group by src_url",
    ),
    "detail_links": (
        detail_links,
        f"with {_LINKS_SQL} select src_url, pos, href from links where href <> ''",
    ),
    "select_first": (
        first_elements,
        r"""
        select url, regexp_extract(html, '<title>([^<]+)', 1) as title,
               regexp_extract(html, '<h1>([^<]+)', 1) as heading,
               regexp_extract(html, '<div class="ad">([^<]+)', 1) as ad,
               regexp_extract(html, '<html lang="([^"]*)"', 1) as lang,
               cast(null as varchar) as absent
        from pages
        """,
    ),
    "listing_requests": (listing, _LISTING_SQL),
    "extract_detail": (
        details,
        f"""
        with {_DETAIL_SQL}
        select original_url, book_name, author, book_description, book_covor_image_url
        from detail where reason is null
        """,
    ),
    "extract_downloads": (
        downloads,
        f"""
        with {_DETAIL_SQL}
        select original_url, urls, progress, update_time, source_site from detail where reason is null
        """,
    ),
    "split_rejects": (
        rejects,
        f"with {_DETAIL_SQL} select original_url, reason from detail where reason is not null",
    ),
    "clean_url": (
        clean_urls,
        f"with {_LINKS_SQL} select src_url, pos, {_ROOT_SQL} || href || '?a=1&b=2' as url from links",
    ),
    "resolve_url": (resolved_urls, _RESOLVED_SQL),
    "url_parts": (
        url_parts,
        f"""
        select url, {_NETLOC_SQL.format('url')} as netloc,
               {_NETLOC_SQL.format('url')} || '/' || sha1(url) as path_key,
               {_NETLOC_SQL.format('url')} || '_' || sha1(url) as blob_key,
               {_CANONICAL_SQL} as canonical, sha1('GET' || {_CANONICAL_SQL}) as fp
        from pages
        """,
    ),
    "cache_urls": (
        cache_urls,
        f"""
        select url, case when {_NETLOC_SQL.format('url')} = 'blog.tionsh.example.net'
                         then '{CACHE_PREFIX}' || url else url end as cached, url as back
        from pages
        """,
    ),
    "remove_entities": (
        entities,
        f"""
        select url, md5({_ENTITIES_SQL.format('html')}) as text_md5,
               {_ENTITIES_SQL.format("regexp_extract(html, '<title>([^<]+)', 1)")} as title
        from pages
        """,
    ),
    "store_path": (
        store_paths,
        f"select url, '/srv/books/' || {_NETLOC_SQL.format('url')} || '/' || sha1(url) as book_file from pages",
    ),
}

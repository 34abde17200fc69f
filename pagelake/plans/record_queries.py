"""Queries over records: defaults, drops, unique load, lookups, and their stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators import media as md
from pagelake.operators import records as rc
from pagelake.operators.extract import extract_detail
from pagelake.plans.load import book_stages, dropped_rows, kept_rows, run_stages, status_counts, store_stages, success_report
from pagelake.plans.page_queries import _DETAIL_SQL, detail_pages
from pagelake.session import new_path, table_stream, written
from pagelake.sources import blobs as bl
from pagelake.sources.archives import bundle_by_key, expand_archives
from pagelake.sources.book_tables import write_book_detail, write_book_detail_sharded
from pagelake.streaming.load import load_stream

NOW = "2024-02-01 00:00:00"


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp")


def order_items(spark, sf) -> DataFrame:
    """An item per order; fields are missing by status, and the file by the order's lines."""
    shipped = _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("part")
    )
    status = F.col("o_orderstatus")
    url = F.concat(F.lit("http://f.example.org/"), F.col("part").cast("string"), F.lit(".zip"))
    return _read(spark, sf, "orders").join(
        shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).select(
        F.when(status != "P", F.col("o_orderpriority")).alias("book_name"),
        F.when(status == "F", F.array(F.col("o_custkey").cast("string"))).alias("author"),
        F.when(status == "O", F.lit("text")).alias("book_description"),
        url.alias("book_file_url"),
        F.concat(F.lit("http://b.example.org/"), F.col("o_orderkey").cast("string")).alias("original_url"),
    )


_ITEMS_SQL = """
items as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
         'http://f.example.org/' || part || '.zip' as book_file_url,
         'http://b.example.org/' || o_orderkey as original_url
  from orders left join (select l_orderkey, min(l_partkey) as part from lineitem group by 1)
       on l_orderkey = o_orderkey)
"""


def _flat(records: DataFrame, extra: list[str]) -> DataFrame:
    return records.select(
        "book_name",
        F.array_join("alias_name", ",").alias("alias_name"),
        F.array_join("author", ",").alias("author"),
        "book_description",
        "book_covor_image_path",
        "book_covor_image_url",
        F.size("book_download").cast("bigint").alias("n_downloads"),
        "book_file_url",
        *extra,
        "original_url",
    )


def filled(spark, sf):
    return _flat(rc.fill_defaults(order_items(spark, sf), "sharded"), ["book_file_id"])


def filled_single(spark, sf):
    return _flat(rc.fill_defaults(order_items(spark, sf), "single"), ["book_file"])


def _filled_sql(file_column):
    return f"""
    with {_ITEMS_SQL}
    select case when o_orderstatus <> 'P' then o_orderpriority end as book_name, '' as alias_name,
           case when o_orderstatus = 'F' then cast(o_custkey as varchar) else '' end as author,
           case when o_orderstatus = 'O' then 'text' else '' end as book_description,
           '' as book_covor_image_path, '' as book_covor_image_url, cast(0 as bigint) as n_downloads,
           coalesce(book_file_url, '') as book_file_url, '' as {file_column}, original_url
    from items
    """


def kept(spark, sf):
    return rc.drop_none(order_items(spark, sf))[0].select("original_url", "book_file_url")


def dropped(spark, sf):
    return rc.drop_none(order_items(spark, sf))[1]


def stamped(spark, sf):
    done = rc.stamp(order_items(spark, sf), _now())
    return done.select("original_url", F.unix_seconds("update_time").alias("stamped_at"), "record_id")


def _document_books(spark, sf) -> DataFrame:
    """Documents as books: equal texts have one name, the language is the author."""
    return _read(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"),
        F.md5("text").alias("book_name"),
        F.array("lang").alias("author"),
        "source",
        F.concat(F.lit("http://d.example.org/"), F.col("doc_id").cast("string")).alias("original_url"),
    )


def inserted(spark, sf):
    accepted, _ = rc.insert_unique(_document_books(spark, sf))
    return accepted.select("seq", "book_name")


def refused(spark, sf):
    """Against a table that already holds the books of one source."""
    books = _document_books(spark, sf)
    _, rejected = rc.insert_unique(books.where("source <> 'src1'"), books.where("source = 'src1'"))
    return rejected.select("seq", "book_name")


def inserted_authors(spark, sf):
    """Language and source are both authors, so copies collide on either."""
    books = _document_books(spark, sf).withColumn("author", F.concat("author", F.array("source")))
    accepted, _ = rc.insert_unique(books)
    return accepted.select("seq", "book_name")


def found(spark, sf):
    parts = _read(spark, sf, "part").select(
        F.col("p_partkey").alias("record_id"),
        F.col("p_name").alias("book_name"),
        F.array("p_brand", "p_type").alias("author"),
    )
    one = rc.lookup(parts, book_name="red widget")
    both = rc.lookup(parts, book_name="blue bolt", author="ECONOMY")
    return one.unionByName(both).select("record_id", "book_name")


def index(spark, sf):
    docs = _read(spark, sf, "documents").select(
        F.array("lang", "source").alias("author"), F.col("doc_id").alias("record_id")
    )
    return rc.inverted_index(docs, "author")


def index_lookup(spark, sf):
    """Books of authors looked up in bulk: which document has which label's language."""
    docs = _read(spark, sf, "documents").select(
        F.split("text", " ").alias("author"), F.col("doc_id").alias("record_id")
    )
    wanted = _read(spark, sf, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("value")).distinct()
    return rc.inverted_index(docs, "author", values=wanted)


def _stage_inputs(spark, sf):
    """Parsed detail pages, pictures by customer, and files that are good for some customers."""
    records = written(extract_detail(detail_pages(spark, sf)), "records")
    customers = _read(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("c"), F.col("c_acctbal").alias("balance")
    )
    images = customers.select(
        F.concat(F.lit("http://h.org/"), "c", F.lit(".jpg")).alias("url"),
        (F.col("balance") > 0).alias("ok"),
        F.concat(F.lit("full/"), "c").alias("path"),
        F.lit(1).alias("width"),
        F.lit(1).alias("height"),
    )
    url = F.concat(F.lit("http://f.org/"), "c", F.lit(".rar"))
    outcomes = customers.select(
        url.alias("url"),
        (F.col("balance") > 5000).alias("ok"),
        F.concat(F.lit("f.org_"), F.sha1(url)).alias("key"),
        F.md5(url).alias("checksum"),
    )
    return records, book_stages(images, outcomes, "/srv/covers")


def staged(spark, sf):
    records, stages = _stage_inputs(spark, sf)
    return kept_rows(run_stages(records, stages)).select(
        "original_url", "book_covor_image_path", "book_file_url", "book_file_id"
    )


def staged_drops(spark, sf):
    """From the stored outcomes, so that the folder of kept records stays closed."""
    records, stages = _stage_inputs(spark, sf)
    rows, _ = store_stages(run_stages(records, stages), new_path(spark, "staged"), stages)
    return dropped_rows(rows.where("outcome <> 'kept'"))


def report(spark, sf):
    records, stages = _stage_inputs(spark, sf)
    return status_counts(success_report(run_stages(records, stages)))


_STAGED_SQL = f"""
with {_DETAIL_SQL}, customers as (select cast(c_custkey as varchar) as c, c_acctbal as balance from customer),
keyed as (
  select d.*, cast(o.o_custkey as varchar) as c, o.o_orderpriority[1:1] as rank
  from detail d join orders o
    on d.original_url = 'http://books.example.org/book_' || o.o_orderkey || '.html'),
filed as (
  select k.*, a.balance as first_balance,
         case when a.balance > 5000 then 'http://f.org/' || k.c || '.rar'
              when b.balance > 5000 then 'http://f.org/' || k.rank || '.rar' end as book_file_url
  from keyed k left join customers a on a.c = k.c left join customers b on b.c = k.rank)
"""


def _as_items(books: DataFrame) -> DataFrame:
    return books.drop("source")


def stored_books(spark, sf):
    """Books written in two runs and read back; the second run brings known ones again."""
    path = new_path(spark, "books")
    books = _as_items(_document_books(spark, sf))
    write_book_detail(books.where("author[0] = 'en'"), path, _now())
    write_book_detail(books, path, _now())
    return spark.read.parquet(path).select(
        "book_name", F.array_join("author", ",").alias("author"), "book_file", "original_url", "record_id"
    )


def streamed_books(spark, sf):
    """The same load from a stream; all files of the table are one batch, so the order of ids is kept."""
    path, checkpoint = new_path(spark, "books"), new_path(spark, "books-state")
    docs = table_stream(spark, f"{sf}/documents.parquet")
    items = docs.select(
        F.col("doc_id").alias("seq"),
        F.md5("text").alias("book_name"),
        F.array("lang").alias("author"),
        F.concat(F.lit("http://d.example.org/"), F.col("doc_id").cast("string")).alias("original_url"),
    )
    load_stream(items, path, checkpoint, availableNow=True).awaitTermination()
    return spark.read.parquet(path).select("book_name", F.array_join("author", ",").alias("author"), "original_url")


def sharded_books(spark, sf):
    """Order times as update times: written in ranges and read back by day."""
    path = new_path(spark, "sharded")
    orders = _read(spark, sf, "orders")
    items = orders.select(
        F.col("o_orderpriority").alias("book_name"),
        F.concat(F.lit("http://b.example.org/"), F.col("o_orderkey").cast("string")).alias("original_url"),
    )
    write_book_detail_sharded(items, path, now=_now())
    return spark.read.parquet(path).select(
        "book_name", "book_file_id", "original_url", "record_id",
        F.unix_seconds("update_time").alias("stamped_at"), F.col("update_date").cast("string").alias("update_date"),
    )


def _blobs(spark, sf) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.md5("text").alias("key"),
        F.concat("source", F.lit(".TXT")).alias("filename"),
        F.col("text").cast("binary").alias("content"),
    )


def blob_chunks(spark, sf):
    chunks = bl.blob_chunks(_blobs(spark, sf).withColumn("key", F.col("seq").cast("string")), 1000)
    return chunks.select(
        "files_id",
        F.col("n").cast("bigint").alias("n"),
        F.octet_length("data").cast("bigint").alias("n_bytes"),
        F.md5("data").alias("data_md5"),
    )


def blob_round_trip(spark, sf):
    """Texts stored by content in two runs, put together again and checked."""
    path = new_path(spark, "blobs")
    blobs = _blobs(spark, sf)
    bl.write_blobs(blobs.where("filename = 'src1.TXT'"), path, 1000, _now())
    bl.write_blobs(blobs, path, 1000, _now())
    back = bl.read_blobs(*bl.read_blob_tables(spark, path))
    return back.select(
        F.col("_id").alias("key"), "length", "md5", F.md5("content").alias("content_md5"),
        "intact", "content_type", F.unix_seconds("upload_date").alias("uploaded_at"),
    )


def path_store(spark, sf):
    path = new_path(spark, "files")
    pages = _read(spark, sf, "pages")
    files = pages.select("url", F.lit("page.html").alias("filename"), F.col("html").cast("binary").alias("content"))
    bl.write_path_store(files, path)
    return spark.read.parquet(path).select("key", "filename", "checksum", F.md5("content").alias("content_md5"))


def archives(spark, sf):
    """Texts bundled by language and source, with a small part size, and taken out again."""
    files = _read(spark, sf, "documents").select(
        F.col("lang").alias("host"),
        F.col("source").alias("key"),
        F.concat(F.lit("/files/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )
    zips = bundle_by_key(files, part_bytes=20000).select(
        F.concat_ws("/", "host", F.concat("key", F.lit(".zip"))).alias("path"), F.col("archive").alias("content")
    )
    return expand_archives(zips).select("path", "member", F.md5("content").alias("content_md5"), "error")


QUERIES = {
    "fill_defaults": (filled, _filled_sql("book_file_id")),
    "fill_defaults_single": (filled_single, _filled_sql("book_file")),
    "drop_none": (
        kept,
        f"with {_ITEMS_SQL} select original_url, book_file_url from items where book_file_url is not null",
    ),
    "drop_none_dropped": (
        dropped,
        f"with {_ITEMS_SQL} select original_url, 'all-failed' as reason from items where book_file_url is null",
    ),
    "stamp": (
        stamped,
        f"""
        with {_ITEMS_SQL}
        select original_url, cast(epoch(timestamp '{NOW}') as bigint) as stamped_at, sha1(original_url) as record_id
        from items
        """,
    ),
    "insert_unique": (
        inserted,
        "select min(doc_id) as seq, md5(text) as book_name from documents group by md5(text), lang",
    ),
    "insert_unique_refused": (
        refused,
        """
        with books as (select doc_id as seq, md5(text) as book_name, lang, source from documents),
        fresh as (
          select *, row_number() over (partition by book_name, lang order by seq) as rn,
                 (book_name, lang) in (select (book_name, lang) from books where source = 'src1') as stored
          from books where source <> 'src1')
        select seq, book_name from fresh where stored or rn > 1
        """,
    ),
    "insert_unique_authors": (
        inserted_authors,
        """
        with recursive books as (
          select doc_id as seq, md5(text) as book_name, [lang, source] as authors,
                 row_number() over (partition by md5(text) order by doc_id) as rn
          from documents),
        walk as (
          select seq, book_name, rn, true as stored, authors as taken from books where rn = 1
          union all
          select b.seq, b.book_name, b.rn, not list_has_any(w.taken, b.authors),
                 case when list_has_any(w.taken, b.authors) then w.taken else w.taken || b.authors end
          from walk w join books b on b.book_name = w.book_name and b.rn = w.rn + 1)
        select seq, book_name from walk where stored
        """,
    ),
    "lookup": (
        found,
        """
        select p_partkey as record_id, p_name as book_name from part
        where p_name = 'red widget' or (p_name = 'blue bolt' and (p_brand = 'ECONOMY' or p_type = 'ECONOMY'))
        """,
    ),
    "inverted_index": (
        index,
        """
        select lang as value, doc_id as record_id from documents
        union select source, doc_id from documents
        """,
    ),
    "inverted_index_lookup": (
        index_lookup,
        """
        with words as (select distinct doc_id, unnest(string_split(text, ' ')) as value from documents)
        select value, doc_id as record_id from words
        where value in (select lower(r_name[1:2]) from region)
        """,
    ),
    "staged_records": (
        staged,
        f"""
        {_STAGED_SQL}
        select original_url,
               case when rank <> '3' and first_balance > 0 then '/srv/covers/full/' || c else '' end
                 as book_covor_image_path,
               book_file_url, 'f.org_' || sha1(book_file_url) as book_file_id
        from filed where reason is null and book_file_url is not null
        """,
    ),
    "staged_drops": (
        staged_drops,
        f"""
        {_STAGED_SQL}
        select original_url, 'parse' as stage, reason from filed where reason is not null
        union all
        select original_url, 'drop-none', 'all-failed' from filed where reason is null and book_file_url is null
        """,
    ),
    "success_report": (
        report,
        f"""
        {_STAGED_SQL}
        select coalesce(reason, case when book_file_url is null then 'all-failed' else 'SUCCESS' end) as status,
               count(*) as n
        from filed group by 1
        """,
    ),
    "write_book_detail": (
        stored_books,
        """
        with firsts as (
          select md5(text) as book_name, lang as author, min(doc_id) as id from documents group by 1, 2)
        select book_name, author, '' as book_file, 'http://d.example.org/' || id as original_url,
               sha1('http://d.example.org/' || id) as record_id
        from firsts
        """,
    ),
    "load_stream": (
        streamed_books,
        """
        with firsts as (
          select md5(text) as book_name, lang as author, min(doc_id) as id from documents group by 1, 2)
        select book_name, author, 'http://d.example.org/' || id as original_url from firsts
        """,
    ),
    "write_book_detail_sharded": (
        sharded_books,
        f"""
        select o_orderpriority as book_name, '' as book_file_id, 'http://b.example.org/' || o_orderkey as original_url,
               sha1('http://b.example.org/' || o_orderkey) as record_id,
               cast(epoch(timestamp '{NOW}') as bigint) as stamped_at, '{NOW[:10]}' as update_date
        from orders
        """,
    ),
    "blob_chunks": (
        blob_chunks,
        """
        with cut as (
          select doc_id, encode(text) as b,
                 unnest(range(cast(ceil(octet_length(encode(text)) / 1000.0) as bigint))) as n
          from documents)
        select cast(doc_id as varchar) as files_id, n,
               cast(octet_length(b[n * 1000 + 1 : n * 1000 + 1000]) as bigint) as n_bytes,
               md5(b[n * 1000 + 1 : n * 1000 + 1000]) as data_md5
        from cut
        """,
    ),
    "blob_round_trip": (
        blob_round_trip,
        f"""
        select md5(text) as key, cast(octet_length(encode(any_value(text))) as bigint) as length, md5(text) as md5,
               md5(text) as content_md5, true as intact, 'txt' as content_type,
               cast(epoch(timestamp '{NOW}') as bigint) as uploaded_at
        from documents group by md5(text)
        """,
    ),
    "path_store": (
        path_store,
        """
        select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || sha1(url) as key, 'page.html' as filename,
               md5(html) as checksum, md5(html) as content_md5
        from pages
        """,
    ),
    "archive_round_trip": (
        archives,
        """
        select lang || '/' || source || '.zip' as path, doc_id || '.txt' as member, md5(text) as content_md5,
               cast(null as varchar) as error
        from documents
        """,
    ),
}

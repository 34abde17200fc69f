"""Queries over texts, lists and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import files as names
from pagelake.functions import text as tx
from pagelake.functions.urls import netloc


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _words_with_nulls(spark, sf):
    """The words of each text, with ``null`` tokens of both kinds where words repeat a rule."""
    words = F.split("text", " ")
    marked = F.transform(
        words,
        lambda w: F.when(F.length(w) == 2, F.lit("null")).when(F.length(w) > 2, w),
    )
    return _read(spark, sf, "documents").select("doc_id", marked.alias("words"))


def strip_null(spark, sf):
    kept = tx.strip_null(F.col("words"))
    only = tx.strip_null(F.col("words"), [None])
    return _words_with_nulls(spark, sf).select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.size(kept).cast("bigint").alias("n_kept"),
        F.md5(F.array_join(kept, " ")).alias("kept_md5"),
        F.size(only).cast("bigint").alias("n_not_null"),
    )


def strip_null_map(spark, sf):
    entries = F.create_map(
        F.lit("lang"), "lang", F.lit("source"), F.when(F.col("lang") == "en", "null").otherwise(F.col("source")),
        F.lit("none"), F.lit(None),
    )
    kept = tx.strip_null_map(entries)
    return _read(spark, sf, "documents").select(
        "doc_id", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("keys")
    )


def lists(spark, sf):
    words = F.split("text", " ")
    distinct = tx.deduplication(words)
    return _read(spark, sf, "documents").select(
        "doc_id",
        tx.list_first_item(words).alias("first_word"),
        tx.list_first_item(F.filter(words, lambda w: w == "never there")).alias("none"),
        F.size(distinct).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join(F.sort_array(distinct), " ")).alias("distinct_md5"),
    )


def checksums(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", tx.checksum(F.col("text").cast("binary")).alias("md5"))


def labels(spark, sf):
    padded = F.concat(F.lit("12345 　\t"), F.col("text"), F.lit("\n  　"))
    return _read(spark, sf, "documents").select(
        "doc_id", F.md5(tx.label_value(padded, 5)).alias("value_md5")
    )


def decoded_bodies(spark, sf):
    """Every text encoded in a charset by its language and decoded again."""
    lang = F.col("lang")
    charset = F.when(lang == "en", "UTF-16BE").when(lang == "de", "utf-8").otherwise("UTF-32BE")
    body = (
        F.when(lang == "en", F.encode("text", "UTF-16BE"))
        .when(lang == "de", F.encode("text", "UTF-8"))
        .otherwise(F.encode("text", "UTF-32"))
    )
    coded = _read(spark, sf, "documents").select("doc_id", body.alias("body"), charset.alias("encoding"))
    return coded.select(
        "doc_id", F.md5(tx.decode_body(F.col("body"), F.col("encoding"), extra=True)).alias("text_md5")
    )


def _responses(spark, sf):
    """A file response per order; status and priority decide how the file is named.

    The GBK bytes of one character stand for each status: D6D0, B9FA and CEC4.
    """
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    rank = F.substring("o_orderpriority", 1, 1)
    raw = F.when(status == "F", "ÖÐ").when(status == "O", "¹ú").otherwise("ÎÄ")
    escaped = F.when(status == "F", "%D6%D0").when(status == "O", "%B9%FA").otherwise("%CE%C4")
    header = (
        F.when(rank == "1", F.concat(F.lit('attachment; filename="'), key, F.lit('.txt"')))
        .when(rank == "2", F.concat(F.lit("attachment; filename*=UTF-8''"), key, F.lit(".txt")))
        .when(rank == "3", F.concat(F.lit("inline; filename= "), raw, key, F.lit(".RAR ")))
    )
    url = F.when(
        rank == "4", F.concat(F.lit("http://down.wmtxt.com/x/"), escaped, key, F.lit(".rar"))
    ).when(
        rank == "5", F.concat(F.lit("http://files.example.org/a+b%20"), key, F.lit(".Zip"))
    ).otherwise(F.concat(F.lit("http://files.example.org/"), key, F.lit(".html?f=a.txt")))
    return _read(spark, sf, "orders").select("o_orderkey", url.alias("url"), header.alias("header"))


def file_names(spark, sf):
    found = names.file_name(F.col("url"), F.col("header"))
    return _responses(spark, sf).select("o_orderkey", found.alias("f")).select(
        "o_orderkey",
        F.col("f.name").alias("name"),
        F.col("f.failed").alias("failed"),
        names.file_ext(F.col("f.name")).alias("ext"),
    )


def header_parts(spark, sf):
    parts = names.filename_from_disposition(F.col("header"))
    return _responses(spark, sf).select(
        "o_orderkey",
        names.header_name(parts["raw"], netloc(F.col("url"))).alias("name"),
        parts["failed"].alias("failed"),
    )


def url_names(spark, sf):
    guess = names.filename_from_url(F.col("url"))
    return _responses(spark, sf).select(
        "o_orderkey",
        guess.alias("escaped"),
        names.url_name(guess, netloc(F.col("url"))).alias("name"),
    )


def numbers(spark, sf):
    """Every order total in five sizes."""
    whole = F.floor("o_totalprice").cast("double")
    sizes = {
        "whole": whole,
        "thousands": whole * 1000,
        "small": whole / F.lit(1e12),
        "eighths": -whole / F.lit(8.0),
        "tenths": F.col("o_custkey") / F.lit(10.0),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("x")) for k, x in sizes.items()])
    numbers = _read(spark, sf, "orders").select("o_orderkey", F.inline(pairs))
    return numbers.select("o_orderkey", "kind", tx.fmt_g(F.col("x")).alias("text"))


_MARKED_SQL = """
marked as (
  select doc_id, list_transform(string_split(text, ' '),
    lambda w: case when length(w) = 2 then 'null' when length(w) > 2 then w end) as words
  from documents)
"""
_ORDER_SQL = """
o as (select *, cast(o_orderkey as varchar) as k, o_orderpriority[1:1] as rank,
             case o_orderstatus when 'F' then '中' when 'O' then '国' else '文' end as sign,
             case o_orderstatus when 'F' then '%D6%D0' when 'O' then '%B9%FA' else '%CE%C4' end as escaped
      from orders)
"""

QUERIES = {
    "strip_null": (
        strip_null,
        f"""
        with {_MARKED_SQL}, kept as (
          select doc_id, words, list_filter(words, lambda w: w is not null and w <> 'null') as k from marked)
        select doc_id, cast(len(words) as bigint) as n_words, cast(len(k) as bigint) as n_kept,
               md5(array_to_string(k, ' ')) as kept_md5,
               cast(len(list_filter(words, lambda w: w is not null)) as bigint) as n_not_null
        from kept
        """,
    ),
    "strip_null_map": (
        strip_null_map,
        "select doc_id, case when lang = 'en' then 'lang' else 'lang,source' end as keys from documents",
    ),
    "list_functions": (
        lists,
        """
        select doc_id, string_split(text, ' ')[1] as first_word, cast(null as varchar) as none,
               cast(len(list_distinct(string_split(text, ' '))) as bigint) as n_distinct,
               md5(array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ')) as distinct_md5
        from documents
        """,
    ),
    "checksum": (checksums, "select doc_id, md5(text) as md5 from documents"),
    "label_value": (
        labels,
        r"""
        select doc_id, md5(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) as value_md5
        from documents
        """,
    ),
    "decode_body": (decoded_bodies, "select doc_id, md5(text) as text_md5 from documents"),
    "file_name": (
        file_names,
        f"""
        with {_ORDER_SQL}
        select o_orderkey,
               case rank when '1' then k || '.txt' when '3' then sign || k || '.RAR'
                    when '4' then sign || k || '.rar' when '5' then 'a+b ' || k || '.Zip' end as name,
               rank = '2' as failed,
               case rank when '1' then 'txt' when '3' then 'rar' when '4' then 'rar' when '5' then 'zip' end as ext
        from o
        """,
    ),
    "header_name": (
        header_parts,
        f"""
        with {_ORDER_SQL}
        select o_orderkey, case rank when '1' then k || '.txt' when '3' then sign || k || '.RAR' end as name,
               rank = '2' as failed
        from o
        """,
    ),
    "url_name": (
        url_names,
        f"""
        with {_ORDER_SQL}
        select o_orderkey,
               case rank when '4' then escaped || k || '.rar' when '5' then 'a+b%20' || k || '.Zip'
                    else k || '.html?f=a.txt' end as escaped,
               case rank when '4' then sign || k || '.rar' when '5' then 'a+b ' || k || '.Zip'
                    else k || '.html?f=a.txt' end as name
        from o
        """,
    ),
    "fmt_g": (
        numbers,
        """
        select o_orderkey, 'whole' as kind, printf('%g', floor(o_totalprice)) as text from orders
        union all select o_orderkey, 'thousands', printf('%g', floor(o_totalprice) * 1000) from orders
        union all select o_orderkey, 'small', printf('%g', floor(o_totalprice) / 1e12) from orders
        union all select o_orderkey, 'eighths', printf('%g', -floor(o_totalprice) / 8) from orders
        union all select o_orderkey, 'tenths', printf('%g', o_custkey / 10.0::double) from orders
        """,
    ),
}

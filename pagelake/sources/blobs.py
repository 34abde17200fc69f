"""File contents: cut into chunks by id, or laid out by path."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.fixed_values import CHUNK_BYTES
from pagelake.functions.files import file_ext
from pagelake.functions.text import checksum
from pagelake.functions.urls import netloc, url_key
from pagelake.operators.membership import not_in
from pagelake.schemas import BLOB_CHUNK, BLOB_FILE
from pagelake.session import delete, discard, written
from pagelake.sources.book_tables import read_if_present

WRITE_ID = T.StructField("write_id", T.StringType())
"""Stored files and chunks carry the id of the call that wrote them."""
#: Folders of ``files`` by a hash of the id, and the column that names them.
ID_BUCKETS = 64
BUCKET = "id_bucket"


def blob_files(
    blobs: DataFrame,
    chunk_bytes: int = CHUNK_BYTES,
    now: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A5: the row that describes each blob ``(key, filename, content)``."""
    return blobs.select(
        *keep,
        F.col("key").alias("_id"),
        F.octet_length("content").cast("bigint").alias("length"),
        F.lit(chunk_bytes).alias("chunk_size"),
        (F.current_timestamp() if now is None else now).alias("upload_date"),
        checksum(F.col("content")).alias("md5"),
        "filename",
        file_ext(F.col("filename")).alias("content_type"),
    )


def blob_chunks(blobs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A5: the content of each blob in pieces ``(files_id, n, data)``; none for an empty one."""
    count = F.ceil(F.octet_length("content") / chunk_bytes).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    numbered = blobs.select(F.col("key").alias("files_id"), "content", F.explode(starts).alias("n"))
    piece = F.substring(F.col("content"), F.col("n") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select("files_id", "n", piece.alias("data"))


def write_blobs(
    blobs: DataFrame,
    path: str,
    chunk_bytes: int = CHUNK_BYTES,
    now: Column | None = None,
    order: str = "seq",
) -> None:
    """A5: store ``(seq, key, filename, content)`` under ``path``; a key is stored once.

    Keys already stored are refused, and of a key repeated in ``blobs`` the first counts;
    both are decided on ``(key, seq)`` alone before any content moves, against the folders of
    ``files`` that the keys of ``blobs`` can be in. Chunks of a call that ended before its files were
    stored have a ``write_id`` that no file has, so a repeated call stores its own and readers do
    not see them; ``sweep_blobs`` removes them.
    """
    write_id = F.lit(uuid.uuid4().hex).alias(WRITE_ID.name)
    spark = blobs.sparkSession
    first = blobs.groupBy("key").agg(F.min(order).alias(order))
    stored = stored_files(spark, path, blobs)
    if stored is not None:
        first = not_in(first, stored.select(F.col("_id").alias("key")), "key")
    first = written(first, "new_blobs")
    new = blobs.join(first, ["key", order], "left_semi")
    described = blob_files(blobs, chunk_bytes, now, keep=(order,)).withColumn("key", F.col("_id"))
    files = described.join(first, ["key", order], "left_semi").drop("key", order)
    chunks = blob_chunks(new, chunk_bytes).repartition("files_id", F.expr("n div 64"))
    # chunks first: a file row then never points at chunks that are not there
    sorted_chunks = chunks.sortWithinPartitions("files_id", "n").select("*", write_id)
    sorted_chunks.write.mode("append").parquet(f"{path}/chunks")
    bucketed = files.select("*", write_id, id_bucket(F.col("_id")).alias(BUCKET))
    bucketed.repartition(BUCKET).sortWithinPartitions(BUCKET, "_id").write.mode("append").partitionBy(BUCKET).parquet(f"{path}/files")
    discard(first)


def id_bucket(key: Column) -> Column:
    """The folder of ``files`` that the row of a key is in."""
    return F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)).cast("int")


def stored_files(spark: SparkSession, path: str, blobs: DataFrame) -> DataFrame | None:
    """The stored files that could have a ``key`` of ``blobs``: a partition filter of at most ``ID_BUCKETS`` numbers."""
    stored = read_if_present(spark, f"{path}/files")
    if stored is None:
        return None
    asked = [r[0] for r in blobs.select(id_bucket(F.col("key"))).distinct().collect()]
    return stored.where(F.col(BUCKET).isin(asked))


def sweep_blobs(spark: SparkSession, path: str, min_age_seconds: int = 86400) -> int:
    """A5: delete chunks that no file row stands for, and say how many Parquet files these were.

    One call writes a Parquet file of chunks, so the ``write_id`` column alone tells which are dead: those
    whose id no row of ``files`` has. Younger ones than ``min_age_seconds`` may belong to a call that
    still runs and stay. Only names of dead files come to the driver, one partition at a time.
    """
    stored = read_if_present(spark, f"{path}/chunks")
    if stored is None:
        return 0
    live = read_if_present(spark, f"{path}/files")
    made = stored.select(
        WRITE_ID.name, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at")
    )
    old = made.where(F.unix_timestamp("at") <= F.unix_timestamp(F.current_timestamp()) - min_age_seconds).distinct()
    if live is not None:
        old = old.join(live.select(WRITE_ID.name).distinct(), WRITE_ID.name, "left_anti")
    removed = 0
    for row in old.select("file").distinct().toLocalIterator():
        delete(spark, unquote(row.file))
        removed += 1
    return removed


def read_blob_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The files and the chunks stored under ``path``."""
    return (
        spark.read.schema(T.StructType([*BLOB_FILE.fields, WRITE_ID])).parquet(f"{path}/files").drop(BUCKET),
        spark.read.schema(T.StructType([*BLOB_CHUNK.fields, WRITE_ID])).parquet(f"{path}/chunks"),
    )


def read_blobs(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blobs put together again: the file row, ``content`` and whether its md5 fits.

    Chunks belong to a file of the same id and, where both tables have it, ``write_id``.
    """
    told = WRITE_ID.name in files.columns and WRITE_ID.name in chunks.columns
    writer = chunks[WRITE_ID.name] if told else F.lit(None).cast("string")
    whole = chunks.groupBy("files_id", writer.alias("_writer")).agg(
        F.expr("listagg(data) within group (order by n)").alias("content")
    )
    same = F.col("_id") == F.col("files_id")
    if told:
        same &= F.col(WRITE_ID.name).eqNullSafe(F.col("_writer"))
    content = F.coalesce("content", F.lit("").cast("binary"))
    return (
        files.join(whole, same, "left")
        .select(*[c for c in files.columns if c != WRITE_ID.name], content.alias("content"))
        .withColumn("intact", F.md5("content") == F.col("md5"))
    )


def with_store_path(df: DataFrame, base: str, url: str = "book_file_url") -> DataFrame:
    """``book_file``: absolute base folder, host and content address of the URL."""
    return df.withColumn(
        "book_file", F.concat_ws("/", F.lit(posixpath.abspath(base)), url_key(F.col(url), "/"))
    )


def write_path_store(
    files: DataFrame, path: str, buckets: int = 64, splits: int | None = None
) -> None:
    """Files ``(url, filename, content)`` in folders of a fixed number of host buckets.

    A bucket is written by up to ``splits`` tasks, chosen by key: as many as the session has
    shuffle partitions, so that one big host spreads over all of them.
    """
    splits = splits or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = files.select(
        url_key(F.col("url")).alias("key"),
        "filename",
        "content",
        checksum(F.col("content")).alias("checksum"),
        F.pmod(F.xxhash64(netloc(F.col("url"))), F.lit(buckets)).alias("host_bucket"),
    )
    part = F.pmod(F.xxhash64("key"), F.lit(splits))
    (
        keyed.repartition("host_bucket", part)
        .sortWithinPartitions("host_bucket", "key")
        .write.mode("append")
        .partitionBy("host_bucket")
        .parquet(path)
    )

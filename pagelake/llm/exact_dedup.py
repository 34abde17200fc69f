"""Exact duplicates through an extendible-hash index kept in shared files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import folded
from pagelake.session import written

KEY_BITS = 60
MAX_DEPTH = 16
BUCKET_ENTRIES = 4096
SALTS = 32


def entries(docs: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """(doc_id, key, sha): an index entry for each document, without its text.

    sha is the SHA-256 of the normalised text, key its first ``key_bits`` bits.
    """
    hashed = docs.select(F.col("doc_id").cast("bigint"), F.sha2(folded(F.col("text")), 256).alias("sha"))
    whole = F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint")
    return hashed.select("doc_id", F.shiftright(whole, KEY_BITS - key_bits).alias("key"), "sha")


def directory(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(first slot, local depth) of each bucket, for key counts by slot at the full depth.

    Starts with one bucket. While a bucket holds more than ``capacity`` keys and can be
    split, it is split on its next bit; a split below the global depth reuses the directory, a
    split at it doubles the directory. ``counts`` has a power of two of slots, so this is
    bounded by that number whatever the size of the data.
    """
    full = (len(counts) - 1).bit_length()
    total = np.concatenate([[0], np.cumsum(counts)])
    global_depth, buckets, open_buckets = 0, [], [(0, 0)]
    while open_buckets:
        first, depth = open_buckets.pop()
        width = 1 << (full - depth)
        if total[first + width] - total[first] <= capacity or depth == full:
            buckets.append((first, depth))
            continue
        global_depth = max(global_depth, depth + 1)
        open_buckets += [(first + width // 2, depth + 1), (first, depth + 1)]
    return buckets


def index(docs: DataFrame, capacity: int = BUCKET_ENTRIES, key_bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """The two shared tables of the index: (doc_id, key, sha) entries and (bucket, key, sha,
    keep_id, group_size) pages.

    Copies are combined before the shuffle, so a page holds one line for each text however
    large its group. Counts of lines by the first ``MAX_DEPTH`` bits (a fixed number) settle
    the directory; bucket numbers follow the order of keys, so each bucket is a key range.
    """
    spark = docs.sparkSession
    listed = written(entries(docs, key_bits), "dedup_entries")
    lines = listed.groupBy("key", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    depth = min(MAX_DEPTH, key_bits)
    slot = F.shiftright("key", key_bits - depth)
    counts = np.zeros(1 << depth, np.int64)
    for row in lines.groupBy(slot.cast("int").alias("slot")).count().toLocalIterator():
        counts[row["slot"]] = row["count"]
    firsts = [first for first, _ in sorted(directory(counts, capacity))]
    owners = np.searchsorted(firsts, np.arange(len(counts)), side="right") - 1
    pointers = spark.createDataFrame(
        pa.table({"slot": pa.array(np.arange(len(counts), dtype=np.int32)), "bucket": pa.array(owners.astype(np.int32))})
    )
    pages = (
        lines.withColumn("slot", slot.cast("int"))
        .join(F.broadcast(pointers), "slot")  # at most 2 ** MAX_DEPTH rows of two ints
        .select("bucket", "key", "sha", "keep_id", "group_size")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key")
    )
    return listed, written(pages, "dedup_index")


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: follow each key's chain and compare the bytes of its texts."""
    key, chain = None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["key"] != key:
                key, chain = row["key"], []
            place = next((i for i, (text, _) in enumerate(chain) if text == row["text"]), len(chain))
            if place == len(chain):
                if any(sha == row["sha"] for _, sha in chain):
                    raise ValueError(f"different texts with the SHA-256 {row['sha']}")
                chain.append((row["text"], row["sha"]))
            out.append({"key": key, "sha": row["sha"], "chain": place, "keep_id": row["keep_id"], "group_size": row["group_size"]})
        yield pa.RecordBatch.from_pylist(out, schema=_CHAIN_SCHEMA)


_CHAIN_SCHEMA = pa.schema(
    [("key", pa.int64()), ("sha", pa.string()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
)


def chains(docs: DataFrame, pages: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """(key, sha, chain, keep_id, group_size) of all texts whose key more than one document has.

    Only those documents' texts are read again. A key is met in ``SALTS`` places, so the texts of
    a large group are spread over tasks and combined there before they meet; each bucket's owner task then walks its key range and compares the bytes of the texts
    that share a key. ``chain`` is the text's place in its key's chain: above 0 for different
    texts with one key.
    """
    crowded = pages.groupBy("bucket", "key").agg(F.sum("group_size").alias("n")).where("n > 1").select("bucket", "key")
    sha = F.sha2("text", 256)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), folded(F.col("text")).alias("text")).withColumn("sha", sha)
    whole = F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint")
    salted = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = (
        texts.withColumn("key", F.shiftright(whole, KEY_BITS - key_bits))
        .withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
        .join(salted, ["key", "salt"])
        .groupBy("bucket", "key", "sha", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    owned = found.repartition("bucket").sortWithinPartitions("bucket", "key", "sha")
    return owned.select("key", "sha", "text", "keep_id", "group_size").mapInArrow(
        _chains, "key bigint, sha string, chain int, keep_id bigint, group_size bigint"
    )


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_ENTRIES, key_bits: int = KEY_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Texts are equal if they are identical after lower-casing A-Z; null is empty. Of equal
    texts the row with the largest doc_id is kept. A null doc_id is less than any other; if
    all of a group are null, keep_id is null and all are kept, as are repeated rows of
    the doc_id that is kept.
    """
    listed, pages = index(docs, capacity, key_bits)
    groups = written(chains(docs, pages, key_bits), "dedup_chains").select("sha", F.col("keep_id").alias("last_id"), "group_size")
    return listed.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("last_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("last_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they are.

    The row with the largest doc_id stays; of several rows with that doc_id and text, any one.
    """
    gone = (
        exact_duplicates(docs)
        .where("not kept")
        .select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"))
        .distinct()
    )
    mark = "text_sha256_of_row"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.sha2(folded(F.col("text")), 256))
    same = marked["doc_id"].cast("bigint").eqNullSafe(gone["gone_id"]) & (marked[mark] == gone["gone_sha"])
    return marked.join(gone, same, "left_anti").dropDuplicates(["doc_id", mark]).drop(mark)

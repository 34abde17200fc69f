"""Zip archives in binary columns."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BYTES = 64 << 20

_MEMBERS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
_ARROW_MEMBERS = pa.schema(
    [("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())]
)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of every ``*.zip`` below ``folder``; ``*.ZIP`` is not one."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "content")
    )


def expand_archives(archives: DataFrame) -> DataFrame:
    """``(path, member, content, error)``: the files in each archive ``(path, content)``.

    Rows whose path does not end in ``.zip`` are left out. A broken archive is one row
    with ``error``.
    """
    named = archives.select("path", "content").where(F.col("path").endswith(".zip"))
    return named.mapInArrow(_expand, _MEMBERS)


def _expand(batches):
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            yield _member(path, info.filename, archive.read(info), None)
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, ValueError) as bad:
                yield _member(path, None, None, type(bad).__name__)


def _member(path, name, content, error):
    return pa.RecordBatch.from_pylist(
        [{"path": path, "member": name, "content": content, "error": error}], _ARROW_MEMBERS
    )


def bundle_by_key(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """A10: ``(host, key, part, archive)``: one zip per ``(host, key)`` of
    ``(host, key, path, content)``, members flattened to their base name.

    Of files that end up with one name the last by path counts. A key with more than
    ``part_bytes`` of content is cut into several zips by a hash of the path, each holding
    about that much, so that no key has to fit into one task; all others are part 0.
    """
    name = F.substring_index("path", "/", -1).alias("_name")
    size = F.octet_length("content").cast("bigint").alias("_size")
    # which file goes where is settled on names and sizes, before any content moves
    last = files.select("host", "key", name, "path", size).groupBy("host", "key", "_name").agg(
        F.max(F.struct("path", "_size")).alias("_last")
    )
    last = last.select("host", "key", "_name", "_last.path", "_last._size")
    parts = last.groupBy("host", "key").agg(
        F.ceil(F.greatest(F.sum("_size"), F.lit(1)) / part_bytes).alias("_parts")
    )
    place = last.join(parts, ["host", "key"]).select(
        "host", "key", "path", "_name", F.pmod(F.xxhash64("path"), "_parts").cast("int").alias("part")
    )
    placed = files.join(place, ["host", "key", "path"]).select(
        "host", "key", "part", "_name", "content"
    )
    schema = T.StructType(
        [
            files.schema["host"],
            files.schema["key"],
            T.StructField("part", T.IntegerType()),
            T.StructField("archive", T.BinaryType()),
        ]
    )
    return placed.groupBy("host", "key", "part").applyInArrow(_bundle, schema)


def _bundle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    buffer = io.BytesIO()
    ordered = table.sort_by("_name")
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in zip(ordered["_name"], ordered["content"]):
            # a fixed date makes the bytes of an archive reproducible
            archive.writestr(zipfile.ZipInfo(name.as_py()), content.as_py() or b"", zipfile.ZIP_DEFLATED)
    host, dir_key, part = (k.as_py() for k in key)
    return pa.table(
        {
            "host": pa.array([host], pa.string()),
            "key": pa.array([dir_key], pa.string()),
            "part": pa.array([part], pa.int32()),
            "archive": pa.array([buffer.getvalue()], pa.binary()),
        }
    )

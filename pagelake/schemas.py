"""Column types of the tables the library reads and writes."""

from pyspark.sql import types as T

DOWNLOAD = T.ArrayType(
    T.StructType(
        [
            T.StructField("url", T.ArrayType(T.StringType())),
            T.StructField("progress", T.StringType()),
            T.StructField("update_time", T.StringType()),
            T.StructField("source_site", T.ArrayType(T.StringType())),
        ]
    )
)

CAPTURE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("encoding", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("kind", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("dont_filter", T.BooleanType()),
        T.StructField("depth", T.IntegerType()),
    ]
)

ITEM = T.StructType(
    [
        T.StructField("book_name", T.StringType()),
        T.StructField("alias_name", T.ArrayType(T.StringType())),
        T.StructField("author", T.ArrayType(T.StringType())),
        T.StructField("book_description", T.StringType()),
        T.StructField("book_covor_image_path", T.StringType()),
        T.StructField("book_covor_image_url", T.StringType()),
        T.StructField("book_download", DOWNLOAD),
        T.StructField("book_file_url", T.StringType()),
        T.StructField("book_file", T.StringType()),
        T.StructField("book_file_id", T.StringType()),
        T.StructField("original_url", T.StringType()),
    ]
)

MEDIA_RESULT = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

STAT_OP = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("spider", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start", T.LongType()),
    ]
)

BLOB_FILE = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("chunk_size", T.IntegerType()),
        T.StructField("upload_date", T.TimestampType()),
        T.StructField("md5", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
    ]
)

BLOB_CHUNK = T.StructType(
    [
        T.StructField("files_id", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)

"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "pagelake") -> SparkSession:
    """Session for tests and bench runs on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; on one machine else the warehouse folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The stored table at ``path``, a file or a folder of files, as a stream.

    The source wants a folder or a pattern; a pattern of one name stands for either, and leaves
    what lies beside it alone.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{{{name}}}")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/pagelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` stored as a table in the shared folder, one folder per value of ``by``, and read back.

    Cuts the lineage for iterative jobs; the data survives the loss of executors, and the
    file sizes give the optimizer true statistics for the next join.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    delete(table.sparkSession, table.stored_at)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    files, place = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

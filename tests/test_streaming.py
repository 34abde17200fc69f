"""A stream ends in the state its batch has."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagelake.operators.frontier import dedup_batch, with_fingerprint
from pagelake.operators.stats import fold_ops, merge_spiders
from pagelake.schemas import CAPTURE, REQUEST
from pagelake.plans import catalog
from pagelake.session import names_in
from pagelake.sources.captures import read_captures
from pagelake.sources.metric_lines import metric_lines
from pagelake.streaming.dedup import dedup_stream
from pagelake.streaming.load import load_stream
from pagelake.streaming.stats import latest_stats, push_batch, running_stats, stats_stream, windowed_stats

T0 = dt.datetime(2024, 1, 1)


def drained(stream, folder):
    query = (
        stream.writeStream.option("checkpointLocation", folder + "/state")
        .format("parquet").trigger(availableNow=True).start(folder + "/out")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder + "/out")


def test_dedup_over_two_runs(spark, folder):
    rng = random.Random(8)
    rows = [(i, f"http://h/{rng.randint(0, 30)}?b=1&a={i % 2}", "GET", None, "list", 0, False, 0) for i in range(300)]
    df = spark.createDataFrame(rows, REQUEST)
    wanted = {r.fp for r in dedup_batch(with_fingerprint(df)).collect()}
    df.where("seq < 100").repartition(3).write.parquet(folder + "/in")
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    drained(dedup_stream(source).select("fp"), folder)
    # the checkpoint carries the state over a restart
    df.where("seq >= 100").repartition(3).write.mode("append").parquet(folder + "/in")
    got = [r.fp for r in drained(dedup_stream(source).select("fp"), folder).collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_dedup_with_watermark(spark, folder):
    rows = [(i, f"http://h/{i % 5}", T0 + dt.timedelta(seconds=i)) for i in range(50)]
    spark.createDataFrame(rows, "seq bigint, url string, ts timestamp").write.parquet(folder + "/in")
    source = spark.readStream.schema("seq bigint, url string, ts timestamp").parquet(folder + "/in")
    assert drained(dedup_stream(source, "ts", "1 hour").select("fp"), folder).count() == 5


def ops(n=400):
    rng = random.Random(12)
    return [(i, T0 + dt.timedelta(seconds=i), rng.choice("abc"), rng.randint(0, 99)) for i in range(n)]


OPS = "seq bigint, ts timestamp, key string, value bigint"


def test_stats_stream_equals_batch(spark, folder):
    df = spark.createDataFrame(ops(), OPS)
    df.repartitionByRange(4, "seq").write.parquet(folder + "/in")
    source = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    stats_stream(source, folder + "/out", folder + "/state", availableNow=True).awaitTermination()
    columns = ["key", "inc_value", "max_value", "min_value", "set_value"]
    got = sorted(map(tuple, latest_stats(spark, folder + "/out").select(columns).collect()))
    assert got == sorted(map(tuple, running_stats(df).select(columns).collect()))
    lines = spark.read.option("lineSep", "\n\n").text(folder + "/out/lines")
    assert lines.count() == 4 * 3 and lines.where("value like 'scrapy.a %'").count() == 4


def test_streamed_lines_follow_the_kind(spark, folder):
    kinds = ["inc", "max", "min", "set"]
    rows = [(i, T0, kinds[i % 4], kinds[i % 4], (i * 37) % 100, 5) for i in range(100)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, key string, op string, value bigint, start bigint")
    df.repartitionByRange(3, "seq").write.parquet(folder + "/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    stats_stream(source, folder + "/out", folder + "/state", availableNow=True).awaitTermination()
    values = {k: [r[4] for r in rows if r[2] == k] for k in kinds}
    wanted = {"inc": 5 + sum(values["inc"]), "max": max(values["max"]), "min": min(values["min"]), "set": values["set"][-1]}
    assert {r.key: r.value for r in latest_stats(spark, folder + "/out").collect()} == wanted
    lines = {r.value for r in spark.read.option("lineSep", "\n\n").text(folder + "/out/lines").collect()}
    assert {f"scrapy.{k} {v} 1704067200" for k, v in wanted.items()} <= lines


MIXED = "seq bigint, ts timestamp, spider string, key string, op string, value bigint, start bigint"


def mixed_ops(n=300):
    rng = random.Random(21)
    kinds = ["inc", "max", "min", "set"]
    return [
        (i, T0 + dt.timedelta(seconds=i), rng.choice(["s1", "s2", None]), rng.choice("abcde"), rng.choice(kinds), rng.randint(-50, 50), rng.randint(0, 9))
        for i in range(n)
    ]


def test_streamed_values_of_mixed_kinds(spark, folder):
    """Lines per operation are those of the batch operator; the state is one table of a few versions."""
    df = spark.createDataFrame(mixed_ops(160), MIXED)
    for i in range(4):  # one after another, so that they arrive in order
        df.where(f"seq div 40 = {i}").coalesce(1).write.mode("append").parquet(folder + "/in")
    source = spark.readStream.schema(MIXED).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    stats_stream(source, folder + "/out", folder + "/state", lines="operations", compact_every=2, availableNow=True).awaitTermination()
    got = {r.key: r.value for r in latest_stats(spark, folder + "/out", 2).collect()}
    assert got == {r.key: r.value for r in fold_ops(df).collect()}
    wanted = sorted(r.line for r in metric_lines(merge_spiders(df)).collect())
    lines = spark.read.option("lineSep", "\n\n").text(folder + "/out/lines").select("value")
    assert sorted(r.value for r in lines.collect()) == wanted
    kept = {r.batch for r in spark.read.parquet(folder + "/out/state").select("batch").distinct().collect()}
    assert kept == {2, 3}


def test_a_batch_that_runs_again(spark, folder):
    df = spark.createDataFrame([*mixed_ops(90), (90, T0, "s1", "f", "inc", None, 1), (91, T0, "s1", "a", "inc", None, 1)], MIXED)
    for number in range(4):
        part = df.where(f"seq div 23 = {number}")
        push_batch(part, number, folder, compact_every=2)
        first = sorted(map(tuple, latest_stats(spark, folder, 2).collect()), key=str)
        push_batch(part, number, folder, compact_every=2)  # as after a failure before it was known to be complete
        assert sorted(map(tuple, latest_stats(spark, folder, 2).collect()), key=str) == first
    wanted = {r.key: r.value for r in fold_ops(df.where("value is not null")).collect()}
    assert {r.key: r.value for r in latest_stats(spark, folder, 2).collect()} == wanted | {"f": None}
    assert sorted(n for n in names_in(spark, folder + "/state")) == ["batch=2", "batch=3"]
    push_batch(df.limit(0), 4, folder, compact_every=2)
    assert {r.key: r.value for r in latest_stats(spark, folder, 2).collect()} == wanted | {"f": None}


def test_closed_windows_equal_batch(spark, folder):
    df = spark.createDataFrame(ops(), OPS)
    df.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(folder + "/in")
    source = spark.readStream.schema(OPS).parquet(folder + "/in")
    got = drained(windowed_stats(source, "10 seconds", "1 minute"), folder)
    wanted = windowed_stats(df, "10 seconds", "1 minute").where(F.col("window.end") <= F.lit(T0 + dt.timedelta(seconds=389)))
    key = lambda d: sorted((r.window.start, r.key, r.inc_value, r.set_value) for r in d.collect())
    assert key(got) == key(wanted) and got.count() > 10


def test_load_stream(spark, folder):
    schema = "seq bigint, book_name string, author array<string>, original_url string"
    rows = [(i, f"n{i % 7}", [f"a{i % 2}"], f"u{i}") for i in range(40)]
    spark.createDataFrame(rows, schema).repartitionByRange(3, "seq").write.parquet(folder + "/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    load_stream(source, folder + "/t", folder + "/state", availableNow=True).awaitTermination()
    stored = spark.read.parquet(folder + "/t")
    assert stored.count() == stored.select("book_name", F.col("author")[0]).distinct().count() == 14


def test_captures_stream(spark, folder):
    spark.createDataFrame([("http://h/a", 200, {}, "utf-8", b"x", [], T0)], CAPTURE).write.parquet(folder + "/in")
    stream = read_captures(spark, folder + "/in", streaming=True)
    assert stream.isStreaming and drained(stream.select("url", "status"), folder).count() == 1


def _rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _tables(spark, folder):
    """Pages and documents, each as one file and as a folder of files, beside another table."""
    tables = {
        "pages": [(i, f"http://h/{i}", f"<p>{i}") for i in range(6)],
        "documents": [(i, f"text {i % 4}", "en", "src1") for i in range(6)],
    }
    names = {"pages": ["page_id", "url", "html"], "documents": ["doc_id", "text", "lang", "source"]}
    for table, rows in tables.items():
        df = spark.createDataFrame(rows, names[table])
        df.repartitionByRange(3, names[table][0]).write.parquet(f"{folder}/parts/{table}.parquet")
        df.toPandas().to_parquet(f"{folder}/{table}.parquet")


def test_captures_stream_reads_files_and_folders(spark, folder):
    _tables(spark, folder)
    queries = catalog.queries()
    for place in (folder, folder + "/parts"):
        got = _rows_of(queries["captures_stream"](spark, place))
        assert got == _rows_of(queries["captures"](spark, place)) and len(got) == 6


def test_load_stream_reads_files_and_folders(spark, folder):
    _tables(spark, folder)
    for place in (folder, folder + "/parts"):
        got = catalog.queries()["load_stream"](spark, place)
        assert sorted(r.original_url for r in got.collect()) == [f"http://d.example.org/{i}" for i in range(4)]

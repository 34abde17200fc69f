"""Shaping, unique load and stores."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelake.operators import records as rc
from pagelake.plans.load import dropped_rows, kept_rows, run_stages, status_counts, store_stages, success_report
from pagelake.schemas import ITEM
from pagelake.sources import blobs as bl
from pagelake.sources.archives import bundle_by_key, expand_archives, read_archives
from pagelake.sources.book_tables import stored_names, write_book_detail, write_book_detail_sharded
from pagelake.sources.captures import captures_from_pages, read_captures, seeds


def test_defaults(spark):
    empty = spark.createDataFrame([{}], ITEM)
    row = rc.fill_defaults(empty, "sharded").first()
    assert row.book_name is None and row.author == [] and row.alias_name == [] and row.book_download == []
    assert {row[c] for c in row.__fields__ if isinstance(row[c], str)} == {""}
    assert "book_file_id" in row and "book_file" not in row.__fields__
    bare = rc.fill_defaults(spark.createDataFrame([("u",)], "original_url string"), "single").first()
    assert bare.book_file == "" and bare.original_url == "u" and "book_file_id" not in bare.__fields__


def test_drop_none(spark):
    rows = [("a", None, None), ("b", "", [{"url": ["x"]}]), ("c", "f", None)]
    df = spark.createDataFrame(
        rows, "original_url string, book_file_url string, book_download array<struct<url:array<string>>>"
    )
    kept, dropped = rc.drop_none(df)
    assert [r.original_url for r in kept.collect()] == ["c"]
    assert sorted(map(tuple, dropped.collect())) == [("a", "no-candidates"), ("b", "all-failed")]


def one_by_one(rows, stored=()):
    taken, accepted = set(stored), []
    for seq, name, authors in sorted(rows):
        pairs = {(name, a) for a in (authors or [None])}
        if not pairs & taken:
            taken |= pairs
            accepted.append(seq)
    return accepted, taken


def books(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, book_name string, author array<string>")


def accepted(df):
    return sorted(r.seq for r in df.collect())


def test_refused_records_block_nobody(spark):
    rows = [(1, "n", ["x", "y"]), (2, "n", ["y", "z"]), (3, "n", ["z"]), (4, "n", []), (5, "n", None), (6, None, ["x"]), (7, None, ["x"])]
    ok, refused = rc.insert_unique(books(spark, rows))
    assert accepted(ok) == [1, 3, 4, 6] and accepted(refused) == [2, 5, 7]


def test_unique_load_equals_one_by_one(spark):
    rng = random.Random(4)

    def some(start, n):
        return [
            (start + i, rng.choice(["n", "m", None]), rng.choice([None, [], rng.choices("abcdefghijklm", k=rng.randint(1, 3))]))
            for i in range(n)
        ]

    old = some(0, 6)
    rng.shuffle(old)
    first, taken = one_by_one(old)
    new = some(100, 60)
    rng.shuffle(new)
    wanted, _ = one_by_one(new, taken)
    stored = books(spark, [r for r in old if r[0] in first])
    ok, refused = rc.insert_unique(books(spark, new).repartition(5), stored)
    assert accepted(ok) == wanted
    assert accepted(refused) == sorted({r[0] for r in new} - set(wanted))


def test_a_chain_of_shared_authors(spark):
    rows = [(i, "n", [str(i), str(i + 1)]) for i in range(9)]
    assert accepted(rc.insert_unique(books(spark, rows))[0]) == [0, 2, 4, 6, 8]


def test_lookup_and_index(spark):
    df = spark.createDataFrame(
        [(1, "n", ["a", "b"], ["x"]), (2, "n", ["b"], []), (3, "m", ["a", "a"], ["x"])],
        "record_id int, book_name string, author array<string>, alias_name array<string>",
    )
    ids = lambda d: sorted(r.record_id for r in d.collect())
    assert ids(rc.lookup(df, book_name="n", author="a")) == [1]
    assert ids(rc.lookup(df, alias_name="x")) == [1, 3]
    assert sorted(map(tuple, rc.inverted_index(df, "author").collect())) == [("a", 1), ("a", 3), ("b", 1), ("b", 2)]
    assert sorted(map(tuple, rc.inverted_index(df, "book_name").collect())) == [("m", 3), ("n", 1), ("n", 2)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_load_reads_only_the_buckets_of_its_names(spark, folder):
    path = folder + "/t"
    many = spark.range(400).selectExpr("id as seq", "concat('name', id % 200) as book_name", "array(concat('a', id)) as author", "concat('u', id) as original_url")
    write_book_detail(many, path)
    batch = spark.createDataFrame([(900, "name7", ["a7"], "u900"), (901, "name7", ["new"], "u901")], many.schema)
    stored = stored_names(spark, path, batch)
    assert "PartitionFilters: [" in plan_of(stored) and "name_bucket" in plan_of(stored).split("PartitionFilters: [")[1].split("]")[0]
    read = {r[0] for r in stored.select("name_bucket").distinct().collect()}
    assert len(read) == 1 and stored.count() < 40  # one folder of 64
    assert accepted(write_book_detail(batch, path)) == [900]
    assert spark.read.parquet(path).count() == 401


def test_a_sweep_leaves_only_live_chunks(spark, folder):
    def blobs(*keys):
        rows = [(i, k, "a.txt", bytearray(k.encode() * 5)) for i, k in enumerate(keys)]
        return spark.createDataFrame(rows, "seq int, key string, filename string, content binary")

    bl.write_blobs(blobs("k1", "k2", "empty"), folder, 4)
    lost = bl.blob_chunks(blobs("k3"), 4).withColumn("write_id", F.lit("ended early"))
    lost.write.mode("append").parquet(folder + "/chunks")
    before = spark.read.parquet(folder + "/chunks").count()
    assert bl.sweep_blobs(spark, folder) == 0  # too young: the call may still run
    assert bl.sweep_blobs(spark, folder, min_age_seconds=0) == 1
    spark.catalog.refreshByPath(folder + "/chunks")
    assert spark.read.parquet(folder + "/chunks").count() == before - lost.count()
    bl.write_blobs(blobs("k3", "k1"), folder, 4)
    assert bl.sweep_blobs(spark, folder, min_age_seconds=0) == 0
    back = bl.read_blobs(*bl.read_blob_tables(spark, folder)).collect()
    assert sorted((r._id, bytes(r.content), r.intact) for r in back) == sorted((k, k.encode() * 5, True) for k in ("k1", "k2", "k3", "empty"))
    few = bl.stored_files(spark, folder, blobs("k2"))
    assert "id_bucket" in plan_of(few).split("PartitionFilters: [")[1].split("]")[0]
    assert bl.sweep_blobs(spark, folder + "/nothing") == 0


def test_book_table_refuses_known_books(spark, folder):
    df = books(spark, [(1, "n", ["a"]), (2, "n", ["a"]), (3, "m", [])]).withColumn("original_url", F.concat(F.lit("u"), "seq"))
    refused = write_book_detail(df, folder + "/t")
    assert accepted(refused) == [2]
    more = df.withColumn("seq", F.col("seq") + 10).unionByName(books(spark, [(20, "new", ["a"])]).withColumn("original_url", F.lit("u20")))
    write_book_detail(more, folder + "/t")
    rows = spark.read.parquet(folder + "/t").collect()
    assert sorted(r.original_url for r in rows) == ["u1", "u20", "u3"]
    assert all(len(r.record_id) == 40 and r.update_time for r in rows)


def test_shards_are_disjoint_ranges_also_for_one_time(spark, folder):
    df = spark.createDataFrame([("n", f"u{i}") for i in range(300)], "book_name string, original_url string")
    write_book_detail_sharded(df, folder + "/s", shards=3, now=F.lit(dt.datetime(2024, 1, 1)))
    files = spark.read.parquet(folder + "/s").groupBy(F.input_file_name()).agg(
        F.min("record_id").alias("lo"), F.max("record_id").alias("hi"), F.count("*").alias("n")
    ).orderBy("lo").collect()
    assert len(files) == 3 and sum(f.n for f in files) == 300 and max(f.n for f in files) < 200
    assert all(a.hi < b.lo for a, b in zip(files, files[1:]))


def test_blobs_round_trip(spark, folder):
    rng = random.Random(1)
    contents = {f"k{i}": rng.randbytes(n) for i, n in enumerate([0, 1, 10, 11, 640, 999])}
    rows = [(i, k, "a.TAR", c) for i, (k, c) in enumerate(contents.items())] + [(99, "k1", "late.txt", b"late")]
    df = spark.createDataFrame(rows, "seq bigint, key string, filename string, content binary")
    bl.write_blobs(df, folder, chunk_bytes=10)
    bl.write_blobs(df.withColumn("content", F.lit(b"again")), folder, chunk_bytes=10)
    files, chunks = bl.read_blob_tables(spark, folder)
    back = bl.read_blobs(files, chunks).collect()
    assert {r._id: bytes(r.content) for r in back} == contents
    assert all(r.intact and r.content_type == "tar" for r in back)
    assert chunks.where("files_id = 'k3'").count() == 2 and chunks.where("files_id = 'k0'").count() == 0


def test_broken_blobs_show(spark, folder):
    df = spark.createDataFrame([(0, "k", "a.txt", b"0123456789ab")], "seq bigint, key string, filename string, content binary")
    bl.write_blobs(df, folder, chunk_bytes=5)
    files, chunks = bl.read_blob_tables(spark, folder)
    assert not bl.read_blobs(files, chunks.where("n <> 1")).first().intact


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in members.items():
            archive.writestr(name.replace("__", "/"), content)
    return buffer.getvalue()


def test_archives(spark, folder):
    rows = [("/a/x.zip", zipped(d__one=b"1", d__e__two=b"2")), ("/a/bad.zip", b"no zip"), ("/a/Y.ZIP", zipped(z=b"z")), ("/a/n.zip", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = sorted(tuple(r) for r in expand_archives(df).collect())
    assert got[:2] == [("/a/bad.zip", None, None, "BadZipFile"), ("/a/n.zip", None, None, "BadZipFile")]
    assert [(p, m, bytes(c), e) for p, m, c, e in got[2:]] == [("/a/x.zip", "d/e/two", b"2", None), ("/a/x.zip", "d/one", b"1", None)]
    import os

    os.makedirs(folder + "/in/sub")
    for name in ("in/a.zip", "in/sub/b.zip", "in/c.ZIP"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(zipped(m=b"m"))
    found = expand_archives(read_archives(spark, folder + "/in")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.zip", "b.zip"]


def test_bundles_flatten_and_keep_the_last_of_a_name(spark):
    rows = [("h", "k", "/h/k/a/n.txt", b"first"), ("h", "k", "/h/k/b/n.txt", b"last"), ("h", "k", "/h/k/m.txt", b"m"), ("h", "j", "/h/j/n.txt", b"j")]
    df = spark.createDataFrame(rows, "host string, key string, path string, content binary")
    zips = bundle_by_key(df)
    assert zips.where("part <> 0").count() == 0 and zips.count() == 2
    named = zips.select(F.concat("key", F.lit(".zip")).alias("path"), F.col("archive").alias("content"))
    got = sorted((r.path, r.member, bytes(r.content)) for r in expand_archives(named).collect())
    assert got == [("j.zip", "n.txt", b"j"), ("k.zip", "m.txt", b"m"), ("k.zip", "n.txt", b"last")]


def test_a_big_key_becomes_several_bundles(spark):
    df = spark.range(200).select(
        F.lit("h").alias("host"), F.lit("k").alias("key"), F.concat(F.lit("/f"), "id").alias("path"), F.lit(b"x" * 100).alias("content")
    )
    zips = bundle_by_key(df, part_bytes=2000)
    assert zips.count() == 10
    named = zips.select(F.lit("k.zip").alias("path"), F.col("archive").alias("content"))
    assert expand_archives(named).select("member").distinct().count() == 200


def test_path_store_and_captures(spark, folder):
    pages = spark.createDataFrame([("http://h/a", "<p>ü</p>"), ("http://h/b", "x")], "url string, html string")
    captures = captures_from_pages(pages)
    captures.write.parquet(folder + "/captures")
    back = read_captures(spark, folder + "/captures")
    assert sorted(bytes(r.body).decode() for r in back.collect()) == ["<p>ü</p>", "x"]
    bl.write_path_store(pages.select("url", F.lit("f").alias("filename"), F.col("html").cast("binary").alias("content")), folder + "/store")
    stored = spark.read.parquet(folder + "/store")
    assert stored.count() == 2 and all(r.key.startswith("h/") for r in stored.collect())
    path = bl.with_store_path(spark.createDataFrame([("http://h/a",)], "book_file_url string"), "/srv/x/../y")
    assert path.first().book_file.startswith("/srv/y/h/")


def test_seeds(spark):
    row = seeds(spark, ["http://h/1"]).first()
    assert (row.url, row.dont_filter, row.priority, row.depth) == ("http://h/1", True, 0, 0)


def test_stages_and_report(spark, folder):
    df = spark.createDataFrame([(f"u{i}", i) for i in range(6)], "original_url string, n int")

    def at_least(limit):
        return lambda items: items.withColumn("reason", F.when(F.col("n") < limit, F.lit(f"below {limit}")))

    stages = [("one", at_least(2)), ("none", lambda d: d.withColumn("n", F.col("n") + 0)), ("two", at_least(4)), ("again", at_least(3))]
    staged = run_stages(df, stages)
    assert sorted(r.original_url for r in kept_rows(staged).collect()) == ["u4", "u5"]
    assert kept_rows(staged).columns == df.columns
    wanted = [("u0", "one"), ("u1", "one"), ("u2", "two"), ("u3", "two")]
    assert sorted((r.original_url, r.stage) for r in dropped_rows(staged).collect()) == wanted
    counts = {r.status: r.n for r in status_counts(success_report(staged)).collect()}
    assert counts == {"SUCCESS": 2, "below 2": 2, "below 4": 2}
    stored, seen = store_stages(staged, folder + "/staged", stages)
    assert seen == {"kept": 2, "one": 2, "none": 0, "two": 2, "again": 0}
    assert {(r.original_url, r.outcome) for r in stored.collect()} == {*wanted, ("u4", "kept"), ("u5", "kept")}
    empty, none = store_stages(run_stages(df.limit(0), stages), folder + "/empty", stages)
    assert set(none.values()) == {0}
    with pytest.raises(ValueError):
        store_stages(staged, folder + "/again", [("kept", stages[0][1])])

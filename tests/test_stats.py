"""Counters, points and history; against a sequential model."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagelake.operators import stats as st
from pagelake.operators.rollup import rollup
from pagelake.schemas import STAT_OP
from pagelake.sources.metric_lines import metric_lines, write_metric_lines

T0 = dt.datetime(2024, 1, 1)


def ops(spark, rows):
    """Rows of (seq, key, op, value[, start[, spider]])."""
    full = []
    for seq, key, op, value, *rest in rows:
        start, spider = (rest + [None, None])[:2]
        full.append((1, seq, T0 + dt.timedelta(seconds=seq), spider, key, op, str(value), start))
    return spark.createDataFrame(full, STAT_OP)


def sequential(rows, prior=None):
    state = dict(prior or {})
    for seq, key, op, value, *rest in sorted(rows):
        start = rest[0] if rest and rest[0] is not None else 0
        if op == "set":
            state[key] = value
        elif op == "inc":
            state[key] = state.get(key, start) + value
        else:
            state[key] = (max if op == "max" else min)(state.get(key, value), value)
    return state


def table(df):
    return {r.key: r.value for r in df.collect()}


def prior_table(spark, prior):
    return spark.createDataFrame(list(prior.items()), "key string, value bigint")


def test_folds_equal_the_sequential_model(spark):
    rng = random.Random(9)
    rows = [
        (i, "hot" if rng.random() < 0.5 else rng.choice("abc"), rng.choice(["inc", "max", "min", "set"]), rng.randint(-20, 20), rng.choice([None, 3]))
        for i in rng.sample(range(5000), 700)
    ]
    prior = {"hot": 7, "other": 1}
    df = ops(spark, rows)
    for width in (4, 64, 4096):
        assert table(st.fold_ops(df, width=width)) == sequential(rows)
        assert table(st.fold_ops(df.repartition(7), prior_table(spark, prior), width=width)) == sequential(rows, prior)


def test_single_operations(spark):
    df = ops(spark, [(1, "a", "x", 5), (2, "a", "x", 3), (3, "b", "x", 1)]).withColumn("value", F.col("value").cast("bigint"))
    prior = prior_table(spark, {"a": 4, "z": 9})
    assert table(st.inc(df, prior)) == {"a": 12, "b": 1, "z": 9}
    assert table(st.inc(df, start=F.lit(100))) == {"a": 108, "b": 101}
    assert table(st.max_value(df, prior)) == {"a": 5, "b": 1, "z": 9}
    assert table(st.min_value(df, prior)) == {"a": 3, "b": 1, "z": 9}
    assert table(st.set_value(df, prior)) == {"a": 3, "b": 1, "z": 9}
    updates = spark.createDataFrame([(1, {"a": 1, "n": 2}), (2, {"a": 8})], "seq bigint, stats map<string,bigint>")
    assert table(st.set_stats(prior, updates)) == {"a": 8, "n": 2, "z": 9}


def test_get_and_clear(spark):
    stats = spark.createDataFrame([("a", "5"), ("b", "text")], "key string, value string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert table(st.get_value(stats, asked, 0)) == {"a": 5, "b": 0, "c": 0}
    assert [r.key for r in st.get_stats(stats).collect()] == ["a", "b"]
    df = ops(spark, [(1, "a", "inc", 1), (2, "a", "inc", 1)]).withColumn("epoch", F.col("seq").cast("int"))
    assert table(st.fold_ops(st.clear_stats(df, 2))) == {"a": 1}


def test_points_sent(spark):
    df = ops(spark, [(1, "k", "set", 5), (2, "k", "set", "word"), (3, "hid", "set", 1), (4, "hid", "inc", 1, None, "w")])
    got = sorted((r.seq, r.name) for r in st.metric_points(df, ignore=["hid"]).collect())
    assert got == [(1, "scrapy.k"), (4, "scrapy.spider.w.hid")]


def test_spiders_share_one_value(spark):
    rng = random.Random(6)
    kinds = {"c": "inc", "hi": "max", "lo": "min"}
    rows = []
    for i in range(300):
        key = rng.choice(list(kinds))
        rows.append((i, key, kinds[key], rng.randint(-9, 9), 50, rng.choice([None, "s1", "s2"])))
    wanted = {r[0]: sequential(rows[: r[0] + 1])[r[1]] for r in rows}
    got = st.merge_spiders(ops(spark, rows).repartition(5), width=16).collect()
    assert {r.seq: r.value for r in got} == wanted
    assert {r.name for r in got if r.key == "c"} == {"scrapy.c", "scrapy.spider.s1.c", "scrapy.spider.s2.c"}


def test_spiders_mix_kinds_on_a_key(spark):
    rng = random.Random(16)
    kinds = ["inc", "max", "min", "set"]
    rows = [(i * 3, rng.choice(["hot", "hot", "b", None]), rng.choice(kinds), rng.randint(-20, 20), rng.choice([None, 3])) for i in range(400)]
    state, wanted = {}, {}
    for row in rows:
        state = sequential([row], state)
        wanted[row[0]] = state[row[1]]
    df = ops(spark, rows).repartition(3)
    for width, levels in ((4, 6), (16, 2), (1024, 4)):
        assert {r.seq: r.value for r in st.merge_spiders(df, width, levels).collect()} == wanted
    probe = ops(spark, [(1, "k", "inc", 5), (2, "k", "max", 100), (3, "k", "inc", 1)])
    assert [r.value for r in st.merge_spiders(probe).orderBy("seq").collect()] == [5, 100, 101]
    assert st.merge_spiders(probe.limit(0)).count() == 0


def test_scheduler_counts(spark):
    log = spark.createDataFrame([("enqueued",), ("enqueued",), ("dequeued",)], "kind string")
    assert table(st.scheduler_counts(log)) == {"scheduler/enqueued/redis": 2, "scheduler/dequeued/redis": 1}


def test_rollup(spark):
    def point(name, second, value, seq):
        return (name, value, T0 + dt.timedelta(seconds=second), seq)

    rows = [point("a_max", i * 10, i, i) for i in range(10)] + [point("a_max", 95, 3, 100)]
    rows += [point("a_min", 0, 4, 1), point("a_min", 5, 2, 2)]
    rows += [point("a_count", i * 10, 5, i) for i in range(9)] + [point("plain", i * 10, i, i) for i in range(49)]
    rows += [point("plain2", i * 10, i, i) for i in range(50)] + [point("b_count", i * 10, 5, i) for i in range(10)]
    df = spark.createDataFrame(rows, "name string, value bigint, ts timestamp, seq bigint")
    got = {r.name: r.value for r in rollup(df, step=10, width=1000).collect()}
    # 10 of 100 slots are enough for a rule, 9 are not; without a rule 50 are needed
    assert got["a_max"] == 8 and got["a_count"] is None and got["b_count"] == 50
    assert got["plain"] is None and got["plain2"] == 24.5
    assert {r.name: r.value for r in rollup(df, step=10, width=20).where("name = 'a_min'").collect()} == {"a_min": 2.0}


def test_lines(spark, folder):
    df = spark.createDataFrame([("a.b", 1234567.0, T0), ("c", 3.0, T0)], "name string, value double, ts timestamp")
    assert [r.line for r in metric_lines(df).collect()] == ["a.b 1.23457e+06 1704067200", "c 3 1704067200"]
    write_metric_lines(df.coalesce(1), folder + "/lines")
    (path,) = __import__("glob").glob(folder + "/lines/part-*")
    assert open(path).read() == "a.b 1.23457e+06 1704067200\n\nc 3 1704067200\n\n"
    now = metric_lines(df.withColumn("ts", F.lit(None).cast("timestamp"))).first().line
    assert int(now.split()[2]) > 1704067200

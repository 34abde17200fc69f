"""Requests: dedup, order, batches, reach; against sequential models."""

import random

from pyspark.sql import functions as F

from pagelake.operators import frontier as fr
from pagelake.operators.ordered import rank_in_key, running
from pagelake.operators.reach import crawl_reach
from pagelake.schemas import REQUEST


def reqs(spark, *rows):
    """Rows of (seq, url, priority, dont_filter)."""
    full = [(s, u, "GET", None, "list", p, d, 0) for s, u, p, d in rows]
    return fr.with_fingerprint(spark.createDataFrame(full, REQUEST))


def seqs(df):
    return [r.seq for r in df.collect()]


def test_first_arrival_wins(spark):
    df = reqs(spark, (3, "http://h/a?x=1&y=2", 0, False), (1, "http://h/a?y=2&x=1#f", 0, False), (2, "http://h/b", 0, False))
    assert sorted(seqs(fr.dedup_batch(df))) == [1, 2]
    assert sorted(seqs(fr.dedup_batch(df.repartition(7)))) == [1, 2]


def test_enqueue(spark):
    df = reqs(
        spark,
        (1, "http://h/a", 0, True), (2, "http://h/a", 0, False), (3, "http://h/a", 0, False),
        (4, "http://h/old", 0, False), (5, "http://h/old", 0, True),
    )
    seen = reqs(spark, (0, "http://h/old", 0, False)).select("fp")
    accepted, new = fr.enqueue(df, seen)
    assert sorted(seqs(accepted)) == [1, 2, 5]
    assert new.count() == 1
    again, none = fr.enqueue(df, seen.unionByName(new))
    assert sorted(seqs(again)) == [1, 5] and none.count() == 0


def test_priority_order(spark):
    df = reqs(
        spark,
        (1, "http://h/b", 0, False), (2, "http://h/a", 0, False), (3, "http://h/a", 5, False), (4, "http://h/a", 0, False)
    ).drop("fp")
    assert seqs(fr.order_priority(df)) == [3, 2, 1]
    assert seqs(fr.order_fifo(df)) == [1, 2, 3, 4]
    assert seqs(fr.order_lifo(df)) == [4, 3, 2, 1]


def test_next_batch_caps(spark):
    rows = [(i, f"http://big/{i:02d}", 9, False) for i in range(12)]
    rows += [(100 + i, f"http://h{i}/", 0, False) for i in range(10)]
    batch = fr.next_batch(reqs(spark, *rows)).collect()
    assert len(batch) == 16
    assert [r.seq for r in batch if r.host == "big"] == list(range(8))


def test_slots_follow_priority_then_arrival(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{'hot' if rng.random() < 0.7 else rng.choice('abc')}/", rng.randint(0, 3), False) for i in range(400)]
    rng.shuffle(rows)
    df = reqs(spark, *rows).withColumn("host", F.regexp_extract("url", "//(.*)/", 1))
    wanted = {}
    for host in {r[1] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[1] == host), key=lambda r: (-r[2], r[0]))):
            wanted[r[0]] = place
    assert {r.seq: r.slot for r in fr.politeness_slots(df).collect()} == wanted
    small = rank_in_key(df, ["host"], "seq", "rank", lead=[("priority", True)], width=16)
    assert {r.seq: r["rank"] - 1 for r in small.collect()} == wanted


def test_running_values_with_null_keys(spark):
    rng = random.Random(5)
    # dense and sparse sequence numbers
    numbers = [*range(400), *rng.sample(range(2**40, 2**62), 100)]
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice([None, *range(-9, 9)])) for i in numbers]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq bigint, k string, v bigint")
    value = F.col("v")
    got = running(df, ["k"], "seq", {"s": ("sum", value), "lo": ("min", value), "hi": ("max", value)}, width=32)
    state, wanted = {}, {}
    for seq, k, v in sorted(rows, key=lambda r: r[0]):
        seen = state.setdefault(k, [])
        if v is not None:
            seen.append(v)
        wanted[seq] = (sum(seen), min(seen), max(seen)) if seen else (None, None, None)
    assert {r.seq: (r.s, r.lo, r.hi) for r in got.collect()} == wanted


def test_pending_and_close(spark):
    queue = reqs(spark, (1, "http://h/a", 0, False), (2, "http://h/b", 0, False))
    left = fr.pending(queue, queue.where("seq = 1"))
    assert seqs(left) == [2]
    assert tuple(fr.pending_state(left).first()) == (1, True)
    assert tuple(fr.pending_state(left.where("false")).first()) == (0, False)
    assert [d.count() for d in fr.close_queue(left, queue.select("fp"), persist=False)] == [0, 0]
    assert [d.count() for d in fr.close_queue(left, queue.select("fp"), persist=True)] == [1, 2]


def test_depth(spark):
    df = reqs(spark, (1, "http://h/a", 5, False)).withColumn("depth", F.lit(2))
    assert fr.depth_priority(df, k=2).first().priority == 1
    assert fr.depth_priority(df, depth_limit=1).count() == 0
    assert fr.depth_priority(df).first().priority == 5


def breadth_first(seeds, links, limit):
    found, level, depth = {s: (0, None) for s in seeds}, list(seeds), 0
    kinds = {s: "list" for s in seeds}
    while level and not (limit and depth >= limit):
        depth += 1
        offers = {}
        for src, dst, kind in links:
            if src in level and kinds[src] == "list" and dst not in found:
                offers.setdefault(dst, []).append((kind != "list", src))
        level = []
        for dst, options in offers.items():
            late, via = min(options)
            found[dst], kinds[dst] = (depth, via), "detail" if late else "list"
            level.append(dst)
    return found


def test_crawl_reach(spark):
    rng = random.Random(11)
    url = "http://h/{}".format
    links = [(url(rng.randint(0, 40)), url(rng.randint(0, 60)), rng.choice(["list", "list", "detail"])) for _ in range(150)]
    links += [(url(0), url(i), "detail") for i in range(60, 90)] + [(url(1), url(0), "list")]
    seeds = [url(0), url(7)]
    edges = spark.createDataFrame(links, "src_url string, url string, kind string")
    start = spark.createDataFrame([(s,) for s in seeds], "url string")
    for limit in (0, 2):
        got = {r.url: (r.depth, r.via) for r in crawl_reach(start, edges, limit).collect()}
        assert got == breadth_first(seeds, links, limit)


def test_crawl_reach_of_sparse_graphs(spark):
    """Trees, chains, cycles off the seeds and blocked list links, as the plain rounds have them."""
    rng = random.Random(5)
    url = "http://h/{}".format
    for n, limit in ((40, 0), (25, 4)):
        links = [(url(rng.randint(max(0, i - 4), i)), url(i + 1), rng.choice(["list"] * 5 + ["detail"])) for i in range(n)]
        links += [(url(rng.randint(0, n)), url(rng.randint(0, n)), rng.choice(["list", "detail"])) for _ in range(n // 6)]
        links += [(url(100 + i), url(100 + (i + 1) % 5), "list") for i in range(5)] + [(url(0), url(0), "list")]
        edges = spark.createDataFrame(links, "src_url string, url string, kind string")
        start = spark.createDataFrame([(url(0),), (url(9),), (url(9),)], "url string")
        got = {r.url: (r.depth, r.via) for r in crawl_reach(start, edges, limit).collect()}
        assert got == breadth_first([url(0), url(9)], links, limit)
    assert crawl_reach(start.limit(0), edges).count() == 0


def test_crawl_reach_of_a_long_chain(spark, monkeypatch):
    """2,000 listing pages with a detail link each, in at most 2 * log2(2000) stored tables."""
    from pagelake.operators import reach

    made, dropped = [], []
    monkeypatch.setattr(reach, "written", lambda df, name, write=reach.written: made.append(name) or write(df, name))
    monkeypatch.setattr(reach, "discard", lambda table, drop=reach.discard: dropped.append(table) or drop(table))
    url = "http://h/{}".format
    ids = spark.range(2000)
    pages = ids.selectExpr("concat('http://h/', id) as src_url", "concat('http://h/', id + 1) as url", "'list' as kind")
    pages = pages.unionAll(ids.selectExpr("concat('http://h/', id)", "concat('http://h/d', id % 700)", "'detail'"))
    got = {r.url: (r.depth, r.via) for r in crawl_reach(spark.createDataFrame([(url(0),)], "url string"), pages).collect()}
    assert len(got) == 2701
    assert all(got[url(i)] == (i, url(i - 1)) for i in range(1, 2001))
    assert all(got[url(f"d{i}")] == (i + 1, url(i)) for i in range(700))
    assert len(made) <= 22 and len(dropped) == len(made)  # the result stays, the settled rounds are one folder


def test_crawl_reach_on_a_cycle(spark):
    edges = spark.createDataFrame(
        [("http://h/1", "http://h/2", "list"), ("http://h/2", "http://h/1#top", "list"), ("http://h/2", "http://h/d", "detail"), ("http://h/d", "http://h/x", "detail")],
        "src_url string, url string, kind string",
    )
    got = crawl_reach(spark.createDataFrame([("http://h/1",)], "url string"), edges)
    assert sorted((r.url, r.depth) for r in got.collect()) == [("http://h/1", 0), ("http://h/2", 1), ("http://h/d", 2)]

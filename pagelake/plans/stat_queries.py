"""Queries over events: counters, metric points, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake import fixed_values as fixed
from pagelake.functions.metrics import metric_name
from pagelake.operators import stats as st
from pagelake.operators.rollup import rollup
from pagelake.session import new_path, table_stream
from pagelake.sources.metric_lines import metric_lines, write_metric_lines
from pagelake.streaming.stats import latest_stats, running_stats, stats_stream


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def event_ops(events: DataFrame) -> DataFrame:
    """An operation per event: its type is the key and says which operation it is."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "click"), "inc").when(kind == "view", "max").when(
        kind == "purchase", "min"
    ).otherwise("set")
    user = F.col("user_id")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(user > 10, F.concat(F.lit("s"), user.cast("string"))).alias("spider"),
        kind.alias("key"),
        op.alias("op"),
        F.floor("value").cast("bigint").alias("value"),
        F.lit(100).cast("bigint").alias("start"),
        F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"), 1).otherwise(2).alias("epoch"),
    )


def ops(spark, sf) -> DataFrame:
    return event_ops(_read(spark, sf, "events"))


_OPS_SQL = """
ops as (
  select event_id as seq, ts, event_type as key,
         case when user_id > 10 then 's' || user_id end as spider,
         case when event_type in ('signup', 'click') then 'inc' when event_type = 'view' then 'max'
              when event_type = 'purchase' then 'min' else 'set' end as op,
         cast(floor(value) as bigint) as value,
         case when ts < timestamp '2024-01-11' then 1 else 2 end as epoch
  from events)
"""
_NAME_SQL = "case when spider is null then 'scrapy.' || key else 'scrapy.spider.' || spider || '.' || key end"


_KEYED_SQL = f"""{_OPS_SQL},
keyed as (select * replace (key || ':' || coalesce(spider, 'none') as key) from ops)
"""


def _keyed(df):
    """One key per kind and spider: some keys are in one epoch only."""
    return df.withColumn("key", F.concat_ws(":", "key", F.coalesce("spider", F.lit("none"))))


def _prior(spark, sf, value):
    """Statistics of the first epoch."""
    early = _keyed(ops(spark, sf)).where("epoch = 1")
    return early.groupBy("key").agg(F.expr(value).alias("value"))


def _later(spark, sf):
    return st.clear_stats(_keyed(ops(spark, sf)), 2)


def _two_runs(function, prior_value):
    def query(spark, sf):
        return function(_later(spark, sf), _prior(spark, sf, prior_value))

    return query


def _two_runs_sql(prior, combined, later):
    return f"""
    with {_KEYED_SQL},
    old as (select key, {prior} as o from keyed where epoch = 1 group by key),
    new as (select key, {later} as n from keyed where epoch = 2 group by key)
    select coalesce(old.key, new.key) as key, cast({combined} as bigint) as value
    from old full join new on old.key = new.key
    """


def counted(spark, sf):
    return st.inc(_later(spark, sf), _prior(spark, sf, "sum(value)"), F.col("start"))


def merged_map(spark, sf):
    """Bulk writes of a map per event over the values of the first epoch."""
    updates = _later(spark, sf).select(
        "seq", F.create_map(F.col("key"), "value", F.concat("key", F.lit("_id")), F.col("seq")).alias("stats")
    )
    return st.set_stats(_prior(spark, sf, "max(value)"), updates)


def folded(spark, sf):
    return st.fold_ops(ops(spark, sf))


def mixed(spark, sf):
    """All operations of all types on one key per user, in order."""
    return ops(spark, sf).withColumn("key", F.coalesce("spider", F.lit("none")))


def folded_mixed(spark, sf):
    return st.fold_ops(mixed(spark, sf))


_WALK_SQL = f"""
with recursive {_OPS_SQL}, numbered as (
  select seq, coalesce(spider, 'none') as key, op, value,
         row_number() over (partition by coalesce(spider, 'none') order by seq) as rn
  from ops),
walk as (
  select key, seq, rn, case when op = 'inc' then 100 + value else value end as x from numbered where rn = 1
  union all
  select n.key, n.seq, n.rn, case n.op when 'inc' then w.x + n.value when 'max' then greatest(w.x, n.value)
                                       when 'min' then least(w.x, n.value) else n.value end
  from walk w join numbered n on n.key = w.key and n.rn = w.rn + 1)
"""
_MIXED_SQL = f"{_WALK_SQL} select key, arg_max(x, rn) as value from walk group by key"
_MIXED_RUNNING_SQL = f"{_WALK_SQL} select seq, key, x as value from walk"


def values(spark, sf):
    stats = ops(spark, sf).groupBy("spider").agg(F.max("value").cast("string").alias("value"))
    stats = stats.select(F.coalesce("spider", F.lit("none")).alias("key"), F.when(F.col("value") > 200, "many").otherwise(F.col("value")).alias("value"))
    asked = _read(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("key"))
    return st.get_value(stats, asked, default=-1)


def dumped(spark, sf):
    return st.get_stats(st.fold_ops(ops(spark, sf)))


def cleared(spark, sf):
    return st.fold_ops(st.clear_stats(ops(spark, sf), 2))


def points(spark, sf):
    """Sets of one key are hidden, those of texts dropped; everything else is sent."""
    sent = ops(spark, sf).withColumn(
        "value", F.when(F.col("value") > 250, F.lit("big")).otherwise(F.col("value").cast("string"))
    ).withColumn("op", F.when(F.col("key").isin("view", "error"), "set").otherwise("inc"))
    found = st.metric_points(sent, ignore=["view"])
    return found.select("seq", "name", F.col("value").cast("bigint").alias("value"))


def names(spark, sf):
    return ops(spark, sf).select("seq", metric_name(F.col("key"), F.col("spider")).alias("name"))


def shared_values(spark, sf):
    return st.merge_spiders(ops(spark, sf)).select("seq", "key", "name", "value")


def shared_mixed(spark, sf):
    """Operations of all kinds on each key, the value after every one of them."""
    return st.merge_spiders(mixed(spark, sf)).select("seq", "key", "value")


def traffic(spark, sf):
    log = ops(spark, sf).select(
        F.when(F.col("key") == "view", "enqueued").when(F.col("key") == "click", "dequeued").alias("kind")
    )
    return st.scheduler_counts(log)


def history(spark, sf):
    kind = F.col("event_type")
    suffix = F.when(kind == "view", "_count").when(kind == "click", "_min").when(kind == "signup", "_max").otherwise("")
    found = _read(spark, sf, "events").select(
        F.concat(F.lit("scrapy."), kind, suffix).alias("name"),
        F.floor("value").cast("bigint").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )
    rolled = rollup(found, step=600, width=7200)
    return rolled.select("name", "bucket", F.round("value", 6).alias("value"))


def _metric_table(spark, sf):
    return ops(spark, sf).select(
        metric_name(F.col("key"), F.col("spider")).alias("name"), F.col("value") / F.lit(4.0), "ts", "seq"
    ).toDF("name", "value", "ts", "seq")


def lines(spark, sf):
    return metric_lines(_metric_table(spark, sf))


def written_lines(spark, sf):
    path = new_path(spark, "lines")
    write_metric_lines(_metric_table(spark, sf), path)
    back = spark.read.option("lineSep", "\n\n").text(path)
    return back.select(F.col("value").alias("line"))


_LINES_SQL = f"""
with {_OPS_SQL}
select {_NAME_SQL} || ' ' || printf('%g', value / 4.0::double) || ' ' || cast(floor(epoch(ts)) as bigint) as line
from ops
"""


def live(spark, sf):
    """The final state of the streaming counters."""
    path, checkpoint = new_path(spark, "stats"), new_path(spark, "stats-state")
    events = table_stream(spark, f"{sf}/events.parquet")
    stats_stream(event_ops(events), path, checkpoint, availableNow=True).awaitTermination()
    return latest_stats(spark, path).drop("ts")


def running_batch(spark, sf):
    return running_stats(ops(spark, sf)).drop("ts")


_RUNNING_SQL = f"""
with {_OPS_SQL}
select key, cast(sum(value) as bigint) as inc_value, max(value) as max_value, min(value) as min_value,
       arg_max(value, seq) as set_value,
       cast(case any_value(op) when 'inc' then 100 + sum(value) when 'max' then max(value)
            when 'min' then min(value) else arg_max(value, seq) end as bigint) as value
from ops group by key
"""

QUERIES = {
    "inc": (
        counted,
        _two_runs_sql("sum(value)", "coalesce(o, 100) + coalesce(n, 0)", "sum(value)"),
    ),
    "max_value": (
        _two_runs(st.max_value, "max(value) - 5"),
        _two_runs_sql("max(value) - 5", "greatest(o, n)", "max(value)"),
    ),
    "min_value": (
        _two_runs(st.min_value, "min(value) + 5"),
        _two_runs_sql("min(value) + 5", "least(o, n)", "min(value)"),
    ),
    "set_value": (
        _two_runs(st.set_value, "max(value)"),
        _two_runs_sql("max(value)", "coalesce(n, o)", "arg_max(value, seq)"),
    ),
    "set_stats": (
        merged_map,
        f"""
        with {_KEYED_SQL},
        old as (select key, max(value) as o from keyed where epoch = 1 group by key),
        new as (
          select key, arg_max(value, seq) as n from keyed where epoch = 2 group by key
          union all select key || '_id', max(seq) from keyed where epoch = 2 group by key)
        select coalesce(old.key, new.key) as key, coalesce(n, o) as value
        from old full join new on old.key = new.key
        """,
    ),
    "fold_ops": (
        folded,
        f"""
        with {_OPS_SQL}
        select key, cast(case any_value(op) when 'inc' then 100 + sum(value) when 'max' then max(value)
                         when 'min' then min(value) else arg_max(value, seq) end as bigint) as value
        from ops group by key
        """,
    ),
    "fold_ops_mixed": (folded_mixed, _MIXED_SQL),
    "get_value": (
        values,
        f"""
        with {_OPS_SQL}, stats as (select coalesce(spider, 'none') as key, max(value) as v from ops group by 1)
        select 's' || c_custkey as key, coalesce(case when v <= 200 then v end, -1) as value
        from customer left join stats on key = 's' || c_custkey
        """,
    ),
    "get_stats": (
        dumped,
        f"""
        with {_OPS_SQL}
        select key, cast(case any_value(op) when 'inc' then 100 + sum(value) when 'max' then max(value)
                         when 'min' then min(value) else arg_max(value, seq) end as bigint) as value
        from ops group by key
        """,
    ),
    "clear_stats": (
        cleared,
        f"""
        with {_OPS_SQL}
        select key, cast(case any_value(op) when 'inc' then 100 + sum(value) when 'max' then max(value)
                         when 'min' then min(value) else arg_max(value, seq) end as bigint) as value
        from ops where epoch = 2 group by key
        """,
    ),
    "metric_points": (
        points,
        f"""
        with {_OPS_SQL}
        select seq, {_NAME_SQL} as name, case when value <= 250 then value end as value
        from ops where key <> 'view' and (key <> 'error' or value <= 250)
        """,
    ),
    "metric_name": (names, f"with {_OPS_SQL} select seq, {_NAME_SQL} as name from ops"),
    "merge_spiders": (
        shared_values,
        f"""
        with {_OPS_SQL}
        select seq, key, {_NAME_SQL} as name,
               cast(case op when 'inc' then 100 + sum(value) over w when 'max' then max(value) over w
                            when 'min' then min(value) over w else value end as bigint) as value
        from ops
        window w as (partition by key order by seq rows between unbounded preceding and current row)
        """,
    ),
    "merge_spiders_mixed": (shared_mixed, _MIXED_RUNNING_SQL),
    "scheduler_counts": (
        traffic,
        f"""
        select '{fixed.ENQUEUED_KEY}' as key, count(*) as value from events where event_type = 'view'
        union all select '{fixed.DEQUEUED_KEY}', count(*) from events where event_type = 'click'
        """,
    ),
    "rollup": (
        history,
        """
        with points as (
          select event_type, cast(floor(value) as bigint) as v, event_id, cast(floor(epoch(ts)) as bigint) as e
          from events),
        slots as (select event_type, e // 600 * 600 as slot, arg_max(v, event_id) as v from points group by 1, 2),
        buckets as (
          select event_type, slot // 7200 * 7200 as bucket, sum(v) as s, min(v) as mn, max(v) as mx, avg(v) as a,
                 count(*) / 12.0 as filled
          from slots group by 1, 2)
        select 'scrapy.' || event_type || case event_type when 'view' then '_count' when 'click' then '_min'
                 when 'signup' then '_max' else '' end as name, bucket,
               cast(case when event_type = 'view' then case when filled >= 0.1 then s end
                    when event_type = 'click' then case when filled >= 0.1 then mn end
                    when event_type = 'signup' then case when filled >= 0.1 then mx end
                    when filled >= 0.5 then round(a, 6) end as double) as value
        from buckets
        """,
    ),
    "metric_lines": (lines, _LINES_SQL),
    "write_metric_lines": (written_lines, _LINES_SQL),
    "running_stats": (running_batch, _RUNNING_SQL),
    "stats_stream": (live, _RUNNING_SQL),
}

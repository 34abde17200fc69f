"""Counters kept from a log of operations.

Operations are ``(seq, key, op, value)`` with ``op`` one of ``inc``, ``max``, ``min`` and
``set``, plus ``start``, ``spider``, ``ts`` and ``epoch`` where an operator names them.
``seq`` is the arrival number: unique and rising. Tables of statistics are ``(key, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake import fixed_values as fixed
from pagelake.functions.metrics import metric_name

FOLD_WIDTH = 4096
FOLD_LEVELS = 3
"""Runs of ``width`` numbers, of ``width`` runs, and so on: 4096 ** 3 numbers in three levels.
Higher numbers stay right; then more than ``width`` runs of a key meet at the last level."""
CHUNK = 64
"""Rows of a bucket whose prefixes are made together."""
_RUN = RUN = ["a", "lo", "hi", "absent"]


def _merged(new: DataFrame, prior: DataFrame | None, how) -> DataFrame:
    """``how(prior value, new value)`` per key; keys of one side keep their value."""
    if prior is None:
        return new.select("key", "value")
    old = prior.select("key", F.col("value").alias("_old"))
    both = new.select("key", F.col("value").alias("_new")).join(old, "key", "full")
    return both.select("key", how(F.col("_old"), F.col("_new")).alias("value"))


def inc(events: DataFrame, prior: DataFrame | None = None, start: Column | None = None) -> DataFrame:
    """G1: counters: earlier value, or ``start`` of the first event, plus all counts."""
    start = F.lit(0) if start is None else start
    sums = events.groupBy("key").agg(
        F.sum(F.col("value").cast("bigint")).alias("_sum"),
        F.min_by(start.cast("bigint"), "seq").alias("_start"),
    )
    if prior is None:
        return sums.select("key", (F.col("_start") + F.col("_sum")).alias("value"))
    old = prior.select("key", F.col("value").alias("_old"))
    total = F.coalesce("_old", "_start") + F.coalesce("_sum", F.lit(0))
    return sums.join(old, "key", "full").select("key", total.alias("value"))


def max_value(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Largest value seen."""
    return _merged(events.groupBy("key").agg(F.max("value").alias("value")), prior, F.greatest)


def min_value(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Smallest value seen."""
    return _merged(events.groupBy("key").agg(F.min("value").alias("value")), prior, F.least)


def set_value(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The last value written."""
    last = events.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return _merged(last, prior, lambda old, new: F.coalesce(new, old))


def set_stats(prior: DataFrame, updates: DataFrame) -> DataFrame:
    """Statistics after writing ``updates(seq, stats map)``; other keys stay."""
    entries = updates.select("seq", F.explode("stats").alias("key", "value"))
    return set_value(entries, prior)


def fold_ops(
    ops: DataFrame, prior: DataFrame | None = None, width: int = FOLD_WIDTH, levels: int = FOLD_LEVELS
) -> DataFrame:
    """Value of each key after all its operations, applied in order.

    Each operation, and any run of them, is ``x -> least(hi, greatest(lo, x + a))`` plus a
    value for a key that did not exist. Runs of at most ``width`` sequence numbers are
    combined, then runs of runs, until each key has one: a hot key never meets in one task.
    """
    runs = fold_runs(ops, width, levels)
    if prior is None:
        return runs.select("key", F.col("absent").alias("value"))
    old = prior.select("key", F.col("value").alias("_old"))
    applied = _applied(F.col("_old"), F.struct(*_RUN))
    return runs.join(old, "key", "full").select(
        "key",
        F.when(F.col("a").isNull(), F.col("_old"))
        .when(F.col("_old").isNull(), F.col("absent"))
        .otherwise(applied)
        .alias("value"),
    )


def fold_runs(ops: DataFrame, width: int = FOLD_WIDTH, levels: int = FOLD_LEVELS) -> DataFrame:
    """``(key, a, lo, hi, absent)``: the run of all operations of each key, in order."""
    runs = ops.select("key", F.col("seq").cast("bigint").alias("seq"), *_own_run(ops))
    for level in range(levels, 0, -1):
        steps = F.sort_array(F.collect_list(F.struct("seq", *_RUN)))
        whole = F.aggregate(F.slice("_steps", 2, F.size("_steps")), F.get("_steps", F.lit(0)), followed_by)
        runs = (
            runs.groupBy("key", _bucket(width, level).alias("_bucket"))
            .agg(steps.alias("_steps"))
            .select("key", F.col("_bucket").alias("seq"), whole.alias("_run"))
            .select("key", "seq", *[f"_run.{c}" for c in _RUN])
        )
    return runs.select("key", *_RUN)


def _applied(value: Column, run: Column) -> Column:
    """A known value after a run."""
    return F.least(run["hi"], F.greatest(run["lo"], value + run["a"]))


def _own_run(ops: DataFrame) -> list[Column]:
    """The run of each single operation."""
    value = F.col("value").cast("bigint")
    start = F.col("start").cast("bigint") if "start" in ops.columns else F.lit(0).cast("bigint")
    is_set, is_inc = F.col("op") == "set", F.col("op") == "inc"
    return [
        F.when(is_inc, value).otherwise(F.lit(0)).alias("a"),
        F.when(is_set | (F.col("op") == "max"), value).alias("lo"),
        F.when(is_set | (F.col("op") == "min"), value).alias("hi"),
        F.when(is_inc, F.coalesce(start, F.lit(0)) + value).otherwise(value).alias("absent"),
    ]


def _bucket(width: int, level: int) -> Column:
    """The bucket of a sequence number; the last level has one for each key."""
    return F.floor(F.col("seq") / width).cast("bigint") if level > 1 else F.lit(0).cast("bigint")


def _running_runs(runs: DataFrame, carried: list[str], width: int, levels: int) -> DataFrame:
    """``(key, seq, *carried, _before, _own)``: the run of all operations of a key before each.

    Prefixes are made inside each bucket; what lies before the bucket comes from the level
    above, joined on the partitioning of the bucket. ``_before`` is null at a key's start.
    A bucket is cut into chunks of ``CHUNK`` rows: a prefix grows inside its chunk alone, and
    those of whole chunks are as few, so no row copies the prefixes of its bucket.
    """
    steps = F.sort_array(F.collect_list(F.struct("seq", *_RUN, *carried)))
    grouped = runs.groupBy(F.struct("key", _bucket(width, levels).alias("seq")).alias("_group")).agg(steps.alias("_steps"))
    starts = F.sequence(F.lit(1), F.size("_steps"), F.lit(CHUNK))
    chunks = F.transform(starts, lambda at: _prefixes(F.slice("_steps", at, CHUNK)))
    local = grouped.withColumn("_chunks", chunks)
    local = local.withColumn("_upto", _prefixes(F.transform("_chunks", lambda c: F.element_at(c, -1))))
    none = F.lit(None).cast(local.schema["_upto"].dataType.elementType)
    if levels > 1:
        totals = local.select("_group.key", "_group.seq", F.element_at("_upto", -1).alias("_t"))
        totals = totals.select("key", "seq", *[f"_t.{c}" for c in _RUN])
        above = _running_runs(totals, [], width, levels - 1)
        above = above.select(F.struct("key", "seq").alias("_above"), F.col("_before").alias("_outer"))
        local = local.join(above, F.col("_group") == F.col("_above"))
    else:
        local = local.withColumn("_outer", none)
    pieces = F.transform(
        "_chunks",
        lambda c, i: F.struct(
            _both(F.col("_outer"), F.get(F.concat(F.array(none), "_upto"), i)).alias("_outer"),
            F.concat(F.array(none), c).alias("_inner"),
            F.slice("_steps", i * CHUNK + 1, CHUNK).alias("_steps"),
        ),
    )
    cut = local.select("_group.key", F.inline(pieces))
    rows = cut.select("key", "_outer", F.inline(F.arrays_zip("_steps", "_inner"))).where(F.col("_steps").isNotNull())
    return rows.select(
        "key", "_steps.seq", *[f"_steps.{c}" for c in carried],
        _both(F.col("_outer"), F.col("_inner")).alias("_before"), _run_of(F.col("_steps")).alias("_own"),
    )


def _prefixes(runs: Column) -> Column:
    """The runs of the first one, the first two, and so on."""
    none_yet = F.array().cast(f"array<struct<seq:bigint,{','.join(f'{c}:bigint' for c in _RUN)}>>")

    def grown(done: Column, step: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        return F.array_append(done, F.when(last.isNull(), _run_of(step)).otherwise(followed_by(last, step)))

    return F.aggregate(runs, none_yet, grown)


def _both(f: Column, g: Column) -> Column:
    """``f`` and then ``g``, where null is no run."""
    return F.when(f.isNull(), g).when(g.isNull(), f).otherwise(followed_by(f, g))


def _run_of(step: Column) -> Column:
    return F.struct(step["seq"].alias("seq"), *[step[c].alias(c) for c in _RUN])


def followed_by(f: Column, g: Column) -> Column:
    """The run ``f`` and then ``g``; a null bound is no bound."""
    lo = F.greatest(g["lo"], f["lo"] + g["a"])
    hi = F.when(f["hi"].isNull(), g["hi"]).otherwise(
        F.least(g["hi"], F.greatest(g["lo"], f["hi"] + g["a"]))
    )
    absent = F.least(g["hi"], F.greatest(g["lo"], f["absent"] + g["a"]))
    return F.struct(
        f["seq"].alias("seq"),
        (f["a"] + g["a"]).alias("a"),
        lo.alias("lo"),
        hi.alias("hi"),
        absent.alias("absent"),
    )


def get_value(stats: DataFrame, keys: DataFrame, default: int | None = None) -> DataFrame:
    """Whole-number value of each asked ``key``, ``default`` where there is none."""
    found = keys.select("key").join(stats.select("key", "value"), "key", "left")
    return found.select(
        "key", F.coalesce(F.col("value").try_cast("bigint"), F.lit(default)).alias("value")
    )


def get_stats(stats: DataFrame) -> DataFrame:
    """The whole table by key."""
    return stats.orderBy("key")


def clear_stats(ops: DataFrame, epoch: int) -> DataFrame:
    """Operations since the last clearing; earlier epochs are forgotten."""
    return ops.where(F.col("epoch") == epoch)


def metric_points(ops: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """``(name, value, ts, seq)`` sent out for operations.

    A ``set`` is sent when its value is a number and its key is not ignored; the other
    operations always are. ``value`` is sent as it stands: for counters, give the value
    after the operation (``merge_spiders``).
    """
    number = F.col("value").try_cast("double")
    hidden = F.col("key").isin(list(ignore)) if ignore else F.lit(False)
    sent = (F.col("op") != "set") | (number.isNotNull() & ~hidden)
    return ops.where(sent).select(
        metric_name(F.col("key"), F.col("spider")).alias("name"),
        number.alias("value"),
        "ts",
        "seq",
    )


def merge_spiders(
    ops: DataFrame, width: int = FOLD_WIDTH, levels: int = FOLD_LEVELS, prior: DataFrame | None = None
) -> DataFrame:
    """``(seq, key, name, value, ts)``: the value all spiders share after each operation,
    under the name of the spider that made it. A key may have operations of all kinds; a
    counter that does not exist (in ``prior(key, value)`` either) begins at the ``start`` of its operation.
    """
    runs = ops.select("key", F.col("seq").cast("bigint").alias("seq"), *_own_run(ops), "spider", "ts")
    found = _running_runs(runs, ["spider", "ts"], width, levels)
    before, own = F.col("_before"), F.col("_own")
    run = F.when(before.isNull(), own).otherwise(followed_by(before, own))
    found = found.select("key", "seq", "spider", "ts", run.alias("_run"))
    value = F.col("_run.absent")
    if prior is not None:
        found = found.join(prior.select("key", F.col("value").alias("_old")), "key", "left")
        value = F.when(F.col("_old").isNull(), value).otherwise(_applied(F.col("_old"), F.col("_run")))
    return found.select(
        "seq", "key", metric_name(F.col("key"), F.col("spider")).alias("name"), value.alias("value"), "ts"
    )


def scheduler_counts(log: DataFrame) -> DataFrame:
    """``(key, value)`` of requests taken in and handed out; ``log(kind)``."""
    counts = log.agg(
        F.count_if(F.col("kind") == "enqueued").alias("_in"),
        F.count_if(F.col("kind") == "dequeued").alias("_out"),
    )
    pairs = F.array(
        F.struct(F.lit(fixed.ENQUEUED_KEY).alias("key"), F.col("_in").alias("value")),
        F.struct(F.lit(fixed.DEQUEUED_KEY).alias("key"), F.col("_out").alias("value")),
    )
    return counts.select(F.inline(pairs))

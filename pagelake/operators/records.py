"""Shaping and loading book records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.membership import known_keys
from pagelake.schemas import ITEM
from pagelake.session import written

_COMMON = [
    "book_name",
    "alias_name",
    "author",
    "book_description",
    "book_covor_image_path",
    "book_covor_image_url",
    "book_download",
    "book_file_url",
]
PROFILES = {"single": "book_file", "sharded": "book_file_id"}


def fill_defaults(items: DataFrame, profile: str = "sharded") -> DataFrame:
    """the fixed columns of a profile; missing text is ``''``, missing lists are empty.

    ``book_name`` has no default. Columns the input lacks count as missing everywhere.
    """
    columns = [*_COMMON, PROFILES[profile], "original_url"]

    def filled(name: str) -> Column:
        kind = ITEM[name].dataType
        value = F.col(name) if name in items.columns else F.lit(None)
        value = value.cast(kind)
        if name == "book_name":
            return value.alias(name)
        empty = F.array().cast(kind) if kind.typeName() == "array" else F.lit("")
        return F.coalesce(value, empty).alias(name)

    return items.select(*[filled(c) for c in columns])


def drop_none(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records with a file, and ``(original_url, reason)`` of the others.

    The reason tells records that never had a candidate from those whose every candidate
    failed; it needs ``book_download``.
    """
    reason = none_reason(items)
    dropped = items.where(reason.isNotNull()).select("original_url", reason.alias("reason"))
    return items.where(reason.isNull()), dropped


def none_reason(items: DataFrame) -> Column:
    """why a record is dropped by ``drop_none``; null for a record with a file."""
    no_file = F.coalesce(F.col("book_file_url"), F.lit("")) == ""
    reason = F.lit("all-failed")
    if "book_download" in items.columns:
        never = F.coalesce(F.size("book_download"), F.lit(0)) < 1
        reason = F.when(never, "no-candidates").otherwise(reason)
    return F.when(no_file, reason)


def stamp(items: DataFrame, now: Column | None = None) -> DataFrame:
    """``update_time`` (UTC now unless given) and ``record_id``, the sha1 of the page URL."""
    return items.withColumns(
        {
            "update_time": F.current_timestamp() if now is None else now,
            "record_id": F.sha1("original_url"),
        }
    )


def insert_unique(
    new: DataFrame,
    existing: DataFrame | None = None,
    name: str = "book_name",
    elements: str = "author",
    order: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """``(inserted, rejected)`` under uniqueness of (name, author) per author.

    The result is that of inserting one by one in ``order`` (unique): a record is refused
    when it shares a pair with one stored before it, and a refused record blocks nobody.

    Records with the same name and author set are first cut to their earliest by a partial
    aggregate: the others cannot get in. A record is then accepted in a round when it is
    the earliest undecided one on all its pairs, and what shares a pair with it is refused.
    With one author each that is one round; chains of shared authors take more. Only ids
    and pairs go round, never the records.
    """
    authors = F.coalesce(F.col(elements), F.array().cast("array<string>"))
    one_null = F.array(F.lit(None).cast("string"))
    parts = F.when(F.size(authors) == 0, one_null).otherwise(F.array_distinct(authors))
    pair = F.transform(
        F.sort_array(parts), lambda a: F.to_json(F.array(F.col(name), a))
    ).alias("_pairs")
    first = new.select(F.col(order).alias("_id"), pair).groupBy("_pairs").agg(
        F.min("_id").alias("_id")
    )
    undecided = first.select("_id", F.size("_pairs").alias("_n"), F.explode("_pairs").alias("_pair"))
    if existing is not None:
        stored = existing.select(F.explode(pair).alias("_pair"))
        undecided = _without_pairs(undecided, known_keys(undecided, stored, "_pair"))
    undecided = written(undecided, "undecided")

    accepted = None
    while not undecided.isEmpty():
        earliest = undecided.groupBy("_pair").agg(F.min(F.struct("_id", "_n")).alias("_w"))
        won = (
            earliest.groupBy("_w._id", "_w._n")
            .agg(F.count("*").alias("_won"))
            .where("_won = _n")
            .select("_id")
        )
        won = written(won, "accepted")
        accepted = won if accepted is None else accepted.unionByName(won)
        if undecided.where("_n > 1").isEmpty():
            break
        taken = undecided.join(won, "_id", "left_semi").select("_pair").distinct()
        undecided = written(_without_pairs(undecided, taken), "undecided")

    if accepted is None:
        return new.where(F.lit(False)), new
    on = F.col(order) == F.col("_id")
    return new.join(accepted, on, "left_semi"), new.join(accepted, on, "left_anti")


def _without_pairs(undecided: DataFrame, taken: DataFrame) -> DataFrame:
    """Undecided records that hold none of the ``taken`` pairs."""
    blocked = undecided.join(taken, "_pair", "left_semi").select("_id").distinct()
    return undecided.join(blocked, "_id", "left_anti").select("_id", "_n", "_pair")


def lookup(
    records: DataFrame,
    book_name: str | None = None,
    author: str | None = None,
    alias_name: str | None = None,
) -> DataFrame:
    """records that equal every given field; lists match by element."""
    if book_name is not None:
        records = records.where(F.col("book_name") == book_name)
    if author is not None:
        records = records.where(F.array_contains("author", author))
    if alias_name is not None:
        records = records.where(F.array_contains("alias_name", alias_name))
    return records


def inverted_index(
    records: DataFrame, field: str, record_id: str = "record_id", values: DataFrame | None = None
) -> DataFrame:
    """``(value, record_id)`` pairs of a field, for bulk lookups by join.

    A popular value stays many rows, never one collected list. With ``values(value)`` only
    their pairs are made: the others are left out before any shuffle of pairs for ``distinct``.
    """
    is_list = records.schema[field].dataType.typeName() == "array"
    value = F.explode(F.array_distinct(field)) if is_list else F.col(field)
    pairs = records.select(value.alias("value"), F.col(record_id).alias("record_id"))
    if values is not None:
        pairs = pairs.join(values.select("value"), "value", "left_semi")
    return pairs.distinct()

"""URL allow and block rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
"""(verdict, host, path); the verdict is "allow" or "block"."""

MAX_BROADCAST_BYTES = 64 << 20
DEFAULT_VERDICT = "allow"

_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER_SCHEME, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER_SCHEME, 2)


class RuleTrie:
    """Rules by host labels from the last to the first, then by path segments.

    A rule's path is a prefix of the URL's, so its last segment may be the beginning of one. Of
    the rules that fit, the one with most host labels wins, then the one with the longest
    path; of a rule given twice, the last.
    """

    def __init__(self, rules: Iterable[Rule], hosts: dict | None = None):
        self.hosts: dict = {} if hosts is None else hosts
        for verdict, host, path in rules:
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(("label", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            node.setdefault("ends", {})[last] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node = None, self.hosts
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            best = self._longest_path(node, segments) or best
        return best

    @staticmethod
    def _longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends = node.get("ends")
            if ends:
                for size in range(len(segment), -1, -1):
                    if segment[:size] in ends:
                        best = ends[segment[:size]]
                        break
            node = node.get(("segment", segment))
            if node is None:
                break
        return best


def _trie_batches(shared, default: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RuleTrie((), shared.value)
        for batch in batches:
            found = [
                trie.find(host, path) or (None, default)
                for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge(
    pages: DataFrame, rules: list[Rule], default: str = DEFAULT_VERDICT, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path. A URL that no rule fits
    has a null rule and the verdict ``default``. The trie is broadcast while the rules have at
    most ``max_broadcast_bytes`` characters; a longer list is matched by a join.
    """
    parts = pages.select(F.col("page_id").cast("bigint"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if sum(len(h) + len(p) for _, h, p in rules) <= max_broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules).hosts)
        return parts.mapInArrow(
            _trie_batches(shared, default), "page_id bigint, host string, path string, rule string, verdict string"
        )
    table = pages.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place long")
    return judge_by_join(parts, table, default)


def judge_by_join(parts: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """The same for a table of rules (verdict, host, path, place) of any size.

    Distinct (host, path) pairs are expanded to their host suffixes, at most one per label, and joined to
    the rules of that host; the longest rule is an aggregate with map-side combine.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = parts.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    listed = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"), "place"
    )
    rank = F.struct(F.size(F.split("rule_host", r"\.")), F.char_length("rule_path"), "place")
    found = (
        asked.join(listed, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))
    )
    return parts.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )

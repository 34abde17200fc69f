"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import text_slices, texts_of
from pagelake.llm.components import components
from pagelake.session import written

HASH_SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
HASHES_AT_ONCE = 1 << 16
SIGN = 1 << 63


def fingerprint(text: str | None) -> int:
    """64 bits: each is set if it is set in over half the hashes of the text's shingles.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A text of
    one or two words is one shingle; a text without words, or null, has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    width = min(SHINGLE_WORDS, len(words))
    last = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, last, HASHES_AT_ONCE):
        part = words[start : min(start + HASHES_AT_ONCE, last) + width - 1]
        grams = zip(*(part[i:] for i in range(width)), strict=False)
        hashes = np.array([hashed(b" ".join(gram), HASH_SEED) for gram in grams], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_slices(batches):
        prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document; fp holds the 64 bits as a bigint."""
    return texts_of(docs).mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")


class BkTree:
    """Integers by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self, values: Iterable[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            self._add(value)

    def _add(self, value: int) -> None:
        node = 0
        while node < len(self.values):
            distance = (value ^ self.values[node]).bit_count()
            if distance == 0:
                return
            node = self.children[node].setdefault(distance, len(self.values))
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Values at most ``radius`` away; only edges that can lead to one are followed."""
        open_nodes = [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                yield self.values[node]
            children = self.children[node]
            for edge in range(distance - radius, distance + radius + 1):
                if edge in children:
                    open_nodes.append(children[edge])


def _forest(tree_values: list[int], queries: list[int], radius: int) -> dict[int, int]:
    """Root of each value after all links between the two lists are joined.

    The root is the least value as a bigint, the order in which ``components`` goes on; the
    least unsigned one could be the greatest there, and a hub of its own.
    """
    parent: dict[int, int] = {}

    def root(value: int) -> int:
        while parent.setdefault(value, value) != value:
            parent[value] = parent[parent[value]]
            value = parent[value]
        return value

    tree = BkTree(tree_values)
    for value in queries:
        for found in tree.within(value, radius):
            a, b = root(value), root(found)
            if a ^ SIGN < b ^ SIGN:
                parent[b] = a
            else:
                parent[a] = b
    return {value: root(value) for value in parent}


def _link_batches(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        for batch in batches:
            for tree, queries in zip(batch.column(0), batch.column(1), strict=True):
                values = [v & mask for v in tree.as_py()]
                asked = [v & mask for v in queries.as_py()]
                rows = [(a, b) for a, b in _forest(values, asked, radius).items() if a != b]
                if rows:
                    pair = np.array(rows, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["src", "dst"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = 4, tree_size: int = 4096) -> DataFrame:
    """(src, dst): a spanning forest of the links in each shard of distinct fingerprints.

    ``prints`` has distinct bigints in column fp. The 64 bits are cut into ``blocks`` parts. Two
    fingerprints within ``radius`` bits agree in ``blocks - radius`` parts at least, so they
    share the shard of those parts. A shard's fingerprints form BK-trees of about
    ``tree_size`` nodes, and every fingerprint of the shard is looked up in them. Trees and
    lookups are sent to the tasks that need them by a join on the shard: all trees
    together grow with the data and are not broadcast to everyone. A shard above
    ``tree_size`` is several trees, each searched by every block of the shard, in tasks of
    their own; no link is lost. More ``blocks`` make smaller shards and more copies.
    """
    width = 64 // blocks
    parts = [((1 << width) - 1) << (width * i) for i in range(blocks - 1)]
    parts.append(((1 << 64) - 1) ^ sum(parts))
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shard = F.explode(
        F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for i, m in enumerate(signed)])
    )
    rows = prints.select("fp", shard.alias("s")).select("fp", "s.kind", "s.shard")
    shared = rows.groupBy("kind", "shard").agg(F.count("*").alias("n")).where("n > 1")
    trees = written(
        rows.join(shared, ["kind", "shard"])
        .withColumn("tree", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tree_size)))
        .groupBy("kind", "shard", "tree")
        .agg(F.collect_list("fp").alias("fps")),
        "bk_trees",
    )
    others = trees.select("kind", "shard", F.col("tree").alias("block"), F.col("fps").alias("asked"))
    pairs = trees.join(others, ["kind", "shard"]).where("tree <= block").select("fps", "asked")
    return pairs.mapInArrow(_link_batches(radius), "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``radius`` bits, and
    component_id is the least doc_id reachable over links. Null and empty texts have
    fingerprint 0 and are linked like any other; repeated rows get the same component. A
    null doc_id never is a component_id unless no document of the component has one.
    Equal fingerprints are one node, so large groups of copies cost one node and are
    joined back by fingerprint.
    """
    prints = written(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = written(components(links(nodes.select("fp"), radius)), "components")
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller doc_id.

    Columns are kept as they are. Rows that share a doc_id are one document and stay or go
    together; documents without a doc_id stay only if no document of their group has one.
    """
    gone = (
        near_duplicates(docs, radius)
        .where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("gone_id"))
        .distinct()
    )
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["gone_id"])
    return docs.join(gone, same, "left_anti")

"""How filters interact: what each one removes in every order, from one tensor of counts per part.

Each document fails or passes five filters, which is a cell of a 2x2x2x2x2 tensor per part. Spark
makes the tensors: one pass over the texts, one aggregate over equal texts, one over the parts.
All 120 orders are then sums over the tensor: along each axis a step takes the documents that
pass, those that fail, or all of them, which one ``einsum`` does for all steps of a part.
"""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import filled

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
MARKS = b"#$%&*|"
UPPER = string.ascii_uppercase.encode()
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MEASURES = ("documents", "good", "toxic")
RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_failures(text: str | None) -> int:
    """Bits 0 to 3: the filters A to D that a text fails, from counts of the whole text.

    >>> [text_failures(t) for t in (None, "ABC", "w " * 50, "#")]
    [1, 5, 2, 9]
    """
    data = (text or "").encode()
    words = data.split()  # exactly at the bytes 09-0D and 20
    upper = len(data) - len(data.translate(None, UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > MAX_UPPER_PERCENT * len(text or "")) << 2
        | (len(data.translate(None, MARKS)) < len(data)) << 3
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts, texts = batch.columns
        found = [(text_failures(t), hashlib.sha256((t or "").encode()).digest()) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [ids, parts, pa.array([f for f, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())],
            names=["doc_id", "part", "fails", "digest"],
        )


def cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """Documents, good ones and toxic ones per part and cell (bit i: filter i fails).

    Texts count as identical when their SHA-256 is the same. Identical texts share A to D, so per
    part and labels only their smallest doc_id and how many rows have it matter: groups of copies
    shrink before they are shuffled by text. A null doc_id is neither smaller nor larger than any.
    A document with several rows of labels is good (toxic) if any of them says so.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), filled(part).alias("part"), F.col("text").cast("string"))
    judged = rows.mapInArrow(_judged, "doc_id bigint, part string, fails int, digest binary")
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("int").alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("int").alias("toxic"),
        )
        .where("good + toxic > 0")
    )
    marked = judged.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    alike = ("digest", "part", "fails", "good", "toxic")
    same_id = marked.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    groups = same_id.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    joined = groups.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    is_first = F.coalesce(F.col("least") == F.col("first"), F.lit(False))
    fresh = F.col("n_null") + F.when(is_first, F.col("n_least")).otherwise(0)
    halves = F.array(
        F.struct(F.col("fails").alias("cell"), fresh.alias("n")),
        F.struct((F.col("fails") + 16).alias("cell"), (F.col("n") - fresh).alias("n")),
    )
    return (
        joined.select("part", "good", "toxic", F.inline(halves))
        .groupBy("part", "cell")
        .agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    )


def _choices() -> tuple[np.ndarray, ...]:
    """For each order and step, along each axis: the weights of (pass, fail) that a measure sums."""
    takes = {"pass": (1, 0), "fail": (0, 1), "all": (1, 1)}
    kept, removed, failing, alone = [], [], [], []
    for order in ORDERS:
        for step, name in enumerate(order):
            before = order[:step]
            for out, own, earlier, later in (
                (kept, "pass", "pass", "all"),
                (removed, "fail", "pass", "all"),
                (failing, "fail", "all", "all"),
                (alone, "fail", "pass", "pass"),
            ):
                out.append([takes[own if f == name else earlier if f in before else later] for f in FILTERS])
    return tuple(np.array(x, dtype=np.int64) for x in (kept, removed, failing, alone))


def contracted(tensor: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Sums over 2x2x2x2x2 tensors (axis A first), one for each row of axis weights."""
    return np.einsum("...abcde,na,nb,nc,nd,ne->...n", tensor, *np.moveaxis(choice, 1, 0), optimize="greedy")


def steps_of(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of all orders and steps from the tensors of documents, good and toxic ones."""
    kept, removed, failing, alone = (contracted(tensors, c) for c in _choices())
    letters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    totals = np.zeros(len(FILTERS), dtype=np.int64)
    np.add.at(totals, letters, removed[0])
    return {
        "kept": kept[0],
        "removed": removed[0],
        "redundant": failing[0] - removed[0],
        "unique_fails": alone[0],
        "good_lost": removed[1],
        "toxic_lost": removed[2],
        "shapley": totals[letters],
    }


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(ORDERS) * len(FILTERS)
    for batch in batches:
        for part, filled_cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tensors = np.zeros((len(MEASURES), 2 ** len(FILTERS)), dtype=np.int64)
            for cell in filled_cells:
                tensors[:, cell["cell"]] = [cell[m] for m in MEASURES]
            # bit 0 is filter A: the last axis of a C-ordered reshape is the lowest bit
            axes = tensors.reshape(len(MEASURES), 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
            columns = [pa.array([part] * size), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist())]
            columns.append(pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))))
            found = steps_of(axes)
            names = ["part", "filter_order", "step", *found]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v) for v in found.values()], names=names)


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    ``part`` defaults to ``source``; null and empty are one part. Null texts are empty: they fail
    A, and E if a smaller doc_id has an empty text too. Rows repeated with one doc_id do not fail
    E for each other. No documents give no rows; further columns are not read.
    """
    whole = cells(docs, labels, F.col("source") if part is None else part)
    per_part = whole.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))
    return per_part.mapInArrow(_reports, RESULT)

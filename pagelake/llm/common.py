"""Helpers shared by the operators: folded text, batches of texts, held-out rows."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def filled(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty."""
    return F.translate(filled(text), string.ascii_uppercase, string.ascii_lowercase)


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns that batch functions read."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def text_slices(
    batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of consecutive rows, about ``limit`` bytes of text at a time.

    A longer text is a slice of its own, so memory is bounded by the longest text.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield ids.slice(start, end - start), texts.slice(start, end - start).to_pylist()


def id_remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``; null without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor

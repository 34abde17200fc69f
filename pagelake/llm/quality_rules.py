"""Quality rules: counts of words, symbols and repeats, then bands of zstandard ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW_WORDS = 3

ZSTD_LEVEL = 3
CHUNK_BYTES = 4096
MIN_CHUNK_BYTES = 1024
"""A shorter last chunk is joined to the one before."""
MAX_BAD_CHUNKS = 0.2
"""A text goes if more than this share of its chunks lies outside the band of a chunk."""
BANDS = (
    (362, 0.25, 0.866), (512, 0.25, 0.820), (724, 0.25, 0.786), (1024, 0.25, 0.767), (1448, 0.20, 0.753), (2048, 0.20, 0.744),
    (2896, 0.20, 0.592), (4096, 0.20, 0.587), (16384, 0.15, 0.583), (32768, 0.10, 0.530), (None, 0.10, 0.504),
)
"""(texts shorter than so many bytes, least ratio, greatest ratio) of compressed to whole size.

A greatest ratio is 0.01 below what random words of eight characters reach at the upper end of the
band (least of twelve seeds): words of 64 characters (0.754 at 2048 bytes), from 2048 bytes on of 26 letters
(0.602 at 2896, 0.593 at 8192), from 32768 on of 16 hex digits (0.514). A text as hard to compress as that
has no words, only characters. Natural texts stay below: of 461 licence, copyright and documentation texts
of one machine and their chunks (none of them test data), the largest had 0.743 below 512 bytes, 0.720 below 2048,
0.586 below 2896, 0.573 in chunks of 4096, 0.565 below 16384 and 0.417 beyond. Between 16384 and 32768 bytes the limit
leaves room for prose. Short texts carry zstandard's tables, so the ratio falls with the length.
"""
EAST_ASIAN_BANDS = (
    (724, 0.25, 0.90), (1024, 0.25, 0.83), (2048, 0.20, 0.80), (2896, 0.20, 0.72), (4096, 0.20, 0.68), (8192, 0.15, 0.65),
    (16384, 0.15, 0.60), (32768, 0.10, 0.55), (None, 0.10, 0.50),
)
"""The same for texts most of whose bytes are Han, kana or Hangul: three bytes each, of thousands of
characters. 0.024 or more above the largest of translated program messages in Chinese, Japanese and Korean, at
eight lengths from 500 bytes to 60 KB."""

RESULT = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint,"
    " n_repeat_words: bigint, ratio: double, n_chunks: bigint, n_bad_chunks: bigint,"
    " base_failed: boolean, kept: boolean>"
)
_ARROW_RESULT = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)
_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_EAST_ASIAN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]+")
_SPACE_BYTES = b"\t\n\v\f\r "


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that the text has twice or more, each word once."""
    grams = list(zip(*(words[i:] for i in range(WINDOW_WORDS)), strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered, total = 0, 0
    for start, gram in enumerate(grams):
        if counts[gram] > 1:
            total += start + WINDOW_WORDS - max(start, covered)
            covered = start + WINDOW_WORDS
    return total


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE_BYTES)]
    return len(lines) - len(set(lines))


def in_band(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    """Whether the ratio is usual for a text of that many bytes."""
    for below, least, most in bands:
        if below is None or n_bytes < below:
            return least <= ratio <= most
    return True


def bands_of(text: str, n_bytes: int):
    """The bands that hold for a text's script."""
    if 2 * n_bytes <= 3 * len(text):  # too few bytes for half of them to be in threes
        return BANDS
    return EAST_ASIAN_BANDS if 6 * sum(map(len, _EAST_ASIAN.findall(text))) > n_bytes else BANDS


def chunk_bounds(n_bytes: int) -> list[tuple[int, int]]:
    starts = list(range(0, n_bytes, CHUNK_BYTES))
    if len(starts) > 1 and n_bytes - starts[-1] < MIN_CHUNK_BYTES:
        starts.pop()
    return list(zip(starts, [*starts[1:], n_bytes][: len(starts)], strict=True))


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    """The fields of ``RESULT`` for one text; null counts as empty and has ratio 0."""
    data = (text or "").encode()
    words = data.split()
    n_words, n_repeat = len(words), repeated_words(words)
    characters = sum(len(w) for w in words) if len(data) == len(text or "") else sum(len(w.decode()) for w in words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    ratio = len(compressor.compress(data)) / len(data) if data else 0.0
    chunks = chunk_bounds(len(data))
    bad, bands = 0, bands_of(text or "", len(data))
    for start, end in chunks if len(chunks) > 1 else []:
        bad += not in_band(end - start, len(compressor.compress(data[start:end])) / (end - start), bands)
    kept = not failed and in_band(len(data), ratio, bands) and bad <= MAX_BAD_CHUNKS * len(chunks)
    symbols = sum(map(len, _SYMBOLS.findall(text or "")))
    return n_words, characters, symbols, duplicate_lines(data), n_repeat, ratio, len(chunks), bad, failed, kept


def measured(text: Column) -> Column:
    """Struct of the counts, ratios and verdicts of a text, as ``RESULT`` lists them.

    A null or empty text has no words, so it fails the base rules. Each row is judged by
    itself: repeated rows get the same verdict.
    """

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressor = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        names = [field.name for field in _ARROW_RESULT]
        for texts in batches:
            rows = [dict(zip(names, measure(t.as_py(), compressor), strict=True)) for t in texts]
            yield pa.array(rows, _ARROW_RESULT)

    return run(text.cast("string"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, measures of the text): one row per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("bigint"), measured(F.col("text")).alias("m")).select("doc_id", "m.*")


def passing(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that a rule rejects, columns as they are."""
    return docs.where(measured(F.col("text"))["kept"])

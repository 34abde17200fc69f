"""Quality scores: random Fourier features of text statistics, ridge and isotonic regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import id_remainder, text_slices, texts_of
from pagelake.session import written

N_FEATURES = 192
RIDGE = 1e-3
SUMMED_GROUPS = 16
SCORE_BINS = 400
SEED = 7
HELD_OUT_DIVISOR = 5
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "log_chars", "mean_word", "upper", "digits", "punctuation", "exclamations", "symbols", "non_ascii",
    "distinct_words", "top_word", "repeat_pairs", "lines_per_word", "duplicate_lines", "short_words", "long_words",
    "vowels", "byte_entropy",
)
_BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "punctuation": b".,;:!?\"'()[]{}-",
    "exclamations": b"!?", "symbols": b"#*$%&|<>=_/\\@^~`+", "vowels": b"aeiouAEIOU",
}
_CLASS_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _BYTE_CLASSES.items()}


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for one text; all are finite, also for null and empty texts."""
    data = (text or "").encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    bytes_seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = bytes_seen[bytes_seen > 0] / size
    found = {k: float(bytes_seen[mask].sum()) / size for k, mask in _CLASS_MASKS.items()}
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    found |= {
        "log_words": float(np.log1p(len(words))),
        "log_chars": float(np.log1p(len(data))),
        "mean_word": float(lengths.sum()) / n,
        "non_ascii": float(bytes_seen[128:].sum()) / size,
        "distinct_words": len(counts) / n,
        "top_word": max(counts.values(), default=0) / n,
        "repeat_pairs": 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        "lines_per_word": len(lines) / n,
        "duplicate_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "short_words": float((lengths <= 2).sum()) / n,
        "long_words": float((lengths >= 12).sum()) / n,
        "byte_entropy": float(-(share * np.log2(share)).sum()),
    }
    return [found[name] for name in STATISTICS]


def _statistic_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_slices(batches):
        rows = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([ids, rows], names=["doc_id", "stats"])


@dataclass
class Model:
    """Scale of the statistics, random frequencies, ridge weights, calibrated steps."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(w x + b) with Gaussian w: inner products approximate a Gaussian kernel."""
        return fourier((stats - self.centre) / self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.edges, self.levels)


def fourier(scaled: np.ndarray, n: int = N_FEATURES, seed: int = SEED) -> np.ndarray:
    """``n`` random Fourier features and a constant; the kernel's width follows the dimension."""
    draw = np.random.default_rng(seed)
    frequencies = draw.normal(size=(scaled.shape[1], n)) / np.sqrt(scaled.shape[1])
    phases = draw.uniform(0, 2 * np.pi, n)
    waves = np.sqrt(2.0 / n) * np.cos(np.clip(scaled, -8, 8) @ frequencies + phases)
    return np.hstack([waves, np.ones((len(scaled), 1))])


def _normal_sums(centre: np.ndarray, scale: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = fourier((_matrix(batch.column("stats")) - centre) / scale)
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                gram, target = gram + x.T @ x, target + x.T @ y
        if not np.isscalar(gram):
            row = np.hstack([gram, target[:, None]]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([row.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _matrix(stats: pa.Array) -> np.ndarray:
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), len(STATISTICS))


def isotonic(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weighted means in non-decreasing order: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for value, count in zip(values, counts, strict=True):
        pools.append([value, count, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v, c, n = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * c) / (pools[-1][1] + c), pools[-1][1] + c, pools[-1][2] + n]
    return np.array([v for v, _, n in pools for _ in range(int(n))])


def _scores(model: Model, calibrated: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _matrix(batch.column("stats"))
            scores = model.score(stats) if calibrated else model.raw(stats)
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "stats"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(scores)], names=[n for n, _ in kept] + ["score"])

    return run


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows: stats (doc_id, stats), labels (doc_id, label 0 or 1).

    Means and spreads are aggregates; the normal equations are summed in each of
    ``SUMMED_GROUPS`` groups of rows, so the driver adds up that many small matrices whatever
    the number of rows; calibration pools ``SCORE_BINS`` bins of equally wide scores. Without
    labelled rows every score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("double").alias("label")).dropna()
    rows = stats.join(known, "doc_id")
    each = [F.col("stats")[i] for i in range(len(STATISTICS))]
    moments = rows.agg(F.count("*").alias("n"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not moments[0]:
        empty = np.zeros(0)
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), empty, empty, empty)
    centre, spread = np.array(moments[1:], float).reshape(2, -1)
    scale = np.where(spread > 1e-9, spread, 1.0)
    parts = rows.repartition(SUMMED_GROUPS, F.xxhash64("doc_id")).select("stats", "label")
    size = N_FEATURES + 1
    total = np.zeros((size, size + 1))
    for row in parts.mapInArrow(_normal_sums(centre, scale), "sums array<double>").collect():
        total += np.array(row["sums"]).reshape(size, size + 1)
    weights = np.linalg.solve(total[:, :size] + RIDGE * moments[0] / N_FEATURES * np.eye(size), total[:, size])
    model = Model(centre, scale, weights, np.zeros(0), np.zeros(0))
    raw = rows.select("stats", "label").mapInArrow(_scores(model, False), "label double, score double")
    bins = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("score"))) * (SCORE_BINS / 2)).alias("bin")
    found = sorted(tuple(r) for r in raw.groupBy(bins).agg(F.avg("score"), F.avg("label"), F.count("*")).collect())
    _, edges, means, counts = np.array(found, float).T
    model.edges, model.levels = edges, np.clip(isotonic(means, counts), 0, 1)
    return model


def held_out(divisor: int = HELD_OUT_DIVISOR) -> Column:
    """Rows no label of which is learned; a row without a doc_id is one."""
    return F.coalesce(id_remainder(divisor) == 0, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``.

    The score depends on the text alone; repeated rows get the same one. A null or empty
    text has statistics of its own and a score like any other. A null label is not learned,
    and a doc_id with several labels counts once for each.
    """
    stats = written(texts_of(docs).mapInArrow(_statistic_batches, "doc_id bigint, stats array<double>"), "text_statistics")
    model = fit(stats.where(~held_out()), labels.select("doc_id", F.col(label).alias("label")))
    scores = stats.select("doc_id", held_out().alias("held_out"), "stats").mapInArrow(
        _scores(model, True), "doc_id bigint, held_out boolean, score double"
    )
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

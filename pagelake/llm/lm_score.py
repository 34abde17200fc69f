"""Language-model scores: pseudo-likelihood of every word given the words on both sides."""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import filled, text_slices, texts_of
from pagelake.session import written

OWN_CLASSES = 96
"""The most frequent words are classes of their own."""
TAIL_CLASSES = 31
"""Other words are classed by their last letters."""
VOCABULARY = 20_000
"""Words whose counts are broadcast; those of all other words are looked up by a join."""
ENDINGS = 100_000
"""Last letters whose class a task remembers."""
WINDOW = (-2, -1, 1, 2)
HIDDEN = 24
ROUNDS = 2
BATCH = 4096
BLOCK = 512
"""Rows of a batch that are worked on at once, so that their scores stay in a core's cache."""
LEARNING_RATE = 0.5
SAFE_SCORE = 80.0
"""Exponentials up to here, and sums of a row of them, fit 32-bit floats; hidden values are within one."""
SUMMED_GROUPS = 16
SEED = 11

EDGE = 0
"""Class of the places before the first and after the last word."""
N_CLASSES = 1 + OWN_CLASSES + TAIL_CLASSES


def tail_class(word: bytes) -> int:
    return 1 + OWN_CLASSES + zlib.crc32(word[-3:]) % TAIL_CLASSES


class _Tails(dict):
    """Class of words by their last letters; so many endings are remembered."""

    def __missing__(self, ending: bytes) -> int:
        found = tail_class(ending)
        if len(self) < ENDINGS:
            self[ending] = found
        return found


class Lexicon:
    """Classes of words, and log p(word | class): of the listed words with their counts, of any
    other as if it had been seen once. ``counts`` is the table (word, n) of all words."""

    def __init__(self, words: dict[bytes, tuple[int, float]], rare: np.ndarray, counts: DataFrame | None = None):
        self.words, self.rare, self.counts = words, rare, counts
        self._place = {w: N_CLASSES + i for i, w in enumerate(words)}
        self._tails = _Tails()
        self._classes = np.array([*range(N_CLASSES), *(c for c, _ in words.values())], np.int64)
        self._logs = np.array([*rare, *(p for _, p in words.values())])

    @staticmethod
    def split(text: str | None) -> list[bytes]:
        """Words in lower case (A-Z)."""
        return (text or "").encode().lower().split()

    def places(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in the tables of classes and logarithms; a word that is not listed has that of its class."""
        found = np.fromiter(map(self._place.get, words, repeat(-1)), np.int32, len(words))
        others = np.flatnonzero(found < 0)
        found[others] = [self._tails[words[i][-3:]] for i in others.tolist()]
        return found

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._classes[places], self._logs[places]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Class and log p(word | class) of each word."""
        return self.at(self.places(self.split(text)))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, from a histogram of counts.

    Counts are binned by their first 12 bits, so the driver sees a bounded number of bins.
    """
    digits = F.length(F.bin("n"))
    shift = F.greatest(digits - 12, F.lit(0))
    low = F.floor(F.col("n") / F.pow(F.lit(2), shift)).cast("bigint") * F.pow(F.lit(2), shift).cast("bigint")
    bins = counts.groupBy(low.alias("low")).agg(F.count("*").alias("words")).collect()
    least, seen = 1 << 62, 0
    for row in sorted(bins, key=lambda b: -b["low"]):
        seen += row["words"]
        if seen > most:
            break
        least = row["low"]
    return least


def lexicon(docs: DataFrame) -> Lexicon:
    """From the counts of all words of all rows.

    Counting combines before the shuffle. The driver sees the most frequent words, at most ``VOCABULARY``, and
    a sum for each class; the counts of all words stay in a stored table. Words of one
    count are listed together or not at all; those not listed are looked up by a join.
    """
    # lower case and white space in one pass; one character is split without a pattern
    spaced = F.translate(filled(F.col("text")), string.ascii_uppercase + "\t\n\v\f\r", string.ascii_lowercase + " " * 5)
    words = docs.select(F.explode(F.split(spaced, " ")).alias("word")).where("word <> ''")
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "word_counts")
    frequent = counts.where(F.col("n") >= _least_count(counts, VOCABULARY)).collect()
    top = sorted(((r["word"].encode(), r["n"]) for r in frequent), key=lambda w: (-w[1], w[0]))
    last_bytes = F.substring(F.encode("word", "utf-8"), -3, 3)  # binary; right() would give characters
    tail = F.crc32(last_bytes) % TAIL_CLASSES + (1 + OWN_CLASSES)
    mass = np.zeros(N_CLASSES)
    for row in counts.groupBy(tail.cast("int").alias("c")).agg(F.sum("n").alias("n")).collect():
        mass[row["c"]] = row["n"]
    for word, n in top[:OWN_CLASSES]:
        mass[tail_class(word)] -= n
    listed: dict[bytes, tuple[int, float]] = {w: (1 + i, 0.0) for i, (w, _) in enumerate(top[:OWN_CLASSES])}
    total = mass + 1.0  # one count is left for words never seen
    for word, n in top[OWN_CLASSES:]:
        c = tail_class(word)
        listed[word] = c, float(np.log(n / total[c]))
    return Lexicon(listed, -np.log(total), counts)


class Network:
    """Classes in the window, each with weights by place, a hidden tanh layer, a softmax."""

    def __init__(self, flat: np.ndarray | None = None):
        self.shapes = [(len(WINDOW), N_CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, N_CLASSES), (N_CLASSES,)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            draw = np.random.default_rng(SEED)
            flat = np.concatenate([draw.normal(0, 0.1, n) if len(s) > 1 else np.zeros(n) for s, n in zip(self.shapes, sizes, strict=True)])
        self.flat = flat.astype(np.float32)
        parts = np.split(self.flat, np.cumsum(sizes)[:-1])
        self.context, self.hidden_bias, self.out, self.out_bias = (p.reshape(s) for p, s in zip(parts, self.shapes, strict=True))

    def powers(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For rows of classes around a word: hidden values, scores of the classes, their
        exponentials, and the sums of these. Scores that could overflow are lowered by the
        best of their row."""
        hidden = self.context[0].take(around[:, 0], axis=0)
        for i in range(1, len(WINDOW)):
            hidden += self.context[i].take(around[:, i], axis=0)
        hidden += self.hidden_bias
        np.tanh(hidden, out=hidden)
        scores = hidden @ self.out
        scores += self.out_bias
        if (np.abs(self.out).sum(axis=0) + np.abs(self.out_bias)).max() > SAFE_SCORE:
            scores -= scores.max(axis=1, keepdims=True)
        powers = np.exp(scores)
        return hidden, scores, powers, (powers @ np.ones(N_CLASSES, np.float32))[:, None]

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden values, log-probabilities of the classes) for rows of classes around a word."""
        hidden, scores, _, sums = self.powers(around)
        return hidden, scores - np.log(sums)

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each row's class ``target``."""
        found = np.empty(len(target))
        for start in range(0, len(target), BLOCK):
            rows = slice(start, start + BLOCK)
            _, scores, _, sums = self.powers(around[rows])
            found[rows] = scores[np.arange(len(scores)), target[rows]] - np.log(sums[:, 0])
        return found

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float = LEARNING_RATE) -> None:
        """One step of gradient descent."""
        n = len(target)
        below, out, out_bias = np.empty((n, HIDDEN), np.float32), np.zeros_like(self.out), np.zeros_like(self.out_bias)
        for start in range(0, n, BLOCK):
            rows = slice(start, start + BLOCK)
            hidden, _, slope, sums = self.powers(around[rows])
            slope /= sums
            slope[np.arange(len(slope)), target[rows]] -= 1
            below[rows] = (slope @ self.out.T) * (1 - hidden * hidden)
            out += hidden.T @ slope
            out_bias += slope.sum(axis=0)
        step = rate / n
        self.out -= step * out
        self.out_bias -= step * out_bias
        self.hidden_bias -= step * below.sum(axis=0)
        for i in range(len(WINDOW)):
            order = np.argsort(around[:, i].astype(np.int16), kind="stable")
            column = around[order, i]
            first = np.flatnonzero(np.diff(column, prepend=-1))
            self.context[i][column[first]] -= step * np.add.reduceat(below.take(order, axis=0), first, axis=0)


def windows(classes: list[np.ndarray]) -> np.ndarray:
    """Rows of the classes around each word of each text; a text's ends see ``EDGE``."""
    reach = max(abs(p) for p in WINDOW)
    gap = np.full(reach, EDGE, np.int64)
    line = np.concatenate([gap, *(part for c in classes for part in (c, gap))])
    places = np.concatenate([np.zeros(0, np.int64), *_places(classes, reach)])
    return np.stack([line[places + p] for p in WINDOW], axis=1)


def _places(classes: list[np.ndarray], reach: int) -> list[np.ndarray]:
    out, at = [], reach
    for c in classes:
        out.append(np.arange(at, at + len(c)))
        at += len(c) + reach
    return out


def _training(shared, flat: np.ndarray, turn: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net, seen = Lexicon(*shared.value), Network(flat), 0
        for ids, texts in text_slices(batches):
            classes = [words.read(t)[0] for i, t in zip(ids.to_pylist(), texts, strict=True) if (i or 0) // 7 % ROUNDS == turn]
            if not sum(map(len, classes)):
                continue
            around, target = windows(classes), np.concatenate(classes)
            order = np.random.default_rng(SEED + len(target)).permutation(len(target))
            for start in range(0, len(order), BATCH):
                part = order[start : start + BATCH]
                net.learn(around[part], target[part])
            seen += len(target)
        if seen:
            value = (net.flat.astype(np.float64) * seen).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(seen)]), pa.array([value], pa.list_(pa.float64()))], names=["seen", "weights"]
            )

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total = 0.0, 0.0
    for batch in batches:
        for n, weights in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen, total = seen + n, total + weights.values.to_numpy()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["seen", "weights"])


def train(docs: DataFrame, words: Lexicon) -> Network:
    """A network trained on all rows: in each round every task trains on its share of them from
    the same start, and the weights are averaged by the number of words seen.

    Each row is read in one of the ``ROUNDS``. Task results are added up in
    ``SUMMED_GROUPS`` tasks, so the driver sees that many networks of a fixed size.
    """
    net = Network()
    shared = docs.sparkSession.sparkContext.broadcast((words.words, words.rare))
    for turn in range(ROUNDS):
        trained = texts_of(docs).mapInArrow(_training(shared, net.flat, turn), "seen double, weights array<double>")
        parts = trained.repartition(SUMMED_GROUPS).mapInArrow(_summed, "seen double, weights array<double>").collect()
        if parts:
            net = Network(np.sum([p["weights"] for p in parts], axis=0) / sum(p["seen"] for p in parts))
    return net


def _score_batches(shared, flat: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = Lexicon(*shared.value), Network(flat)
        for ids, texts in text_slices(batches):
            classes, own, others, times, first = [], [], [], [], [0]
            for text in texts:
                split = words.split(text)
                places = words.places(split)
                unlisted = Counter([split[i] for i in np.flatnonzero(places < N_CLASSES).tolist()])
                others += unlisted.keys()
                times += unlisted.values()
                first.append(len(others))
                for column, part in zip((classes, own), words.at(places), strict=True):
                    column.append(part)
            logs = net.log_probability(windows(classes), np.concatenate(classes)) + np.concatenate(own)
            ends = np.cumsum([len(c) for c in classes])
            sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[np.concatenate([[0], ends])])
            unlisted = pa.MapArray.from_arrays(pa.array(first, pa.int32()), pa.array(others, pa.string()), pa.array(times, pa.int64()))
            columns = [ids, pa.array([len(c) for c in classes], pa.int64()), pa.array(sums), unlisted]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "log_likelihood", "unlisted"])

    return run


_SCORED = "doc_id bigint, n_words bigint, log_likelihood double, unlisted map<string, bigint>"


def score(docs: DataFrame, words: Lexicon, net: Network) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood): one row per row of ``docs``.

    The sum over all words of the whole text of the log-probability given two words on each
    side. A null or empty text has no words, sum 0 and a null mean. Repeated rows get the
    same score.

    A task takes words that are not broadcast for seen once and passes them on; the logarithms
    of their counts come from the table of all words. Rows are stored before they get numbers
    that the sums meet by, since a second run may deal out tasks anew.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words.words, words.rare))
    scored = texts_of(docs).mapInArrow(_score_batches(shared, net.flat), _SCORED)
    found = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm_scored")
    others = found.select("row", F.explode("unlisted").alias("word", "times"))
    counted = others.hint("merge").join(words.counts.where("n > 1"), "word")  # the logarithm of one is zero
    added = counted.select(
        "row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_words"),
        (F.col("times") * F.log("n")).alias("log_likelihood"),
    )
    sums = found.select("row", "doc_id", "n_words", "log_likelihood").unionByName(added).groupBy("row")
    whole = sums.agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words")], F.sum("log_likelihood").alias("log_likelihood")).drop("row")
    return whole.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))

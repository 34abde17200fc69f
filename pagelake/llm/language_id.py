"""Language of texts: scripts narrow the candidates, Viterbi labels spans of words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import id_remainder, text_slices

HELD_OUT_DIVISOR = 3
HELD_OUT_REMAINDER = 1
GRAM_SIZES = (1, 2, 3)
CODE_BITS = 21
MAX_GRAMS = 4000
"""N-grams kept of each language, the most frequent; this bounds the model that is broadcast."""
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
MIN_SCRIPT_SHARE = 0.001
COUNTED_WORDS = 200_000
CACHED_WORDS = 200_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\s\d_.,;:!?\"'()\[\]{}<>|/\\*#$%&=+@^~`-]+")

#: Scripts by ranges of code points.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x2FA1F),
)


def script(letter: str) -> str:
    """Script of a letter; empty for other characters, ``other`` beyond the ranges."""
    if not letter.isalpha():
        return ""
    code = ord(letter)
    return next((name for name, first, last in SCRIPTS if first <= code <= last), "other")


def words_of(text: str | None) -> list[str]:
    """Lower-case words; digits and ASCII punctuation separate them."""
    return _WORD.findall((text or "").lower())


@dataclass
class Letters:
    """Code points of many words, a space before and after each."""

    codes: np.ndarray
    owner: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Letters:
        codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        return cls(codes, np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the n-grams inside words; a key holds 21 bits of each code point."""
        n = max(0, len(self.codes) - size + 1)
        places = np.flatnonzero(self.owner[:n] == self.owner[size - 1 :])
        keys = np.zeros(len(places), np.int64)
        for i in range(size):
            keys = keys << CODE_BITS | self.codes[places + i]
        return places, keys

    def scripts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(names, place among the names of each word's first letter, number of letters of each word).

        The first name is the empty one, of words without a letter.
        """
        seen, place = np.unique(self.codes, return_inverse=True)
        of_seen = [script(chr(c)) for c in seen.tolist()]
        names = ["", *sorted(set(of_seen) - {""})]
        kinds = np.array([names.index(k) for k in of_seen], np.int64)[place]
        at = np.where(kinds > 0, np.arange(len(kinds)), len(kinds))
        first = np.minimum.reduceat(at, self.starts)
        return names, np.append(kinds, 0)[first], np.add.reduceat((kinds > 0).astype(np.int64), self.starts)


def gram_key(gram: str) -> int:
    key = 0
    for character in gram:
        key = key << CODE_BITS | ord(character)
    return key


def gram_of(key: int) -> str:
    """The n-gram of a key; no word holds a character of code 0."""
    out = ""
    while key:
        out, key = chr(key & (1 << CODE_BITS) - 1) + out, key >> CODE_BITS
    return out


def _counts(words: Counter) -> Iterator[tuple[str, str, int]]:
    """(kind, item, n) of the scripts and n-grams of counted words."""
    letters, n = Letters.of(list(words)), np.fromiter(words.values(), np.int64, len(words))
    names, kinds, _ = letters.scripts()
    yield from (("script", name, int(c)) for name, c in zip(names, np.bincount(kinds, n, len(names)), strict=True) if c)
    for size in GRAM_SIZES:
        places, keys = letters.grams(size)
        seen, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, n[letters.owner[places]], len(seen))
        yield from (("gram", gram_of(key), int(c)) for key, c in zip(seen.tolist(), sums, strict=True))


def _gram_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams and scripts by language; words are counted first, n-grams per distinct word."""
    words: dict[str, Counter] = defaultdict(Counter)

    def counted() -> pa.RecordBatch:
        rows = [(lang, *row) for lang, seen in words.items() if seen for row in _counts(seen)]
        words.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "kind", "item", "n"])

    for langs, texts in text_slices(batches):
        for lang, text in zip(langs.to_pylist(), texts, strict=True):
            words[lang].update(words_of(text))
        if sum(map(len, words.values())) > COUNTED_WORDS:
            yield counted()
    yield counted()


@dataclass
class Model:
    """Log-probabilities of n-grams by language, and the languages of each script."""

    langs: list[str]
    grams: dict[str, np.ndarray]
    missing: np.ndarray
    scripts: dict[str, np.ndarray]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams in order, and their rows of log-probabilities, ``missing`` last."""
        keys = np.array([gram_key(g) for g in self.grams], np.int64)
        order = np.argsort(keys)
        logs = np.array([*self.grams.values(), self.missing], np.float32).reshape(len(keys) + 1, len(self.langs))
        return keys[order], logs[np.append(order, len(keys))]


class WordTable:
    """Scores and letters of the words met so far, each scored once.

    A score is the mean log-probability per n-gram, times the word's length; languages that
    do not write in the word's script are left out. A word without letters says nothing.
    """

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.logs = model.table()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """Place of each word in ``scores`` and ``letters``; new words are added."""
        if len(self.place) > CACHED_WORDS:
            self.clear()
        new = list(set(words).difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            scores, letters = self._scored(new)
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = Letters.of(words)
        names, kinds, counts = letters.scripts()
        total = np.zeros((len(words), len(self.model.langs)), np.float32)
        for size in GRAM_SIZES:
            places, keys = letters.grams(size)
            row = np.searchsorted(self.keys, keys)
            row[np.append(self.keys, -1)[row] != keys] = len(self.keys)
            owner = letters.owner[places]
            for i in range(len(self.model.langs)):
                total[:, i] += np.bincount(owner, self.logs[row, i], len(words)) / len(GRAM_SIZES)
        everywhere = np.ones(len(self.model.langs), bool)
        written = np.array([self.model.scripts.get(name, everywhere) for name in names])[kinds]
        scores = np.where(written, total, total.min(axis=1, keepdims=True) - 20.0)
        return np.where((kinds > 0)[:, None], scores, 0.0).astype(np.float32), counts


def fit(docs: DataFrame) -> Model:
    """Counts over all given rows (text, lang); the driver sees at most ``MAX_GRAMS`` n-grams,
    the most frequent, and the script counts of each language."""
    labelled = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = (
        labelled.mapInArrow(_gram_batches, "lang string, kind string, item string, n bigint")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("n").alias("n"))
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "item")))
    top = (
        counts.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(16)))
        .groupBy("lang", "kind", "salt")
        .agg(F.slice(ranked, 1, MAX_GRAMS).alias("top"), F.sum("n").alias("total"))
        .groupBy("lang", "kind")
        .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, MAX_GRAMS).alias("top"), F.sum("total").alias("total"))
    )
    found = {(r["lang"], r["kind"]): r for r in top.collect()}
    langs = sorted({lang for lang, _ in found})
    model = Model(langs, {}, np.zeros(len(langs), np.float32), {})
    for i, lang in enumerate(langs):
        total = found[lang, "gram"]["total"] + SMOOTHING * MAX_GRAMS
        model.missing[i] = np.log(SMOOTHING / total)
    for i, lang in enumerate(langs):
        total = found[lang, "gram"]["total"] + SMOOTHING * MAX_GRAMS
        for row in found[lang, "gram"]["top"]:
            model.grams.setdefault(row["item"], model.missing.copy())[i] = np.log((SMOOTHING - row["n"]) / total)
        written_in = found[lang, "script"]
        for row in written_in["top"]:
            if -row["n"] >= MIN_SCRIPT_SHARE * written_in["total"]:
                model.scripts.setdefault(row["item"], np.zeros(len(langs), bool))[i] = True
    return model


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """Best language of each word of each text, where a change of language costs ``penalty``.

    All texts advance together, word by word, the longest first; of equal paths the one that
    stays, then the first language, is taken.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order], np.int64)
    longest = int(sizes.max(initial=0))
    if not longest:
        return [np.zeros(0, np.int64) for _ in scores]
    active = np.cumsum(np.bincount(sizes, minlength=longest + 1)[::-1])[::-1][1:].tolist()  # texts that have each step
    ends = np.cumsum([0, *active])
    starts, ends = ends[:-1].tolist(), ends[1:].tolist()
    text = np.repeat(np.arange(len(sizes)), sizes)
    step_of = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text]
    row = np.array(starts, np.int64)[step_of] + text  # words of one step are neighbours
    width = scores[0].shape[1]
    by_step = np.zeros((len(text), width))
    by_step[row] = np.concatenate([scores[i] for i in order])
    stays = np.zeros(by_step.shape, bool)
    source = np.zeros(len(by_step), np.int64)
    state = np.zeros(active[0], np.int64)
    best = by_step[: len(state)]
    for step in range(1, longest):
        n, rows = active[step], slice(starts[step], ends[step])
        if n < len(best):
            state[n : len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        jump = best.max(axis=1, keepdims=True) - penalty
        best.argmax(axis=1, out=source[rows])
        np.greater_equal(best, jump, out=stays[rows])
        best = np.maximum(best, jump) + by_step[rows]
    state[: len(best)] = best.argmax(axis=1)
    labels, each, flat_stays = np.zeros(len(by_step), np.int64), np.arange(len(state)) * width, stays.reshape(-1)
    for step in range(longest - 1, -1, -1):
        n, first = active[step], starts[step]
        now = state[:n]
        labels[first : first + n] = now
        if step:
            kept = flat_stays[first * width + each[:n] + now]
            np.copyto(now, source[first : first + n], where=~kept)
    in_order = np.split(labels[row], np.cumsum(sizes)[:-1])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(order)
    for i, path in zip(order, in_order, strict=True):
        out[i] = path
    return out


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))


def _label_batches(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        table = WordTable(model)
        for ids, texts in text_slices(batches):
            split = [words_of(t) if model.langs else [] for t in texts]
            ends = np.cumsum([len(words) for words in split])
            places = table.places([w for words in split for w in words])
            scores = np.split(table.scores[places], ends[:-1])
            letters = np.split(np.where(_first_in_text(places, ends), table.letters[places], 0), ends[:-1])
            rows = [_labelled(model.langs, path, n) for path, n in zip(viterbi(scores), letters, strict=True)]
            columns = zip(*rows, strict=True)
            types = [pa.string(), pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "lang_pred", "score", "spans"]
            )

    return run


def _first_in_text(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a word first stands in its text: a line that fills a text over and over has one vote."""
    text = np.searchsorted(ends, np.arange(len(places)), side="right")
    _, first = np.unique(text * (places.max(initial=0) + 1) + places, return_index=True)
    out = np.zeros(len(places), bool)
    out[first] = True
    return out


def _labelled(langs: list[str], path: np.ndarray, letters: np.ndarray) -> tuple[str, float, list[dict]]:
    """The language with most letters (each word once), its share of them, and runs of words of one language."""
    if not letters.sum():
        return UNKNOWN, 0.0, []
    shares = np.bincount(path, weights=letters, minlength=len(langs))
    cuts = np.flatnonzero(np.diff(path)) + 1
    spans = [{"lang": langs[part[0]], "words": len(part)} for part in np.split(path, cuts)]
    return langs[int(shares.argmax())], float(shares.max() / shares.sum()), spans


def held_out() -> Column:
    """Rows from which nothing is learned; a row without a doc_id is one."""
    return F.coalesce(id_remainder(HELD_OUT_DIVISOR) == HELD_OUT_REMAINDER, F.lit(True))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans): one row per row of ``docs``.

    A null text, one without letters, or any text when no language was learned, is ``und``
    with score 0 and no spans. Repeated rows get the same result. ``spans`` are runs of words
    in the order of the text. The broadcast model is bounded by ``MAX_GRAMS`` per language.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.grams, model.missing, model.scripts))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _label_batches(shared), "doc_id bigint, lang_pred string, score double, spans array<struct<lang:string,words:int>>"
    )

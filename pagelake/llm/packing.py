"""Packing of tokenised documents into sequences by linear grouping and best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelake.llm.common import text_slices, texts_of
from pagelake.session import written

CAPACITY = 2048
END_ID = 0
LARGE_SHARE = 8
"""Lengths above a ``LARGE_SHARE``-th of the capacity are large."""
GROUPS = (24, 96, 192)
CACHED_WORDS = 400_000
MAX_COLUMNS = 1500


class WordEncoder:
    """Ids of texts, from the ids of their white-space separated words.

    The tokenizer drops white space and never joins characters across it, so a text's ids
    are those of its words in order. A word of Latin characters is lower-cased and cut here as
    the tokenizer's file says, and its parts go to the tokenizer's model; any other word goes
    through the whole tokenizer, as does one that holds an added token such as <|endoftext|>.
    With ``added_as_text`` added tokens are text like any other. Ids of at most ``CACHED_WORDS``
    words are remembered.
    """

    def __init__(self, path: str, added_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        self.added = () if added_as_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    @staticmethod
    def _words(text: str) -> list[str]:
        """Python also splits at four control characters that the tokenizer takes for symbols."""
        return _SOLID(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _part(self, part: str) -> bytes:
        # visible ASCII has its own names
        plain = part.isascii() and part.isprintable()
        found = self.model.tokenize(part if plain else part.encode().decode("latin-1").translate(_BYTE_NAMES))
        ids = self.known_parts[part] = b"".join([token.id.to_bytes(4, "little") for token in found])
        return ids

    def _learn(self, words: set[str], added: tuple[str, ...]) -> None:
        """Remember the ids of words; ``added`` are the added tokens that they may hold."""
        known, parts = self.known, self.known_parts
        if len(known) > CACHED_WORDS:
            known.clear()
            parts.clear()
        others = []
        for word in words.difference(known):
            if (word.isascii() or _LATIN(word)) and not (added and any(token in word for token in added)):
                low = word.lower()
                if low.isalpha():
                    known[word] = parts.get(low) or self._part(low)
                else:
                    known[word] = b"".join([parts.get(p) or self._part(p) for p in _cut(low)])
            else:
                others.append(word)
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            known[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        split = [self._words(text or "") for text in texts]
        self._learn(set().union(*split), tuple(t for t in self.added if any(t in text for text in texts if text)))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in split]


#: How the tokenizer's file cuts normalised words.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: Characters up to Latin Extended-B: composed already, with lower-case forms of their own.
_LATIN = regex.compile("[\0-\u024f]*").fullmatch




def _cut(word: str) -> list[str]:
    """Parts of a word; most are letters and one mark, and need no pattern."""
    return [word[:-1], word[-1]] if word[-1] in ".,;:!?" and word[:-1].isalpha() else _PARTS(word)


_SOLID = regex.compile(r"\S+").findall


def _byte_names() -> dict[int, int]:
    """Byte-level vocabularies write a byte as the character of that code if it is visible, and
    the others in order from code 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_NAMES = _byte_names()


_PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, task int, place bigint"
)
_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "place"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]


def _piece_batches(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordEncoder(path, added_as_text=False), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for ids, texts in text_slices(batches):
            rows = []
            for doc_id, tokens in zip(ids.to_pylist(), encoder.encode(texts), strict=True):
                data = tokens.tobytes() + int(end_id).to_bytes(4, "little")
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start : start + 4 * capacity]
                    length = len(part) // 4
                    rows.append((doc_id, piece, start // 4, length, part if with_ids else None, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=_PIECE_NAMES)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, task, place): documents cut to ``capacity``.

    ids are little-endian unsigned 32-bit integers; ``place`` counts the pieces of a length
    within the task that wrote them. Must be stored before use: a second run may deal out
    tasks anew.
    """
    return texts_of(docs).mapInArrow(_piece_batches(path, capacity, end_id, with_ids), _PIECES)


class Plan:
    """Where pieces go, as runs: ``count`` pieces of a length, by rank, to as many sequences."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        """(length, first rank, count, first sequence, offset)"""
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        """Sequences by free room: (first sequence, count)."""
        self._next_rank: dict[int, int] = defaultdict(int)

    def new(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        """The next ``count`` pieces of the length go to as many sequences from ``first``."""
        self.runs.append((length, self._next_rank[length], count, first, offset))
        self._next_rank[length] += count


def _best_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations of few sizes and how often each is used: the linear programme that covers
    the demand with fewest sequences, by column generation with a knapsack for each new column."""
    n = len(sizes)
    columns = [np.eye(n)[i] * (capacity // sizes[i]) for i in range(n)]
    basis = list(range(n))
    inverse = np.diag([1.0 / columns[i][i] for i in range(n)])
    for _ in range(MAX_COLUMNS * n):
        amounts = inverse @ demand
        prices = np.ones(n) @ inverse
        column, value = _knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-9:
            break
        change = inverse @ column
        ratios = np.where(change > 1e-12, amounts / np.maximum(change, 1e-12), np.inf)
        leaving = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaving]):
            break
        columns.append(column)
        basis[leaving] = len(columns) - 1
        pivot = inverse[leaving] / change[leaving]
        inverse = inverse - np.outer(change, pivot)
        inverse[leaving] = pivot
        if len(columns) > MAX_COLUMNS + n:
            break
    return [(columns[b], a) for b, a in zip(basis, inverse @ demand, strict=True)]


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest price, repeats allowed."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for i in np.argsort(-prices / sizes):
        if prices[i] <= 1e-12:
            break
        size = int(sizes[i])
        for start in range(size, capacity + 1, size):  # one more of this size each time
            end = min(start + size, capacity + 1)
            offer = best[start - size : end - size] + prices[i]
            better = offer > best[start:end] + 1e-12
            best[start:end][better] = offer[better]
            last[start:end][better] = i
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0 or best[room] == best[room - 1]:
            room -= 1
            continue
        column[last[room]] += 1
        room -= int(sizes[last[room]])
    return column, float(column @ prices)


class _Supply:
    """The pieces of one rounded length, longest first, handed out in runs of equal length."""

    def __init__(self, counts: dict[int, int]):
        self.left = sorted(counts.items(), reverse=True)

    def take(self, count: int) -> list[tuple[int, int]]:
        out = []
        while count and self.left:
            length, there = self.left.pop(0)
            n = min(count, there)
            out.append((length, n))
            if there > n:
                self.left.insert(0, (length, there - n))
            count -= n
        return out


def grouped(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, cut into groups of equally many pieces.

    A length with more pieces than a group is split between groups, so the groups' rounded
    lengths may repeat.
    """
    total = sum(n for _, n in large)
    bounds = [total * (i + 1) // groups for i in range(groups)]
    out: list[list[tuple[int, int]]] = [[]]
    done = 0
    for length, count in large:
        while count:
            room = bounds[len(out) - 1] - done
            if room <= 0:
                if len(out) == groups:
                    room = count
                else:
                    out.append([])
                    continue
            n = min(count, room)
            out[-1].append((length, n))
            done += n
            count -= n
    return [g for g in out if g]


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
    """Places for all pieces, from the number of pieces of each length (index 0 to capacity).

    Full pieces are sequences of their own. Large lengths are rounded up to the longest of
    their group, the groups having equally many pieces; the configurations of these few sizes
    that the linear programme uses are filled in whole numbers with actual pieces, all but
    the smallest of a configuration, whose room the piece that fits best is to take; what is
    left of the large ones and then all small ones go, longest first, where they fit best.
    Few groups waste room by rounding, many leave more to the last step, so each number of
    ``groups`` is tried and the plan with fewest sequences taken. The work depends on the
    capacity, not on the number of pieces.
    """
    return min((_plan(counts, capacity, n) for n in groups), key=lambda plan: plan.sequences)


def _plan(counts: np.ndarray, capacity: int, groups: int) -> Plan:
    plan = Plan(capacity)
    if counts[capacity]:
        plan.put(capacity, int(counts[capacity]), plan.new(int(counts[capacity])), 0)
    edge = capacity // LARGE_SHARE
    left = {length: int(counts[length]) for length in range(1, capacity) if counts[length]}
    large = [(length, n) for length, n in sorted(left.items(), reverse=True) if length > edge]
    if large:
        rounded: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for part in grouped(large, min(groups, sum(n for _, n in large))):
            for length, n in part:
                rounded[part[0][0]][length] += n
        tops = sorted(rounded, reverse=True)
        supplies = [_Supply(rounded[t]) for t in tops]
        demand = np.array([float(sum(rounded[t].values())) for t in tops])
        for column, amount in _best_columns(np.array(tops), demand, capacity):
            if times := int(amount + 1e-7):
                slots = [i for i, n in enumerate(column.astype(int)) for _ in range(n)]
                _fill(plan, left, [supplies[i].take(times) for i in slots[:-1] or slots], times)
    for length in sorted(left, reverse=True):
        _best_fit(plan, length, left[length])
    return plan


def _fill(plan: Plan, left: dict[int, int], slots: list[list[tuple[int, int]]], times: int) -> None:
    """``times`` sequences of one configuration, cut where the actual lengths change.

    A slot whose group has run out stays free.
    """
    first = plan.new(times)
    ends = [np.cumsum([n for _, n in slot], dtype=np.int64) for slot in slots]
    cuts = sorted({0, times, *(int(e) for end in ends for e in end)})
    for begin, end in zip(cuts, cuts[1:], strict=False):
        offset = 0
        for slot, until in zip(slots, ends, strict=True):
            at = int(np.searchsorted(until, begin, side="right"))
            if at < len(slot):
                length = slot[at][0]
                plan.put(length, end - begin, first + begin, offset)
                left[length] -= end - begin
                offset += length
        plan.room[plan.capacity - offset].append((first + begin, end - begin))


def _best_fit(plan: Plan, length: int, count: int) -> None:
    """Pieces of one length into the fullest sequences that have room, then into new ones."""
    while count:
        room = min((r for r, runs in plan.room.items() if r >= length and runs), default=None)
        if room is None:
            room, new = plan.capacity, -(-count // (plan.capacity // length))
            plan.room[room].append((plan.new(new), new))
        first, free = plan.room[room].pop()
        n = min(free, count)
        plan.put(length, n, first, plan.capacity - room)
        plan.room[room - length].append((first, n))
        if free > n:
            plan.room[room].append((first + n, free - n))
        count -= n


def _placing(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, bounds = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            low, high = bounds[length], bounds[length + 1]
            while (low < high - 1).any():  # the last run of the length that begins at or before the rank
                middle = (low + high) // 2
                right = (low < high - 1) & (runs[middle.clip(max=len(runs) - 1), 1] <= rank)
                low, high = np.where(right, middle, low), np.where(right | (low >= high - 1), high, middle)
            found = runs[low]
            placed = [pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + placed, names=[n for n, _ in kept] + ["sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset): one row per piece.

    Each document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Only
    documents above ``capacity`` are cut. Repeated rows, and rows without a doc_id, are
    documents of their own. Without ``with_ids`` the ids themselves are null, only their
    checksums are stored. The driver sees the number of pieces of each length, at most
    ``capacity`` numbers, and broadcasts runs of places whose number depends on the capacity
    alone. A piece's rank among those of its length is its place in its task plus the number
    in earlier tasks, so a length that most pieces have is never one group.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    runs = np.array(sorted(make_plan(counts, capacity, groups).runs) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    bounds = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(
        _placing(spark.sparkContext.broadcast((runs, bounds))),
        "doc_id bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )

"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned again and again in a cycle. Words are counted
from the first shard on; a longer phrase starts to be counted at the shard after the one where
both its subphrases (without the last word, without the first) reached the threshold, and stops
when it has seen every shard once. So phrases of different lengths are counted in the same scans.

The scans count phrases by keys of 32 bits of a hash within one of many blocks, which tasks merge
block by block: a count may be too large (equal keys), never too small. Phrases that share a key
only become candidates in vain. When a phrase became active follows from
its subphrases alone: arrays of a fixed size hold, per low bits of the hash, the scan after which a
phrase with these bits reached the threshold. All tasks get them; their size does not depend on the
data. One last cycle over the shards counts what completed its cycle at the threshold or above, by
its words. Everything below the threshold is gone by then, exactly as if all had been counted by words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import filled
from pagelake.session import discard, written

THRESHOLD = 10
TOP = 2000
#: Percent of a phrase's occurrences that lie in a longer candidate and make it redundant.
INSIDE_PERCENT = 50
SHARDS = 2
#: Slots of the activity arrays (one byte each) for words, pairs and triples.
SLOTS = (1 << 23, 1 << 25, 1 << 25)
SLICE_BYTES = 4 << 20
#: Least number of blocks of hashes; else half the shuffle partitions, up to a power of two, so that
#: slices send few and large blocks. What one merge holds is one block.
MIN_BLOCKS = 16

COUNTS = "size byte, block int, keys binary, counts binary"
MERGED = f"{COUNTS}, frequent binary"
PHRASES = "lang string, phrase string, size byte, n bigint"

#: Decimal products are exact: at most 37 digits, then 38 with the factor of a million.
_SCORE = """
    cast(1000000 as decimal(7, 0)) * cast(cast(a as decimal(18, 0)) * cast(a as decimal(18, 0)) as decimal(31, 0))
    div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))
"""

_BREAK = b"\xff"  # a byte that UTF-8 text never holds
_FOLD = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def words_and_breaks(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in order, with a break wherever a piece ends.

    >>> words_and_breaks("The cat, it\\tsat.".encode())
    [b'the', b'cat', b'\\xff', b'it', b'sat', b'\\xff']
    """
    return text.translate(_FOLD).replace(_BREAK, b" \xff ").split()


def _mixed(first, second):
    """Hash of a phrase from the hash of all but its last word and that of its last word."""
    return ((first << np.uint64(21)) | (first >> np.uint64(43))) ^ second


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(SLOTS[size - 1] - 1)).astype(np.int64)


class _Slice:
    """Some texts of one language as numbers: words in order with breaks between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        tokens = words_and_breaks(b"\n".join([*texts, b""]))
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        del tokens
        self.lang, self.words, self.ids = lang, coded.dictionary, coded.indices.to_numpy()
        self.pause = self.words.index(pa.scalar(_BREAK, pa.binary())).as_py()
        prefix = lang.encode() + b" "
        self.hashes = np.array([xxhash.xxh64_intdigest(prefix + w, 42) for w in self.words.to_pylist()], dtype=np.uint64)

    def active(self, steps: np.ndarray) -> np.ndarray:
        """Of each position's word the entry of an activity array; 0 for breaks."""
        of_words = steps[_slots(self.hashes, 1)]
        of_words[self.pause] = 0
        return of_words[self.ids]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the pairs that start at these positions."""
        return _mixed(self.hashes[self.ids[at]], self.hashes[self.ids[at + 1]])


def _spots(hashes: np.ndarray, size: int) -> np.ndarray:
    """Slot and high half of the hashes in one number, so that sorting goes by slot."""
    return (hashes & np.uint64(SLOTS[size - 1] - 1)) << np.uint64(32) | hashes >> np.uint64(32)


def _keys(spots: np.ndarray, size: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each spot, and its key there: place in the block, then high bits of the hash."""
    bits = np.uint64((SLOTS[size - 1] // blocks).bit_length() - 1)
    return (spots >> (bits + np.uint64(32))).astype(np.int32), (spots >> bits).astype(np.uint32)


def _starts(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """First scan that counts a phrase, from the activity of its two subphrases; 0 for never."""
    start = np.maximum(first, second).astype(np.int16) + 1
    return np.where((first > 0) & (second > 0), start, 0)


def _scanned(own: _Slice, scan: int, shards: int, words: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, sorted spots and counts of the phrases that a scan counts in a slice."""

    def due(start: np.ndarray) -> np.ndarray:
        return np.flatnonzero((start > 0) & (start <= scan) & (scan < start + shards))

    if scan <= shards:
        counts = np.bincount(own.ids, minlength=len(own.words))
        others = np.arange(len(counts)) != own.pause
        spots = _spots(own.hashes[others], 1)
        order = np.argsort(spots)
        yield 1, spots[order], counts[others][order]
    steps = own.active(words)
    starts = _starts(steps[:-1], steps[1:])
    at = due(starts)
    if len(at):
        yield 2, *np.unique(_spots(own.pairs(at), 2), return_counts=True)
    live = np.flatnonzero(starts)
    hashes, pair_steps = np.zeros(len(own.ids), np.uint64), np.zeros(len(own.ids), np.uint8)
    hashes[live] = own.pairs(live)
    pair_steps[live] = pairs[_slots(hashes[live], 2)]
    at = due(_starts(pair_steps[:-2], pair_steps[1:-1]))
    if len(at):
        yield 3, *np.unique(_spots(_mixed(hashes[at], own.hashes[own.ids[at + 2]]), 3), return_counts=True)


def _named(own: _Slice, threshold_bits: tuple) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Size, phrase and count of the phrases of a slice whose slots are frequent."""

    def frequent(hashes: np.ndarray, size: int) -> np.ndarray:
        slot = _slots(hashes, size)
        return (threshold_bits[size - 1][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1

    ids, known = own.ids.astype(np.int64), len(own.words)
    counts = np.bincount(ids, minlength=known)
    yield 0, pa.array([b""], pa.binary()), np.array([len(ids) - counts[own.pause]])
    on = frequent(own.hashes, 1).astype(bool)
    on[own.pause] = False
    words = np.flatnonzero(on)
    yield 1, own.words.take(pa.array(words)), counts[words]
    both = on[ids]
    at = np.flatnonzero(both[:-1] & both[1:])
    hashes, good = own.pairs(at), np.zeros(len(ids), dtype=bool)
    good[at] = frequent(hashes, 2)
    whole = np.zeros(len(ids), np.uint64)
    whole[at] = hashes
    at = np.flatnonzero(good)
    pairs, place, counts = np.unique(ids[at] * known + ids[at + 1], return_inverse=True, return_counts=True)
    names = pc.binary_join_element_wise(own.words.take(pa.array(pairs // known)), own.words.take(pa.array(pairs % known)), pa.scalar(b" ", pa.binary()))
    yield 2, names, counts
    pair_at = np.zeros(len(ids), np.int64)
    pair_at[at] = place
    at = np.flatnonzero(good[:-2] & good[1:-1])
    at = at[frequent(_mixed(whole[at], own.hashes[ids[at + 2]]), 3).astype(bool)]
    triples, counts = np.unique(pair_at[at] * known + ids[at + 2], return_counts=True)
    yield 3, pc.binary_join_element_wise(names.take(pa.array(triples // known)), own.words.take(pa.array(triples % known)), pa.scalar(b" ", pa.binary())), counts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    """The texts of a task by language, about ``SLICE_BYTES`` at a time; a longer text is one slice."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sum(sizes.values()) >= SLICE_BYTES:
                fullest = max(sizes, key=sizes.get)
                del sizes[fullest]
                yield _Slice(fullest, held.pop(fullest))
    for lang in list(held):
        yield _Slice(lang, held.pop(lang))


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of an array as binary values."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _scan(shard: DataFrame, scan: int, shards: int, blocks: int, shared: Broadcast) -> DataFrame:
    """Counts of the active phrases of one shard, as blocks of slot ranges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches):
            for size, spots, counts in _scanned(own, scan, shards, *shared.value):
                if not len(spots):
                    continue
                block, keys = _keys(spots, size, blocks)
                first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                ends = np.append(first[1:], len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), size, np.int8)), pa.array(block[first]), _cut(keys, ends), _cut(_short(counts), ends)],
                    names=["size", "block", "keys", "counts"],
                )

    return shard.select("lang", "text").mapInArrow(count, COUNTS)


def _short(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits; larger ones, which any threshold is below, stay at the top."""
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


def _merged(blocks: int, threshold: int):
    """Merges the counts of a block: those below the threshold go on, the slots of the others become bits."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        size, block = (k.as_py() for k in key)
        keys = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("counts").to_pylist()])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.add.reduceat(counts[order].astype(np.int64), first)
        high = counts >= threshold
        width = SLOTS[size - 1] // blocks
        bits = np.zeros(width, dtype=bool)
        bits[keys[high] >> np.uint32(33 - width.bit_length())] = True
        row = [size, block, keys[~high].tobytes(), _short(counts[~high]).tobytes()]
        row.append(np.packbits(bits, bitorder="little").tobytes() if high.any() else b"")
        kinds = (pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ["size", "block", "keys", "counts", "frequent"]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return merge


class _Activity:
    """For each slot the scan after which a phrase of that hash was frequent; 0 if none was yet."""

    def __init__(self):
        self.steps = [np.zeros(n, dtype=np.uint8) for n in SLOTS]

    def mark(self, rows: list, blocks: int, scan: int) -> bool:
        """Set the slots that were not set; whether there are any."""
        fresh = False
        for size, block, bits in rows:
            width = SLOTS[size - 1] // blocks
            steps = self.steps[size - 1][block * width : (block + 1) * width]
            new = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool) & (steps == 0)
            steps[new] = scan
            fresh |= size < 3 and bool(new.any())
        return fresh


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS) -> DataFrame:
    """lang, phrase, size and n of all phrases of 1 to 3 words found ``threshold`` times or more.

    One row per language with size 0 has the number of its words, rare ones included. ``lang`` null
    is ``und``, ``text`` null is empty. The counts of each scan are a table in the shared folder, so a
    lost executor costs tasks, not scans. To the driver come bits of slots, at most an eighth of
    ``SLOTS`` bytes a scan. ``shards`` is at most 80.
    """
    spark = docs.sparkSession
    dealt = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        filled(F.col("text")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"),
    )
    stored = written(dealt, "phrase_shards", by="shard")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(max(MIN_BLOCKS, 1 << (partitions - 1).bit_length() >> 1), SLOTS[0] // 8)
    activity, state = _Activity(), None
    scan, last = 0, shards
    while scan < last:
        scan += 1
        shared = spark.sparkContext.broadcast(activity.steps[:2])
        found = _scan(stored.where(F.col("shard") == (scan - 1) % shards), scan, shards, blocks, shared)
        if state is not None:  # of sizes whose phrases have not all completed their cycle
            unfinished = (F.col("size") >= 1 + (scan - 1) // shards) & (F.length("keys") > 0)
            found = found.unionAll(state.where(unfinished).drop("frequent"))
        merged = written(found.groupBy("size", "block").applyInArrow(_merged(blocks, threshold), MERGED), f"phrase_scan_{scan}")
        shared.destroy()
        if state is not None:
            discard(state)
        state = merged
        rows = state.where("length(frequent) > 0").select("size", "block", "frequent").collect()
        if activity.mark(rows, blocks, scan):  # what became active now is counted in the next ``shards`` scans
            last = max(last, scan + shards)
    discard(state)
    bits = spark.sparkContext.broadcast([np.packbits(s > 0, bitorder="little") for s in activity.steps])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches):
            for size, phrases, counts in _named(own, bits.value):
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.lang]).take(pa.array(np.zeros(n, np.int8))), phrases.cast(pa.string()), pa.array(np.full(n, size, np.int8)), pa.array(counts.astype(np.int64))],
                    names=["lang", "phrase", "size", "n"],
                )

    summed = stored.select("lang", "text").mapInArrow(name, PHRASES).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    counts = written(summed.where((F.col("n") >= threshold) | (F.col("size") == 0)), "phrase_counts")
    bits.destroy()
    discard(stored)
    return counts


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """The best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    ``score`` is floor(1000000 * a * a / (l * r)) of the lowest cut, in exact decimals of 38 digits
    (enough while a is below 10**16). Phrases found half the time inside a longer candidate are dropped.
    Ties go by a, then by the phrase's bytes. Null languages are ``und``; null and empty texts
    have no words; no documents give no rows; repeated rows count each time.
    """
    counts = phrase_counts(docs, threshold, shards)
    totals = counts.where("size = 0").select("lang", "n")
    known = counts.where("size > 0")
    long = known.where("size > 1").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")

    def joined(first: int, last: Column | int) -> Column:
        return F.array_join(F.slice(words, first, last), " ")

    parts = F.transform(
        F.sequence(F.lit(1), F.col("size").cast("int") - 1),
        lambda k: F.struct(k.alias("cut"), joined(1, k).alias("left"), joined(k + 1, F.size(words) - k).alias("right")),
    )
    cuts = long.select("lang", "phrase", "size", "a", F.inline(parts))
    sides = known.select("lang", F.col("phrase"), F.col("n"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(sides.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    scored = cuts.withColumn("score", F.expr(_SCORE))
    lowest = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inner = long.where("size = 3").select("lang", "a", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < INSIDE_PERCENT * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), F.asc("phrase"))
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "low.l", "low.r", "n", F.col("low.score").alias("score")
    )

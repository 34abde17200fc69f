"""Byte-level BPE: merges as recursive queries of DuckDB inside each partition."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import text_slices, texts_of

CACHED_WORDS = 150_000
WORDS_AT_ONCE = 50_000
STATES_AT_ONCE = 5_000_000
"""Words of one query together make at most so many rows (the sum of their squared lengths), which
holds its memory: long words of unspaced scripts go in smaller queries."""
QUERY_BYTES = 96
"""A recursive query keeps a row per token and step, the square of a word's length; longer
words are merged with a heap instead, to the same result."""
DECODED_AT_ONCE = 1 << 19

_STATES = """
with recursive states(word, step, pos, following, token) as (
  select word, 0, pos, pos + 1, token from letters
  union all
  select s.word, s.step + 1, s.pos, case when s.pos = b.pos then b.after_right else s.following end,
         case when s.pos = b.pos then b.merged else s.token end
  from states s
  join (select word, arg_min(pos, offer) as pos, arg_min(right_pos, offer) as right_pos,
               arg_min(after_right, offer) as after_right, arg_min(merged, offer) as merged
        from (select l.word, l.pos, r.pos as right_pos, r.following as after_right, m.merged, (m.merged << 24) + l.pos as offer
              from states l
              join states r on r.word = l.word and r.pos = l.following
              join merges m on m.pair = (l.token << 32) + r.token)
        group by word) b on b.word = s.word
  where s.pos <> b.right_pos
)
select word, pos, token from states s
where step = (select max(step) from states t where t.word = s.word)
order by word, pos
"""
"""Each step contracts the pair of least rank of each word, the leftmost of equal ones; a word
without a pair that can be merged stays at its last step."""

_DECODE = """
select doc, string_agg(hex, '' order by pos) as hex
from tokens join vocabulary using (token) group by doc order by doc
"""


class BpeCodec:
    """Encoding and decoding by the ranks of a vocabulary file, as the tiktoken library would."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.letter = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        pairs = [
            ((ranks[token[:i]] << 32) + ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.database = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._create("merges", dict(zip(("pair", "merged"), np.array(pairs, np.int64).T, strict=True)))
        self._create("vocabulary", {"token": np.array(list(ranks.values()), np.int64), "hex": [t.hex() for t in ranks]})

    def _create(self, name: str, columns: dict) -> None:
        self.database.register("given", pa.table(columns))
        self.database.execute(f"create or replace table {name} as select * from given")
        self.database.unregister("given")

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        sizes = np.array([len(w) for w in words])
        number = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.letter[np.frombuffer(b"".join(words), np.uint8)]
        self._create("letters", {"word": number.astype(np.int32), "pos": pos.astype(np.int32), "token": token.astype(np.int64)})
        found = self.database.execute(_STATES).fetchnumpy()
        ids = found["token"].astype("<u4")
        ends = np.searchsorted(found["word"], np.arange(len(words)), side="right")
        return [part.tobytes() for part in np.split(ids, ends[:-1])]

    def _merged_by_heap(self, word: bytes) -> bytes:
        """The same for one long word, in time n log n."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        following = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(left: int) -> None:
            right = following[left]
            if right < len(parts):
                rank = self.ranks.get(parts[left] + parts[right])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, parts[left], parts[right]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = following[left]
            if parts[left] != a or right >= len(parts) or parts[right] != b:
                continue
            parts[left], parts[right] = a + b, None
            following[left] = following[right]
            if following[right] < len(parts):
                before[following[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return np.array([self.ranks[p] for p in parts if p is not None], "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        short = []
        for word in words.difference(self.known):
            data = word.encode()
            if data in self.ranks:
                self.known[word] = self.ranks[data].to_bytes(4, "little")
            elif len(data) > QUERY_BYTES:
                self.known[word] = self._merged_by_heap(data)
            else:
                short.append((word, data))
        short.sort(key=lambda pair: len(pair[1]))  # a query takes as many steps as its longest word
        rows = np.cumsum([len(data) ** 2 for _, data in short])
        start = 0
        while start < len(short):
            done = rows[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(rows, done + STATES_AT_ONCE, side="right")))
            part = short[start : min(end, start + WORDS_AT_ONCE)]
            start += len(part)
            for (word, _), ids in zip(part, self._merged([d for _, d in part]), strict=True):
                self.known[word] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        split = [self.pattern.findall(text or "") for text in texts]
        self._learn(set().union(*split))
        return [b"".join([self.known[w] for w in matches]) for matches in split]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids, joined in order; long lists go in parts."""
        width = 4 * DECODED_AT_ONCE
        parts = [(i, ids[at : at + width]) for i, ids in enumerate(encoded) for at in range(0, len(ids), width)]
        ends = np.cumsum([len(ids) // 4 for _, ids in parts])
        out: list[list[bytes]] = [[] for _ in encoded]
        start = 0
        while start < len(parts):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + DECODED_AT_ONCE, side="right")))
            for (i, _), data in zip(parts[start:end], self._decoded([ids for _, ids in parts[start:end]]), strict=True):
                out[i].append(data)
            start = end
        return [b"".join(found) for found in out]

    def _decoded(self, encoded: list[bytes]) -> list[bytes]:
        doc = np.repeat(np.arange(len(encoded)), [len(ids) // 4 for ids in encoded])
        tokens = {"doc": doc.astype(np.int32), "pos": np.arange(len(doc)), "token": np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)}
        self._create("tokens", tokens)
        texts = dict(self.database.execute(_DECODE).fetchall())
        return [bytes.fromhex(texts.get(i, "")) for i in range(len(encoded))]


def _coded_batches(path: str, pattern: str, digests: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(path, pattern)
        for ids, texts in text_slices(batches):
            encoded = codec.encode(texts)
            decoded = codec.decode(encoded)
            counts = pa.array([len(e) // 4 for e in encoded], pa.int64())
            if digests:
                pair = [pa.array([hashlib.sha256(x).hexdigest() for x in side]) for side in (encoded, decoded)]
            else:
                pair = [pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, counts, *pair], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def coded(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): one row per row of ``docs``.

    ids are the little-endian unsigned 32-bit ids of the whole text, decoded the bytes they
    stand for; with ``digests`` both are SHA-256 in hex instead. Each match of ``pattern`` is
    merged by itself. A null text is empty and has no ids.
    """
    kind = "string" if digests else "binary"
    return texts_of(docs).mapInArrow(
        _coded_batches(path, pattern, digests), f"doc_id bigint, n_tokens bigint, ids {kind}, decoded {kind}"
    )

"""Collocations against plain counts, whatever the number of shards."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz ")


def counts_of(docs):
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = [w for w in piece.split(" ") if w]
            for size in (1, 2, 3):
                f[lang or "und"].update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return f


def plain(docs, threshold, top):
    rows = []
    for lang, f in counts_of(docs).items():
        n, scored = sum(c for p, c in f.items() if " " not in p), []
        longer = [p for p, c in f.items() if p.count(" ") == 2 and c >= threshold]
        for phrase, a in f.items():
            words = phrase.split(" ")
            if len(words) < 2 or a < threshold:
                continue
            if any(f" {phrase} " in f" {p} " and p != phrase and 100 * f[p] >= 50 * a for p in longer):
                continue
            cuts = [(f[" ".join(words[:k])], f[" ".join(words[k:])], k) for k in range(1, len(words))]
            score, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for x, y, k in cuts)
            scored.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


def made(n=120, seed=6):
    draw = random.Random(seed)
    words = ["The", "cat", "É", "é", "new", "york", "ÿ中", "x\x1cy", "a", "b"] + ["w%d" % i for i in range(30)]
    fixed = ["new york city", "of the new", "a b a b"]
    docs = []
    for _ in range(n):
        text = "".join(draw.choice([*words, *fixed]) + draw.choice([" ", " ", " ", "\t ", ", ", "\n"]) for _ in range(draw.randint(0, 80)))
        docs.append((draw.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("en", None), ("en", ""), ("de", "..."), ("en", "long tail " * 20000), (None, "new york")] * 2


@pytest.mark.parametrize("shards, threshold, top", [(2, 10, 2000), (3, 4, 25)])
def test_against_plain_counts(spark, shards, threshold, top):
    docs = made()
    table = spark.createDataFrame([(i, t, g, "a", 1) for i, (g, t) in enumerate(docs)], "doc_id bigint, text string, lang string, phrase string, n int")
    found = co.collocations(table, threshold, top, shards)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(docs, threshold, top)


def test_counts_are_those_of_all_frequent_phrases(spark):
    docs = made(60, 8)
    table = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(docs)], "doc_id bigint, text string, lang string")
    got = {(r.lang, r.phrase): r.n for r in co.phrase_counts(table, 3, 4).collect()}
    want = {(g, p): n for g, f in counts_of(docs).items() for p, n in f.items() if n >= 3}
    assert got == want | {(g, ""): sum(n for p, n in f.items() if " " not in p) for g, f in counts_of(docs).items()}


def test_scans_count_each_phrase_in_each_shard_once():
    """Activity as it grows over the scans of four shards; a phrase is counted in four scans or never."""
    words, pairs = np.zeros(co.SLOTS[0], np.uint8), np.zeros(co.SLOTS[1], np.uint8)
    own = co._Slice("en", [b"a b c. b c a"])
    spots = {w: co._slots(own.hashes, 1)[i] for i, w in enumerate(own.words.to_pylist())}
    ids = {w: i for i, w in enumerate(own.words.to_pylist())}

    def pair(x, y):
        return co._mixed(own.hashes[[ids[x]]], own.hashes[[ids[y]]])

    seen = Counter()
    for scan in range(1, 13):
        for size, found, counts in co._scanned(own, scan, 4, words, pairs):
            seen.update({(size, int(s)): int(n) for s, n in zip(found, counts, strict=True)})
        if scan in (1, 3):  # b and c are frequent after the first scan, a after the third
            words[[spots[w] for w in ((b"b", b"c") if scan == 1 else (b"a",))]] = scan
        if scan in (2, 5):
            pairs[co._slots(pair(b"b", b"c") if scan == 2 else pair(b"c", b"a"), 2)] = scan
    bca = co._mixed(pair(b"b", b"c"), own.hashes[[ids[b"a"]]])
    want = {(1, w): 8 for w in co._spots(own.hashes[[ids[b"a"], ids[b"b"], ids[b"c"]]], 1).tolist()}
    for count, size, phrase in ((8, 2, pair(b"b", b"c")), (4, 2, pair(b"c", b"a")), (4, 2, pair(b"a", b"b")), (4, 3, bca)):
        want[size, co._spots(phrase, size).tolist()[0]] = count
    assert seen == want


def test_keys_name_their_slots():
    hashes = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
    for size, blocks in ((1, 16), (2, 1024), (3, co.SLOTS[0] // 8)):
        block, keys = co._keys(co._spots(hashes, size), size, blocks)
        width = co.SLOTS[size - 1] // blocks
        assert (block.astype(np.int64) * width + (keys >> np.uint32(33 - width.bit_length())) == co._slots(hashes, size)).all()


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 1).alias("l"), F.lit(big + 2).alias("r"))
    assert row.select(F.expr(co._SCORE).alias("s")).first().s == 1000000 * big * big // ((big + 1) * (big + 2))


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert co.collocations(empty).count() == 0

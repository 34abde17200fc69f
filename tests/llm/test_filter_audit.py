"""The filter audit against documents pushed through every order one by one."""

import itertools
import random

from pagelake.llm import filter_audit

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    found = []
    for i, text, _ in docs:
        text = text or ""
        words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        upper = sum("A" <= c <= "Z" for c in text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * upper > 5 * len(text)}
        fails |= {"D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        found.append({k for k, v in fails.items() if v})
    return found


def plain(docs, good, toxic):
    failed, rows = failures(docs), {}
    for part in {s or "" for _, _, s in docs}:
        own = [(d[0], f) for d, f in zip(docs, failed, strict=True) if (d[2] or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                removed[name] += len(gone)
                rows[part, order, step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for key in [k for k in rows if k[0] == part]:
            rows[key].append(removed[key[1][key[2] - 1]])
    return rows


def audited(spark, docs, labels):
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, source string, part string, n int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(table, marks).collect()
    return {(r.part, r.filter_order, r.step): [r[m] for m in (*MEASURES, "shapley")] for r in found}, len(found)


def test_all_orders(spark):
    draw = random.Random(4)
    words = ["w%d" % i for i in range(90)] + ["Ab", "ZZ", "é", "#", "x\x1cy", "a|b"]
    texts = [" ".join(draw.choices(words[: draw.choice([20, 90, 96])], k=draw.choice([3, 49, 50, 80]))) for _ in range(60)]
    docs = [(draw.randrange(200), draw.choice(texts), draw.choice(["s", "t", None, ""])) for _ in range(150)]
    docs += [(None, None, "s"), (None, "", "s"), (7, "", "u"), (9, None, "u"), (9, "", "u"), (9, "", "u"), (300, "A " * 70000, "u"), (None, texts[0], "t")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    want = plain(docs, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    got, n = audited(spark, docs, labels)
    assert n == len(got) == 600 * 4
    assert got == want


def test_nothing(spark):
    got, n = audited(spark, [(1, "a", "s")], [])
    assert n == 600 and got["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    table = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert filter_audit.audit(table, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0

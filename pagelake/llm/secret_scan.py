"""Secret scans: an inverted index of trigrams picks the documents that each rule must read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import filled
from pagelake.session import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches ``pattern`` and is long enough in ``group``."""

    kind: str
    pattern: str
    min_chars: int
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
"""Greedy runs of 24 or more are the long ones among all runs, found without listing the rest."""

RUN_BEGINS = r"(?<![A-Za-z0-9_-])"
FURTHER_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("jwt", RUN_BEGINS + r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
)
"""A token of three parts begins where a run of its characters does, so that a run is tried once."""
RULES = BASE_RULES + FURTHER_RULES
CHUNK = 256
"""Matches whose places are summed up together."""
BLOCK = 1024
"""Characters of the blocks that a text is cut from for masking."""

MAX_STRINGS = 64
"""Literal alternatives that are followed at once; beyond, a part of a pattern demands nothing."""

Conjunctions = frozenset[frozenset[str]]
"""Alternatives, each a set of trigrams that a text must all have. One empty set: no demand."""

ANYTHING: Conjunctions = frozenset([frozenset()])


def _both(a: Conjunctions, b: Conjunctions) -> Conjunctions:
    joined = {x | y for x in a for y in b} if len(a) * len(b) <= MAX_STRINGS else set(a)
    return frozenset(x for x in joined if not any(y < x for y in joined))


def _either(parts: list[Conjunctions]) -> Conjunctions:
    joined = frozenset().union(*parts)
    return frozenset(x for x in joined if not any(y < x for y in joined))


def _demand(strings: set[str]) -> Conjunctions:
    """A text that has one of the strings has all trigrams of that string."""
    return _either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _strings_of_set(members: list) -> set[str] | None:
    """The characters of a small class, or None."""
    found = {chr(value).lower() for op, value in members if op is ops.LITERAL}
    plain = all(op is ops.LITERAL for op, _ in members)
    return found if plain and len(found) <= 8 else None


def _walk(items) -> tuple[set[str] | None, Conjunctions]:
    """(all strings the part can match, or None; what any text with a match must have)."""
    run: set[str] | None = {""}
    exact, demand = True, ANYTHING
    for op, value in items:
        strings, below = None, ANYTHING
        if op is ops.LITERAL:
            strings = {chr(value).lower()}
        elif op is ops.IN:
            strings = _strings_of_set(value)
        elif op is ops.SUBPATTERN:
            strings, below = _walk(value[-1])
        elif op is ops.BRANCH:
            branches = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in branches):
                strings = set().union(*(s for s, _ in branches))
            else:
                below = _either([_both(_demand(s) if s is not None else ANYTHING, d) for s, d in branches])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            least, most, body = value
            inner, below = _walk(body)
            if inner is not None and (least, most) == (0, 1):
                strings, below = inner | {""}, ANYTHING
            elif inner is not None and least == most and len(inner) ** least <= MAX_STRINGS:
                strings = {""}
                for _ in range(least):
                    strings = {a + b for a in strings for b in inner}
            elif least == 0:
                below = ANYTHING
            elif inner is not None:
                below = _demand(inner)
        elif op is ops.AT:
            continue
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        demand = _both(_both(demand, _demand(run)), below)
        run, exact = {""}, False
        if strings is not None:
            run = strings if len(strings) <= MAX_STRINGS else {""}
    return (run, demand) if exact else (None, _both(demand, _demand(run)))


def trigram_query(pattern: str) -> Conjunctions:
    """Alternatives of trigrams (lower case) without which no text can match ``pattern``."""
    strings, demand = _walk(parser.parse(pattern))
    return _both(demand, _demand(strings)) if strings is not None else demand


def check_rules(rules: tuple[Rule, ...]) -> None:
    """Refuse rules that match nothing at all in a text: their matches could be empty."""
    for rule in rules:
        if re.compile(rule.pattern).search("") is not None:
            raise ValueError(f"the rule {rule.kind} matches an empty text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): which documents have which of the trigrams, in any letter case.

    Only trigrams that some rule asks for are listed, so the index is a fraction of the text.
    """
    text = F.lower(filled(F.col("text")))
    had = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(text, t))
    return docs.where("doc_id is not null").select(F.explode(had).alias("trigram"), F.col("doc_id").cast("bigint").alias("doc_id"))


def candidates(index: DataFrame, queries: dict[str, Conjunctions]) -> DataFrame:
    """(candidate_id, kinds): documents whose postings meet the trigram query of a rule.

    The postings of one document are at most one row per trigram asked for. Each is a bit
    array, so the intersection is an aggregate with map-side combine.
    """
    wanted = sorted({t for q in queries.values() for c in q for t in c})
    had = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("had"))
    kinds = [
        F.when(
            _any_of([_all_of([F.array_contains("had", t) for t in sorted(c)]) for c in sorted(q, key=sorted)]),
            F.lit(kind),
        )
        for kind, q in queries.items()
    ]
    met = had.select(F.col("doc_id").alias("candidate_id"), F.array_compact(F.array(*kinds)).alias("kinds"))
    return met.where(F.size("kinds") > 0) if wanted else met


def _all_of(tests: list[Column]) -> Column:
    found = F.lit(True)
    for test in tests:
        found = found & test
    return found


def _any_of(tests: list[Column]) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, how: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values``, an array of whole numbers, ``how`` over those before it; 0 before the first.

    Prefixes grow inside chunks of ``CHUNK`` values, and those of whole chunks apart from them, so
    the work grows with the number of values, not with its square.
    """
    none = F.array().cast("array<int>")

    def last(done: Column) -> Column:
        return F.coalesce(F.get(done, F.size(done) - 1), F.lit(0))

    def prefixes(of: Column) -> Column:
        return F.aggregate(of, none, lambda done, value: F.array_append(done, how(last(done), value)))

    def joined(chunks: Column) -> Column:
        totals = prefixes(F.transform(chunks, last))
        return _with(
            F.concat(F.array(F.lit(0)), totals),
            lambda upto: F.flatten(
                F.transform(
                    chunks,
                    lambda chunk, i: F.transform(
                        F.concat(F.array(F.lit(0)), F.slice(chunk, 1, F.size(chunk) - 1)), lambda inner: how(F.get(upto, i), inner)
                    ),
                )
            ),
        )

    def summed(all_values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_values), F.lit(CHUNK))
        found = _with(F.transform(starts, lambda at: prefixes(F.slice(all_values, at, CHUNK))), joined)
        return F.when(F.size(all_values) > 0, found).otherwise(none)

    return _with(values, summed)


def _matches(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end) of the rule's matches, in code points, leftmost first."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    long_enough = F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.char_length(g) >= rule.min_chars
    )
    pieces = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), hits.alias("hit"), long_enough.alias("ok")),
        lambda p: F.struct(
            F.char_length(p["before"]).alias("before"), F.coalesce(F.char_length(p["hit"]), F.lit(0)).alias("hit"), p["ok"].alias("ok")
        ),
    )

    def spans(cut: Column) -> Column:
        begun = _before(F.transform(cut, lambda p: p["before"] + p["hit"]), lambda a, b: a + b)
        placed = F.transform(
            F.arrays_zip(cut.alias("p"), begun.alias("at")),
            lambda z: F.struct(
                (z["at"] + z["p"]["before"]).alias("start"),
                F.lit(place).alias("place"),
                (z["at"] + z["p"]["before"] + z["p"]["hit"]).alias("end"),
                z["p"]["ok"].alias("ok"),
            ),
        )
        good = F.filter(placed, lambda s: s["ok"])
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end")))

    return _with(pieces, spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` in the struct ``doc``, and ``spans``: array of (start, place, end).

    Spans are code point offsets, end exclusive, by start and then by the rule's place in
    ``rules``; matches of one rule do not overlap, those of different rules may. A null text
    counts as empty. A document is read by a rule if the rule demands no trigrams, if the
    postings meet its trigram query, or if it has no doc_id and so no postings. Rows with one
    doc_id share their postings, which only adds texts to read. The candidates meet the
    documents in a join by doc_id.
    """
    check_rules(rules)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    selective = {k: q for k, q in queries.items() if frozenset() not in q}
    whole = docs.select(F.struct("*").alias("doc"))
    if not selective:
        found = whole.withColumn("kinds", F.array().cast("array<string>"))
    else:
        index = written(postings(docs, sorted({t for q in selective.values() for c in q for t in c})), "trigrams")
        named = candidates(index, selective)
        found = whole.join(named, F.col("doc.doc_id").cast("bigint") == named["candidate_id"], "left").drop("candidate_id")
    text = filled(F.col("doc.text"))
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    each = []
    for place, rule in enumerate(rules):
        must_read = F.lit(True)
        if rule.kind in selective:
            must_read = F.col("doc.doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        each.append(F.when(must_read & text.rlike(rule.pattern), _matches(text, rule, place)).otherwise(none))
    return found.select("doc", F.array_sort(F.flatten(F.array(*each))).alias("spans"))


def written_spans(spans: Column, rules: tuple[Rule, ...] = RULES, first: int | None = None) -> Column:
    """``kind:start:end`` of the spans of the ``first`` rules (or all), comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    chosen = spans if first is None else F.filter(spans, lambda s: s["place"] < first)
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"], s["end"])), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every character of a span replaced by ``*``; its length stays.

    What stands between spans is taken from blocks of ``BLOCK`` characters, so no character is
    found by walking from the beginning of the text.
    """

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        few = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substring(few, start - first * BLOCK + 1, end - start)

    def built(blocks: Column) -> Column:
        reached = _before(F.transform(spans, lambda s: s["end"]), F.greatest)
        parts = F.transform(
            F.arrays_zip(spans.alias("span"), reached.alias("at")),
            lambda z: F.concat(
                F.when(z["span"]["start"] > z["at"], cut(blocks, z["at"], z["span"]["start"])).otherwise(""),
                F.repeat(F.lit("*"), F.greatest(z["span"]["end"] - F.greatest(z["span"]["start"], z["at"]), F.lit(0))),
            ),
        )
        rest = cut(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text))
        return F.concat(F.array_join(parts, ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _with(blocks, built)).otherwise(text)


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all found secrets masked in the text; every other column is kept as it is.

    No row goes. A null text stays null.
    """
    found = scan(docs, rules)
    columns = [
        masked(F.col("doc.text").cast("string"), F.col("spans")).alias(c) if c == "text" else F.col("doc")[c].alias(c)
        for c in docs.columns
    ]
    return found.select(*columns)

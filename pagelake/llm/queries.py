"""Registered queries of this subpackage with their SQL twins (None where SQL has no way)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import bpe, collocations, exact_dedup, filter_audit, html_text, language_id, lm_score, packing, quality_model, quality_rules, secret_scan, simhash, url_filter

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each document over links of at most two differing fingerprint bits."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Longest rule and verdict of each page's URL."""
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)


_OP2_SQL = r"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
rules(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                          ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
pairs as (select distinct host, path from parts),
best as (
  select host, path, arg_max({'rule': h || p, 'verdict': v}, length(h) * 10000 + length(p)) as b
  from pairs join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by host, path)
select page_id, parts.host, parts.path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict
from parts left join best on parts.host = best.host and parts.path = best.path
"""


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.coded(table(spark, sf, "documents"), path, public_tokenizers.PATTERN, digests=True)
    return found.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Which row of each group of equal texts is kept."""
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


_OP4_SQL = """
with folded as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, text_sha256
from folded window w as (partition by text_sha256)
"""


def op5_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated probability that a document is of good quality."""
    return quality_model.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo-likelihood of each document under a network trained on all of them."""
    docs = table(spark, sf, "documents")
    words = lm_score.lexicon(docs)
    return lm_score.score(docs, words, lm_score.train(docs, words))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and the verdict of the compression bands."""
    return quality_rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Main language of each document and its share of the letters."""
    docs = table(spark, sf, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identified(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and places of all secrets in each document."""
    found = secret_scan.scan(table(spark, sf, "documents").select("doc_id", "text"))
    base = len(secret_scan.BASE_RULES)
    places = F.transform("spans", lambda s: s["place"])
    count = {
        f"n_{rule.kind}": (F.size(places) - F.size(F.array_remove(places, place))).cast("bigint")
        for place, rule in enumerate(secret_scan.BASE_RULES)
    }
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        *[c.alias(n) for n, c in count.items()],
        F.sha2(secret_scan.written_spans(F.col("spans"), first=base), 256).alias("base_sha256"),
        secret_scan.written_spans(F.col("spans")).alias("spans"),
    )


def _spans_sql(place: int, rule: secret_scan.Rule) -> str:
    # no look-behind in this SQL: the character before is part of the match, and left out of its span
    begins = rule.pattern.startswith(secret_scan.RUN_BEGINS)
    pattern = rule.pattern.replace(secret_scan.RUN_BEGINS, "(?:^|[^A-Za-z0-9_-])").replace("'", "''")
    before = "+ (h not like 'e%')::int" if begins else ""
    return f"""
  select doc_id, {place} as place, '{rule.kind}' as kind,
         cast(sum(length(a) + length(h)) over w - length(h) {before} as bigint) as s, cast(sum(length(a) + length(h)) over w as bigint) as e,
         length(g) >= {rule.min_chars} as ok
  from (select doc_id, i, befores[i] as a, hits[i] as h, groups[i] as g
        from (select doc_id, unnest(range(1, len(hits) + 1)) as i, befores, hits, groups
              from (select doc_id, string_split_regex(text, '{pattern}') as befores,
                           regexp_extract_all(text, '{pattern}', 0) as hits,
                           regexp_extract_all(text, '{pattern}', {rule.group}) as groups
                    from documents where regexp_matches(text, '{pattern}'))))
  window w as (partition by doc_id order by i)"""


_OP9_SQL = f"""
with spans as ({' union all '.join(_spans_sql(i, r) for i, r in enumerate(secret_scan.RULES))}),
found as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, place) filter (place < {len(secret_scan.BASE_RULES)}) as base,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, place) as spans
  from spans where ok group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join found using (doc_id)
"""


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each piece of each document in sequences of 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf, "documents"), path, with_ids=False).drop("ids")


def op11_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of each page."""
    return html_text.main_texts(table(spark, sf, "pages"))


#: The main text of pages laid out as those of the test tables: headings and paragraphs of one article element.
_OP11_SQL = r"""
with blocks as (
  select page_id, url,
         list_transform(
           string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(p|h1)>'),
           lambda b: regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) as parts
  from pages),
texts as (
  select page_id, url,
         array_to_string(list_filter(list_transform(parts, lambda b: trim(regexp_replace(
           replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
           '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) as text
  from blocks)
select page_id, url, text, length(text) as n_chars from texts
"""


def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations.collocations(table(spark, sf, "documents"))


_OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
ones as (select lang, unnest(w) as phrase from words),
f as (
  select lang, phrase, 1 as size, count(*) as n from ones group by lang, phrase
  union all
  select lang, phrase, 2, count(*) from (select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as phrase from words)
  group by lang, phrase having count(*) >= 10
  union all
  select lang, phrase, 3, count(*)
  from (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as phrase from words)
  group by lang, phrase having count(*) >= 10),
longer as (
  select lang, sub, max(n) as n
  from (select lang, n, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as sub
        from f where size = 3) group by lang, sub),
cuts as (
  select lang, phrase, n as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as lp,
         array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') as rp
  from (select *, unnest(range(1, size)) as k from f where size > 1)),
scored as (
  select c.lang, c.phrase, c.a, c.k, fl.n as l, fr.n as r,
         cast((1000000::hugeint * c.a * c.a) // (fl.n::hugeint * fr.n) as bigint) as score
  from cuts c join f fl on fl.lang = c.lang and fl.phrase = lp join f fr on fr.lang = c.lang and fr.phrase = rp),
lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank
  from lowest s left join longer o on o.lang = s.lang and o.sub = s.phrase
  where o.n is null or 100 * o.n < 50 * a)
select lang, rank, phrase, a, l, r, (select cast(sum(n) as bigint) from f where f.lang = ranked.lang and size = 1) as n, score
from ranked where rank <= 2000
"""


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes in every order, per source."""
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


_OP13_SQL = r"""
with marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id),
docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
         min(doc_id) over (partition by coalesce(text, '')) as first
  from documents),
judged as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} as fails
  from docs left join marks using (doc_id)),
cells as (
  select part, concat(case when fails.A then 'A' else '' end, case when fails.B then 'B' else '' end, case when fails.C then 'C' else '' end,
                      case when fails.D then 'D' else '' end, case when fails.E then 'E' else '' end) as failed,
         count(*) as n, sum(good) as good, sum(toxic) as toxic
  from judged group by part, failed),
letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a join letters b on b.f <> a.f join letters c on c.f not in (a.f, b.f)
  join letters d on d.f not in (a.f, b.f, c.f) join letters e on e.f not in (a.f, b.f, c.f, d.f)),
steps as (
  select filter_order, cast(s as integer) as step, substr(filter_order, s, 1) as own, left(filter_order, s - 1) as before
  from (select filter_order, unnest(range(1, 6)) as s from orders)),
met as (
  select part, filter_order, step, own, n, good, toxic, contains(failed, own) as fails_own, failed = own as only_own,
         len(translate(failed, before, '')) < len(failed) as gone
  from cells, steps),
summed as (
  select part, filter_order, step, own,
         cast(coalesce(sum(n) filter (not gone and not fails_own), 0) as bigint) as kept,
         cast(coalesce(sum(n) filter (not gone and fails_own), 0) as bigint) as removed,
         cast(coalesce(sum(n) filter (gone and fails_own), 0) as bigint) as redundant,
         cast(coalesce(sum(n) filter (only_own), 0) as bigint) as unique_fails,
         cast(coalesce(sum(good) filter (not gone and fails_own), 0) as bigint) as good_lost,
         cast(coalesce(sum(toxic) filter (not gone and fails_own), 0) as bigint) as toxic_lost
  from met group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley
from summed
"""


QUERIES = {
    "op1_simhash_near_dedup": (op1_simhash_near_dedup, None),
    "op2_url_filter": (op2_url_filter, _OP2_SQL),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_exact_dedup": (op4_exact_dedup, _OP4_SQL),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_lm_score": (op6_lm_score, None),
    "op7_quality_rules": (op7_quality_rules, None),
    "op8_language_id": (op8_language_id, None),
    "op9_secret_scan": (op9_secret_scan, _OP9_SQL),
    "op10_best_fit_packing": (op10_best_fit_packing, None),
    "op11_html_extraction": (op11_html_extraction, _OP11_SQL),
    "op12_phrase_collocations": (op12_phrase_collocations, _OP12_SQL),
    "op13_filter_audit": (op13_filter_audit, _OP13_SQL),
}


def queries():
    import corpus_pipeline

    return {name: query for name, (query, _) in QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

"""DuckDB SQL for the operators that SQL can express, with the operators' own constants."""

from __future__ import annotations

from math import log

from tidemark.llm import decontaminate, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"


def _rules() -> str:
    values = [f"({r}, {c}, {cut})" for r, rule in enumerate(quality_rules.RULES) for c, cut in enumerate(rule[3])]
    return "(values " + ", ".join(values) + ") as v(r, c, cut)"


def quality() -> str:
    """Counts, base rules, exact binomial tests of every cutoff in fixed sequence, and the verdict."""
    rules, p = quality_rules.RULES, quality_rules.RISK / len(quality_rules.RULES)
    rate = "case v.r " + " ".join(f"when {r} then 100 * {x[1]} > v.cut * {x[2]}" for r, x in enumerate(rules)) + " end"
    tail = f"list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * {log(p)!r} + (n - j) * ln(1 - {p!r}))))"
    return rf"""
with w as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
grams as (select doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g, unnest(range(1, len(w) - 3)) as i from w where len(w) > 5),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
covered as (select doc_id, count(distinct i + o) as n from again, (select unnest(range(0, 5)) as o) group by 1),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from w),
m as (select w.doc_id, lang, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  coalesce(covered.n, 0) as n_repeat_words, cast(len(l) as bigint) as n_lines,
  cast(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as bigint) as n_echoes
  from w join lines using (doc_id) left join covered using (doc_id)),
b as (select *, n_words < {quality_rules.BASE_WORDS} or 100 * n_repeat_words > {quality_rules.BASE_REPEAT} * n_words as base_failed from m),
held as (select b.*, q from b join (select doc_id, min(quality) as q from labels where quality is not null group by 1) using (doc_id) where not base_failed),
counts as (select lang, v.r, v.c, v.cut, count(case when q = 1 then 1 end) as n, count(case when q = 1 and ({rate}) then 1 end) as k, count(case when q = 0 and ({rate}) then 1 end) as bad from held, {_rules()} group by all),
tested as (select *, n > 0 and k < n * {p!r} and {tail} <= {quality_rules.ERROR / len(rules)!r} / (select count(distinct lang) from counts) as ok from counts),
passed as (select *, bool_and(ok) over (partition by lang, r order by c desc) as certified from tested),
cutoffs as (select lang, r, arg_max(cut, bad * 100000 + cut) as cut from passed where certified group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from cutoffs v where v.lang = b.lang and ({rate})) as kept from b"""


def decontamination() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda x: rf"regexp_extract_all(translate(coalesce({x}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    size = decontaminate.WINDOW
    return rf"""
with d as (select doc_id, {words("text")} as w from documents),
q as (select item_id, {words("text")} as w from benchmark),
phrases as (select item_id, least(len(w), {size}) as size, unnest(list_transform(range(1, greatest(len(w) - {size} + 1, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), {size}) - 1], ' '))) as g from q where len(w) > 0),
sizes as (select distinct size from phrases),
own as (select doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as g, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size),
hits as (select doc_id, item_id, i, size from own join phrases using (size, g)),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from hits) group by 1),
items as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(covered.n, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)"""

"""DuckDB twins of the queries that SQL can express, by brute force rather than by the method."""

from __future__ import annotations

from braidwork.llm.licenses import PHRASES, compiled
from braidwork.llm.linespread import MIN_SITES

SITE_SPREAD = rf"""
with parts as (
  select doc_id, coalesce('s' || source, '') as site, text, string_split(text, chr(10)) as ls from documents
), lines as (
  select distinct doc_id, text, site, unnest(ls) as line, generate_subscripts(ls, 1) as pos from parts where text is not null
), bad as (
  select line from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by line having count(distinct site) >= {MIN_SITES}
), marked as (
  select l.*, b.line is not null and row_number() over (partition by l.line order by doc_id, pos) > 1 as gone
  from lines l left join bad b on l.line = b.line
), per_doc as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
  from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       strlen(coalesce(kept, ''))::bigint as kept_bytes, md5(coalesce(kept, '')) as kept_md5
from documents d left join per_doc p on d.doc_id = p.doc_id
"""


def license_join() -> str:
    """Every line against every template; base phrases by comparing word lists at every place."""
    words = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = ", ".join(f"('{t.label}', {quoted(sorted(t.tokens))}, {t.need})" for t in compiled())
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES)
    return f"""
with t(label, tokens, need) as (values {templates}), p(label, parts) as (values {phrases}),
w as (select doc_id, coalesce(text, '') as text, {words.format("coalesce(text, '')")} as ws from documents),
places as (
  select doc_id, label, unnest(list_filter(range(0, greatest(len(ws) - len(parts) + 1, 0)), lambda i: ws[i + 1 : i + len(parts)] = parts)) as place
  from w, p where contains(ws, 'license')
),
base as (
  select doc_id, count(*) as n, min(place) as a, max(place) as b, string_agg(distinct label, ',' order by label) as labels from places group by doc_id
),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
blocks as (select doc_id, list_distinct({words.format("line")}) as ws from lines),
hits as (
  select doc_id, label, len(list_intersect(ws, tokens)) / len(tokens) as share
  from blocks, t where len(list_intersect(ws, tokens)) >= need
),
alllabels as (select doc_id, label from hits union select doc_id, label from places),
more as (select doc_id, string_agg(distinct label, ',' order by label) as labels from alllabels group by doc_id),
best as (select doc_id, max(share) as share from hits group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, a::bigint as first_word, b::bigint as last_word,
       coalesce(base.labels, '') as base_labels, coalesce(more.labels, '') as labels,
       case when base.n > 0 then 1.0::double else coalesce(share, 0)::double end as score
from w left join base using (doc_id) left join more using (doc_id) left join best using (doc_id)
"""

"""DuckDB SQL that says the same as the queries which SQL can express.

The piece codec, packing, the classifiers and the secret scan (its weak parts need look-around, which that SQL
doesn't have) are held against libraries and plain Python in the tests instead.
"""

from __future__ import annotations

from .quality_rules import CHAR_CLASSES, COMMON_WORDS

SPACE = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _count(pattern: str) -> str:
    escaped = pattern.replace("'", "''")
    return f"length(regexp_replace(t, '[^{escaped}]', '', 'g'))"


def _closure(nodes: str, links: str) -> str:
    """(x, root) of each node: the least that links (x, y), which go both ways, reach."""
    return (
        f"reach(x, y) as (select x, x from {nodes} union select r.x, l.y from reach r join {links} l on r.y = l.x), "
        "roots as (select x, min(y) as root from reach group by x)"
    )


op1_near_duplicates = f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}+'),
                             lambda w: w <> '') as w
  from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as s from words where len(w) >= 2
    union all select doc_id, w[1] from words where len(w) = 1)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from shingles a join shingles b using (s)
  where a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * common >= 80 * (a.n + b.n - common)),
ways as (select x, y from links union all select y, x from links),
nodes as (select doc_id as x from documents),
{_closure("nodes", "ways")}
select d.doc_id, coalesce(n, 0) as n_shingles, root as component_id, d.doc_id = root as kept
from documents d left join sizes s on s.doc_id = d.doc_id join roots on x = d.doc_id
"""

op2_quote_threads = f"""
with recursive split as (
  select conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) as x,
    generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) as i from conversations),
marked as (select *, regexp_extract(x, '^((?:[\\x20\\x09]*>)+)', 1) as marks from split),
parsed as (
  select *, length(regexp_replace(marks, '[^>]', '', 'g')) as level,
    case when marks <> '' then regexp_extract(x, '^((?:[\\x20\\x09]*>)+)[\\x20\\x09]?(.*)$', 2) else x end as body
  from marked),
lines as (select conv_id, turn, i, level, body, lower(trim(regexp_replace(body, '{SPACE}+', ' ', 'g'))) as norm from parsed),
origins as (select conv_id, norm, min(turn) as origin from lines where level = 0 and norm <> '' group by 1, 2),
linked as (
  select l.conv_id, l.turn, level, origin from lines l join origins o on l.conv_id = o.conv_id and l.norm = o.norm
  where level > 0 and l.norm <> '' and origin < l.turn),
votes as (select conv_id, turn, origin, count(*) as votes from linked where level = 1 group by 1, 2, 3),
chosen as (
  select conv_id, turn, origin from votes
  qualify row_number() over (partition by conv_id, turn order by votes desc, origin desc) = 1),
nodes as (
  select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before
  from (select distinct conv_id, turn from conversations where conv_id is not null and turn is not null)),
replies as (
  select n.conv_id, n.turn, coalesce(c.origin, n.before) as parent from nodes n
  left join chosen c on c.conv_id = n.conv_id and c.turn = n.turn),
threads(conv_id, turn, root, depth) as (
  select conv_id, turn, turn, 0::bigint from replies where parent is null
  union all select r.conv_id, r.turn, t.root, t.depth + 1 from replies r
  join threads t on t.conv_id = r.conv_id and t.turn = r.parent),
told as (
  select conv_id, turn, count(*) filter (level > 0) as n_quoted,
    trim(coalesce(string_agg(body, chr(10) order by i) filter (level = 0), ''), chr(10) || ' ') as content
  from lines group by 1, 2),
counts as (select conv_id, turn, count(*) as n_linked from linked group by 1, 2)
select m.conv_id, m.turn, m.role, r.parent as parent_turn, coalesce(t.root, m.turn) as thread_turn,
  coalesce(t.depth, 0) as depth, n_quoted, coalesce(n_linked, 0) as n_linked, content,
  coalesce(m.role, '') || ': ' || content as formatted
from conversations m join told o on o.conv_id = m.conv_id and o.turn = m.turn
left join replies r on r.conv_id = m.conv_id and r.turn = m.turn
left join threads t on t.conv_id = m.conv_id and t.turn = m.turn
left join counts c on c.conv_id = m.conv_id and c.turn = m.turn
"""

_vocabulary = " ".join(f"when '{code}' then {_list(ws)}" for code, ws in COMMON_WORDS.items())
op4_quality_rules = f"""
with base as (
  select doc_id, lang, t, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') as w
  from (select doc_id, lang, coalesce(text, '') as t from documents)),
windows as (
  select doc_id, p, w[p:p + 7] as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from base where len(w) >= 8)),
often as (select doc_id, p from windows qualify count(*) over (partition by doc_id, win) > 1),
steps as (select doc_id, least(8, coalesce(lead(p) over (partition by doc_id order by p) - p, 8)) as step from often),
repeats as (select doc_id, sum(step)::bigint as n from steps group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from base)
  where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id),
counted as (
  select b.doc_id, lang, t, w, len(w)::bigint as n_words, length(regexp_replace(t, '{SPACE}+', '', 'g'))::bigint as word_chars,
    {_count("#*$%&|<>")}::bigint as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from base b left join lines l on l.doc_id = b.doc_id left join repeats r on r.doc_id = b.doc_id),
ruled as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    [{", ".join(_count(c) for c in CHAR_CLASSES)}, length(t) - word_chars, n_symbols] as cc0,
    list_transform(case lang {_vocabulary} else []::varchar[] end, lambda v: len(list_filter(w, lambda x: x = v))::bigint) as cw0
  from counted),
cells as (
  select doc_id, lang, base_failed, n_words, list_concat(cc0, [greatest(length(t) - list_sum(cc0), 0)]) as cc,
    list_concat(cw0, [n_words - coalesce(list_sum(cw0), 0)]) as cw from ruled),
one as (
  select doc_id, lang, base_failed, 'c' as kind, unnest(cc)::double as v, generate_subscripts(cc, 1) as i from cells
  union all select doc_id, lang, base_failed, 'w', unnest(cw)::double, generate_subscripts(cw, 1) from cells),
refs as (select lang, kind, i, sum(v) as q from one where not base_failed group by 1, 2, 3),
totals as (select lang, kind, sum(q) as q from refs group by 1, 2),
sums as (select doc_id, kind, sum(v) as p from one group by 1, 2),
shares as (
  select o.doc_id, o.kind, s.p as tp, t.q as tq, v / s.p as a, r.q / t.q as b from one o
  join sums s on s.doc_id = o.doc_id and s.kind = o.kind
  join totals t on t.lang is not distinct from o.lang and t.kind = o.kind
  join refs r on r.lang is not distinct from o.lang and r.kind = o.kind and r.i = o.i
  where s.p >= case o.kind when 'c' then 200 else 80 end and t.q >= 10 * case o.kind when 'c' then 200 else 80 end),
distances as (
  select doc_id, kind, sqrt(greatest(sum(case when a > 0 then a * log2(2 * a / (a + b)) else 0 end
    + case when b > 0 then b * log2(2 * b / (a + b)) else 0 end) / 2, 0)) as d from shares group by 1, 2)
select r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(c.d, 0) <= 0.28 and coalesce(w.d, 0) <= 0.27 as kept
from ruled r left join distances c on c.doc_id = r.doc_id and c.kind = 'c'
left join distances w on w.doc_id = r.doc_id and w.kind = 'w'
"""

op5_embedding_duplicates = f"""
with recursive usable as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
nodes as (select vec_id as x from embeddings),
{_closure("nodes", "links")},
counts as (select x, count(*) as n from links group by x)
select v.vec_id, coalesce(n, 0) as n_links, root as component_id, v.vec_id = root as kept
from embeddings v join roots r on r.x = v.vec_id left join counts c on c.x = v.vec_id
"""

op10_repeats = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (
  select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as s
  from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as p from docs where length(h) >= 200)),
again as (select doc_id, p from strings qualify row_number() over (partition by s order by doc_id, p) > 1),
marked as (
  select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as new from again),
runs as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from marked),
spans as (select doc_id, run, min(p) as a, max(p) + 100 as b from runs group by 1, 2),
pieces as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as begin, a as stop from spans
  union all select d.doc_id, coalesce(max(b), 0), max(length(h) // 2) from docs d left join spans s on s.doc_id = d.doc_id
  group by d.doc_id),
kept as (
  select p.doc_id, string_agg(substr(h, 2 * p.begin + 1, 2 * (stop - p.begin)), '' order by p.begin) as rest
  from pieces p join docs d on d.doc_id = p.doc_id group by p.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, (length(h) // 2 - length(rest) // 2)::bigint as n_removed,
  coalesce(n, 0) as n_spans, sha256(unhex(rest)) as kept_sha256
from docs d join kept k on k.doc_id = d.doc_id
left join (select doc_id, count(*) as n from spans group by 1) s on s.doc_id = d.doc_id
"""

ORACLES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quote_threads": op2_quote_threads,
    "op4_quality_rules": op4_quality_rules,
    "op5_embedding_duplicates": op5_embedding_duplicates,
    "op10_repeats": op10_repeats,
}

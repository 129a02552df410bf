"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import hash_unit_sql
from .urls import RULES

_HOST = r"translate(regexp_extract(regexp_extract({u}, '(?s)^.*?://(.*)$', 1), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(regexp_extract({u}, '(?s)^.*?://(.*)$', 1), '(?s)^[^/?#]*([^?#]*)', 1)"


def _host(u: str) -> str:
    return f"coalesce({_HOST.format(u=u)}, '')"


def _path(u: str) -> str:
    return f"coalesce({_PATH.format(u=u)}, '')"


def _node(u: str) -> str:
    bare = f"regexp_replace(trim({u}), '(?s)#.*$', '')"
    return f"case when contains({bare}, '://') then lower(regexp_extract({bare}, '(?s)^(.*?)://', 1)) || '://' || {_host(bare)} || regexp_extract({bare}, '(?s)^.*?://[^/?#]*(.*)$', 1) end"


def _attribute(name: str) -> str:
    forms = (r'"([^"]*)"', r"''([^'']*)''", r"([^\s\"''>]+)")
    return "coalesce(" + ", ".join(rf"nullif(regexp_extract(tag, '(?is)\b{name}\s*=\s*{f}', 1), '')" for f in forms) + ", '')"


def _resolved(base: str, t: str) -> str:
    scheme = f"regexp_extract({base}, '(?s)^(.*?)://', 1)"
    root = f"{scheme} || '://' || {_host(base)}"
    folder = f"coalesce(nullif(regexp_extract({_path(base)}, '(?s)^(.*/)', 1), ''), '/')"
    return rf"""case when {t} is null or {t} = '' then null
        when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.\-]*://') then {t}
        when starts_with({t}, '//') then {scheme} || ':' || {t}
        when starts_with({t}, '/') then {root} || {t}
        when starts_with({t}, '?') then {root} || {_path(base)} || {t}
        else {root} || {folder} || {t} end"""


_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)


def _ruled(name: str, source: str) -> str:
    return f"""{name} as (select x.*, r.rule, r.own from {source} x left join lateral (
        select rh || rp as rule, rv as own from rules
        where (x.host = rh or ends_with(x.host, '.' || rh)) and starts_with(x.path, rp)
        order by length(rh || rp) desc, rh || rp limit 1) r on true)"""


OP2 = rf"""
with recursive rules(rh, rp, rv) as (values {_RULES}),
tags as (select url, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\b[^>]*>)', 1)) as tag from pages where contains(url, '://')),
links as (select url, trim(coalesce(
    case when regexp_matches(lower({_attribute("rel")}), '(^|\s)canonical(\s|$)') then {_attribute("href")} end,
    case when lower({_attribute("http-equiv")}) = 'refresh' then regexp_extract({_attribute("content")}, '(?is)url\s*=\s*[''"]?([^''"]+)', 1) end)) as t from tags),
ends as (select {_node("url")} as a, {_node("to_url")} as b from (select url, {_resolved("url", "t")} as to_url from links)),
edges as (select a, b from ends where a is not null and b is not null and a <> b union select b, a from ends where a is not null and b is not null and a <> b),
reach(node, other) as (select a, a from edges union select r.node, e.b from reach r join edges e on r.other = e.a),
classes as (select node, min(other) as root from reach group by node),
named as (select node, root, {_host("node")} as host, {_path("node")} as path from classes),
{_ruled("judged_nodes", "named")},
blocked as (select root, max(case when own = 'block' then 1 else 0 end) as b from judged_nodes group by root),
marked as (select c.node, c.root, b.b from classes c join blocked b using (root)),
parts as (select page_id, {_host("url")} as host, {_path("url")} as path, {_node("url")} as n from pages),
{_ruled("judged", "parts")}
select page_id, host, path, rule, coalesce(own, case when b = 1 then 'block' else 'allow' end) as verdict, root as alias_of
from judged left join marked on n = node
"""

_U5 = hash_unit_sql("coalesce(doc_id::varchar, md5(text))", "'mix'")
OP5 = rf"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, {_U5} as u from documents),
strata as (select source, length(bin(size)) as favour, sum(size)::bigint as words from sized group by all),
sources as (select source, sum(words)::bigint as source_size from strata group by source),
ranked as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as w, source_size * 2.0::double as cap from sources),
steps as (select *, row_number() over (order by cap / w, source nulls last) as k,
    coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as caps,
    sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rest,
    sum(source_size) over () * 1.5::double as total from ranked),
level as (select arg_min((total - caps) / rest, k) as lv from steps where cap > w * ((total - caps) / rest)),
goals as (select source, source_size, case when lv is null or cap <= w * lv then cap else w * lv end as target from steps left join level on true),
tried as (select s.source, favour, words, source_size, target,
    (target - 2.0::double * coalesce(sum(words) over (partition by s.source order by favour desc rows between unbounded preceding and 1 preceding), 0))
        / nullif(sum(favour * words) over (partition by s.source order by favour desc rows between current row and unbounded following), 0)::double as l
    from strata s join goals g on s.source is not distinct from g.source),
rates as (select source, arg_max(l, favour) filter (where l * favour <= 2.0::double) as rate from tried group by source),
held as (select t.source, source_size, target, rate, sum(floor(least(2.0::double, coalesce(rate * favour, 2.0::double))) * words) as certain
    from tried t join rates r on t.source is not distinct from r.source group by all),
odds as (select doc_id, s.source, size, u, source_size, target, certain,
    case when size = 0 then 0.0::double else least(2.0::double, coalesce(rate * length(bin(size)), 2.0::double)) end as e
    from sized s join held h on s.source is not distinct from h.source),
parted as (select *, e - floor(e) as part from odds),
queued as (select *, coalesce(sum(case when part > 0 then size else 0 end) over (partition by source order by case when part > 0 then (u / (1 - u)) / (part / (1 - part)) end nulls first, doc_id, size
    rows between unbounded preceding and 1 preceding), 0) as before from parted)
select doc_id, size, source_size, target,
    ((floor(e) + case when part > 0 and before + size / 2.0::double <= target - certain then 1 else 0 end) * size)::bigint as taken
from queued
"""

_COSTS = ", ".join(f"{{'c': -ln({hash_unit_sql('doc_id', str(s))}) / 1.0, 's': {s}}}" for s in range(17))
OP7 = f"""
with crc as (select list(v order by i) as t from (select i, list_reduce(range(8), lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end, i::bigint) as v from range(256) r(i))),
costs as (select doc_id, text, [{_COSTS}] as c, {hash_unit_sql("doc_id")} as u from documents),
dealt as (select doc_id, coalesce(octet_length(encode(text)), 0)::bigint + 1 as size,
    case when text is not null then 4294967295 - list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint),
        lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1]), 4294967295::bigint) end as text_crc32,
    'key' as law, list_min(c[:16])['s']::int as shard, list_min(c)['s']::int as grown_shard, u from costs, crc)
select doc_id, size, text_crc32, law, shard, row_number() over (partition by shard order by u, doc_id, text_crc32, size) - 1 as slot, grown_shard from dealt
"""

#: What a recursive closure of links(a, b), in both directions, says of each node.
_CLOSURE = """reach(node, other) as (select a, b from links union select r.node, l.b from reach r join links l on r.other = l.a),
roots as (select node, least(node, min(other)) as root from reach group by node)"""

#: Every pair of vectors.
OP1 = f"""
with recursive sound as (select vec_id, embedding::double[] as e from embeddings
    where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from sound a join sound b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
{_CLOSURE},
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, vec_id) as component_id, vec_id = coalesce(root, vec_id) as kept
from embeddings left join counts on vec_id = a left join roots on vec_id = node
"""

#: Every pair of documents that share a shingle.
OP3 = rf"""
with recursive words as (select doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as g from words),
sizes as (select doc_id, count(*) as size from grams group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as n from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by all),
alike as (select a, b, n, p.size as size_a, q.size as size_b from shared join sizes p on a = p.doc_id join sizes q on b = q.doc_id where n >= 0.8::double * (p.size + q.size - n) - 1e-9::double),
links as (select a, b from alike),
{_CLOSURE},
counts as (select a, count(*) as n, min(case when n = size_a and n = size_b then b end) as twin from alike group by a)
select doc_id, least(doc_id, coalesce(twin, doc_id)) as class_id, coalesce(n, 0)::bigint as n_links, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept
from documents left join counts on doc_id = a left join roots on doc_id = node
"""


def _plan(buckets: int) -> str:
    """The dynamic programme of the buckets, a table for each number of them, and the way back."""
    tables = ["t1 as materialized (select j, pad as cost, 1::bigint as start from pads where i = 1)"]
    tables += [
        f"""t{k} as materialized (select j, min({{'c': coalesce(cost, 0) + pad, 'i': i}}) as best, best['c'] as cost, best['i'] as start
        from (select p.i, p.j, p.pad, q.cost from pads p left join t{k - 1} q on q.j = p.i - 1) group by j)"""
        for k in range(2, buckets + 1)
    ]
    back = [f"k{buckets} as (select j, start from t{buckets} where j = (select max(j) from h))"]
    back += [f"k{k} as (select t.j, t.start from t{k} t join k{k + 1} x on t.j = x.start - 1)" for k in range(buckets - 1, 0, -1)]
    return ",\n".join([*tables, *back]) + ",\nends as (" + " union ".join(f"select j from k{k}" for k in range(1, buckets + 1)) + ")"


OP4 = rf"""
with sized as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens, {hash_unit_sql("doc_id", "'pack'")} as u from documents),
h as materialized (select n_tokens as top, count(*) as n, row_number() over (order by n_tokens) as j from sized group by n_tokens),
sums as materialized (select j, top, n, sum(n) over (order by j)::bigint as r, sum(n * top) over (order by j)::bigint as w from h),
pads as materialized (select x.j as i, y.j as j, (y.top * (y.r - x.r + x.n) - (y.w - x.w + x.n * x.top))::bigint as pad from sums x join sums y on x.j <= y.j),
{_plan(16)},
buckets as (select row_number() over (order by top) - 1 as bucket, top as bucket_len, coalesce(lag(top) over (order by top), -1) as below from ends join h using (j)),
placed as (select doc_id, n_tokens, bucket::int as bucket, bucket_len, greatest(1, 65536 // greatest(bucket_len, 1)) as per,
    row_number() over (partition by bucket order by u, doc_id, n_tokens) - 1 as place from sized join buckets on n_tokens > below and n_tokens <= bucket_len)
select doc_id, n_tokens, bucket, bucket_len, (place // per)::bigint as batch, (place % per)::int as slot from placed
"""

_ENOUGH = "case when n >= 20 then 2 when n >= 3 then 3 else 10 end"
#: Every pair of lines of a leaf.
OP8 = rf"""
with recursive docs as (select row_number() over () as r, doc_id, text from documents),
split as (select r, doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from (select r, doc_id, string_split(text, chr(10)) as l from docs where text <> '')),
tokens as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as t from split),
masked as (select *, list_transform(t, lambda x: case when regexp_matches(x, '\p{{Nd}}') then '<*>' else x end) as m, array_to_string(t, ' ') as whole from tokens where len(t) > 0),
kinds as (select *, len(t) >= 3 and len(list_filter(m, lambda x: x = '<*>')) <= (1::double - 0.8::double) * len(t) as fixed,
    case when len(t) >= 3 then len(t) when length(whole) >= 100 then 20 when length(whole) >= 20 then 3 else len(t) end as n from masked),
parsed as (select r, doc_id, pos, n, m, fixed, case when len(t) < 3 then [len(t)::varchar] else list_concat([len(t)::varchar], m[1:3]) end as leaf,
    case when fixed then array_to_string(m, ' ') else whole end as id from kinds),
named as (select *, dense_rank() over (order by leaf, id, fixed) as line from parsed),
kept as (select line, any_value(leaf) as leaf, any_value(m) as m, any_value(n) as n, any_value(fixed) as fixed from named group by line),
able as (select * from kept where fixed and n >= 5),
links as (select x.line as a, y.line as b from able x join able y on x.leaf = y.leaf and x.line <> y.line
    where len(list_filter(range(1, x.n + 1), lambda i: x.m[i] = y.m[i] and x.m[i] <> '<*>')) >= 0.8::double * x.n - 1e-9::double),
{_CLOSURE},
templates as (select line, n, coalesce(root, line) as template from kept left join roots on line = node),
recurring as (select template, min(doc_id) as keep from (select distinct r, doc_id, line from named) join templates using (line) group by template having count(distinct r) >= any_value({_ENOUGH})),
lost as (select r, pos from named join templates using (line) join recurring using (template) where doc_id <> keep),
left_ as (select s.r, count(*) as n_lines, count(l.pos) as n_dropped, string_agg(line, chr(10) order by s.pos) filter (l.pos is null) as text from split s left join lost l on s.r = l.r and s.pos = l.pos group by s.r)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, case when d.text is null then null else coalesce(x.text, '') end as text
from docs d left join left_ x on d.r = x.r
"""

_SAFE = r"regexp_replace(coalesce(text, ''), '<(\\*)(turn:|/turn>|part:)', '<\\\1\2', 'g')"
OP12 = rf"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, {_SAFE} as safe from conversations
    union all select -7, i, case when i = 0 then 'user' else 'assistant' end, t, regexp_replace(t, '</turn>', '<\\/turn>') from (select unnest([0, 1]) as i, '\### Assistant: </turn> ok' as t)),
whole as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, safe) as told,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, safe), '') as learnt,
    string_agg('<turn:' || replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') || '>' || safe || '</turn>' || chr(10), '') as formatted from rows group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, length(formatted) as formatted_chars from whole
"""

#: Pairs of equal 5-grams of a document, by their distance: pairs without a gap between them are a run.
OP13 = rf"""
with crc as (select list(v order by i) as t from (select i, list_reduce(range(8), lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end, i::bigint) as v from range(256) r(i))),
docs as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
    4294967295 - list_reduce(regexp_extract_all(hex(encode(doc_id::varchar)), '..').list_transform(lambda h: ('0x' || h)::bigint), lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1]), 4294967295::bigint) as h
    from documents, crc),
cuts as (select r, doc_id, w, len(w) as n, coalesce(h % 10 = 0, false) as planted, (h // 10) % len(w) as a, h // 10 as g from docs),
texts as (select r, doc_id, n, case when planted and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from cuts),
grams as (select r, n, unnest(range(n - 4)) as i, unnest(list_transform(range(n - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) as gram from texts where n >= 6),
pairs as (select x.r, x.i, y.i - x.i as q from grams x join grams y on x.r = y.r and x.gram = y.gram and y.i > x.i and 4 * (y.i - x.i) <= x.n),
stretches as (select r, q, min(i) as start, count(*) + 4 + q as length from (select *, i - row_number() over (partition by r, q order by i) as island from pairs) group by r, q, island),
runs as (select r, start, length, min(q) as period from stretches where length >= greatest(6, 4 * q) group by r, start, length),
best as (select r, count(*) as n_runs, max({{'l': length, 's': -start, 'p': -period}}) as b, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as told from runs group by r),
words as (select r, unnest(range(n)) as i, unnest(w) as word from texts),
lost as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(word, ' ' order by i) as text from words anti join lost using (r, i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, (-b['s'])::bigint as start, b['l']::bigint as length, (-b['p'])::bigint as period, (1000 * b['l'] // -b['p'])::bigint as exponent_milli,
    sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from texts left join best using (r) left join kept using (r)
"""

#: op9_nearest_neighbours by comparing every query with every vector. Its scores differ in their last bits, as sums go in another
#: order, so it serves a test and not as the query's SQL.
EXACT_SEARCH = """
with sound as (select vec_id, embedding::double[] as e from embeddings
    where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.e, b.e) as score from sound a join sound b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""

ORACLES = {
    "op1_embedding_near_dedup": OP1, "op2_url_filter": OP2, "op3_ngram_join": OP3, "op4_length_packing": OP4, "op5_source_mixing": OP5, "op7_sharding": OP7, "op8_line_dedup": OP8,
    "op12_chat_format": OP12, "op13_periodic_runs": OP13,
}

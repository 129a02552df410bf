"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

from fernglass.operators.display import PLAYERS
from fernglass.operators.fielded import SEARCH_FIELDS

from .catalog import _BIRTHS, _STATES, ENTRY_QUERY, PART_FIELDS, PLAYER_QUERY, RANKED_QUERY

TOKEN = r"'[a-z0-9]+(?:[''\-][a-z0-9]+)*'"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {TOKEN})"


_TF = f"tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_tok('text')}) as term from documents) group by all)"
_DF = "df as (select term, count(*) as df from tf group by term)"
_N = "size as (select count(*) as n from documents)"
_STD = "case when df = 0 then 0 else ln(n::double / (df + 1)) end"
_PRB = "case when df = 0 or df = n then 0 else greatest(0, ln((n - df)::double / df)) end"
_W = f"w as (select doc_id, term, tf, df, (1 + ln(tf)) * ({_STD}) as w_standard, (1 + ln(tf)) * ({_PRB}) as w_probabilistic from tf join df using (term) cross join size)"
_NORMS = "norms as (select doc_id, sqrt(sum(w_standard * w_standard)) as n_standard, sqrt(sum(w_probabilistic * w_probabilistic)) as n_probabilistic from w group by doc_id)"
_INDEX = f"with {_TF}, {_DF}, {_N}, {_W}, {_NORMS}"


def _scores(method: str, queries: str) -> str:
    idf = _STD if method == "standard" else _PRB
    return f"""{_INDEX},
    qtf as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tok('query')}) as term from ({queries})) group by all),
    q as (select query_id, term, (1 + ln(qtf)) * ({idf}) as q from (select query_id, term, qtf, coalesce(df, 0) as df from qtf left join df using (term)) cross join size),
    qn as (select query_id, sqrt(sum(q * q)) as q_norm from q group by query_id),
    scores as (select query_id, doc_id, round(sum(q * w_{method}) / (any_value(q_norm) * any_value(n_{method})), 6) as score
        from q join qn using (query_id) join w using (term) join norms using (doc_id) where q_norm > 0 and n_{method} > 0 group by query_id, doc_id)"""


def _ranked(method: str) -> str:
    one = f"select 0 as query_id, '{RANKED_QUERY}' as query"
    return f"{_scores(method, one)} select doc_id, score from scores order by score desc, doc_id limit 10"


def _has(term: str) -> str:
    return f"list_contains({_tok('text')}, '{term}')"


_SETS = f"with {_TF}"


def _members(term: str) -> str:
    return f"select doc_id from tf where term = '{term}'"


#: Words by Unicode's breaks, ideographs and hiragana set apart first.
_LETTERS, _DIGITS = r"(?:[\pL\p{Nl}]\pM*)+", r"(?:\p{Nd}\pM*)+"
_CORE = rf"(?:{_LETTERS}(?:[:.·’‘''․‧]\pM*{_LETTERS})*|{_DIGITS}(?:[,;.’‘''․]\pM*{_DIGITS})*)+"
_WORDS = rf"regexp_extract_all(regexp_replace(lower(text), '([\p{{Han}}\p{{Hiragana}}]\pM*)', ' \1 ', 'g'), '\p{{Pc}}*{_CORE}(?:\p{{Pc}}+{_CORE})*\p{{Pc}}*')"

_PLAYERS = """players as (select c_custkey as doc_id, case when c_custkey % 11 = 0 then 'Unknown' else c_name end as Player,
    case when c_custkey % 7 = 0 then 'Unknown Status (Meta Missing)' else c_mktsegment end as CurrentTeam from customer)"""

_SOURCES = """a as (select 'player ' || right(c_name, 9) as Player, case when c_custkey % 3 = 0 then 'N/A' else (c_custkey % 8)::varchar || '-1' end as Height,
    case when c_custkey % 4 <> 0 then (c_custkey % 300)::varchar end as Weight, case when c_custkey % 5 = 0 then 'N/A' else (c_custkey % 2)::varchar end as BornYear,
    c_mktsegment as College, c_name as BornCity, c_nationkey::varchar as BornState from customer),
b as (select ' PLAYER ' || right(s_name, 9) || ' ' as player_name, case when s_suppkey % 5 = 0 then 'N/A' else (s_suppkey % 2)::varchar end as birth_year, s_name,
    case when s_suppkey % 6 = 0 then 'N/A' else (s_suppkey % 7)::varchar || '-' || (s_suppkey % 12)::varchar end as hc, s_nationkey::varchar as hs from supplier)"""
_ON = "upper(trim(a.Player)) = upper(trim(b.player_name)) and {a} = {b}"


def _merged(on: str) -> str:
    side_b = "b.s_name is null"
    return f"""with {_SOURCES} select coalesce(a.Player, b.player_name, 'N/A') as Player, coalesce(a.Height, b.hc, 'N/A') as Height,
    coalesce(a.Weight, case when {side_b} then null else '200 lb' end, 'N/A') as Weight, coalesce(a.BornYear, b.birth_year, 'N/A') as BornYear,
    case when {side_b} then 'N/A' else '2001' end as DraftYear, coalesce(a.College, b.s_name, 'N/A') as College, case when a.Player is not null then '' else b.hs end as HighSchool,
    coalesce(a.College, 'N/A') as Position, coalesce(a.BornCity, 'N/A') as BornCity, coalesce(a.BornState, 'N/A') as BornState, coalesce(b.s_name, 'N/A') as BirthPlace_Other,
    case when a.Player is null then 'N/A' else 'Retired' end as CurrentTeam, case when a.Player is null then 'N/A' else 'Undrafted' end as DraftTeam, 'N/A' as draft_round,
    case when a.Player is null then 'N/A' else 'Alive' end as DiedYear, case when {side_b} then 'N/A' else 'info' end as info
    from a full outer join b on {on}"""


_SAME = _ON.format(a="a.BornYear", b="b.birth_year")
_DERIVED = f"""with merged as ({_merged(_SAME)}) select Player as player, regexp_replace(Weight, '[^0-9]', '', 'g') as weight, regexp_replace(Weight, '[^0-9]', '', 'g') as weight_text,
    Player as full_name_search, BornCity || ' ' || BornState || ' ' || BirthPlace_Other as location_search from merged"""

_PLAYER_ROWS = f"""select c_custkey as doc_id, c_name as Player, 'QB' as Position, '6-' || (c_custkey % 10) as Height, '2' || (c_custkey % 10) || '0lb' as Weight, (1950 + c_custkey % 50)::varchar as BornYear,
    case when c_custkey % 3 = 0 then 'Town & Co' else 'Town' end as BornCity, case when c_custkey % 3 = 0 then n_name else [{', '.join(f"'{s}'" for s in _STATES)}][c_custkey % 4 + 1] end as BornState,
    case when c_custkey % 6 = 0 then 'Died' when c_custkey % 6 = 1 then 'Retired' else n_name end as CurrentTeam, case when c_custkey % 6 = 0 then (2001 + c_custkey % 20)::varchar else 'Alive' end as DiedYear,
    c_mktsegment as College, 'H''' || n_name as HighSchool, case when c_custkey % 5 = 0 then 'Undrafted' else c_mktsegment end as DraftTeam,
    case when c_custkey % 5 = 0 then 'Undrafted' else (1950 + c_custkey % 50)::varchar end as DraftYear
    from customer join nation on c_nationkey = n_nationkey where c_custkey % 13 <> 0"""
_MISSING_ROWS = """select c_custkey as doc_id, c_name as Player, 'N/A' as Position, 'N/A' as Height, 'N/A' as Weight, 'N/A' as BornYear, 'N/A' as BornCity, 'N/A' as BornState,
    'Unknown Status (Meta Missing)' as CurrentTeam, 'N/A' as DiedYear, 'N/A' as College, 'N/A' as HighSchool, 'Undrafted' as DraftTeam, 'Undrafted' as DraftYear from customer where c_custkey % 13 = 0"""
_TEXT_ORDER = "Player, Position, Height, Weight, BornYear, BornCity, BornState, CurrentTeam, DiedYear, College, HighSchool, DraftTeam, DraftYear"

_IS_PLAYER = "(p_partkey % 4 = 0 or (p_partkey % 3 <> 2 and p_partkey % 4 <> 1)) and p_partkey % 10 <> 0"


def _cell(value: str, width: int, right: bool) -> str:
    return f"{'lpad' if right else 'rpad'}(left({value}, {width}), {width}, ' ')"


_CELLS = {"#": "c_custkey::varchar", "Doc ID": "c_custkey::varchar", "Score": "printf('%.4f', c_acctbal / 7)", "Player": "c_name", "Pos": "c_mktsegment"}
_LINE = " || ' | ' || ".join(_cell(_CELLS.get(s.title, "'N/A'"), s.width, s.right) for s in PLAYERS)

_STOK = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_PART = "parts as (" + " union all ".join(f"select p_partkey as doc_id, '{f}' as field, {b}::double as boost, {_STOK.format(x=f)} as toks from part" for f, b in PART_FIELDS.items()) + ")"
_BM = f"""with {_PART}, post as (select doc_id, field, boost, len(toks) as len, unnest(toks) as term from parts),
    ptf as (select doc_id, field, boost, len, term, count(*) as tf from post group by all), pdf as (select field, term, count(*) as df from ptf group by all),
    st as (select field, count(*) as n, avg(len(toks)) as ml from parts where len(toks) > 0 group by field),
    sc as (select doc_id, term, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::double * (0.25::double + 0.75::double * len / ml)) as s from ptf join pdf using (field, term) join st using (field))"""


def _sum(terms: str) -> str:
    return f"(select doc_id, sum(s) as s from sc where term in ({terms}) group by doc_id)"


def _like(test: str, where: str = "true") -> str:
    """Fields with a term that passes the test count their boost."""
    return f"{_BM} select doc_id, round(sum(boost), 6) as score from (select distinct doc_id, field, boost from ptf where {test} and {where}) group by doc_id"


def _near(word: str, edits: int) -> str:
    """Terms so many edits away score by BM25 with the largest document frequency of theirs in the field, times 1 less the edits
    over the shorter length."""
    return f"""{_BM}, away as (select field, term, df, damerau_levenshtein(term, '{word}') as e from pdf where damerau_levenshtein(term, '{word}') <= {edits}),
        most as (select field, max(df) as df from away group by field)
        select doc_id, round(sum(boost * (1 - e / least(length(term), {len(word)})::double) * ln(1 + (n - most.df + 0.5) / (most.df + 0.5)) * tf / (tf + 1.2::double * (0.25::double + 0.75::double * len / ml))), 6) as score
        from ptf join away using (field, term) join most using (field) join st using (field) group by doc_id"""


_MONEY = "c_acctbal::decimal(12,2)::varchar"
_NAMED = "case when c_custkey % 17 = 0 then '' else c_name end"
_SOUND = "c_custkey % 7 <> 0 and c_custkey % 11 <> 0 and c_custkey % 13 <> 0 and c_custkey % 17 <> 0"

#: small must be in a field, ring mustn't, economy counts twice; all in one field.
_MUST = f"""{_BM}, fs as (select ptf.doc_id, field, term, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::double * (0.25::double + 0.75::double * len / ml)) as s
    from ptf join pdf using (field, term) join st using (field))
    select doc_id, round(sum(case term when 'small' then s when 'economy' then 2 * s else 0 end), 6) as score from fs x
    where exists (select 1 from fs y where y.doc_id = x.doc_id and y.field = x.field and y.term = 'small') and not exists (select 1 from fs y where y.doc_id = x.doc_id and y.field = x.field and y.term = 'ring')
    group by doc_id"""


#: Pairs of spots of two neighbours: bolt then red, or red then bolt, with at most two places of moving; the best match of
#: each start counts 1 / (1 + the moves). A query that names a field counts with the boosts of all.
_SLOP = f"""with w as (select p_partkey as doc_id, {_STOK.format(x='p_name')} as t from part), n as (select doc_id, len(t) as len, generate_subscripts(t, 1) as pos, unnest(t) as term from w),
    st as (select count(*) as n, avg(len(t)) as ml from w), df as (select term, count(distinct doc_id) as df from n group by term),
    moved as (select doc_id, len, term, pos - case when term = 'red' then 1 else 0 end as q from n where term in ('bolt', 'red')),
    starts as (select distinct doc_id, len, q from moved),
    gaps as (select s.doc_id, s.len, s.q, greatest(min(m.q) filter (m.term = 'bolt'), min(m.q) filter (m.term = 'red')) - s.q as gap, count(distinct m.term) as k
        from starts s join moved m on m.doc_id = s.doc_id and m.q >= s.q group by s.doc_id, s.len, s.q),
    found as (select doc_id, any_value(len) as len, sum(1 / (1 + gap)) as f from gaps where k = 2 and gap <= 2 group by doc_id)
    select doc_id, round({sum(PART_FIELDS.values())}::double * (select sum(ln(1 + (n - df + 0.5) / (df + 0.5))) from df, st where term in ('bolt', 'red')) * f / (f + 1.2::double * (0.25::double + 0.75::double * len / ml)), 6) as score
    from found, st"""

_PLACE = "replace(n_name, '_', ' ')"
_CUSTOMERS = f"""c as (select c_custkey as doc_id, replace(c_name, '#', ' ') as player, c_mktsegment as position, 'College of ' || {_PLACE} as college, case when c_custkey % 3 = 0 then '' else {_PLACE} end as borncity,
    case when c_custkey % 4 = 0 then '' else 'Bigland' end as bornstate, case when c_custkey % 5 = 0 then 'Retired' else c_mktsegment || ' Bears' end as currentteam, 'Undrafted' as draftteam, 'N/A' as highschool,
    'a player of ' || {_PLACE} || ' in ' || c_mktsegment as info, (180 + c_custkey % 90)::varchar as weight, '6-' || (c_custkey % 12) as height from customer join nation on c_nationkey = n_nationkey)"""
_FIELD_TEXT = {"full_name_search": "player", "position_search": "position", "college_search": "college", "location_search": "concat_ws(' ', nullif(borncity, ''), nullif(bornstate, ''))", "birthplace_other": "''"}
_TOPK = f"""with {_CUSTOMERS}, parts as ({" union all ".join(f"select doc_id, '{f}' as field, {b}::double as boost, {_STOK.format(x=_FIELD_TEXT.get(f, f))} as toks from c" for f, b in SEARCH_FIELDS.items())}),
    ptf as (select doc_id, field, boost, len(toks) as len, term, count(*) as tf from (select *, unnest(toks) as term from parts) group by all), pdf as (select field, term, count(*) as df from ptf group by all),
    st as (select field, count(*) as n, avg(len(toks)) as ml from parts where len(toks) > 0 group by field),
    top as (select doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::double * (0.25::double + 0.75::double * len / ml))), 4) as score from ptf join pdf using (field, term) join st using (field)
        where term in ({", ".join(f"'{t}'" for t in PLAYER_QUERY.split())}) group by doc_id order by score desc, doc_id limit 10)"""

_AWKWARD = "select c_custkey::varchar as key, c_name || case when c_custkey % 2 = 0 then ', the \"old\" one' else chr(10) || 'of two lines' end as name, printf('%03d', c_custkey % 1000) as code from customer"

ORACLES = {
    "tokenize": f"select doc_id, len({_tok('text')}) as n_tokens from documents",
    "standard_words": f"select doc_id, coalesce(len(w), 0) as n_words, md5(coalesce(array_to_string(w, ' '), '')) as words_md5 from (select doc_id, {_WORDS} as w from documents)",
    "term_frequency": f"with {_TF} select doc_id, term, tf from tf",
    "document_frequency": f"with {_TF}, {_DF} select term, df from df order by term",
    "postings": f"with {_TF} select term, string_agg(doc_id::varchar, ',' order by doc_id) as doc_ids from tf group by term",
    "posting_blocks": f"with {_TF} select term, (doc_id // 100)::bigint as block, string_agg(doc_id::varchar, ',' order by doc_id) as doc_ids from tf group by all",
    "vocabulary": f"with {_TF} select distinct term from tf order by term",
    "collection_size": "select count(*) as n from documents",
    "idf_both": f"with {_TF}, {_DF}, {_N} select term, df, round({_STD}, 6) as idf_standard, round({_PRB}, 6) as idf_probabilistic from df cross join size",
    "tfidf_weights": f"{_INDEX} select doc_id, term, round(w_standard, 6) as w_standard, round(w_probabilistic, 6) as w_probabilistic from w",
    "transpose_weights": f"{_INDEX} select term, doc_id, round(w_standard, 6) as w_standard from w order by term, doc_id",
    "doc_norms": f"{_INDEX} select doc_id, round(n_standard, 6) as n_standard, round(n_probabilistic, 6) as n_probabilistic from norms",
    "player_documents": f"select doc_id, concat_ws(' ', {_TEXT_ORDER}) as text, Player as name, CurrentTeam as team, BornYear as born from ({_PLAYER_ROWS})",
    **dict.fromkeys(("ranked_standard", "json_search", "stream_ranked", "stream_refreshed"), _ranked("standard")),
    "ranked_probabilistic": _ranked("probabilistic"),
    **dict.fromkeys(("ranked_batch", "ranked_batch_pruned"), f"{_scores('standard', 'select item_id as query_id, text as query from benchmark')} select * from (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from scores) where rank <= 10"),
    "ranked_empty": "select doc_id, 0.0::double as score from documents where false",
    "total_hits": _scores("standard", f"select 0 as query_id, '{RANKED_QUERY}' as query") + " select count(*) as total from scores",
    "boolean_and": f"select doc_id from documents where {_has('the')} and {_has('of')}",
    "boolean_or": f"select doc_id from documents where {_has('trash')} or {_has('clown')}",
    "boolean_not": f"select doc_id from documents where {_has('the')} and not {_has('of')}",
    "boolean_mixed": f"select doc_id from documents where ({_has('der')} or {_has('the')}) and {_has('of')}",
    "boolean_leading_not": f"select doc_id from documents where not {_has('the')}",
    "boolean_or_not": f"select doc_id from documents where {_has('the')} and not {_has('of')}",
    "boolean_quoted": f"select doc_id from documents where {_has('the')} or {_has('mit')}",
    "boolean_missing": "select doc_id from documents where false",
    "boolean_postings": f"select doc_id from documents where {_has('the')} and not {_has('of')}",
    "boolean_setops": f"{_SETS} ((({_members('trash')}) union ({_members('der')})) except ({_members('und')}) union ({_members('the')})) intersect ({_members('of')})",
    "corrupt_filter": f"with {_PLAYERS} select doc_id, concat_ws(' ', nullif(Player, ''), nullif(CurrentTeam, '')) as text from players where Player <> 'Unknown' and CurrentTeam <> 'Unknown Status (Meta Missing)'",
    "outer_join_merge": _merged(_SAME) + " order by Player",
    "left_na_precedence": f"""with {_SOURCES} select coalesce(a.Player, b.player_name) as Player, coalesce(nullif(a.Height, 'N/A'), nullif(b.hc, 'N/A'), 'N/A') as Height,
        coalesce(nullif(a.BornYear, 'N/A'), nullif(b.birth_year, 'N/A'), 'N/A') as BornYear from a full outer join b on {_ON.format(a="nullif(a.BornYear, 'N/A')", b="nullif(b.birth_year, 'N/A')")} order by Player""",
    "blank_to_na": "select p_partkey, case when p_size % 2 = 0 then 'N/A' else p_brand end as brand, case when p_size % 3 = 0 then 'N/A' else p_type end as kind from part",
    "distinct_rows": "select distinct c_mktsegment, c_nationkey from customer",
    "html_title_h1": "select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) as title, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<.*?>', '', 'g')) as h1 from pages",
    "html_links": """with found as (select page_id, unnest(l) as link, generate_subscripts(l, 1) as i from (select page_id, regexp_extract_all(html, '<a href="(/[^"]+)">[^<]+</a>', 1) as l from pages)),
        firsts as (select page_id, link, min(i) as i from found group by all)
        select page_id, row_number() over (partition by page_id order by i) - 1 as at, 'https://example.org' || link as link from firsts""",
    "html_unescape": "select c_custkey, '<b> ' || c_name || ' & ''' || c_mktsegment || '\"' as text from customer",
    "player_extract": _PLAYER_ROWS,
    "player_extract_missing": _MISSING_ROWS,
    "natural_sort": "select row_number() over (order by chr((65 + c_custkey % 26)::int), c_custkey) as place, chr((65 + c_custkey % 26)::int) || '_' || c_custkey || '.html' as file from customer",
    "page_classify": f"select p_partkey from part where {_IS_PLAYER}",
    "infobox_fields": """select p_partkey, p_size || '0' || case when length(p_size || '0') in (2, 3) then ' lb' else '' end as weight, p_brand || ', X' as birth_place, '6' as height_ft,
        (p_partkey % 12)::varchar as height_in, 'State ' || p_type as college, '' as high_school, '1' as draftround from part""",
    "first_sentence": "select p_partkey, p_name || ' is a ' || p_type || ' of size' || p_size || '.' as info from part",
    "wiki_players": f"""select distinct p_name as player_name, (1900 + p_partkey % 100)::varchar as birth_year, p_brand || ', X' as birth_place, '6' as height_ft, (p_partkey % 12)::varchar as height_in,
        p_size || '0' || case when length(p_size || '0') in (2, 3) then ' lb' else '' end as weight_lb, 'State ' || p_type as college, 'N/A' as high_school, (2000 + p_partkey % 20)::varchar as draft_year,
        '1' as draft_round, p_name || ' is a ' || p_type || ' of size' || p_size || '.' as info from part where {_IS_PLAYER}""",
    "birth_year": f"select c_custkey, case when c_custkey % {len(_BIRTHS)} <> {len(_BIRTHS) - 1} then (1900 + c_custkey % 100)::varchar end as birth_year from customer",
    "wiki_clean": "select c_custkey, c_name || ' is the ' || c_custkey || ' and plain label ' || c_custkey || ' bold end' as text from customer",
    "clean_name_surname": "select c_custkey, c_name || ' ' || c_mktsegment as name, c_mktsegment as surname from customer",
    "bm25_multifield": f"{_BM} select doc_id, round(sum(s), 6) as score from sc where term in ('small', 'ring', '13') group by doc_id",
    "bm25_and": f"{_BM} select a.doc_id, round(a.s + b.s, 6) as score from {_sum(chr(39) + 'red' + chr(39))} a join {_sum(chr(39) + 'economy' + chr(39))} b using (doc_id)",
    "bm25_not": f"{_BM} select doc_id, round(s, 6) as score from {_sum(chr(39) + 'small' + chr(39))} where doc_id not in (select doc_id from sc where term = 'economy')",
    "bm25_and_not": f"{_BM} select doc_id, round(s, 6) as score from (select doc_id, sum(s) as s from sc where term in ('red', 'bolt') group by doc_id) where doc_id not in (select doc_id from sc where term = 'economy')",
    "bm25_field_error": f"{_BM} select doc_id, round(sum(s), 6) as score from sc where term = 'ring' and doc_id not in (select doc_id from sc where term = 'economy') group by doc_id",
    "bm25_not_error": f"{_BM} select doc_id, round(sum(s), 6) as score from sc where term = 'small' group by doc_id",
    "bm25_not_regex_error": f"{_BM} select doc_id, round(sum(s), 6) as score from sc where term = 'ring' group by doc_id",
    "bm25_prefix": _like("term like 'ec%'"),
    "bm25_wildcard": _like("term like 'b_lt'"),
    "csv_accepted": f"select c_custkey as key, c_name as name, {_MONEY} as balance from customer where {_SOUND}",
    "csv_rejected": f"""select c_custkey as key, case when c_custkey % 7 = 0 or c_custkey % 11 = 0 then 'columns' else concat_ws('|', case when c_custkey % 13 = 0 then 'balance: decimal(12,2)' end,
        case when c_custkey % 17 = 0 then 'name: missing' end) end as reasons, case when c_custkey % 7 = 0 then c_custkey || ',' || {_NAMED}
        when c_custkey % 11 = 0 then c_custkey || ',' || {_NAMED} || ',' || case when c_custkey % 13 = 0 then 'much' else {_MONEY} end || ',more' end as raw from customer where not ({_SOUND})""",
    "observed_totals": f"select count(*) as read, count(*) filter ({_SOUND}) as accepted, count(*) filter (not ({_SOUND})) as rejected from customer",
    "extraction_totals": "select count(*) as pages, count(*) filter (c_custkey % 13 = 0) as missing, count(*) as written from customer",
    "bm25_fuzzy": _near("smoll", 1),
    "bm25_fuzzy_score": _near("bolt", 2),
    "bm25_match_all": f"{_BM} select doc_id, sum(boost)::double as score from parts where not list_contains(toks, 'small') group by doc_id",
    "bm25_regex": _like("regexp_full_match(term, '(ri|bo)[a-z]{1,2}')"),
    "bm25_infix": _like("term like '%lat%'"),
    "bm25_by_dictionary": f"select doc_id, round(sum(score), 6) as score from (({_like("term like 'b_lt'")}) union all ({_near("glod", 2)}) union all ({_like("term like 'wid%t'")})) group by doc_id",
    "bm25_range": f"{_BM} select doc_id, round({sum(PART_FIELDS.values())}, 6)::double as score from (select distinct doc_id from ptf where field = 'p_name' and term >= 'rad' and term <= 'ret')",
    "bm25_must": _MUST,
    "bm25_blank": "select p_partkey as doc_id, 0.0::double as score from part where false",
    "exact_numeric": f"""with st as (select count(*) as n, sum((p_size = 21)::int) as df from part)
        select p_partkey as doc_id, round({len(SEARCH_FIELDS)} * (ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2::double), 6) as score from part, st where p_size = 21""",
    "field_statistics": f"with {_PART} select field, count(*) as n, round(avg(len(toks)), 6) as mean_len from parts group by field union all select 'weight', count(*), 1.0::double from part",
    "phrase_search": f"select doc_id from documents where regexp_matches(lower(text), '(^|[^\\pL\\pN_])in[^\\pL\\pN_]+the([^\\pL\\pN_]|$)')",
    "digits_weight": "select p_partkey, case when p_partkey % 5 = 0 then '' else p_size::varchar end as weight from part",
    "derived_fields": _DERIVED,
    "stored_projection": """select c_custkey as doc_id, round(c_acctbal, 4) as score, case when c_custkey % 2 <> 0 then c_name when c_custkey % 3 <> 0 then c_name else 'Unknown' end as player,
        c_mktsegment as position, 'N/A' as college, 'N/A' as currentteam from customer""",
    "display_rows": f"select c_custkey as rank, '| ' || {_LINE} || ' |' as line from customer",
    "search_ranked_mode": f"""{_scores('standard', f"select 0 as query_id, '{ENTRY_QUERY}' as query")}, top as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from scores)
        select rank, doc_id, score, lang, source from top join documents using (doc_id) where rank <= 7""",
    "search_boolean_mode": f"""select row_number() over (order by doc_id) as rank, doc_id, null::double as score, lang, source from documents where {_has('trash')} or {_has('clown')} order by doc_id limit 7""",
    "search_boolean_total": f"select count(*) as total from documents where {_has('trash')} or {_has('clown')}",
    "index_build": f"{_INDEX} select doc_id, term, tf, df, round(w_standard, 6) as w_standard from w",
    "index_json": f"with {_TF} select term, count(*) as df, string_agg(doc_id::varchar, ',' order by doc_id) as doc_ids from tf group by term",
    "boolean_trailing": f"select doc_id from documents where {_has('the')}",
    "page_framing": """select case when p_partkey % 10 = 0 then 'Template:' else '' end || p_name || ' (part)' as title, (p_partkey % 12)::varchar as height_in from part""",
    "csv_round_trip": _AWKWARD,
    "csv_declared": _AWKWARD,
    "csv_inferred": f"select key::bigint as key, name, code::int::varchar as code from ({_AWKWARD})",
    "json_round_trip": f"select code, key, name from ({_AWKWARD})",
    "sample_rows": "select c_custkey, c_name from customer order by c_custkey limit 3",
    "progress_counts": f"with {_PLAYERS} select count(*) as processed, count(*) filter (Player <> 'Unknown' and CurrentTeam <> 'Unknown Status (Meta Missing)') as kept from players",
    "html_comments": "select page_id, coalesce(array_to_string(list_filter(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), lambda x: contains(x, 'ad 1')), '|'), '') as comments from pages",
    "bm25_range_exclusive": f"{_BM} select doc_id, round({sum(PART_FIELDS.values())}, 6)::double as score from (select distinct doc_id from ptf where field = 'p_name' and term > 'gizmo' and term < 'red')",
    "bm25_transposed": _near("smlal", 1),
    "bm25_slop": _SLOP,
    **dict.fromkeys(("append_index", "reindexed"), f"{_BM} select doc_id, round(sum(s), 6) as score from sc where term in ('small', 'ring', '13') group by doc_id"),
    "fielded_topk": f"{_TOPK} select doc_id, score from top",
    "fielded_results": f"""{_TOPK} select doc_id, score, player, position, college, currentteam, coalesce(nullif(borncity, ''), 'N/A') as borncity, weight from top join c using (doc_id)""",
    "fielded_height_text": f"with {_CUSTOMERS} select doc_id from c where doc_id % 12 = 11 and position = 'MACHINERY'",
}

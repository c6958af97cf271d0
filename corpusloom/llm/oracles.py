"""SQL for the problems that SQL can express; the others are tested against brute force."""

from __future__ import annotations

import unicodedata

from .lines import OPEN_WORDS
from .textform import _FOREIGN, FULL_WIDTH, INVISIBLE, LIGATURES, LOOKALIKE_LETTERS, MARKS, SPACES

_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _bare(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


def _class(ranges: str) -> str:
    """A set of characters and ranges as RE2 spells it."""
    return "".join(c if c == "-" else rf"\x{{{ord(c):X}}}" for c in ranges)


def _text(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def _plain(ranges: str) -> tuple[str, str]:
    """The characters of ranges that have a plain character of their own, and these."""
    firsts = [ord(c) for c in ranges.split("-")[0] + "".join(x[1:] for x in ranges.split("-")[1:])]
    lasts = [ord(x[0]) for x in ranges.split("-")[1:]]
    pairs = [(chr(n), unicodedata.normalize("NFKC", chr(n)).strip()) for a, b in zip(firsts, lasts) for n in range(a, b + 1)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_WIDE, _NARROW = _plain(FULL_WIDTH)
_OTHERS = "".join(LOOKALIKE_LETTERS.values())
_LATIN = "".join(k * len(v) for k, v in LOOKALIKE_LETTERS.items())


def consistent(c: str) -> str:
    """The consistent form of a column."""
    x = f"translate({c}, {_text(_WIDE + SPACES + INVISIBLE)}, {_text(_NARROW + ' ' * len(SPACES))})"
    for lig in LIGATURES:
        x = f"replace({x}, chr({ord(lig)}), '{unicodedata.normalize('NFKC', lig)}')"
    words = rf"regexp_extract_all({x}, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+')"
    latin = rf"list_transform({words}, lambda w: case when regexp_matches(w, '[A-Za-z\x{{AA}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{2B8}}\x{{1E00}}-\x{{1EFF}}]') then translate(w, {_text(_OTHERS)}, {_text(_LATIN)}) else w end)"
    return f"case when {c} is not null then nfc_normalize(coalesce(array_to_string({latin}, ''), '')) end"


# p3
_ODD = rf"[{_class(FULL_WIDTH + MARKS)}{_class(INVISIBLE)}{_class(SPACES)}{_class(LIGATURES)}]"
_MIXED = rf"\p{{Latin}}[{_class(_FOREIGN)}]|[{_class(_FOREIGN)}]\p{{Latin}}"
P3_FOUND = f"""with v as (select row_id, 'content' as field, content as v from corpus union all select row_id, 'emetteur', emetteur from corpus)
    select distinct row_id, field from v where regexp_matches(v, '{_ODD}') or regexp_matches(v, '{_MIXED}')"""
P3_CONSISTENT = f"select row_id, {consistent('content')} as content, {consistent('emetteur')} as emetteur from corpus"

# p4
_PAGE = r"^[^\p{L}\p{N}]*(?:p(?:age|\.)?\s*)?\p{Nd}{1,4}(?:\s*(?:/|sur|of|de)\s*\p{Nd}{1,4})?[^\p{L}\p{N}]*$"
_OPEN = "'" + "', '".join(sorted(OPEN_WORDS)) + "'"


def _goes_on(a: str, b: str) -> str:
    """Line b goes on with the sentence of line a; both without outer blanks."""
    head = f"left(regexp_replace({b}, '^[«(\"''“ ]+', ''), 1)"
    last = rf"list_last(regexp_extract_all(lower(right({a}, 20)), '[\p{{L}}\p{{N}}]+'))"
    return f"""coalesce({a} <> '' and {b} <> '' and (not contains('.!?…:;»)”"', right({a}, 1)) or {a} like '%n°')
        and (({head} = lower({head}) and {head} <> upper({head})) or contains(',(«-–¬''’', right({a}, 1)) or coalesce({last} in ({_OPEN}), false)), false)"""


_LINES = f"""c as (select row_id, document_id, {consistent('emetteur')} as issuer, string_split({consistent('content')}, chr(10)) as ls, string_split(content, chr(10)) as raws from corpus where content is not null and emetteur is not null),
    l as (select row_id, document_id, issuer, unnest(ls) as line, unnest(raws) as raw, cast(generate_subscripts(ls, 1) as bigint) as line_no from c),
    s as (select *, {_bare('line')} as bare from l),
    n as (select *, lag(bare) over w as before, lead(bare) over w as after, lower(array_to_string(list_filter(regexp_split_to_array(line, '{_BLANK}+'), lambda x: x <> ''), ' ')) as form from s window w as (partition by row_id order by line_no)),
    f as (select *, {_goes_on('before', 'bare')} or {_goes_on('bare', 'after')} as piece, form <> '' and not (length(form) < 40 and regexp_matches(form, '{_PAGE}')) as counts from n),
    k as (select issuer, form from f where counts group by issuer, form having count(distinct document_id) >= 5 and avg(case when piece then 1.0 else 0.0 end) < 0.5)"""
P4_FOUND = f"with {_LINES} select f.row_id, f.line_no from f join k on f.issuer = k.issuer and f.form = k.form where f.counts"
P4_CLEAN = f"""with {_LINES}, left_over as (select f.row_id, string_agg(f.raw, chr(10) order by f.line_no) as content from f left join k on f.issuer = k.issuer and f.form = k.form where k.form is null group by f.row_id)
    select corpus.row_id, case when content is null or emetteur is null then content else coalesce(kept, '') end as content from corpus left join (select row_id, content as kept from left_over) o on corpus.row_id = o.row_id where corpus.row_id is not null"""

# p5
_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
P5_EXACT_REPORT = f"""with s as (select distinct row_id, regexp_replace(lower(split), '{_BLANK}+', '', 'g') as split from splits where split is not null and row_id is not null),
    w as (select row_id, {consistent('emetteur')} as emetteur, {_WORDS.format(c=consistent('content'))} as w from corpus),
    h as (select w.row_id, emetteur, case when len(w) > 0 then array_to_string(w, ' ') end as h, split from w join s on w.row_id = s.row_id)
    select split, emetteur, count(*) as rows, cast(sum(case when h in (select h from h where split = 'train' and h is not null) then 1 else 0 end) as bigint) as leaked from h where split in ('validation', 'test') group by split, emetteur"""


# p6
def _type(c: str) -> str:
    return f"case when coalesce({_bare(c)}, '') = '' then 'other_doc' else lower({_bare(c)}) end"


def _share(part: str, pool: str, spare: str, name: str, source: str) -> str:
    """Whole numbers that split a pool by what is spare, largest remainders first."""
    over = f"over (partition by {part})"
    return f"""{name}1 as (select *, sum({spare}) {over} as total, least({pool}, sum({spare}) {over}) as p from {source}),
        {name}2 as (select *, case when total > 0 then cast(floor(cast(p * {spare} as double) / total) as bigint) else 0 end as base from {name}1),
        {name}3 as (select *, case when total > 0 then p * {spare} - base * total else 0 end as rest from {name}2),
        {name}4 as (select *, row_number() over (partition by {part} order by rest desc, e, t, epoch, type_document) as place, p - sum(base) {over} as open from {name}3),
        {name} as (select * exclude (total, p, base, rest, place, open), cast(base + case when place <= open and rest > 0 then 1 else 0 end as bigint) as {name}_share from {name}4)"""


_COUNTS = f"""k as (select row_id, epoch, type_document, {_bare('epoch')} as e, {_type('type_document')} as t from corpus where epoch is not null),
    c as (select e, t, count(*) as n from k group by e, t), s as (select cast(floor(count(*) / 5) as bigint) as s from corpus),
    w as (select distinct epoch, type_document, {_bare('epoch')} as e, {_type('type_document')} as t, greatest(coalesce(min_rows, 0), cast(floor(cast(coalesce(target_bp, 0) as bigint) * s / 10000) as bigint)) as wanted from targets cross join s)"""
P6_FOUND = f"with {_COUNTS} select distinct w.epoch, w.type_document from w left join c on w.e = c.e and w.t = c.t where coalesce(c.n, 0) < wanted"
_ALLOCATED = f"""{_COUNTS}, a as (select w.*, coalesce(c.n, 0) as available from w left join c on w.e = c.e and w.t = c.t),
    b as (select *, least(wanted, greatest(0, available - coalesce(sum(wanted) over (partition by e, t order by epoch, type_document rows between unbounded preceding and 1 preceding), 0))) as own, row_number() over (partition by e, t order by epoch, type_document) as i from a),
    d as (select *, case when i = 1 then greatest(0, available - sum(own) over (partition by e, t)) else 0 end as spare, sum(wanted - own) over (partition by e) as unmet from b),
    {_share('e', 'unmet', 'spare', 'sibling', 'd')},
    g as (select *, spare - sibling_share as rest_spare, unmet - sum(sibling_share) over (partition by e) as open_e, row_number() over (partition by e order by t, epoch, type_document) as j from sibling),
    h as (select *, 1 as one, sum(case when j = 1 then open_e else 0 end) over () as pool from g),
    {_share('one', 'pool', 'rest_spare', 'cousin', 'h')},
    allocated as (select e, t, epoch, type_document, cast(wanted as bigint) as wanted, available, cast(own + sibling_share + cousin_share as bigint) as quota from cousin)"""
P6_ALLOCATION = f"with {_ALLOCATED} select epoch, type_document, wanted, available, quota from allocated"
P6_SAMPLE = f"""with {_ALLOCATED}, q as (select e, t, sum(quota) as quota from allocated group by e, t),
    r as (select k.*, q.quota, row_number() over (partition by k.e, k.t order by md5(concat_ws(':', cast(row_id as varchar), '42')), row_id) as place from k join q on k.e = q.e and k.t = q.t)
    select row_id, epoch, type_document from r where place <= quota"""


# p9
def _runs(source: str, key: str, text: str, n: int = 18) -> str:
    return f"""(select distinct {key}, array_to_string(w[i : i + {n - 1}], ' ') as run from (select {key}, w, unnest(range(1, len(w) - {n - 2})) as i from (select {key}, {_WORDS.format(c=consistent(text))} as w from {source} where {text} is not null) x) y)"""


P9_FOUND = f"select distinct d.doc_id, g.row_id from {_runs('documents', 'doc_id', 'text')} d join {_runs('gold', 'row_id', 'content')} g on d.run = g.run"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_FOUND,
        "p3_consistent": P3_CONSISTENT,
        "p4_found": P4_FOUND,
        "p4_clean": P4_CLEAN,
        "p5_exact_report": P5_EXACT_REPORT,
        "p6_found": P6_FOUND,
        "p6_allocation": P6_ALLOCATION,
        "p6_sample": P6_SAMPLE,
        "p9_found": P9_FOUND,
    }

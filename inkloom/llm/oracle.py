"""The training-data queries that SQL can state, in the checking engine's dialect."""

from __future__ import annotations

from inkloom.llm import repeats, truncation
from inkloom.llm.chapters import NARROW, NUMERAL, WIDE

_NARROW = NARROW.replace("'", "''")

#: Valid chapters and their lines.
VALID = "select distinct book_id, number, title, source from chapters where source is not null and json_valid(source) and ltrim(source) like '[%'"


def masked(column: str) -> str:
    bare = f"regexp_replace(lower(translate({column}, '{WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"
    return f"regexp_replace(regexp_replace({bare}, '{NUMERAL}', '0', 'g'), '0年0月0日?', '0', 'g')"


def host(column: str) -> str:
    return f"regexp_replace(lower(regexp_extract({column}, '^[A-Za-z]+://([^/:?#]+)', 1)), '^(www|wap|m)\\.', '')"


P2 = f"""
with valid as ({VALID}),
named as (select v.book_id, v.number, v.source, coalesce({masked("b.title")}, '') as book_name,
  regexp_replace(coalesce({masked("v.title")}, ''), '^(正文)?(第?0[章节回话卷]?)+', '') as name
  from valid v left join (select id, min(title) as title from books group by id) b on b.id = v.book_id),
lines as (select book_id, number, book_name, name, unnest(from_json(source, '["VARCHAR"]')) as line, generate_subscripts(from_json(source, '["VARCHAR"]'), 1) as para from named),
keyed as (select book_id, number, para, replace(replace({masked("coalesce(line, '')")}, case when length(book_name) > 1 then book_name else chr(1) end, 'Ⓑ'),
  case when length(name) > 1 then name else chr(1) end, 'Ⓒ') as key from lines),
accepted as (select book_id, canonical_number as number, min(source_id) as site from source_candidates where state = 'accepted' and canonical_number is not null group by 1, 2),
hosts as (select {host("source_url")} as host, min(id) as site from sources group by 1),
sites as (select c.book_id, c.number, coalesce(a.site, h.site) as site from (select book_id, number, min(url) as url from chapters group by 1, 2) c
  left join accepted a on a.book_id = c.book_id and a.number = c.number left join hosts h on h.host = {host("c.url")}),
pages as (select v.book_id, v.number, s.site from valid v join sites s on s.book_id = v.book_id and s.number = v.number where s.site is not null),
totals as (select site, count(*) as total from pages group by site),
placed as (select p.site, k.* from keyed k join pages p on p.book_id = k.book_id and p.number = k.number),
counts as (select site, key, count(*) as n from placed group by site, key),
rates as (select c.key, c.n / t.total as rate from counts c join totals t on t.site = c.site),
even as (select key, case when (select count(*) from totals) > 1 then (ln(sum(rate)) - sum(rate * ln(rate)) / sum(rate)) / ln((select count(*) from totals)) else 0 end as evenness from rates group by key),
sets as (select site, key, count(distinct book_id || ' ' || number) as chapters, count(distinct book_id) as books from placed group by site, key),
kept as (select s.site, s.key from sets s join totals t on t.site = s.site join even e on e.key = s.key
  where s.chapters >= {repeats.CHAPTERS} and s.books >= {repeats.BOOKS} and s.chapters >= t.total * {repeats.SHARE!r} and e.evenness < {repeats.EVEN})
select p.book_id, p.number, cast(p.para as bigint) as para from placed p join kept k on k.site = p.site and k.key = p.key
"""


def _sign(column: str) -> str:
    source = truncation._FROM.replace("\\\\", "\\").replace("\\t", "\t").replace("'", "''")
    target = truncation._TO
    return f"regexp_replace(translate({column}, '{source}', '{target}'), '0+', '0', 'g')"


_CLOSED = "[。！？!?…”’」』）)\\]】》>～~—*＊◇◆★☆※|｜.}$@_%›;]$"

P4 = f"""
with valid as ({VALID.replace("distinct ", "")}),
lines as (select book_id, number, regexp_replace(line, '[ ]+$', '') as line from (select book_id, number, unnest(from_json(source, '["VARCHAR"]')) as line from valid) x where line is not null),
long as (select * from lines where length(line) > 2),
clean as (select {_sign("regexp_replace(line, '([.][.]+|…)$', '')")} || chr(3) as text from long where not contains(line, '�')),
grams as (select substr(text, cast(i as bigint), 4) as gram, count(*) as n from (select text, unnest(generate_series(1, length(text) - 3)) as i from clean where length(text) > 3) x group by 1),
counts as (select left(gram, 3) as gram, sum(case when right(gram, 1) not in ('。', ' ', chr(3)) then n else 0 end) as mid,
  sum(case when right(gram, 1) = '。' then n else 0 end) as stop, sum(case when right(gram, 1) = chr(3) then n else 0 end) as final from grams group by 1),
pairs as (select right(gram, 2) as gram, sum(mid) as mid, sum(stop) as stop, sum(final) as final from counts group by 1),
marked as (select book_id, number, regexp_matches(line, '[^�]�$') and not contains(left(line, length(line) - 1), '�') as torn,
  regexp_matches(line, '([^.][.][.]+|[^…]…)$') as dotted, not regexp_matches(right(line, 1), '{_CLOSED}') and not contains(line, '�') as unclosed,
  contains(line, '“') and not contains(line, '�') and length(replace(line, '“', '')) < length(replace(line, '”', '')) as unquoted,
  {_sign("regexp_replace(right(line, 64), '(�|[.][.]+|…)$', '')")} as tail from long),
ends as (select book_id, number, torn, dotted, unclosed, unquoted, right(rtrim(tail, '。'), 3) as gram,
  length(string_split(tail, ' ')[-1]) > 6 or not contains(tail, ' ') as prose, rtrim(tail, ' ') as trimmed from marked where torn or dotted or unclosed or unquoted),
judged as (select e.*, coalesce(coalesce(c.mid + c.stop, 0) >= {truncation.SEEN} or coalesce(c.final, 0) > {truncation.SEEN}, false) as known,
  c.mid as m3, c.stop as s3, c.final as f3, p.mid as m2, p.stop as s2, p.final as f2 from ends e left join counts c on c.gram = e.gram left join pairs p on p.gram = right(e.gram, 2)),
told as (select *, case when known then m3 else m2 end as mid, case when known then s3 else s2 end as stop, case when known then f3 else f2 end as final from judged)
select book_id, number from told where (prose or length(string_split(trimmed, ' ')[-1]) > 6 or not contains(trimmed, ' ')) and regexp_matches(trimmed, '[一-鿿]') and not regexp_matches(gram, '[锟斤拷]') and (
  unquoted or (unclosed or torn) and mid + stop >= {truncation.SEEN} and final - 1 <= {truncation.LAST} * (mid + stop)
  or dotted and mid >= {truncation.SEEN} and stop + final - 1 <= {truncation.LAST} * mid)
union select book_id, number from chapters where ltrim(source) like '[%' and not json_valid(source)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p4_found": P4}

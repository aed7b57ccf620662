"""Pieces of plain SQL shared by the checks of the core queries."""

from __future__ import annotations

from .records import BODY

WS = r"[ \t\n\r\f\v]"
MARKER = r"(?s)<!--\s*(?:stay:.*?)\s*-->|\{/\*\s*(?:stay:.*?)\s*\*/\}"
INSIDE = r"(?s)^(?:<!--|\{/\*)\s*(stay:.*?)\s*(?:-->|\*/\})$"


def body(c: str) -> str:
    return BODY.format(c)


def digest(c: str) -> str:
    return f"sha256({body(c)})"


def edges(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def bare(c: str) -> str:
    """Without markers."""
    return rf"regexp_replace(regexp_replace({c}, '(?s)<!--\s*(stay:.*?)\s*-->', '', 'g'), '(?s)\{{/\*\s*(stay:.*?)\s*\*/\}}', '', 'g')"


def norm(c: str) -> str:
    """Match normalization."""
    return rf"translate(regexp_replace({edges(c)}, '{WS}+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def feeds(c: str) -> str:
    return f"(length({c}) - length(replace({c}, chr(10), '')))"


def parse(docs: str = "select doc_id, text from documents", tag: str = "") -> str:
    """CTEs lines, chunks, blocks and marks (with the tag at the end of their names) of documents (doc_id, text)."""
    t = tag
    return rf"""
src{t} as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as ls from ({docs}) where text is not null),
raw{t} as (select doc_id, unnest(ls) as ln, unnest(range(1, len(ls) + 1)) as i from src{t}),
opened{t} as (select doc_id from src{t} where regexp_matches(ls[1], '^---[ \t]*$')),
closed{t} as (select doc_id, min(i) as c from raw{t} where i > 1 and regexp_matches(ln, '^(---|\.\.\.)[ \t]*$') and doc_id in (select doc_id from opened{t}) group by 1),
front{t} as (select r.doc_id, c from closed{t} join raw{t} r on r.doc_id = closed{t}.doc_id and r.i > 1 and r.i < c group by 1, 2
  having bool_and(regexp_matches(ln, '[^ \t\f\v]')) and bool_or(regexp_matches(ln, '^[ \t]*(-[ \t]+[^\x00-\x20\x7f]|[^\x00-\x20\x7f:#][^:]*:([ \t]|$))'))),
lines{t} as (select r.doc_id, i, case when c is not null and i <= c then '' else ln end as ln from raw{t} r left join front{t} using (doc_id)),
flagged{t} as (select *, regexp_matches(ln, '[^ \t\f\v]') as nb from lines{t}),
runs{t} as (select *, coalesce(lag(nb) over (partition by doc_id order by i), false) as pb from flagged{t}),
numbered{t} as (select *, sum(case when nb and not pb then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as ch from runs{t}),
chunks{t} as (select doc_id, ch, min(i) as line, string_agg(ln, chr(10) order by i) as chunk from numbered{t} where nb group by 1, 2),
bared{t} as (select *, {edges(bare('chunk'))} as content from chunks{t}),
owned{t} as (select *, sum(case when content <> '' then 1 else 0 end) over (partition by doc_id order by ch rows unbounded preceding) - 1 as idx,
  row_number() over (partition by doc_id order by ch) as nth,
  sum(case when content <> '' then 1 else 0 end) over (partition by doc_id order by ch rows unbounded preceding) as full_so_far from bared{t}),
placed{t} as (select *, case when idx < 0 then nth - 1 else idx + (select count(*) from owned{t} o where o.doc_id = w.doc_id and o.idx < 0) end as pos from owned{t} w),
blocks{t} as (select doc_id, cast(pos as int) as pos, cast(case when content = '' then -1 else idx end as int) as idx, cast(line as int) as line, content from placed{t} where content <> '' or idx < 0),
cut{t} as (select doc_id, ch, line, pos, regexp_extract_all(chunk, '{MARKER}') as raws, regexp_split_to_array(chunk, '{MARKER}') as pieces from placed{t} where regexp_matches(chunk, '{MARKER}')),
each{t} as (select doc_id, ch, line, pos, unnest(raws) as raw, unnest(range(1, len(raws) + 1)) as k, raws, pieces from cut{t}),
read{t} as (select doc_id, pos, ch, k, raw, regexp_extract(raw, '{INSIDE}', 1) as inside,
  line + {feeds("(array_to_string(pieces[1:k], '') || array_to_string(raws[1:k-1], ''))")} as line from each{t}),
marks{t} as (select r.doc_id, cast(r.pos as int) as pos, b.idx, cast(row_number() over (partition by r.doc_id, r.pos order by ch, k) - 1 as int) as seq,
  nullif(regexp_extract(inside, '^stay:\s*([A-Za-z0-9_-]+)(?:\s|$)', 1), '') as id,
  lower(nullif(regexp_extract(inside, '\bhash\s*=\s*sha256:([0-9a-fA-F]+)', 1), '')) as hash,
  lower(nullif(regexp_extract(inside, '\bsubhash\s*=\s*sha256:([0-9a-fA-F]+)', 1), '')) as subhash,
  raw, case when starts_with(raw, '<') then 'html' else 'mdx' end as syntax, cast(r.line as int) as line,
  not regexp_matches(inside, '^stay:\s*([A-Za-z0-9_-]+)(?:\s|$)') as malformed, b.content
  from read{t} r join blocks{t} b on b.doc_id = r.doc_id and b.pos = r.pos)"""


#: A deterministic edit of a document, the second version of the comparisons: see corpus.edited.
EDITED = r"""
select doc_id, case when text is null then null else
  replace(regexp_replace(
    case when length(text) % 5 = 0 and len(ids) > 1 then replace(replace(replace(text, ids[1], '@@'), ids[2], ids[1]), '@@', ids[2]) else text end,
    '<!-- stay:[A-Za-z0-9]*[A-F] [^>]*-->|\n- [^\n]* has [^\n]*', '', 'g'), ' when ', ' once ')
  || chr(10) || chr(10) || 'Added by the edit.' || chr(10) || '<!-- stay:added' || doc_id || ' -->' || chr(10)
  || case when len(ids) > 0 and length(text) % 3 = 0 then chr(10) || 'Copied by the edit.' || chr(10) || '<!-- stay:' || ids[1] || ' -->' || chr(10) else '' end end as text
from (select doc_id, text, regexp_extract_all(text, '<!-- stay:([A-Za-z0-9]+) ', 1) as ids from documents)"""

#: Documents to lint: those of the table, with dirt that a lint finds; see corpus.dirty.
DIRTY = r"""
select doc_id, case when text is null then null else
  case when length(text) % 9 = 0 then '<!-- stay:orphan' || doc_id || ' -->' || chr(10) || chr(10) else '' end
  || regexp_replace(regexp_replace(replace(text, ' when ', ' once '), '<!-- (stay:[A-Za-z0-9]*[0-3]) ([^>]*)-->', '{/* \1 \2*/}', 'g'), 'stay:([A-Za-z0-9]*[4-5]) hash', 'stay:note=\1 hash', 'g')
  || case when len(ids) > 0 then chr(10) || chr(10) || 'Repeated.' || chr(10) || '<!-- stay:' || ids[1] || ' -->' || chr(10) else '' end end as text
from (select doc_id, text, regexp_extract_all(text, '<!-- stay:([A-Za-z0-9]+) ', 1) as ids from documents)"""

"""Queries over one and two versions of documents: parsing, lint, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff, lint, segment
from . import sql
from .corpus import KEYS, dirty, documents, edited


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.blocks(dirty(spark, sf_dir), KEYS)
    return rows.select("doc_id", "pos", "idx", "line", "content", "body_hash", F.size("markers").alias("n_markers"))


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.document_lines(documents(spark, sf_dir).where("text is not null"))
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("digest"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.markers(segment.blocks(dirty(spark, sf_dir), KEYS), KEYS).drop("content")


def body_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).where("text is not null").select("doc_id", T.body_hash(t).alias("full_hash"), T.body_hash(t, 12).alias("short_hash"), T.body_hash(T.strip_markers(t)).alias("bare_hash"))


def _lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.marker_findings(segment.markers(segment.blocks(dirty(spark, sf_dir), KEYS), KEYS), KEYS)


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.sorted_findings(_lint(spark, sf_dir), KEYS).select("doc_id", "place", "level", "code", "message", "id", "line")


def lint_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.counts(_lint(spark, sf_dir), KEYS)


def lint_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.text_report(documents(spark, sf_dir), _lint(spark, sf_dir), KEYS, "doc_id")


def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lint(spark, sf_dir).groupBy("level", "code").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_documents"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (diff.id_index(segment.blocks(v(spark, sf_dir), KEYS), KEYS) for v in (documents, edited))
    return diff.compare(before, after, KEYS)


def diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.findings(_compared(spark, sf_dir), KEYS, check_collections=True).select("doc_id", "level", "code", "message", "id")


def _code(code: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff.findings(_compared(spark, sf_dir), KEYS, check_collections=True).where(F.col("code") == code).select("doc_id", "id")

    return run


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.findings(_compared(spark, sf_dir), KEYS).groupBy("level", "code").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_documents"))


def gold_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (diff.id_index(segment.blocks(v(spark, sf_dir), KEYS), KEYS) for v in (documents, edited))
    return diff.ground_truth(before, after, KEYS)


def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.blocks(documents(spark, sf_dir), KEYS).where("idx >= 0")
    return rows.select("doc_id", "pos", T.item_count(F.col("content")).alias("n_items")).where("n_items > 0")


def extract_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.collection_items(T.fold_lines(F.col("text")))).alias("nth", "i"))
    return rows.select("doc_id", "nth", "i.kind", "i.text")


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.blocks(documents(spark, sf_dir), KEYS).where("idx >= 0")
    c = F.col("content")
    return rows.select("doc_id", "idx", T.kind(c).alias("kind"), T.heading_level(c).cast("int").alias("level"), T.block_id(F.col("idx"), c).alias("block_id"), T.match_normalize(T.first_line(c)).alias("first_line"))


QUERIES = {
    f.__name__: f
    for f in (blocks, front_matter, markers, body_hashes, lint_findings, lint_level_counts, lint_text_report, lint_summary, diff_findings, diff_counts, gold_map, item_counts, extract_items, block_kinds)
} | {f"diff_{name}": _code(code) for name, code in (("dropped", "DROPPED_ID"), ("new", "NEW_ID"), ("duplicated", "DUPLICATED_ID"), ("relocated", "RELOCATED_ID"), ("drift", "HASH_DRIFT"), ("collection_shrank", "COLLECTION_SHRANK"))}

_DIRTY = "with " + sql.parse(sql.DIRTY)
_PLAIN = "with " + sql.parse()
_QUOTED = r"""case when contains(raw, '''') and not contains(raw, '"') then '"' || q || '"' else '''' || replace(q, '''', '\''') || '''' end"""
_FOUND = _DIRTY + rf""",
good as (select *, row_number() over (partition by doc_id, id, malformed order by pos, seq) as nth, first_value(line) over (partition by doc_id, id, malformed order by pos, seq) as first_line,
  left({sql.digest('content')}, length(hash)) as now, replace(replace(replace(replace(raw, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') as q from marks),
found as (
  select doc_id, pos, seq, 0 as step, 'error' as level, 'MALFORMED_MARKER' as code, 'marker has no parseable id: ' || {_QUOTED} as message, cast(null as varchar) as id, line from good where malformed
  union all select doc_id, pos, seq, 1, 'error', 'ORPHAN_MARKER', 'marker ' || id || ' has no preceding block to attach to', id, line from good where not malformed and idx < 0
  union all select doc_id, pos, seq, 2, 'error', 'DUPLICATE_ID', 'id ' || id || ' appears more than once (first at line ' || first_line || ')', id, line from good where not malformed and nth > 1
  union all select doc_id, pos, seq, 3, 'warn', 'HASH_DRIFT', 'id ' || id || ': stored hash=sha256:' || hash || ' != current sha256:' || now || ' (content edited since the hash was written)', id, line
    from good where not malformed and content <> '' and now <> hash),
ranked as (select *, case level when 'error' then 0 when 'warn' then 1 else 2 end as r from found)"""
_INDEX = """
ix{0} as (select doc_id, id, count(*) as n, min((idx, seq)) as place, arg_min(content, (idx, seq)) as content from marks{0} where idx >= 0 and id is not null and not malformed group by 1, 2)"""
_PAIRS = "with " + sql.parse(tag="_b") + "," + sql.parse(sql.EDITED, "_a") + "," + _INDEX.format("_b") + "," + _INDEX.format("_a") + rf""",
base as (select *, {sql.digest('content')} as h from ix_b where n = 1),
owner as (select doc_id, h, arg_min(id, (place, id)) as owner from base group by 1, 2),
pairs as (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.id, b.id) as id, a.n, a.h as ah, b.h as bh, a.content as ac, b.content as bc, owner, a.place as ap
  from (select *, {sql.digest('content')} as h from ix_a) a full join base b on a.doc_id = b.doc_id and a.id = b.id left join owner o on o.doc_id = a.doc_id and o.h = a.h)"""


def _items(c: str) -> str:
    """Rows and bullets of a text as a list of lines."""
    ls = f"string_split({c}, chr(10))"
    row, div = r"'^\s*\|.*\|\s*$'", r"'^\s*\|[\s:|\-]+\|\s*$'"
    return (
        f"list_filter(list_zip({ls}, list_append(({ls})[2:], '')), lambda p: (regexp_matches(p[1], {row}) and not regexp_matches(p[1], {div}) and not regexp_matches(p[2], {div}) "
        rf"and length(regexp_replace(p[1], '[|\s]', '', 'g')) > 0) or regexp_matches(p[1], '^\s*[-*+]\s+\S'))"
    )


_DIFFS = _PAIRS + f""",
kept as (select *, len({_items('bc')}) as n0, len({_items('ac')}) as n1 from pairs),
found as (
  select doc_id, 'error' as level, 'DROPPED_ID' as code, 'id ' || id || ' was in the baseline but is gone after the edit (silent loss)' as message, id from kept where bh is not null and ah is null
  union all select doc_id, 'error', 'DUPLICATED_ID', 'id ' || id || ' appears ' || n || ' times after the edit (copy without re-mint, or a regeneration collision)', id from kept where n > 1
  union all select doc_id, 'info', 'NEW_ID', 'id ' || id || ' is new (not in the baseline)', id from kept where ah is not null and bh is null
  union all select doc_id, 'error', 'RELOCATED_ID', 'id ' || id || ' now sits on content that previously carried id ' || owner || ' (markers look swapped or relocated)', id from kept where n = 1 and ah <> bh and owner <> id
  union all select doc_id, 'warn', 'HASH_DRIFT', 'id ' || id || ': content changed between versions (edited in place)', id from kept where n = 1 and ah <> bh and coalesce(owner = id, true)
  union all select doc_id, 'error', 'COLLECTION_SHRANK', 'id ' || id || ': collection shrank from ' || n0 || ' to ' || n1 || ' items (a table row or list bullet was dropped from inside the block)', id from kept where n = 1 and bh is not null and n0 > 0 and n1 < n0)"""

SQL = {
    "blocks": _DIRTY + f" select b.doc_id, b.pos, b.idx, b.line, b.content, {sql.digest('b.content')} as body_hash, cast(count(m.pos) as int) as n_markers from blocks b left join marks m on m.doc_id = b.doc_id and m.pos = b.pos group by all",
    "front_matter": _PLAIN + " select doc_id, cast(count(*) as int) as n_lines, sha256(string_agg(ln, chr(10) order by i)) as digest from lines group by 1",
    "markers": _DIRTY + " select doc_id, pos, idx, seq, id, hash, subhash, raw, syntax, line, malformed from marks",
    "body_hashes": f"select doc_id, {sql.digest('text')} as full_hash, left({sql.digest('text')}, 12) as short_hash, {sql.digest(sql.bare('text'))} as bare_hash from documents where text is not null",
    "lint_findings": _FOUND + " select doc_id, cast(row_number() over (partition by doc_id order by r, line, code, pos, seq, step) as int) as place, level, code, message, id, line from ranked",
    "lint_level_counts": _FOUND + " select doc_id, count(*) filter (level = 'error') as n_error, count(*) filter (level = 'warn') as n_warn, count(*) filter (level = 'info') as n_info, bool_or(level = 'error') as has_errors from found group by 1",
    "lint_text_report": _FOUND + """,
shown as (select *, '  [' || rpad(level, cast(greatest(5, length(level)) as int), ' ') || '] ' || rpad(code, cast(greatest(16, length(code)) as int), ' ') || ' ' || lpad('L' || line, cast(greatest(5, length('L' || line)) as int), ' ') || '  ' || message as t from ranked),
per as (select doc_id, string_agg(t, chr(10) order by r, line, code, pos, seq, step) filter (code <> 'HASH_DRIFT') as body, count(*) filter (code = 'HASH_DRIFT') as h,
  count(*) filter (level = 'error') as e, count(*) filter (level = 'warn') as w, count(*) filter (level = 'info') as n from shown group by 1)
select d.doc_id, case when p.doc_id is null then d.doc_id || ': clean (no findings)' else d.doc_id || ':' || coalesce(chr(10) || body, '')
  || case when h > 0 then chr(10) || '  -> ' || h || case when h = 1 then ' hash-drift finding' else ' hash-drift findings' end || ' hidden (--show-drift to list)' else '' end
  || chr(10) || '  -> ' || e || ' error, ' || w || ' warn, ' || n || ' info' end as report from documents d left join per p using (doc_id)""",
    "lint_summary": _FOUND + " select level, code, count(*) as n_findings, count(distinct doc_id) as n_documents from found group by 1, 2",
    "diff_findings": _DIFFS + " select * from found",
    "diff_counts": _DIFFS + " select level, code, count(*) as n_findings, count(distinct doc_id) as n_documents from found where code <> 'COLLECTION_SHRANK' group by 1, 2",
    "gold_map": _PAIRS + " select doc_id, id, cast(ap[1] as int) as gold_idx from pairs where bh is not null and n = 1 and (ah = bh or owner is null or owner = id)",
    "item_counts": _PLAIN + f" select doc_id, pos, cast(len({_items('content')}) as int) as n_items from blocks where idx >= 0 and len({_items('content')}) > 0",
    "extract_items": rf"""select doc_id, cast(k - 1 as int) as nth, case when regexp_matches(x, '^\s*[-*+]\s+\S') then 'bullet' else 'row' end as kind, {sql.edges('x')} as text
from (select doc_id, unnest(its)[1] as x, unnest(range(1, len(its) + 1)) as k from (select doc_id, {_items("regexp_replace(text, '\r\n?', chr(10), 'g')")} as its from documents))""",
    "block_kinds": _PLAIN + rf""" select doc_id, idx,
  case when starts_with(content, '#') then 'heading' when starts_with(content, '```') then 'code' when starts_with(content, '|') then 'table' when regexp_matches(content, '^(- |\* |\d+[.)])') then 'list' else 'para' end as kind,
  cast(case when regexp_matches(content, '^#{{1,6}}([ \t]|$)') then length(regexp_extract(content, '^(#+)', 1)) when regexp_matches(content, '^[^\n]*\S[^\n]*\n=+[ \t]*$') then 1 when regexp_matches(content, '^[^\n]*\S[^\n]*\n-+[ \t]*$') then 2 else 0 end as int) as level,
  'b' || idx || '-' || left({sql.digest('content')}, 4) as block_id, {sql.norm(sql.edges("split_part(content, chr(10), 1)"))} as first_line from blocks where idx >= 0""",
} | {f"diff_{name}": _DIFFS + f" select doc_id, id from found where code = '{code}'" for name, code in (("dropped", "DROPPED_ID"), ("new", "NEW_ID"), ("duplicated", "DUPLICATED_ID"), ("relocated", "RELOCATED_ID"), ("drift", "HASH_DRIFT"), ("collection_shrank", "COLLECTION_SHRANK"))}

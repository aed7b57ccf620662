"""Queries over markers and chunks: stamping, anchors, resolution, edits with truth, caches, commits, studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cache, commit, diff, dogfood, lint, perturb, resolve, score, segment, stamp, study, survival
from ..session import stored, table
from . import sql
from .corpus import KEYS, dirty, documents, edited
from .versions import _DIFFS, _DIRTY, _FOUND, _PAIRS, _PLAIN


def _before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.blocks(documents(spark, sf_dir), KEYS)


def _after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.blocks(edited(spark, sf_dir), KEYS)


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp.stamp(_before(spark, sf_dir), KEYS)


def restamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp.restamp(segment.blocks(dirty(spark, sf_dir), KEYS), KEYS)


def repaired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp.repairs(segment.markers(segment.blocks(dirty(spark, sf_dir), KEYS), KEYS), KEYS)


def wrapped_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.sha2(stamp.wrap(F.col("text"), F.lit(" Shorten the text. ")).cast("binary"), 256).alias("digest"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.anchors(_before(spark, sf_dir), KEYS).drop("line")


def resolve_marker_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.by_marker_and_hash(resolve.anchors(_before(spark, sf_dir), KEYS), _after(spark, sf_dir), KEYS)
    return rows.select("doc_id", "id", F.coalesce("method", F.lit("open")).alias("method"), F.col("target").cast("int"), "score")


def resolve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(resolve.anchors(_before(spark, sf_dir), KEYS), stored(_after(spark, sf_dir), "after"), KEYS)


def twin_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that the hash tier gives to a block that carries another id."""
    rows = resolve.by_marker_and_hash(resolve.anchors(_before(spark, sf_dir), KEYS), _after(spark, sf_dir), KEYS).where("method = 'hash'")
    marks = _after(spark, sf_dir).where("idx >= 0 and size(markers) > 0").select("doc_id", F.col("idx").alias("target"))
    return rows.join(marks, ["doc_id", "target"]).select("doc_id", "id", F.col("target").cast("int"))


def _edit(op: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = perturb.apply(perturb.annotate(_before(spark, sf_dir), KEYS), KEYS, op).select("doc_id", F.posexplode_outer("pb").alias("pos", "b")).where("pos is not null")
        return rows.select("doc_id", "pos", F.col("b.text").alias("text"), F.array_join("b.ids", ",").alias("ids"))

    return run


def _truth(op: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return perturb.truth_rows(perturb.apply(perturb.annotate(_before(spark, sf_dir), KEYS), KEYS, op), KEYS).select("doc_id", "id", F.array_join("accept", ",").alias("accept"), F.col("preferred").cast("int"))

    return run


STUDY = tuple(perturb.OPERATORS | perturb.SECTION_OPERATORS)


def _studied(spark: SparkSession, sf_dir: str, cases, ops: tuple[str, ...] = STUDY, paths: bool = False) -> DataFrame:
    """``cases`` of the study of all edits, with markers stripped and kept; column ``markers`` tells which."""
    stripped = study.Study(documents(spark, sf_dir), KEYS, list(ops), True, paths)
    runs = [cases(s).withColumn("markers", F.lit(name)) for name, s in (("stripped", stripped), ("kept", stripped.with_markers(False)))]
    return runs[0].unionByName(runs[1])


def evaluated(spark: SparkSession, sf_dir: str, ops: tuple[str, ...] = STUDY) -> DataFrame:
    """Every id of every document after every edit, without and with markers: category, method and score."""
    return _studied(spark, sf_dir, lambda s: s.scored(), ops)


def margin_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin 0 and the usual one under every edit."""
    return score.rates(score.tally(_studied(spark, sf_dir, study.margins), ["markers", "op", "margin"]))


def heading_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms of heading preference under every edit."""
    return study.arm_report(_studied(spark, sf_dir, study.arms, paths=True), KEYS, ("markers", "op"))


def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = score.rates(score.tally(evaluated(spark, sf_dir), ["markers", "op"], total=True))
    return score.with_interval(cells.withColumn("survived", F.col("correct") + F.col("wrong") + F.col("missed")), "correct", "survived", "low", "high")


def eval_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.grouping(evaluated(spark, sf_dir), ["markers", "op", "method"])


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles above every block."""
    rows = _before(spark, sf_dir).where("idx >= 0").select("doc_id", "idx", "line")
    return rows.join(resolve.heading_paths(documents(spark, sf_dir), KEYS), ["doc_id", "line"]).select("doc_id", "idx", F.array_join("path", " > ").alias("path"))


def _chunks(spark: SparkSession, sf_dir: str, version) -> DataFrame:
    """Chunks of the stamped form of a version."""
    blocks = segment.blocks(stamp.restamp(segment.blocks(version(spark, sf_dir), KEYS), KEYS), KEYS)
    return cache.chunks(blocks, lint.marker_findings(segment.markers(blocks, KEYS), KEYS), KEYS)


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, documents)


def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = segment.blocks(dirty(spark, sf_dir), KEYS)
    return cache.violations(blocks, lint.marker_findings(segment.markers(blocks, KEYS), KEYS), KEYS)


def _index(spark: SparkSession, sf_dir: str, version) -> DataFrame:
    """Keys of a cache. An id that several blocks carry is none; the query ``quarantined_ids`` lists these."""
    rows = diff.id_index(segment.blocks(version(spark, sf_dir), KEYS), KEYS).where("n = 1")
    return rows.select("doc_id", "id", T.body_hash(F.col("content")).alias("body_hash"))


def cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.decide(_index(spark, sf_dir, documents), _index(spark, sf_dir, edited), KEYS)


def cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.decision_counts(cache_decisions(spark, sf_dir), KEYS)


def cache_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (_index(spark, sf_dir, v) for v in (documents, edited))
    return cache.sync(old, new, "doc_id").groupBy("doc_id", "action").agg(F.count("*").alias("n_keys"))


def reembed_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.reembed_parity(_index(spark, sf_dir, documents), _index(spark, sf_dir, edited), KEYS)


def duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block that carries an id counts, also where several carry the same."""
    rows = segment.markers(_after(spark, sf_dir), KEYS).where("idx >= 0 and id is not null and not malformed")
    return cache.duplicate_records(rows.select("doc_id", "id", T.body_hash(F.col("content")).alias("body_hash")), KEYS)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per repository: every document is changed, and some are added, deleted, renamed or copied, by what
    their text is like."""
    d = table(spark, sf_dir, "documents").where("text is not null and repo is not null and doc_path is not null").select("doc_id", "repo", F.concat(F.col("doc_id").cast("string"), F.lit("/"), "doc_path").alias("path"), "text")
    e = d.join(edited(spark, sf_dir).withColumnRenamed("text", "after"), "doc_id")
    k = F.length("text") % 8
    status = F.when(k == 0, "D").when(k == 1, "A").when(k == 2, "R").when(k == 3, "C").otherwise("M")
    return e.select(
        F.col("repo").alias("commit_id"), F.col("doc_id").cast("int").alias("seq"), status.alias("status"), "path",
        F.when(status.isin("R"), F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("src"), F.col("path").alias("dst"),
        F.when(~status.isin("A", "C"), F.col("text")).alias("before"), F.when(status != "D", F.col("after")).alias("after"),
    ).drop("path")


def commit_pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.pairings(entries(spark, sf_dir))


def commit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.reports(commit.findings(entries(spark, sf_dir)))


def commit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(entries(spark, sf_dir), "entries")
    return commit.move_notes(commit.findings(e)).unionByName(commit.deletion_notes(e)).distinct()


def commit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.gate(commit.findings(entries(spark, sf_dir)))


def _survival_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = segment.survival_spans(documents(spark, sf_dir).where("text is not null"), KEYS)
    id_ = T.survival_id(F.col("pos"), F.col("chunk"))
    h = F.left(F.sha2(F.col("chunk").cast("binary"), 256), F.lit(4))
    rows = spans.select("doc_id", id_.alias("id"), h.alias("h")).join(F.broadcast(survival.syntaxes(spark)))  # eight rows
    written = survival.render(F.col("template"), F.col("id"), F.col("h"))
    return rows.select("doc_id", "id", "marker", "pattern", F.when(F.col("h") < "4", F.regexp_replace(written, r"[{}<>\[\]^]", "")).when(F.col("h") > "d", "").otherwise(written).alias("out"), (F.col("h") < "8").alias("instructed"))


def survival_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.cells(_survival_ids(spark, sf_dir), ["doc_id", "marker", "instructed"])


def survival_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.report(survival_cells(spark, sf_dir), [["marker"], ["instructed"], ["marker", "instructed"]])


def survival_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.pivot(survival_cells(spark, sf_dir), "marker", "instructed", ["true", "false"]).withColumnsRenamed({"true": "told", "false": "naive"})


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = diff.compare(diff.id_index(_before(spark, sf_dir), KEYS), diff.id_index(_after(spark, sf_dir), KEYS), KEYS)
    return dogfood.structural(compared, diff.findings(compared, KEYS), KEYS)


def study_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("doc_id", "n_stays", F.array_join("dropped", ",").alias("dropped"), "relocated", "duplicated", "hash_drift", "new_ids", "caught", F.array_join("block_reason", ",").alias("block_reason"))


def _judged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells under replies that call every second section deleted and leave out the third."""
    cells = _cells(spark, sf_dir)
    lines = F.transform("dropped", lambda _, i: F.when(i == 2, "").otherwise(F.concat((i + 1).cast("string"), F.lit(": "), F.when(i % 2 == 1, "DELETED").otherwise("SURVIVED"))))
    replies = cells.select("doc_id", F.array_join(lines, "\n").alias("reply"))
    return dogfood.finalized(cells, dogfood.judged(cells, replies, KEYS), KEYS)


def study_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards and nags."""
    return _judged_cells(spark, sf_dir).select("doc_id", "content_drops", "marker_strips", "judge_unknown", "is_guard", "is_nag")


def eligible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dogfood.eligible(table(spark, sf_dir, "documents"), "doc_path", "text", 400).select("doc_id", "doc_path", F.col("n_words").cast("int"))


QUERIES = {
    f.__name__: f
    for f in (
        stamped, restamped, repaired_ids, wrapped_prompts, anchors, resolve_marker_hash, resolve_full, twin_captures, eval_rollup, eval_slices, margin_ablation, heading_arms, heading_paths, chunked, chunk_violations, cache_decisions, cache_counts, cache_sync,
        reembed_parity, duplicate_records, commit_pairings, commit_reports, commit_notes, commit_gate, survival_cells, survival_report, survival_pivot, study_cells, study_verdicts, eligible_docs,
    )
}
QUERIES |= {f"perturb_{op}": _edit(op) for op in STUDY}
QUERIES |= {f"truth_{op}": _truth(op) for op in STUDY}

_KIND = r"(not starts_with(content, '#') and not starts_with(content, '```') and not starts_with(content, '|') and not regexp_matches(content, '^(- |\* |\d+[.)])'))"
_PB = _PLAIN + f""",
pb as (select doc_id, idx as i, content as text, 'b' || idx || '-' || left({sql.digest('content')}, 4) as id, {_KIND} as para, max(idx) over (partition by doc_id) + 1 as n from blocks where idx >= 0),
paras as (select *, case when para then row_number() over (partition by doc_id, para order by i) end as nth, lead(para) over (partition by doc_id order by i) as np, lead(text) over (partition by doc_id order by i) as nt, lead(id) over (partition by doc_id order by i) as nid from pb)"""
_ROWS = " select doc_id, cast(row_number() over (partition by doc_id order by i, s) - 1 as int) as pos, text, coalesce(id, '') as ids from out"
_INDEXED = "select doc_id, id, sha256(body) as body_hash from (select doc_id, id, {b} as body from ix{t} where n = 1)"
_DECIDE = _PAIRS + f""",
o as ({_INDEXED.format(b=sql.body('content'), t='_b')}), w as ({_INDEXED.format(b=sql.body('content'), t='_a')}),
decided as (select coalesce(o.doc_id, w.doc_id) as doc_id, coalesce(o.id, w.id) as id, case when w.id is null then 'evict' when o.body_hash = w.body_hash then 'reuse' else 'reembed' end as action from o full join w on o.doc_id = w.doc_id and o.id = w.id)"""


def _written(marks: str, src: str) -> str:
    return src + f""",
per as (select b.doc_id, b.pos, concat_ws(chr(10), nullif(b.content, ''), nullif({marks}, '')) as t from blocks b left join marks m on m.doc_id = b.doc_id and m.pos = b.pos group by b.doc_id, b.pos, b.idx, b.content)
select doc_id, string_agg(t, chr(10) || chr(10) order by pos) || chr(10) as text from per group by 1"""


_NEW = f"'<!-- stay:' || left(sha256(b.doc_id || ':' || b.idx), 8) || ' hash=sha256:' || left({sql.digest('b.content')}, 12) || ' -->'"
_NAMED = "coalesce(bool_or(m.id is not null and not m.malformed), false)"
_RENEWED = f"case when m.malformed or m.idx < 0 then m.raw when m.syntax = 'html' then '<!-- stay:' || m.id || ' hash=sha256:' || left({sql.digest('m.content')}, 12) || ' -->' else '{{/* stay:' || m.id || ' hash=sha256:' || left({sql.digest('m.content')}, 12) || ' */}}' end"
_ANCHORS = """
near as (select *, right(coalesce(lag(content) over w, ''), 48) as prefix, left(coalesce(lead(content) over w, ''), 48) as suffix from blocks{0} where idx >= 0 window w as (partition by doc_id order by idx)),
anchors as (select m.doc_id, m.id, {1} as hash, n.content as quote, n.prefix, n.suffix, n.idx, m.seq from marks{0} m join near n on n.doc_id = m.doc_id and n.idx = m.idx where m.id is not null and not m.malformed)"""
_TIERS = _PAIRS + "," + _ANCHORS.format("_b", sql.digest("n.content")) + f""",
lastone as (select * from (select *, row_number() over (partition by doc_id, id order by idx desc, seq desc) as k from anchors) where k = 1),
bym as (select doc_id, id, min(idx) as t from marks_a where idx >= 0 and id is not null and not malformed group by 1, 2),
byh as (select doc_id, h, min(idx) as t from (select doc_id, idx, {sql.digest('content')} as h from blocks_a where idx >= 0) group by 1, 2 having count(*) = 1),
tiers as (select l.doc_id, l.id, case when bym.t is not null then 'marker' when byh.t is not null then 'hash' else 'open' end as method, cast(coalesce(bym.t, byh.t) as int) as target,
  case when coalesce(bym.t, byh.t) is not null then 1.0 end as score from lastone l left join bym on bym.doc_id = l.doc_id and bym.id = l.id left join byh on byh.doc_id = l.doc_id and byh.h = l.hash)"""
_CELLS = _DIFFS + """,
named as (select doc_id, count(*) as n_stays from base group by 1),
per as (select doc_id, string_agg(id, ',' order by id) filter (code = 'DROPPED_ID') as dropped, count(*) filter (code = 'RELOCATED_ID') as relocated, count(*) filter (code = 'DUPLICATED_ID') as duplicated,
  count(*) filter (code = 'HASH_DRIFT') as hash_drift, count(*) filter (code = 'NEW_ID') as new_ids, bool_or(level = 'error') as caught, array_to_string(list_sort(list(distinct code) filter (level = 'error')), ',') as block_reason
  from found where code <> 'COLLECTION_SHRANK' group by 1),
cells as (select coalesce(n.doc_id, p.doc_id) as doc_id, coalesce(n_stays, 0) as n_stays, coalesce(dropped, '') as dropped, coalesce(relocated, 0) as relocated, coalesce(duplicated, 0) as duplicated, coalesce(hash_drift, 0) as hash_drift,
  coalesce(new_ids, 0) as new_ids, coalesce(caught, false) as caught, coalesce(block_reason, '') as block_reason from named n full join per p on n.doc_id = p.doc_id)"""

_JUDGED = _CELLS + """, ids as (select doc_id, unnest(string_split(dropped, ',')) as id, unnest(range(0, len(string_split(dropped, ',')))) as i from cells where dropped <> ''),
votes as (select doc_id, count(*) filter (i <> 2 and i % 2 = 1) as d, count(*) filter (i <> 2 and i % 2 = 0) as s, count(*) filter (i = 2) as u from ids group by 1),
judged as (select c.*, coalesce(d, 0) as content_drops, coalesce(s, 0) as marker_strips, coalesce(u, 0) as judge_unknown, caught and coalesce(d, 0) > 0 as is_guard, caught and coalesce(d, 0) = 0 as is_nag from cells c left join votes v on v.doc_id = c.doc_id)"""

_SURVIVAL = r"""
with r as (select doc_id, unnest(ls) as ln, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as ls from documents where text is not null)),
f as (select *, regexp_matches(ln, '\S') as nb from r), g as (select *, coalesce(lag(nb) over (partition by doc_id order by i), false) as pb from f),
n as (select *, sum(case when nb and not pb then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as ch from g),
c as (select doc_id, ch, string_agg(ln, chr(10) order by i) as chunk from n where nb group by 1, 2),
s as (select * from (values
  ('html_comment', '<!-- stay:{0} -->', '<!--\s*stay:{0}\b[^>]*-->'),
  ('html_comment_hash', '<!-- stay:{0} hash=sha256:{1} -->', '<!--\s*stay:{0}\b[^>]*-->'),
  ('pandoc_attr', '{#{0}}', '\{#{0}\b[^}]*\}'),
  ('kramdown_ial', '{: #{0}}', '\{:\s*#{0}\b[^}]*\}'),
  ('obsidian_caret', '^{0}', '\^{0}\b'),
  ('visible_tag', '[{0}]', '\[{0}\]'),
  ('mdx_comment', '{/* stay:{0} */}', '\{/\*\s*stay:{0}\b.*?\*/\}'),
  ('frontmatter_map', '  {0}: "{1}"', '{0}')) v(marker, template, pattern)),
w as (select doc_id, 'blk' || (ch - 1) || left(sha256(chunk), 4) as id, left(sha256(chunk), 4) as h, marker, pattern, template from c cross join s),
o as (select doc_id, id, h, marker, replace(pattern, '{0}', id) as pattern, replace(replace(template, '{0}', id), '{1}', h) as written from w),
e as (select *, case when h < '4' then regexp_replace(written, '[{}<>\[\]^]', '', 'g') when h > 'd' then '' else written end as out, h < '8' as instructed from o),
cells as (select doc_id, marker, instructed, count(*) as n_ids, count(*) filter (regexp_matches(out, pattern)) as intact, count(*) filter (regexp_matches(out, '\b' || id || '\b')) as present from e group by 1, 2, 3)"""

_SYNONYMS = """map {
  'messages': 'records', 'message': 'record', 'order': 'request', 'orders': 'requests', 'pipeline': 'workflow', 'validate': 'check',
  'validation': 'checking', 'partner': 'vendor', 'product': 'catalogue', 'pricing': 'price', 'error': 'fault', 'errors': 'faults',
  'stage': 'step', 'stages': 'steps', 'queue': 'buffer', 'backup': 'archive', 'data': 'information', 'configuration': 'config',
  'files': 'documents', 'drive': 'disk', 'remote': 'offsite', 'repository': 'repo', 'repositories': 'repos', 'checklist': 'list',
  'restore': 'recovery', 'coverage': 'breadth', 'confidence': 'assurance', 'persist': 'store', 'persistence': 'storage',
  'downstream': 'later', 'consumers': 'clients'}"""
_END = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _reworded(t: str) -> str:
    words = f"array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: coalesce(map_extract({_SYNONYMS}, lower(w))[1], w)), '')"
    return f"rtrim(regexp_replace({words}, ', ', ' and '), {_END}) || ' (revised)'"


_LEVEL = r"""case when regexp_matches(text, '^#{1,6}([ \t]|$)') then length(regexp_extract(text, '^(#+)', 1)) when regexp_matches(text, '^[^\n]*\S[^\n]*\n=+[ \t]*$') then 1 when regexp_matches(text, '^[^\n]*\S[^\n]*\n-+[ \t]*$') then 2 else 0 end"""
_HEADS = _PB + f""",
leveled as (select *, {_LEVEL} as lv from pb), heads as (select *, case when lv > 0 then row_number() over (partition by doc_id, lv > 0 order by i) end as nh, count(*) filter (lv > 0) over (partition by doc_id) as n_heads from leveled),
seconds as (select doc_id, i as second, lv as level from heads where nh = 2)"""
_EDITS = {
    "heavy_paraphrase": _PB + f" select doc_id, i as pos, case when para then {_reworded('text')} else text end as text, id as ids from pb",
    "decoy": _PB + f""", out as (select doc_id, i, 0 as s, case when nth = 1 then rtrim(text, {_END}) || ' A small clarifying note.' else text end as text, id from paras union all select doc_id, i, 1, {_reworded('text')}, null from paras where nth = 1)""" + _ROWS,
    "cross_section_move": _HEADS + """, chosen as (select h.doc_id, min(i) as src from heads h join seconds using (doc_id) where i > second and lv = 0 group by 1),
lasts as (select h.doc_id, max(i) as l from heads h join chosen using (doc_id) where i <> src group by 1),
out as (select h.doc_id, case when i = src then l - 0.5 else i end as i, 0 as s, text, id from heads h left join chosen using (doc_id) left join lasts using (doc_id))""" + _ROWS,
    "section_move": _HEADS + """, bounds as (select h.doc_id, second, coalesce(min(i) filter (i > second and lv between 1 and level), max(n)) as fin from heads h join seconds using (doc_id) where n_heads >= 3 group by 1, 2),
out as (select h.doc_id, case when i >= second and i < fin then 1 else 0 end as i, i as s, text, id from heads h left join bounds using (doc_id))""" + _ROWS,
    "heading_rename": _HEADS + rf""" select doc_id, i as pos, case when coalesce(nh % 2 = 0, false) then
  case when regexp_matches(text, '^ {{0,3}}#{{1,6}}\s') then regexp_extract(text, '^ {{0,3}}(#{{1,6}})\s', 1) || ' ' || {_reworded("rtrim(trim(regexp_replace(regexp_extract(text, '^ {0,3}#{1,6}[ \t]+([^\n]*)', 1), '#+[ \t]*$', ''), ' '), ' ' || chr(9))")}
  else {_reworded("split_part(text, chr(10), 1)")} || chr(10) || split_part(text, chr(10), 2) end else text end as text, id as ids from heads""",
    "heading_delete": _HEADS + ", out as (select doc_id, i, 0 as s, text, id from heads where coalesce(nh, 0) <> 2)" + _ROWS,
}
_MARKED_RAW = r"regexp_extract_all(input, '(?s)(?:<!--|\{/\*)\s*stay:\s*([A-Za-z0-9_-]+)\s[^>]*?(?:-->|\*/\})', 1)"

SQL = {
    "stamped": _written(f"concat_ws(chr(10), string_agg(m.raw, chr(10) order by m.seq), case when b.idx >= 0 and not {_NAMED} then {_NEW} end)", _PLAIN),
    "restamped": _written(f"string_agg({_RENEWED}, chr(10) order by m.seq)", _DIRTY),
    "repaired_ids": _DIRTY + " select doc_id, pos, seq, id, left(sha256(doc_id || ':' || pos || ':' || seq || ':' || id), 8) as new_id from (select *, row_number() over (partition by doc_id, id order by pos, seq) as n from marks where id is not null and not malformed) where n > 1",
    "wrapped_prompts": f"select doc_id, sha256('Shorten the text.' || chr(10) || chr(10) || 'This document contains identity markers such as <!-- stay:ID --> or {{/* stay:ID */}}. Keep every marker directly after the block it belongs to, give new blocks none, and never reuse the marker of a block for other content.' || chr(10) || chr(10) || 'Return only the resulting Markdown document.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {sql.edges('text')}) as digest from documents where text is not null",
    "anchors": _PLAIN + "," + _ANCHORS.format("", sql.digest("n.content")) + " select * from anchors",
    "resolve_marker_hash": _TIERS + " select * from tiers",
    "twin_captures": _TIERS + " select t.doc_id, t.id, t.target from tiers t where method = 'hash' and exists (select 1 from marks_a m where m.doc_id = t.doc_id and m.idx = t.target)",
    "chunk_violations": _FOUND + """,
own as (select b.doc_id, b.pos, b.idx, count(m.id) filter (not m.malformed) as n from blocks b left join marks m on m.doc_id = b.doc_id and m.pos = b.pos group by 1, 2, 3)
select distinct doc_id, 'finding' as reason from found where level = 'error' or code = 'HASH_DRIFT' union select doc_id, case when n = 0 then 'unstamped' else 'several ids' end from own where idx >= 0 and n <> 1""",
    "cache_decisions": _DECIDE + " select * from decided",
    "cache_counts": _DECIDE + " select doc_id, count(*) filter (action = 'reuse') as n_reuse, count(*) filter (action = 'reembed') as n_reembed, count(*) filter (action = 'evict') as n_evict from decided group by 1",
    "cache_sync": _DECIDE + """, i as (select doc_id, concat_ws(':', doc_id, id, body_hash) as key from w), s as (select doc_id, concat_ws(':', doc_id, id, body_hash) as key from o where doc_id in (select doc_id from w))
select coalesce(s.doc_id, i.doc_id) as doc_id, case when s.key is null then 'add' when i.key is null then 'delete' else 'skip' end as action, count(*) as n_keys from s full join i on s.key = i.key group by 1, 2""",
    "reembed_parity": _DECIDE + """, h as (select doc_id, count(*) as n from (select distinct doc_id, body_hash from w except select distinct doc_id, body_hash from o) group by 1), d as (select doc_id, count(*) as n from decided where action = 'reembed' group by 1)
select coalesce(h.doc_id, d.doc_id) as doc_id, coalesce(h.n, 0) as by_hash, coalesce(d.n, 0) as by_id from h full join d on h.doc_id = d.doc_id""",
    "duplicate_records": _PAIRS + f" select doc_id, count(distinct {sql.digest('content')}) as by_hash, count(distinct id) as by_id from marks_a where idx >= 0 and id is not null and not malformed group by 1",
    "survival_cells": _SURVIVAL + " select *, intact / n_ids as intact_rate, present / n_ids as present_rate from cells",
    "survival_pivot": _SURVIVAL + " select marker, avg(intact / n_ids) filter (instructed) as told, avg(intact / n_ids) filter (not instructed) as naive from cells group by 1",
    "study_cells": _CELLS + " select * from cells",
    "study_verdicts": _JUDGED + " select doc_id, content_drops, marker_strips, judge_unknown, is_guard, is_nag from judged",
    "eligible_docs": r"""select doc_id, doc_path, cast(n as int) as n_words from (select *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as n from documents)
where doc_path like '%.md' and not regexp_matches(doc_path, '(^|/)INDEX\.md$') and contains(text, 'stay:') and n <= 400""",
    "perturb_reorder": _PB + " select doc_id, cast(n - 1 - i as int) as pos, text, id as ids from pb",
    "perturb_edit_in_place": _PB + f" select doc_id, i as pos, case when para and i % 2 = 1 then rtrim(regexp_replace(text, 'the ', 'each ')) || ' This sentence was added by an editor.' else text end as text, id as ids from pb",
    "perturb_delete": _PB + ", out as (select doc_id, i, 0 as s, text, id from paras where nth is null or nth <> 2)" + _ROWS,
    "perturb_clone": _PB + ", out as (select doc_id, i, 0 as s, text, id from paras union all select doc_id, i, 1, text, null from paras where nth = 1)" + _ROWS,
    "perturb_split": _PB + """, c as (select *, min(case when para and contains(text, '. ') then i end) over (partition by doc_id) as f from pb),
out as (select doc_id, i, 0 as s, case when i = f then left(text, cast(instr(text, '. ') - 1 as int)) || '.' else text end as text, id from c union all select doc_id, i, 1, substr(text, cast(instr(text, '. ') + 2 as int)), null from c where i = f)""" + _ROWS,
    "perturb_merge": _PB + """, c as (select *, min(case when para and np then i end) over (partition by doc_id) as f from paras),
out as (select doc_id, i, 0 as s, case when i = f then rtrim(text) || ' ' || ltrim(nt) else text end as text, case when i = f then id || ',' || nid else id end as id from c where f is null or i <> f + 1)""" + _ROWS,
    "perturb_insert": _PB + f""", d as (select distinct doc_id, n // 2 as mid from pb),
out as (select doc_id, 0 as i, 0 as s, text, id from pb where i = 0 union all select doc_id, 1, 0, 'This is an entirely new paragraph inserted by a later editor, describing unrelated background that did not exist before.', null from d union all select p.doc_id, 2, p.i, text, id from pb p join d using (doc_id) where p.i >= 1 and p.i < mid
  union all select doc_id, 3, 0, 'Another new paragraph was added here to pad the document with additional context that no original marker should ever match.', null from d union all select p.doc_id, 4, p.i, text, id from pb p join d using (doc_id) where p.i >= mid)""" + _ROWS,
}
SQL |= {f"perturb_{op}": text for op, text in _EDITS.items()}


def _truth_of(op: str) -> str:
    """Every id sits on the block that carries it after the edit; of a split block either part will do; ids that are gone
    must be detached."""
    accept = "case when following = '' then pos || ',' || (pos + 1) else cast(pos as varchar) end" if op == "split" else "cast(pos as varchar)"
    gone = f" union all select doc_id, id, null, null from (select doc_id, id from ({_PB} select doc_id, id from pb) except select doc_id, id from homes)" if op in ("delete", "heading_delete") else ""
    return f"""with edited as ({SQL['perturb_' + op]}), near as (select *, lead(ids) over (partition by doc_id order by pos) as following from edited),
homes as (select doc_id, unnest(string_split(ids, ',')) as id, pos, following from near where ids <> '')
select doc_id, id, {accept} as accept, pos as preferred from homes{gone}"""


SQL |= {f"truth_{op}": _truth_of(op) for op in STUDY if f"perturb_{op}" in SQL}
_RESTAMPED = SQL["restamped"].replace(_DIRTY, _PLAIN)
SQL |= {
    "survival_report": _SURVIVAL + """ select 'marker' as grouping, marker, cast(null as varchar) as instructed, avg(intact / n_ids) as mean_rate, count(*) as n_cells from cells group by marker
union all select 'instructed', null, cast(instructed as varchar), avg(intact / n_ids), count(*) from cells group by instructed
union all select 'marker+instructed', marker, cast(instructed as varchar), avg(intact / n_ids), count(*) from cells group by marker, instructed""",
    "chunked": "with " + sql.parse(_RESTAMPED, "_r") + f""",
dup as (select doc_id from marks_r where id is not null and not malformed group by doc_id, id having count(*) > 1),
odd as (select b.doc_id from blocks_r b left join marks_r m on m.doc_id = b.doc_id and m.pos = b.pos where b.idx >= 0 group by b.doc_id, b.pos having count(m.id) filter (not m.malformed) <> 1),
bad as (select doc_id from marks_r where malformed or idx < 0 or (content <> '' and hash is not null and left({sql.digest('content')}, length(hash)) <> hash) union select doc_id from dup union select doc_id from odd)
select b.doc_id, m.id, b.content as text, {sql.digest('b.content')} as body_hash from blocks_r b join marks_r m on m.doc_id = b.doc_id and m.pos = b.pos where b.idx >= 0 and m.id is not null and not m.malformed and b.doc_id not in (select doc_id from bad)""",
}


def _md(path: str) -> str:
    return rf"(regexp_matches({path}, '\.(md|markdown)$') and not starts_with({path}, '.blockloom/'))"


_LINTS = _FOUND[len(_DIRTY) :].replace("found as (", "lints as (").replace("from found)", "from lints)")
_TWO_SIDES = "with " + sql.parse(tag="_b") + "," + sql.parse(sql.EDITED, "_a") + ","
# One commit per repository. In these tables no deleted document shares an id with a new one, so that nothing is claimed;
# the query over pairings would show it.
_COMMITS = rf"""with later as ({sql.EDITED}), given as (select doc_id, repo, doc_id || '/' || doc_path as path, text, case length(text) % 8 when 0 then 'D' when 1 then 'A' when 2 then 'R' when 3 then 'C' else 'M' end as status
  from documents where text is not null and repo is not null and doc_path is not null),
entries as (select repo as commit_id, cast(g.doc_id as int) as seq, status, case when status = 'R' then 'old/' || path else path end as src, path as dst,
  case when status not in ('A', 'C') then g.text end as before, case when status <> 'D' then l.text end as after from given g join later l on l.doc_id = g.doc_id),
changed as (select *, case when status = 'R' and {_md('src')} and before is not null then src when status not in ('C', 'R') and before is not null then dst end as origin from entries where status <> 'D' and {_md('dst')}),
gone as (select * from entries where {_md('src')} and (status = 'D' or status = 'R' and not {_md('dst')}))"""
_COMMIT_FOUND = (
    _COMMITS + "," + sql.parse("select dst as doc_id, coalesce(after, '') as text from changed") + _LINTS
    + "," + sql.parse("select dst as doc_id, before as text from changed where origin is not null", "_b") + "," + sql.parse("select dst as doc_id, coalesce(after, '') as text from changed where origin is not null", "_a")
    + "," + _PAIRS[len(_TWO_SIDES) :] + _DIFFS[len(_PAIRS) :]
    + """,
carried as (select distinct c.commit_id, m.id, c.dst as other from marks m join changed c on c.dst = m.doc_id where m.idx >= 0 and m.id is not null and not m.malformed),
every as (select doc_id, level, code, message, id, line from lints union all select doc_id, level, code, message, id, null from found where code <> 'COLLECTION_SHRANK'),
moves as (select c.commit_id, e.doc_id, e.id, string_agg(distinct k.other, ', ' order by k.other) as moved_to from every e join changed c on c.dst = e.doc_id join carried k on k.commit_id = c.commit_id and k.id = e.id and k.other <> e.doc_id where e.code = 'DROPPED_ID' group by 1, 2, 3),
standing as (select c.commit_id, c.dst, c.origin, e.level, e.code, e.message, e.id, e.line, case when e.code = 'DROPPED_ID' then m.moved_to end as moved_to from every e join changed c on c.dst = e.doc_id left join moves m on m.doc_id = e.doc_id and m.id = e.id)"""
)
SQL |= {
    "commit_pairings": _COMMITS + " select commit_id, seq, dst, origin from changed",
    "commit_reports": _COMMIT_FOUND + " select commit_id, case when origin is null or origin = dst then dst else dst || ' (baseline ' || origin || ')' end as label, level, code, message, id, line from standing where moved_to is null",
    "commit_gate": _COMMIT_FOUND + " select commit_id, bool_or(level = 'error' and moved_to is null) as has_errors from standing group by 1",
    "commit_notes": _COMMIT_FOUND + "," + sql.parse("select src as doc_id, coalesce(before, '') as text from gone", "_g") + """,
lost as (select distinct g.commit_id, g.src, g.status, g.dst, m.id from marks_g m join gone g on g.src = m.doc_id where m.idx >= 0 and m.id is not null and not m.malformed
  and not exists (select 1 from changed c where c.commit_id = g.commit_id and c.origin = g.src) and not exists (select 1 from carried k where k.commit_id = g.commit_id and k.id = m.id)),
listed as (select commit_id, src, status, dst, count(*) as n, list_sort(list(id)) as ids from lost group by 1, 2, 3, 4),
shown as (select *, array_to_string(ids[1:6], ', ') || case when n > 6 then ', ...' else '' end as names from listed)
select distinct commit_id, id || ': moved out of ' || coalesce(origin, dst) || ' into ' || moved_to || ' (still in this commit, not blocking)' as note from standing where moved_to is not null
union select commit_id, case when status = 'R' then src || ': renamed to ' || dst || ', leaving Markdown tracking with ' || n || ' stay(s) not carried by another Markdown file (' || names || ')'
  else src || ': deleted with ' || n || ' stay(s) that no staged file carries (' || names || ')' end from shown""",
}

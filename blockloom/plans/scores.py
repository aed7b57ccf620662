"""Queries over scores: rewrites against their own markers, summaries of edit studies, the shape of a corpus, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cache, diff, dogfood, resolve, rewrites, score, segment, study, survival
from ..session import stored
from . import sql
from .corpus import KEYS, documents, edited
from .documents import _with_item_ids
from .identity import _JUDGED, STUDY, _before, _judged_cells, _studied
from .versions import _PAIRS, _PLAIN


def _rewrite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.score_blocks(documents(spark, sf_dir), edited(spark, sf_dir), KEYS)


def rewrite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of every document, looked for in the edited version without its markers."""
    return _rewrite_scores(spark, sf_dir)


def rewrite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery by band of similarity, tier and model; the model is made of the document's number."""
    rows = _rewrite_scores(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")))
    return rewrites.report(rows, ["method", "model"])


def rewrite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.summary(_rewrite_scores(spark, sf_dir))


def rewrite_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids have a truth and which have none, whatever the resolver does."""
    rows = _rewrite_scores(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count_if(F.col("cat") == "no_truth").alias("no_truth"), F.count_if(F.col("cat") != "no_truth").alias("scored"))


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of a list item, looked for in the same documents without the first entry of each list."""
    before = stored(_with_item_ids(spark, sf_dir, documents), "before")
    after = before.withColumn("text", F.regexp_replace("text", r"\n\n- [^\n]*\n", "\n\n"))
    return rewrites.score_items(before, after, KEYS)


def corpus_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.shape(documents(spark, sf_dir), KEYS, len(STUDY))


def _arm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _studied(spark, sf_dir, study.arms, paths=True)


def planned_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms over the edits that were planned and over those added later, each on its own."""
    return study.arm_report(study.planned(_arm_cells(spark, sf_dir)), KEYS, ("markers", "planned"))


def arm_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms that recover less than the control under some edit, or attach more falsely."""
    cells = stored(study.arm_report(_arm_cells(spark, sf_dir), KEYS, ("markers", "op")), "cells")
    return study.vetoes(cells, ("markers", "op")).select("markers", "op", "arm", "recovery", "false_rate", "c_recovery", "c_false")


def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the usable cells of the edit study, by task, model and over all."""
    d = F.col("doc_id")
    cells = _judged_cells(spark, sf_dir).withColumns({"task": F.concat(F.lit("t"), (d % 3).cast("string")), "model": F.concat(F.lit("m"), (d % 2).cast("string")), "ok": d % 7 != 0, "truncated": d % 11 == 0})
    return dogfood.summaries(rewrites.usable(cells), ["task", "model"])


def study_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with lost content, the greatest loss first, under labels that name no document."""
    cells = _judged_cells(spark, sf_dir).where("content_drops > 0").select("doc_id", "content_drops", "n_stays")
    return dogfood.ranked(dogfood.labels(cells, KEYS, ["n_stays", "doc_id"]), "content_drops", ["doc_id"])


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small forms of every text: without an outer fence, without headings, as a front matter entry, as numbers."""
    t, n = F.col("text"), F.length("text")
    fenced = F.concat(F.lit("```md\n"), t, F.when(n % 2 == 0, "\n```").otherwise(""))
    e = cache.fake_embedding(F.sha2(t.cast("binary"), 256))
    return documents(spark, sf_dir).where("text is not null").select(
        "doc_id", F.sha2(T.strip_outer_fence(fenced).cast("binary"), 256).alias("unfenced"), F.sha2(T.strip_headings(t).cast("binary"), 256).alias("no_headings"),
        survival.front_matter_entry(F.lit("id"), F.regexp_replace(t, r"[^ -~]", "")).alias("entry"), T.band_label((n % 103) / 100).alias("band"), T.percent((n % 9) / 8).alias("per_cent"),
        F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 6).alias("embedding_sum"),
    )


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of four neighbouring stamped blocks, keyed by their members."""
    rows = resolve.anchors(_before(spark, sf_dir), KEYS).select("doc_id", "id", F.col("hash").alias("body_hash"), F.col("quote").alias("text"), "idx", "seq")
    per = cache.sections(rows, KEYS, F.floor(F.col("idx") / 4).cast("int"), F.struct("idx", "seq"))
    return per.select("doc_id", "section", "key", "n_members", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def quarantined_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that several blocks of a document carry: no key for a cache, so that they are kept out of it and listed here."""
    return diff.id_index(segment.blocks(edited(spark, sf_dir), KEYS), KEYS).where("n > 1").select("doc_id", "id", "n")


def merged_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the dropped ids, counted by document and then added up."""
    judged = _judged_cells(spark, sf_dir)
    rows = judged.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("cat"), F.col(n).alias("k")) for c, n in (("correct", "content_drops"), ("wrong", "marker_strips"), ("missed", "judge_unknown"))])).alias("x")).select("doc_id", "x.cat", "x.k")
    partial = rows.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("cat") == c, F.col("k"))), F.lit(0)).alias(c) for c in score.CATEGORIES], F.sum("k").alias("n"))
    return score.rates(score.merged(partial.withColumn("half", F.col("doc_id") % 2), ["half"]))


QUERIES = {f.__name__: f for f in (rewrite_scores, rewrite_report, rewrite_summary, rewrite_gold, item_scores, corpus_shape, planned_arms, arm_vetoes, study_summary, study_ranked, text_forms, section_chunks, quarantined_ids, merged_tallies)}

_FENCED = "'```md' || chr(10) || text || case when length(text) % 2 = 0 then chr(10) || '```' else '' end"
_WHOLE = r"'(?s)^\s*```[A-Za-z]*[ \t]*\n(.*?)\n```\s*$'"
_BYTES = " + ".join(f"strpos('0123456789abcdef', substr(sha256(text), {2 * i + 1}, 1)) * 16 - 16 + strpos('0123456789abcdef', substr(sha256(text), {2 * i + 2}, 1)) - 1" for i in range(8))
_SUMS = "count(*) as n, cast(sum(n_stays) as bigint) as stays, cast(sum(content_drops) as bigint) as content_drops, cast(sum(marker_strips) as bigint) as marker_strips, cast(sum(judge_unknown) as bigint) as unknown, count(*) filter (content_drops > 0) as cells_with_drops, count(*) filter (marker_strips > 0) as cells_with_strips, count(*) filter (caught) as blocked, count(*) filter (is_guard) as guards, count(*) filter (is_nag) as nags, cast(sum(relocated) as bigint) as relocated, cast(sum(duplicated) as bigint) as duplicated, cast(sum(hash_drift) as bigint) as hash_drift"

SQL = {
    "rewrite_gold": _PAIRS + """, ids as (select distinct doc_id, id from marks_b where idx >= 0 and id is not null and not malformed),
gold as (select doc_id, id from pairs where bh is not null and n = 1 and (ah = bh or owner is null or owner = id))
select i.doc_id, count(*) filter (g.id is null) as no_truth, count(*) filter (g.id is not null) as scored from ids i left join gold g on g.doc_id = i.doc_id and g.id = i.id group by 1""",
    "study_summary": _JUDGED + f""", cells_ok as (select *, 't' || (doc_id % 3) as task, 'm' || (doc_id % 2) as model from judged where doc_id % 7 <> 0 and doc_id % 11 <> 0)
select 'task' as slice, task as value, {_SUMS} from cells_ok group by 1, 2 union all select 'model', model, {_SUMS} from cells_ok group by 1, 2 union all select 'all', null, {_SUMS} from cells_ok having count(*) > 0""",
    "study_ranked": _JUDGED + """ select doc_id, content_drops, n_stays, 'doc' || case when k < 10 then '0' else '' end || k as label, cast(row_number() over (order by content_drops desc, doc_id) as int) as place
from (select *, row_number() over (order by n_stays, doc_id) as k from judged where content_drops > 0)""",
    "text_forms": rf"""select doc_id, sha256(case when regexp_matches({_FENCED}, {_WHOLE}) then regexp_extract({_FENCED}, {_WHOLE}, 1) else {_FENCED} end) as unfenced,
  sha256(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^#{{1,6}}[ \t]')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')) as no_headings,
  '  id: "' || replace(left(trim(regexp_replace(regexp_replace(text, '[^ -~]', '', 'g'), '\s+', ' ', 'g')), 40), '"', '''') || '"' as entry,
  case when length(text) % 103 < 30 then '0.0-0.3' when length(text) % 103 < 50 then '0.3-0.5' when length(text) % 103 < 70 then '0.5-0.7' when length(text) % 103 < 90 then '0.7-0.9' when length(text) % 103 < 101 then '0.9-1.0' else '1.0-1.0' end as band,
  cast(round_even((length(text) % 9) * 12.5, 0) as bigint) as per_cent, round(({_BYTES}) / 255.0, 6) as embedding_sum from documents where text is not null""",
    "section_chunks": _PLAIN + f""", own as (select m.doc_id, m.id, {sql.digest('b.content')} as h, b.content as text, b.idx, m.seq from marks m join blocks b on b.doc_id = m.doc_id and b.pos = m.pos where b.idx >= 0 and m.id is not null and not m.malformed)
select doc_id, cast(idx // 4 as int) as section, sha256(string_agg(id || ':' || h, ',' order by idx, seq)) as key, cast(count(*) as int) as n_members, sha256(string_agg(text, chr(10) || chr(10) order by idx, seq)) as text_hash from own group by 1, 2""",
    "quarantined_ids": _PAIRS + " select doc_id, id, n from ix_a where n > 1",
    "merged_tallies": _JUDGED + """, t as (select doc_id % 2 as half, cast(sum(content_drops) as bigint) as correct, cast(sum(marker_strips) as bigint) as wrong, cast(sum(judge_unknown) as bigint) as missed from judged group by 1)
select half, correct, wrong, missed, cast(0 as bigint) as correct_detach, cast(0 as bigint) as false_attach, correct + wrong + missed as n, coalesce(correct / nullif(correct + wrong + missed, 0), 0.0) as recovery, coalesce(wrong / nullif(correct + wrong + missed, 0), 0.0) as false_rate from t""",
}

"""Queries over list items, trees, wrapped documents and rendered output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bridge, children, lint, perturb, render, segment
from ..sources import files
from .corpus import KEYS, dirty, documents, edited
from .versions import _FOUND


def _with_item_ids(spark: SparkSession, sf_dir: str, version) -> DataFrame:
    """Documents whose bullets carry ids."""
    t = F.regexp_replace("text", r"(?m)^- ([A-Z])([^\n]*)$", "- $1$2 <!-- stay:i$1 subhash=sha256:0000 -->")
    return version(spark, sf_dir).select("doc_id", t.alias("text"))


def child_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children.child_rows(documents(spark, sf_dir), KEYS).drop("ids")


def child_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children.child_findings(_with_item_ids(spark, sf_dir, documents), KEYS)


def child_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children.child_resolutions(_with_item_ids(spark, sf_dir, documents), edited(spark, sf_dir), KEYS)


def child_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children.child_diff(_with_item_ids(spark, sf_dir, documents), edited(spark, sf_dir), KEYS)


def tree_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children.tree_spans(documents(spark, sf_dir), KEYS)


def segmenter_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children.agreement(documents(spark, sf_dir), KEYS)


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = perturb.annotate(segment.blocks(documents(spark, sf_dir), KEYS), KEYS).select("doc_id", perturb.serialize(F.col("pb"), False).alias("text"))
    return bridge.to_wrapped(annotated, segment.blocks(annotated, KEYS), KEYS)


def wrapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir)


def unwrapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.from_wrapped(_wrapped(spark, sf_dir).where("error is null"), KEYS)


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", render.visible_text(F.col("text")).alias("visible"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that keep, escape, drop or fence the markers of every document."""
    d = documents(spark, sf_dir).where("text is not null")
    t = F.col("text")
    tools = {
        "keeps": t, "drops": F.regexp_replace(t, "(?s)<!-- stay:.*?-->", ""), "escapes": F.replace(t, F.lit("<!-- stay:"), F.lit("&lt;!-- stay:")),
        "spans": F.regexp_replace(t, "(?s)(<!-- stay:.*?-->)", "`$1`{=html}"), "fails": t, "edits": F.replace(t, F.lit(" the "), F.lit(" each ")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tool"), v.alias("out")) for k, v in tools.items()])).alias("x")
    rows = d.select("doc_id", t.alias("input"), each).select(F.concat_ws(":", F.col("doc_id").cast("string"), "x.tool").alias("run_id"), "x.tool", F.col("doc_id").cast("string").alias("fixture"), "input", "x.out")
    return rows.withColumn("rc", F.when(F.col("tool") == "fails", 1).otherwise(0)).withColumn("err", F.when(F.col("rc") == 1, "no such option\nusage"))


def roundtrip_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.roundtrip(_runs(spark, sf_dir))


def render_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(_runs(spark, sf_dir))


def mdx_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.compiled(_runs(spark, sf_dir))


def sanitizer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over an ``id`` attribute made of every document's number."""
    d = documents(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    html = F.concat(F.lit('<p id="b'), i, F.lit('">x</p>'))
    out = F.when(i.endswith("1"), F.lit("<p>x</p>")).when(i.endswith("2"), F.replace(html, F.lit('id="'), F.lit('id="user-content-'))).otherwise(html)
    return render.sanitized(d.select(i.alias("run_id"), html.alias("input"), out.alias("out"), F.lit(0).alias("rc"), F.lit(None).cast("string").alias("err")))


def tool_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderers of the matrix, each in the part of a tool that treats markers in its way."""
    part = F.create_map(*[F.lit(x) for pair in (("keeps", "markdown-it"), ("escapes", "markdown-it-default"), ("drops", "marked"), ("spans", "python-markdown"), ("fails", "mdx"), ("edits", "github")) for x in pair])
    runs = _runs(spark, sf_dir)
    verdicts = render.rendered(runs).join(runs.select("run_id", F.try_element_at(part, F.col("tool")).alias("tool"), "fixture"), "run_id").withColumn("axis", F.lit("render"))
    return render.matrix(verdicts, render.tools(spark))


def tool_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.tools(spark).select("tool", "axis", F.size("fixtures").alias("n_fixtures"), F.col("primary").alias("main"), F.col("remedy").isNotNull().alias("has_remedy"))


def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.marker_findings(segment.markers(segment.blocks(dirty(spark, sf_dir), KEYS), KEYS), KEYS)
    return files.findings_by_label(lint.sorted_findings(found, KEYS), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        child_items, child_findings, child_resolutions, child_diff, tree_spans, segmenter_agreement, wrapped_blocks, unwrapped_blocks, visible_text, roundtrip_verdicts, render_verdicts, mdx_verdicts, sanitizer_verdicts, tool_matrix, tool_list, findings_json,
    )
}

_RUNS = r"""with runs as (
  select d.doc_id || ':' || tool as run_id, tool, text as input, case tool when 'drops' then regexp_replace(text, '(?s)<!-- stay:.*?-->', '', 'g') when 'escapes' then replace(text, '<!-- stay:', '&lt;!-- stay:')
    when 'spans' then regexp_replace(text, '(?s)(<!-- stay:.*?-->)', '`\1`{=html}', 'g') when 'edits' then replace(text, ' the ', ' each ') else text end as out, tool = 'fails' as failed
  from documents d cross join (values ('keeps'), ('drops'), ('escapes'), ('spans'), ('fails'), ('edits')) t(tool) where text is not null),
ids as (select *, list_distinct(regexp_extract_all(input, '(?s)(?:<!--|\{/\*)\s*stay:\s*([A-Za-z0-9_-]+)\s[^>]*?(?:-->|\*/\})', 1)) as i,
  replace(replace(replace(replace(replace(regexp_replace(regexp_replace(out, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as seen from runs),
looked as (select *, list_sort(list_filter(i, lambda x: contains(seen, 'stay:' || x))) as leaked, list_filter(i, lambda x: regexp_matches(out, '<!--\s*stay:' || x || '\b')) as kept,
  list_sort(list_filter(i, lambda x: regexp_matches(out, '"[^"]*stay:' || x || '\b'))) as quoted, list_filter(i, lambda x: contains(out, 'stay:' || x)) as there from ids),
rendered as (select run_id, tool, case when failed then 'ERROR' when len(leaked) > 0 then 'LEAKED_VISIBLE' else 'INVISIBLE' end as verdict,
  case when failed then 'no such option' when len(leaked) > 0 then 'marker(s) rendered as visible text: ' || array_to_string(leaked, ', ') when len(kept) > 0 then 'comment retained in HTML source (invisible)' else 'comment dropped from output (invisible)' end as note from looked)"""

SQL = {
    "render_verdicts": _RUNS + " select run_id, verdict, note from rendered",
    "mdx_verdicts": _RUNS + """ select run_id, case when failed then 'ERROR' when len(quoted) > 0 then 'LEAKED_VISIBLE' else 'INVISIBLE' end as verdict,
  case when failed then 'HTML-comment marker is invalid MDX (use the {/* */} form)' when len(quoted) > 0 then 'marker rendered as JSX text: ' || array_to_string(quoted, ', ')
    when len(there) > 0 then 'compiles; marker hoisted to a JS comment, renders as an empty expression' else 'compiles; marker dropped, renders to nothing' end as note from looked""",
    "tool_matrix": _RUNS + """, named as (select *, case tool when 'keeps' then 'markdown-it' when 'escapes' then 'markdown-it-default' when 'drops' then 'marked' when 'spans' then 'python-markdown' when 'fails' then 'mdx' else 'github' end as t,
  case verdict when 'LEAKED_VISIBLE' then 0 when 'ERROR' then 1 else 2 end as rank from rendered),
cells as (select t as tool, arg_min({'v': verdict, 'n': note}, {'r': rank, 'v': verdict, 'n': note}) as x, count(distinct verdict) > 1 as divergent, count(*) filter (verdict <> 'INVISIBLE') as n_bad, count(*) as n_fixtures from named group by 1)
select c.tool, 'render' as axis, label, x.v as verdict, divergent, n_bad, n_fixtures, x.n || case when remedy is not null and n_bad > 0 then '; ' || remedy else '' end as note from cells c join (values
  ('github', 'GitHub (cmark-gfm)', null), ('markdown-it', 'markdown-it (html: true)', null), ('markdown-it-default', 'markdown-it (default, html: false)', 'set html: true; by default the comment is escaped and can be read'),
  ('marked', 'marked', null), ('python-markdown', 'python-markdown (MkDocs)', null), ('mdx', 'MDX (@mdx-js/mdx)', 'use the {/* */} form: an HTML comment is no MDX')) d(tool, label, remedy) on d.tool = c.tool""",
    "tool_list": """select * from (values ('prettier', 'roundtrip', 3, null, false), ('mdformat', 'roundtrip', 3, null, false), ('remark', 'roundtrip', 3, null, false), ('pandoc-gfm', 'roundtrip', 3, null, false), ('pandoc-markdown', 'roundtrip', 3, null, true),
  ('remark-mdx', 'roundtrip', 1, null, false), ('github', 'render', 3, null, false), ('markdown-it', 'render', 3, null, false), ('markdown-it-default', 'render', 3, null, true), ('marked', 'render', 3, null, false),
  ('python-markdown', 'render', 3, null, false), ('mdx', 'render', 2, 'mdx', true), ('rehype-sanitize', 'sanitize', 2, null, true), ('dompurify', 'sanitize', 2, null, false)) t(tool, axis, n_fixtures, main, has_remedy)""",
    "visible_text": _RUNS + " select cast(split_part(run_id, ':', 1) as bigint) as doc_id, seen as visible from looked where tool = 'keeps'",
    "sanitizer_verdicts": """select cast(doc_id as varchar) as run_id, case when doc_id % 10 = 1 then 'ID_STRIPPED' when doc_id % 10 = 2 then 'ID_PREFIXED' else 'ID_SURVIVES' end as verdict,
  case when doc_id % 10 = 1 then 'anchor id removed: b' || doc_id when doc_id % 10 = 2 then 'id kept but renamed (e.g. user-content-): #id deep link breaks' else 'id preserved verbatim' end as note from documents""",
    "findings_json": _FOUND + """ select doc_id, '[' || string_agg(json_merge_patch('{}', to_json({'level': level, 'code': code, 'message': message, 'id': id, 'line': line})), ',' order by r, line, code, pos, seq, step) || ']' as findings from ranked group by 1""",
}

"""What formatters, renderers and sanitizers do to markers: verdicts from input and output texts.

``runs`` has run_id, tool, axis, fixture, input, out, err and rc.
"""

from __future__ import annotations

import html
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import first_line, visible_tags_removed
from . import diff, segment

# Verdicts of each axis, the worst first.
SEVERITY = {
    "roundtrip": ["DROPPED", "RELOCATED", "DUPLICATED", "MANGLED", "ERROR", "SURVIVES"],
    "render": ["LEAKED_VISIBLE", "ERROR", "INVISIBLE"],
    "sanitize": ["ID_STRIPPED", "ID_PREFIXED", "ERROR", "ID_SURVIVES"],
}
KEY = ["run_id"]


@F.pandas_udf(StringType())
def unescape(t: pd.Series) -> pd.Series:
    return t.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


def visible_text(t: Column) -> Column:
    """What a reader sees: comments and tags gone, entities resolved."""
    return unescape(visible_tags_removed(t))


def _ids(text: Column) -> Column:
    """Ids of all well-formed markers of a text, in order, blocks aside."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)(?:<!--|\{/\*)\s*stay:\s*([A-Za-z0-9_-]+)(?=\s)[^>]*?(?:-->|\*/\})"), F.lit(1))
    return F.array_distinct(bodies)


def _word(before: str, i: Column) -> Column:
    return F.concat(F.lit(before), i, F.lit(r"\b"))


def clean_marker(out: Column, i: Column) -> Column:
    """A marker of the id that stands free: its opener does not follow a backtick."""
    return F.regexp_like(out, _word(r"(?<!`)<!--\s*stay:", i)) | F.regexp_like(out, _word(r"(?<!`)\{/\*\s*stay:", i))


def _named(prefix: str, ids: Column) -> Column:
    return F.concat(F.lit(prefix), F.array_join(F.array_sort(ids), ", "))


def roundtrip(runs: DataFrame) -> DataFrame:
    """(run_id, verdict, note) of text-to-text runs. Losses come before moves, copies and broken forms; drift never fails."""
    sides = [diff.id_index(segment.blocks(runs.select("run_id", F.coalesce(F.col(c), F.lit("")).alias("text")), KEY), KEY) for c in ("input", "out")]
    found = diff.findings(diff.compare(*sides, KEY), KEY)
    per = found.groupBy("run_id").agg(*[F.collect_set(F.when(F.col("code") == c, F.col("id"))).alias(c) for c in ("RELOCATED_ID", "DUPLICATED_ID", "HASH_DRIFT")])
    o = F.coalesce("out", F.lit(""))
    rows = runs.join(per, "run_id", "left").withColumn("i", _ids(F.col("input"))).withColumn("have", _ids(o)).withColumn("o", o)
    rows = rows.withColumn("missing", F.array_except("i", "have")).withColumn("escaped", F.filter("missing", lambda i: F.regexp_like(F.col("o"), _word(r"&lt;!--\s*stay:", i))))
    rows = rows.withColumn("lost", F.array_except("missing", "escaped")).withColumn("mangled", F.array_union(F.filter(F.array_intersect("i", "have"), lambda i: ~clean_marker(F.col("o"), i)), F.col("escaped")))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    cases = [
        (F.col("rc") != 0, "ERROR", F.coalesce(first_line(F.col("err")), F.lit(""))),
        (some("lost"), "DROPPED", _named("marker(s) lost: ", F.col("lost"))),
        (some("RELOCATED_ID"), "RELOCATED", _named("marker(s) moved to the wrong block: ", F.col("RELOCATED_ID"))),
        (some("DUPLICATED_ID"), "DUPLICATED", _named("marker(s) duplicated: ", F.col("DUPLICATED_ID"))),
        (some("mangled"), "MANGLED", _named("marker(s) rewritten to a non-comment form (code span / escaped): ", F.col("mangled"))),
        (some("HASH_DRIFT"), "SURVIVES", F.lit("clean; hash drifts on reflow (expected)")),
    ]
    return _verdict(rows, cases, "SURVIVES", F.lit("clean, no drift"))


def _verdict(rows: DataFrame, cases: list[tuple[Column, str, Column]], verdict: str, note: Column) -> DataFrame:
    last = F.struct(F.lit(verdict).alias("verdict"), note.alias("note"))
    for when, name, text in reversed(cases):
        last = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("verdict"), text.alias("note"))).otherwise(last)
    return rows.select("run_id", last.alias("v")).select("run_id", "v.verdict", "v.note")


def rendered(runs: DataFrame) -> DataFrame:
    """(run_id, verdict, note) of text-to-HTML runs: a marker leaks if its text can be seen."""
    o = F.coalesce("out", F.lit(""))
    rows = runs.withColumn("o", o).withColumn("i", _ids(F.col("input"))).withColumn("seen", visible_text(o))
    rows = rows.withColumn("leaked", F.filter("i", lambda i: F.contains(F.col("seen"), F.concat(F.lit("stay:"), i))))
    kept = F.exists("i", lambda i: F.regexp_like(F.col("o"), _word(r"<!--\s*stay:", i)))
    cases = [(F.col("rc") != 0, "ERROR", F.coalesce(first_line(F.col("err")), F.lit(""))), (F.size("leaked") > 0, "LEAKED_VISIBLE", _named("marker(s) rendered as visible text: ", F.col("leaked")))]
    return _verdict(rows, cases, "INVISIBLE", F.when(kept, "comment retained in HTML source (invisible)").otherwise("comment dropped from output (invisible)"))


def compiled(runs: DataFrame) -> DataFrame:
    """(run_id, verdict, note) of MDX runs, whose output is a script: a marker leaks inside a string."""
    o = F.coalesce("out", F.lit(""))
    rows = runs.withColumn("o", o).withColumn("i", _ids(F.col("input"))).withColumn("leaked", F.filter("i", lambda i: F.regexp_like(F.col("o"), _word(r'"[^"]*stay:', i))))
    kept = F.exists("i", lambda i: F.contains(F.col("o"), F.concat(F.lit("stay:"), i)))
    cases = [(F.col("rc") != 0, "ERROR", F.lit("HTML-comment marker is invalid MDX (use the {/* */} form)")), (F.size("leaked") > 0, "LEAKED_VISIBLE", _named("marker rendered as JSX text: ", F.col("leaked")))]
    return _verdict(rows, cases, "INVISIBLE", F.when(kept, "compiles; marker hoisted to a JS comment, renders as an empty expression").otherwise("compiles; marker dropped, renders to nothing"))


def sanitized(runs: DataFrame) -> DataFrame:
    """(run_id, verdict, note) of HTML-to-HTML runs over ``id`` attributes."""
    o = F.coalesce("out", F.lit(""))
    rows = runs.withColumn("o", o).withColumn("i", F.regexp_extract_all(F.coalesce("input", F.lit("")), F.lit('id="([^"]+)"'), F.lit(1)))
    exact = lambda i: F.contains(F.col("o"), F.concat(F.lit('id="'), i, F.lit('"')))
    ends = lambda i: F.exists(F.regexp_extract_all(F.col("o"), F.lit('id="([^"]*)"'), F.lit(1)), lambda x: F.endswith(x, i))
    rows = rows.withColumn("stripped", F.filter("i", lambda i: ~exact(i) & ~ends(i))).withColumn("prefixed", F.filter("i", lambda i: ~exact(i) & ends(i)))
    cases = [
        (F.col("rc") != 0, "ERROR", F.coalesce(first_line(F.col("err")), F.lit(""))), (F.size("i") == 0, "ERROR", F.lit("emit produced no id= to test")),
        (F.size("stripped") > 0, "ID_STRIPPED", F.concat(F.lit("anchor id removed: "), F.array_join("stripped", ", "))), (F.size("prefixed") > 0, "ID_PREFIXED", F.lit("id kept but renamed (e.g. user-content-): #id deep link breaks")),
    ]
    return _verdict(rows, cases, "ID_SURVIVES", F.lit("id preserved verbatim"))


def severity(axis: Column, verdict: Column) -> Column:
    """Place of a verdict in the order of its axis, 0 the worst; 99 of an unknown one."""
    rank = F.lit(99)
    for name, order in SEVERITY.items():
        for i, v in enumerate(order):
            rank = F.when((axis == name) & (verdict == v), i).otherwise(rank)
    return rank


def worst(verdicts: DataFrame, by: list[str], axis: str = "axis") -> DataFrame:
    """The worst verdict of each group by the order of its axis; unknown ones are the best."""
    order = F.struct(severity(F.col(axis), F.col("verdict")).alias("r"), "verdict")
    return verdicts.groupBy(*by, axis).agg(F.min_by("verdict", order).alias("verdict"), F.countDistinct("verdict").alias("n_verdicts"), F.count("*").alias("n_fixtures"))


# The tools of the matrix as (tool, label, axis, fixtures, primary fixture, remedy).
_SOURCES = ("blocks", "blocks_trailing", "hash")
TOOLS = [
    ("prettier", "prettier", "roundtrip", _SOURCES, None, None),
    ("mdformat", "mdformat", "roundtrip", _SOURCES, None, None),
    ("remark", "remark + remark-stringify", "roundtrip", _SOURCES, None, None),
    ("pandoc-gfm", "pandoc (gfm → gfm)", "roundtrip", _SOURCES, None, None),
    ("pandoc-markdown", "pandoc (markdown → markdown)", "roundtrip", _SOURCES, None, "keep markers on a line of their own, or write gfm: markers that trail a line become raw code spans"),
    ("remark-mdx", "remark-mdx (round-trip)", "roundtrip", ("mdx",), None, None),
    ("github", "GitHub (cmark-gfm)", "render", _SOURCES, None, None),
    ("markdown-it", "markdown-it (html: true)", "render", _SOURCES, None, None),
    ("markdown-it-default", "markdown-it (default, html: false)", "render", _SOURCES, None, "set html: true; by default the comment is escaped and can be read"),
    ("marked", "marked", "render", _SOURCES, None, None),
    ("python-markdown", "python-markdown (MkDocs)", "render", _SOURCES, None, None),
    ("mdx", "MDX (@mdx-js/mdx)", "render", ("mdx", "blocks"), "mdx", "use the {/* */} form: an HTML comment is no MDX"),
    ("rehype-sanitize", "rehype-sanitize", "sanitize", ("blocks", "blocks_trailing"), None, "link to the id with its prefix user-content-"),
    ("dompurify", "DOMPurify", "sanitize", ("blocks", "blocks_trailing"), None, None),
]
TOOL = "tool string, label string, axis string, fixtures array<string>, primary string, remedy string"


def tools(spark: SparkSession) -> DataFrame:
    """The tools as a table of one row each."""
    return spark.createDataFrame([(*t[:3], list(t[3]), *t[4:]) for t in TOOLS], TOOL)


def matrix(verdicts: DataFrame, dimension: DataFrame) -> DataFrame:
    """One cell per tool of ``dimension`` (see :func:`tools`) on its axis: the verdict of its primary fixture if it has
    one, else the worst; whether fixtures differ; the note with the remedy where the cell, or any fixture, is not green.

    ``verdicts`` has tool, axis, fixture, verdict and note. Tools without a run have no cell.
    """
    rows = verdicts.join(F.broadcast(dimension.select("tool", "axis", "label", "primary", "remedy")), ["tool", "axis"])  # a few tools
    rows = rows.withColumn("own", F.coalesce(F.col("fixture") == F.col("primary"), F.lit(False)))
    bad = ~F.col("verdict").isin("SURVIVES", "INVISIBLE", "ID_SURVIVES")
    cells = rows.groupBy("tool", "axis", "label", "remedy").agg(
        F.min_by(F.struct("verdict", "note"), F.struct(~F.col("own"), severity(F.col("axis"), F.col("verdict")), "verdict", "note")).alias("v"),
        (F.countDistinct("verdict") > 1).alias("divergent"), F.count_if(bad).alias("n_bad"), F.count("*").alias("n_fixtures"),
    )
    note = F.when(F.col("remedy").isNotNull() & (F.col("n_bad") > 0), F.concat(F.col("v.note"), F.lit("; "), F.col("remedy"))).otherwise(F.col("v.note"))
    return cells.select("tool", "axis", "label", F.col("v.verdict").alias("verdict"), "divergent", "n_bad", "n_fixtures", note.alias("note"))

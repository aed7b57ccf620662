"""Findings of one version of a document.

A finding is (keys, level, code, message, id, line) with ``visit``, its place in the order of the reading. All joins are
within a document; only marker rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import body_hash

# Levels and their order.
LEVELS = {"error": 0, "warn": 1, "info": 2}


def rank(level: Column) -> Column:
    return F.when(level == "error", 0).when(level == "warn", 1).when(level == "info", 2).otherwise(9)


def _quoted(c: Column) -> Column:
    """A string as a Python literal would show it."""
    x = F.regexp_replace(c, r"\\", r"\\\\\\\\")
    for sign, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        x = F.replace(x, F.lit(sign), F.lit("\\" + name))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def marker_findings(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Malformed, orphan, duplicate and drifted markers.

    A malformed marker is nothing else. Duplicates are all occurrences of an id in a document after the first in the
    order of the reading. A stored hash drifts where it is not the beginning of the hash of the block's content.
    """
    good = ~F.col("malformed")
    order = Window.partitionBy(*keys, "id", good).orderBy("pos", "seq")
    now = F.left(body_hash(F.col("content")), F.length("hash"))
    seen = markers.withColumn("__nth", F.row_number().over(order)).withColumn("__first", F.first("line").over(order)).withColumn("__now", now)
    id_ = F.col("id")

    def finding(level: str, code: str, when: Column, message: Column, with_id: bool = True) -> Column:
        fields = [F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"), (id_ if with_id else F.lit(None).cast("string")).alias("id"), F.col("line").alias("line")]
        return F.when(F.coalesce(when, F.lit(False)), F.struct(*fields))

    rows = [
        finding("error", "MALFORMED_MARKER", ~good, F.concat(F.lit("marker has no parseable id: "), _quoted(F.col("raw"))), False),
        finding("error", "ORPHAN_MARKER", good & (F.col("idx") < 0), F.concat(F.lit("marker "), id_, F.lit(" has no preceding block to attach to"))),
        finding("error", "DUPLICATE_ID", good & (F.col("__nth") > 1), F.concat(F.lit("id "), id_, F.lit(" appears more than once (first at line "), F.col("__first").cast("string"), F.lit(")"))),
        finding(
            "warn", "HASH_DRIFT", good & (F.col("content") != "") & (F.col("__now") != F.col("hash")),
            F.concat(F.lit("id "), id_, F.lit(": stored hash=sha256:"), F.col("hash"), F.lit(" != current sha256:"), F.col("__now"), F.lit(" (content edited since the hash was written)")),
        ),
    ]
    found = seen.select(*keys, "pos", "seq", F.posexplode(F.array(*rows)).alias("step", "f")).where("f is not null")
    return found.select(*keys, "f.level", "f.code", "f.message", "f.id", "f.line", F.struct("pos", "seq", "step").alias("visit"))


def sorted_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``place``: the order of level, line and code, equal ones as they were found."""
    order = Window.partitionBy(*keys).orderBy(rank(F.col("level")), F.coalesce("line", F.lit(0)), "code", "visit")
    return findings.withColumn("place", F.row_number().over(order))


def counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: errors, warnings, notes, and whether there is any error."""
    n = {f"n_{k}": F.count_if(F.col("level") == v).alias(f"n_{k}") for k, v in (("error", "error"), ("warn", "warn"), ("info", "info"))}
    return findings.groupBy(*keys).agg(*n.values(), F.bool_or(F.col("level") == "error").alias("has_errors"))


def text_report(documents: DataFrame, findings: DataFrame, keys: list[str], label: str, show_drift: bool = False) -> DataFrame:
    """The report of each document as one text. Drift is hidden unless asked for, but counted.

    A document's findings are gathered in one row, as the report is one text; they are as many as its markers at most a
    few times over.
    """
    hidden = F.lit(False) if show_drift else F.col("code") == "HASH_DRIFT"
    where = F.coalesce(F.concat(F.lit("L"), F.nullif(F.col("line"), F.lit(0)).cast("string")), F.lit("-"))
    pad = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    left = F.when(F.length(where) < 5, F.lpad(where, 5, " ")).otherwise(where)
    line = F.concat(F.lit("  ["), pad(F.col("level"), 5), F.lit("] "), pad(F.col("code"), 16), F.lit(" "), left, F.lit("  "), F.col("message"))
    rows = findings.select(*keys, "level", hidden.alias("hidden"), F.struct(rank(F.col("level")).alias("r"), F.coalesce("line", F.lit(0)).alias("l"), "code", "visit", line.alias("text")).alias("x"))
    n = lambda level: F.count_if(F.col("level") == level)
    per = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(~F.col("hidden"), F.col("x")))).alias("xs"), F.count_if("hidden").alias("h"), n("error").alias("e"), n("warn").alias("w"), n("info").alias("i"))
    s = lambda c: F.col(c).cast("string")
    receipt = F.when(F.col("h") > 0, F.concat(F.lit("  -> "), s("h"), F.when(F.col("h") == 1, " hash-drift finding").otherwise(" hash-drift findings"), F.lit(" hidden (--show-drift to list)")))
    tail = F.concat(F.lit("  -> "), s("e"), F.lit(" error, "), s("w"), F.lit(" warn, "), s("i"), F.lit(" info"))
    parts = F.concat(F.array(F.concat(F.col(label).cast("string"), F.lit(":"))), F.transform("xs", lambda x: x["text"]), F.array_compact(F.array(receipt)), F.array(tail))
    full = documents.select(*dict.fromkeys([*keys, label])).join(per, keys, "left")
    report = F.when(F.col("xs").isNull(), F.concat(F.col(label).cast("string"), F.lit(": clean (no findings)"))).otherwise(F.array_join(parts, "\n"))
    return full.select(*keys, report.alias("report"))

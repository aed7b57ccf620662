"""Views of the test tables that the core queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

KEYS = ["doc_id"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _ids() -> Column:
    return F.regexp_extract_all("text", F.lit(r"<!-- stay:([A-Za-z0-9]+) "), F.lit(1))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of every document: two ids swapped here and there, markers lost, words changed, blocks added and
    copied with their id."""
    df = documents(spark, sf_dir).withColumn("ids", _ids())
    swapped = F.expr("IF(length(text) % 5 = 0 AND size(ids) > 1, replace(replace(replace(text, ids[0], '@@'), ids[1], ids[0]), '@@', ids[1]), text)")
    t = F.replace(F.regexp_replace(swapped, r"<!-- stay:[A-Za-z0-9]*[A-F] [^>]*-->|\n- [^\n]* has [^\n]*", ""), F.lit(" when "), F.lit(" once "))
    added = F.concat(F.lit("\n\nAdded by the edit.\n<!-- stay:added"), F.col("doc_id").cast("string"), F.lit(" -->\n"))
    copied = F.expr(r"IF(size(ids) > 0 AND length(text) % 3 = 0, concat('\nCopied by the edit.\n<!-- stay:', ids[0], ' -->\n'), '')")
    return df.select("doc_id", F.concat(t, added, copied).alias("text"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with what a lint finds: an orphan marker, markers in the other syntax, malformed and repeated ids, drift."""
    df = documents(spark, sf_dir).withColumn("ids", _ids())
    orphan = F.expr(r"IF(length(text) % 9 = 0, concat('<!-- stay:orphan', doc_id, ' -->\n\n'), '')")
    t = F.regexp_replace(F.replace("text", F.lit(" when "), F.lit(" once ")), "<!-- (stay:[A-Za-z0-9]*[0-3]) ([^>]*)-->", "{/* $1 $2*/}")
    t = F.regexp_replace(t, "stay:([A-Za-z0-9]*[4-5]) hash", "stay:note=$1 hash")
    again = F.expr(r"IF(size(ids) > 0, concat('\n\nRepeated.\n<!-- stay:', ids[0], ' -->\n'), '')")
    return df.select("doc_id", F.concat(orphan, t, again).alias("text"))

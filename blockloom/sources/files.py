"""Documents from files, findings to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, text) of Markdown files, each as a whole."""
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{md,markdown}").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """Rewrites as JSON documents: doc, model, task, before, after and whatever else they carry."""
    return spark.read.option("multiLine", "true").json(path)


def finding_json(level: Column, code: Column, message: Column, id_: Column, line: Column) -> Column:
    """A finding as JSON, without null fields."""
    return F.to_json(F.struct(level.alias("level"), code.alias("code"), message.alias("message"), id_.alias("id"), line.alias("line")))


def findings_by_label(findings: DataFrame, label: str) -> DataFrame:
    """(label, findings): the sorted findings of a document as a JSON array."""
    x = F.struct("place", finding_json(*(F.col(c) for c in ("level", "code", "message", "id", "line"))).alias("j"))
    per = findings.groupBy(label).agg(F.sort_array(F.collect_list(x)).alias("xs"))
    return per.select(label, F.concat(F.lit("["), F.array_join(F.transform("xs", lambda v: v["j"]), ","), F.lit("]")).alias("findings"))


def write_findings(findings: DataFrame, label: str, path: str) -> None:
    findings_by_label(findings, label).write.mode("error").json(path)


def exit_status(findings: DataFrame) -> int:
    """1 if any finding is an error, else 0."""
    return int(not findings.where("level = 'error'").isEmpty())

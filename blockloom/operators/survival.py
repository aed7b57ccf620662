"""How markers of eight syntaxes fare in rewritten texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How each syntax writes an id ({0}) and a hash ({1}), and the pattern that finds it again.
SYNTAXES = [
    ("html_comment", "<!-- stay:{0} -->", r"<!--\s*stay:{0}\b[^>]*-->"),
    ("html_comment_hash", "<!-- stay:{0} hash=sha256:{1} -->", r"<!--\s*stay:{0}\b[^>]*-->"),
    ("pandoc_attr", "{#{0}}", r"\{#{0}\b[^}]*\}"),
    ("kramdown_ial", "{: #{0}}", r"\{:\s*#{0}\b[^}]*\}"),
    ("obsidian_caret", "^{0}", r"\^{0}\b"),
    ("visible_tag", "[{0}]", r"\[{0}\]"),
    ("mdx_comment", "{/* stay:{0} */}", r"\{/\*\s*stay:{0}\b.*?\*/\}"),
    ("frontmatter_map", '  {0}: "{1}"', r"{0}"),
]


def syntaxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNTAXES, "marker string, template string, pattern string")


def render(template: Column, id_: Column, hash_: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{0}"), id_), F.lit("{1}"), hash_)


def intact(out: Column, pattern: Column, id_: Column) -> Column:
    """Whether the marker of an id stands in a text. Ids are of letters, digits, - and _."""
    return F.coalesce(F.regexp_like(out, F.replace(pattern, F.lit("{0}"), id_)), F.lit(False))


def present(out: Column, id_: Column) -> Column:
    """Whether the id stands anywhere as a word."""
    return F.coalesce(F.regexp_like(out, F.concat(F.lit(r"\b"), id_, F.lit(r"\b"))), F.lit(False))


def front_matter_entry(id_: Column, block: Column) -> Column:
    snippet = F.replace(F.left(F.trim(F.regexp_replace(block, r"\s+", " ")), F.lit(40)), F.lit('"'), F.lit("'"))
    return F.concat(F.lit("  "), id_, F.lit(': "'), snippet, F.lit('"'))


def cells(ids: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of ids by cell; ``ids`` has ``out``, ``pattern`` and ``id``."""
    rows = ids.withColumn("i", intact(F.col("out"), F.col("pattern"), F.col("id"))).withColumn("p", present(F.col("out"), F.col("id")))
    per = rows.groupBy(*by).agg(F.count("*").alias("n_ids"), F.count_if("i").alias("intact"), F.count_if("p").alias("present"))
    return per.withColumn("intact_rate", F.col("intact") / F.col("n_ids")).withColumn("present_rate", F.col("present") / F.col("n_ids"))


def report(cell_rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Mean rate of intact markers over several groupings at once: (grouping, marker, ..., mean_rate, n_cells)."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = [F.struct(F.lit("+".join(s)).alias("grouping"), *[(F.col(c).cast("string") if c in s else F.lit(None).cast("string")).alias(c) for c in names]) for s in sets]
    rows = cell_rows.select(F.explode(F.array(*out)).alias("g"), "intact_rate")
    return rows.groupBy("g.grouping", *[f"g.{c}" for c in names]).agg(F.avg("intact_rate").alias("mean_rate"), F.count("*").alias("n_cells"))


def pivot(cell_rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return cell_rows.groupBy(row).pivot(column, values).agg(F.avg("intact_rate"))

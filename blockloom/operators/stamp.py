"""Writing markers: stamp unmarked blocks, renew hashes, mint ids for later copies, wrap a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import body_hash, format_marker

WRITTEN = 12  # hex digits of a written hash
# What a wrapped prompt says.
PRESERVE = (
    "This document contains identity markers such as <!-- stay:ID --> or {/* stay:ID */}. Keep every marker directly after the block it belongs to, "
    "give new blocks none, and never reuse the marker of a block for other content."
)
RETURN_ONLY = "Return only the resulting Markdown document."


def mint(keys: list[str]) -> Column:
    """A new id that depends on the document and the place of the block, so that a repeated run gives the same."""
    return F.left(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("idx").cast("string")).cast("binary"), 256), F.lit(8))


def _document(rows: DataFrame, keys: list[str], marks: Column) -> DataFrame:
    part = F.concat_ws("\n", F.nullif(F.col("content"), F.lit("")), F.when(F.size(marks) > 0, F.array_join(marks, "\n")))
    per = rows.select(*keys, F.struct("pos", part.alias("t")).alias("x")).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return per.select(*keys, F.concat(F.array_join(F.transform("xs", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("text"))


def stamp(block_rows: DataFrame, keys: list[str], new_id=mint) -> DataFrame:
    """The document with a marker under every content block that has no well-formed one; markers that are there stay."""
    new = format_marker(new_id(keys), F.left("body_hash", F.lit(WRITTEN)))
    named = F.exists("markers", lambda m: m["id"].isNotNull() & ~m["malformed"])
    marks = F.when(named | (F.col("idx") < 0), F.transform("markers", lambda m: m["raw"])).otherwise(F.concat(F.transform("markers", lambda m: m["raw"]), F.array(new)))
    return _document(block_rows, keys, marks)


def restamp(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The document with the stored hash of every well-formed marker renewed; ids stay."""
    marks = F.transform("markers", lambda m: F.when(m["malformed"] | (F.col("idx") < 0), m["raw"]).when(m["syntax"] == "html", format_marker(m["id"], F.left("body_hash", F.lit(WRITTEN)))).otherwise(format_marker(m["id"], F.left("body_hash", F.lit(WRITTEN)), "mdx")))
    return _document(block_rows, keys, marks)


def repairs(marker_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, seq, id, new_id) for every later copy of an id."""
    order = Window.partitionBy(*keys, "id").orderBy("pos", "seq")
    later = marker_rows.where("id is not null and not malformed").withColumn("__n", F.row_number().over(order)).where("__n > 1")
    fresh = F.left(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("pos").cast("string"), F.col("seq").cast("string"), F.col("id")).cast("binary"), 256), F.lit(8))
    return later.select(*keys, "pos", "seq", "id", fresh.alias("new_id"))


def wrap(text: Column, task: Column | None = None) -> Column:
    """Prompt that asks a model to keep the markers."""
    from ..functions.text import strip_edges

    parts = [] if task is None else [F.nullif(strip_edges(task), F.lit(""))]
    return F.concat_ws("\n\n", *parts, F.lit(PRESERVE), F.lit(RETURN_ONLY), F.concat(F.lit("---\n\n"), strip_edges(text)))

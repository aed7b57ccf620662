"""Scores of rewrites that kept their markers: the markers say where each id should be found without them.

Nothing is judged by a model. An id whose marker the rewrite lost, copied or moved has no truth and counts nowhere.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.similarity import match_form, ratio
from ..functions.text import band_label, strip_markers
from ..session import stored
from . import children, diff, resolve, segment

CATEGORIES = ("correct", "wrong", "missed")
RESULT = ("id", "cat", "method", "score", "sim", "target", "gold")
MODE = "commonmark"  # of items: without a grammar of lists most real documents have none


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two texts in match form; 0 where one is null or empty."""
    return pd.Series([ratio(match_form(x), match_form(y)) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def usable(rows: DataFrame) -> DataFrame:
    """Runs that came back whole."""
    return rows.where(F.coalesce("ok", F.lit(False)) & ~F.coalesce("truncated", F.lit(False)))


def with_truth(scored: DataFrame) -> DataFrame:
    return scored.where("cat != 'no_truth'")


def _category(gold: Column, method: Column, target: Column) -> Column:
    return F.when(gold.isNull(), "no_truth").when(method == "detached", "missed").when(target == gold, "correct").otherwise("wrong")


def _scored(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    rows = rows.withColumn("cat", _category(F.col("gold"), F.col("method"), F.col("target")))
    known = F.col("cat") != "no_truth"
    rows = rows.withColumn("sim", F.when(known, similarity(F.when(known, F.col("before_body")), F.col("after_body"))).otherwise(0.0))
    return rows.select(*keys, "id", "cat", "method", score.alias("score"), "sim", "target", "gold")


def score_blocks(before: DataFrame, after: DataFrame, keys: list[str], text: str = "text", **setting) -> DataFrame:
    """(keys, id, cat, method, score, sim, target, gold) of every id of ``before``, found in ``after`` without its markers."""
    old, new = segment.blocks(before, keys, text), stored(segment.blocks(after, keys, text), "rewritten")
    anchors = stored(resolve.anchors(old, keys), "anchors")
    bare = segment.blocks(after.withColumn(text, strip_markers(F.col(text))), keys, text)
    found = resolve.resolve(anchors, bare, keys, **setting)
    gold = diff.ground_truth(diff.id_index(old, keys), diff.id_index(new, keys), keys).select(*keys, "id", F.col("gold_idx").cast("int").alias("gold"))
    bodies = new.where("idx >= 0").select(*keys, F.col("idx").alias("gold"), F.col("content").alias("after_body"))
    quotes = anchors.groupBy(*keys, "id").agg(F.max_by("quote", F.struct("idx", "seq")).alias("before_body"))
    rows = found.join(quotes, [*keys, "id"]).join(gold, [*keys, "id"], "left").join(bodies, [*keys, "gold"], "left")
    return _scored(rows, keys, F.col("score"))


def child_gold(before: DataFrame, after: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, id, gold, after_body, mismatch): the item that each id sits on, without ids that were dropped.

    ``mismatch`` marks documents whose number of items changes when their markers go: there the numbers of items mean
    nothing, and a caller must leave them out or stop.
    """
    lines = children._lines(after, keys, text).join(children._lines(after.withColumn(text, strip_markers(F.col(text))), keys, text).withColumnRenamed("lines", "later"), keys)

    def work(marked, bare):
        own = [c for b in children.document(marked, MODE) for c in b.items]
        plain = [c for b in children.document(bare, MODE) for c in b.items]
        first: dict[str, int] = {}
        for c in own:
            for m in c.marks:
                if m.id:
                    first.setdefault(m.id, c.index)
        odd = len(own) != len(plain)
        return [(i, at, None if odd else plain[at].content, odd) for i, at in first.items()]

    gold = children._stage(lines, keys, work, "id string, gold int, after_body string, mismatch boolean", [pa.string(), pa.int32(), pa.string(), pa.bool_()])
    dropped = children.child_diff(before, after, keys, text, MODE).where("code = 'CHILD_DROPPED'").select(*keys, "id")
    sides = [diff.id_index(segment.blocks(v, keys, text), keys) for v in (before, after)]
    gone = diff.findings(diff.compare(*sides, keys), keys).where("code = 'DROPPED_ID'").select(*keys, "id")
    return gold.join(dropped.unionByName(gone).distinct(), [*keys, "id"], "left_anti")


def score_items(before: DataFrame, after: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The same for ids of list items; documents whose items do not correspond have no truth."""
    bare = after.withColumn(text, strip_markers(F.col(text)))
    found = children.child_resolutions(before, bare, keys, text, MODE)
    quotes = children.child_rows(before, keys, text, MODE).select(*keys, F.explode("ids").alias("id"), F.col("content").alias("before_body")).dropDuplicates([*keys, "id"])
    gold = child_gold(before, after, keys, text).where("not mismatch").drop("mismatch")
    rows = found.join(quotes, [*keys, "id"], "left").join(gold, [*keys, "id"], "left")
    return _scored(rows, keys, F.when(_category(F.col("gold"), F.col("method"), F.col("target")) == "correct", 1.0).otherwise(0.0))


def report(scored: DataFrame, by: list[str]) -> DataFrame:
    """One table per column of ``by``, per band of similarity and over all, in one pass: (slice, value, counts, rates)."""
    rows = with_truth(scored).withColumn("band", band_label(F.col("sim")))
    slices = [F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in ("band", *by)] + [F.struct(F.lit("all").alias("slice"), F.lit(None).cast("string").alias("value"))]
    each = rows.select(F.explode(F.array(*slices)).alias("s"), "cat").select("s.slice", "s.value", "cat")
    counts = each.groupBy("slice", "value").agg(*[F.count_if(F.col("cat") == c).alias(c) for c in CATEGORIES], F.count("*").alias("n"))
    return counts.withColumn("recovery", F.col("correct") / F.col("n")).withColumn("false_rate", F.col("wrong") / F.col("n"))


def summary(scored: DataFrame) -> DataFrame:
    """One row: how many ids, found, wrong and detached; how many an exact hash finds; what the quote tier adds; mean similarity."""
    is_ = lambda c, v: F.col(c) == v
    return with_truth(scored).agg(
        F.count("*").alias("n"), F.count_if(is_("cat", "correct")).alias("correct"), F.count_if(is_("cat", "wrong")).alias("wrong"), F.count_if(is_("cat", "missed")).alias("detached"),
        F.count_if(is_("method", "hash")).alias("exact"), F.count_if(is_("cat", "correct") & is_("method", "quote")).alias("quote_saves"), F.coalesce(F.avg("sim"), F.lit(0.0)).alias("mean_sim"),
    )

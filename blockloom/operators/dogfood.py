"""What a check of edits catches: cells of an edit study, a judge's verdicts, guards and nags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def eligible(df: DataFrame, name: str, text: str, word_cap: int, n: int | None = None) -> DataFrame:
    """Stamped Markdown documents of at most ``word_cap`` words, the shortest first, index files left out."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    rows = df.where(F.col(name).endswith(".md") & ~F.col(name).rlike(r"(^|/)INDEX\.md$") & F.col(text).contains("stay:")).withColumn("n_words", words).where(F.col("n_words") <= word_cap)
    return rows.orderBy("n_words", name).limit(n) if n is not None else rows


def structural(compared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One cell per document: stays before, counts by finding, whether the edit is caught and for which codes."""
    count = lambda code: F.count_if(F.col("code") == code)
    per = found.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(F.col("code") == "DROPPED_ID", F.col("id")))).alias("dropped"),
        count("RELOCATED_ID").alias("relocated"), count("DUPLICATED_ID").alias("duplicated"), count("HASH_DRIFT").alias("hash_drift"), count("NEW_ID").alias("new_ids"),
        F.bool_or(F.col("level") == "error").alias("caught"), F.sort_array(F.collect_set(F.when(F.col("level") == "error", F.col("code")))).alias("block_reason"),
    )
    stays = compared.where("b_hash is not null").groupBy(*keys).agg(F.count("*").alias("n_stays"))
    return stays.join(per, keys, "full").select(
        *keys, F.coalesce("n_stays", F.lit(0)).alias("n_stays"), F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("relocated", "duplicated", "hash_drift", "new_ids")],
        F.coalesce("caught", F.lit(False)).alias("caught"), F.coalesce("block_reason", F.array().cast("array<string>")).alias("block_reason"),
    )


def verdicts(reply: Column) -> Column:
    """Map of number to SURVIVED or DELETED from lines such as ``3: DELETED``; the last line on a number stands."""
    numbers = F.regexp_extract_all(reply, F.lit(r"(?im)^\s*\[?(\d+)\]?\s*[:.)\-]\s*\**(SURVIVED|DELETED)\b"), F.lit(1))
    words = F.regexp_extract_all(reply, F.lit(r"(?im)^\s*\[?(\d+)\]?\s*[:.)\-]\s*\**(SURVIVED|DELETED)\b"), F.lit(2))
    pairs = F.arrays_zip(numbers.alias("n"), words.alias("w"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(numbers, i + 2, F.size(numbers)), lambda m: m.cast("int") == p["n"].cast("int")))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["n"].cast("int").alias("n"), F.upper(p["w"]).alias("w"))))


def judged(cells: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, verdict) of every dropped id, numbered from 1 in the order of the ids; UNKNOWN without a verdict."""
    ids = cells.select(*keys, F.posexplode("dropped").alias("k", "id"))
    rows = ids.join(replies.select(*keys, verdicts(F.col("reply")).alias("v")), keys, "left")
    return rows.select(*keys, "id", F.coalesce(F.try_element_at("v", F.col("k") + 1), F.lit("UNKNOWN")).alias("verdict"))


def finalized(cells: DataFrame, judged_rows: DataFrame, keys: list[str]) -> DataFrame:
    """A caught edit is a guard if a section is really gone, else a nag."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    per = judged_rows.groupBy(*keys).agg(n("DELETED").alias("content_drops"), n("SURVIVED").alias("marker_strips"), n("UNKNOWN").alias("judge_unknown"))
    rows = cells.join(per, keys, "left")
    z = {c: F.coalesce(c, F.lit(0)) for c in ("content_drops", "marker_strips", "judge_unknown")}
    return rows.withColumns(z).withColumn("is_guard", F.col("caught") & (F.col("content_drops") > 0)).withColumn("is_nag", F.col("caught") & (F.col("content_drops") == 0))


def labels(cells: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``label`` (doc01, doc02, ...) in the order of the sample, which is a small table."""
    n = F.row_number().over(Window.orderBy(*order))
    return cells.withColumn("label", F.concat(F.lit("doc"), F.lpad(n.cast("string"), 2, "0")))


def summaries(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sums over finalized cells, overall and per column of ``by`` in one pass: (slice, value, sums and counts)."""
    slices = [F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in by] + [F.struct(F.lit("all").alias("slice"), F.lit(None).cast("string").alias("value"))]
    each = cells.withColumn("s", F.explode(F.array(*slices)))
    total = lambda c, name: F.sum(c).alias(name)
    return each.groupBy("s.slice", "s.value").agg(
        F.count("*").alias("n"), total("n_stays", "stays"), total("content_drops", "content_drops"), total("marker_strips", "marker_strips"), total("judge_unknown", "unknown"),
        F.count_if(F.col("content_drops") > 0).alias("cells_with_drops"), F.count_if(F.col("marker_strips") > 0).alias("cells_with_strips"),
        F.count_if("caught").alias("blocked"), F.count_if("is_guard").alias("guards"), F.count_if("is_nag").alias("nags"),
        total("relocated", "relocated"), total("duplicated", "duplicated"), total("hash_drift", "hash_drift"),
    )


def ranked(rows: DataFrame, by: str, tie: list[str]) -> DataFrame:
    """Rows of a report with their place, the greatest first. A report is a small table."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), *tie)))

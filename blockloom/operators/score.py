"""Scores of resolutions against truth, rates with exact intervals, grouped reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("correct", "wrong", "missed", "correct_detach", "false_attach")


def category(accept: Column, target: Column) -> Column:
    """``accept`` is null where the id must be detached; ``target`` is null where it was."""
    return (
        F.when(accept.isNull() & target.isNull(), "correct_detach").when(accept.isNull(), "false_attach").when(target.isNull(), "missed").when(F.array_contains(accept, target), "correct").otherwise("wrong")
    )


def scored(truth: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, cat, method, score, target); an id without a resolution counts as detached."""
    rows = truth.join(resolved, [*keys, "id"], "left")
    return rows.select(*keys, "id", category(F.col("accept"), F.col("target")).alias("cat"), F.coalesce("method", F.lit("detached")).alias("method"), "score", "target")


def tally(rows: DataFrame, by: list[str], total: bool = False, more: list[Column] | None = None) -> DataFrame:
    """Counts of the categories by group; with ``total`` also over all groups, with nulls for their names."""
    counts = [F.count_if(F.col("cat") == c).alias(c) for c in CATEGORIES]
    grouped = rows.rollup(*by) if total else rows.groupBy(*by)
    return grouped.agg(*counts, F.count("*").alias("n"), *(more or []))


def merged(counts: DataFrame, by: list[str]) -> DataFrame:
    """Partial counts added up."""
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*CATEGORIES, "n")])


def rates(counts: DataFrame) -> DataFrame:
    """Adds recovery (correct of all that survived) and false rate (wrong or falsely attached of all); 0 of nothing."""
    found = F.col("correct") + F.col("wrong") + F.col("missed")
    all_ = found + F.col("correct_detach") + F.col("false_attach")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return counts.withColumn("recovery", share(F.col("correct"), found)).withColumn("false_rate", share(F.col("wrong") + F.col("false_attach"), all_))


def grouping(rows: DataFrame, by: list[str]) -> DataFrame:
    """One report per column of ``by`` and one over all: (slice, value, counts, rates)."""
    sets = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in by], F.struct(F.lit("all").alias("slice"), F.lit(None).cast("string").alias("value")))).alias("s"), "cat")
    return rates(tally(sets.select("s.slice", "s.value", "cat"), ["slice", "value"]))


def clopper_pearson(k: int, n: int, alpha: float = 0.05, steps: int = 80) -> tuple[float, float]:
    """Exact interval of a binomial share, by bisection on the distribution; (0, 1) of nothing."""
    import math

    if n <= 0:
        return 0.0, 1.0

    def at_most(x: int, p: float) -> float:
        if p <= 0.0:
            return 1.0
        if p >= 1.0:
            return 1.0 if x >= n else 0.0
        a, b = math.log(p), math.log1p(-p)
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * a + (n - i) * b) for i in range(x + 1))

    def root(below) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if below(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else root(lambda p: 1.0 - at_most(k - 1, p) < alpha / 2)
    high = 1.0 if k == n else root(lambda p: at_most(k, p) > alpha / 2)
    return low, high


def with_interval(df: DataFrame, k: str, n: str, low: str, high: str, alpha: float = 0.05) -> DataFrame:
    """Adds the exact interval of k of n; meant for aggregated rows."""
    kept = df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [clopper_pearson(int(x or 0), int(y or 0), alpha) for x, y in zip(b.column(k).to_pylist(), b.column(n).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64())], names=[*b.schema.names, low, high])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{low}` double, `{high}` double")


def against_control(cells: DataFrame, arm: str, control, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """Cells of other arms with what they lose against the control arm: recovery or safety."""
    base = cells.where(F.col(arm) == control).select(*keys, F.col("recovery").alias("c_recovery"), F.col("false_rate").alias("c_false"))
    rows = cells.where(F.col(arm) != control).join(base, keys)
    return rows.withColumn("veto", (F.col("recovery") < F.col("c_recovery") - eps) | (F.col("false_rate") > F.col("c_false") + eps))

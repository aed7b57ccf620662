"""What changed between full snapshots: a full outer join on the key that compares canonical row hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import body_hash, clean_hash


def successors(df: DataFrame, snap: str, delivery: str) -> DataFrame:
    """One row per snapshot: its highest delivery and the next snapshot present. As many rows as snapshots."""
    per = df.where(F.col(snap).isNotNull()).groupBy(snap).agg(F.max(delivery).alias("last_delivery"))
    order = Window.orderBy(snap)
    return per.select(
        F.col(snap).alias("s_no"), "last_delivery", F.lead(snap).over(order).alias("next_no"), F.lag(snap).over(order).isNotNull().alias("has_before")
    )


def same_body(a: Column, b: Column) -> Column:
    """Equal in as many digits as both have: stored hashes may be cut."""
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.left(a, n) == F.left(b, n), F.lit(False)) | (a.isNull() & b.isNull())


def snapshot_changes(df: DataFrame, keys: list[str], snap: str, delivery: str, order: str, digest: Column) -> DataFrame:
    """Records added, removed or changed between each snapshot and the next lower one present.

    Of a snapshot only its highest delivery counts, in it the row of a record with the latest ``order`` (null is the
    lowest; of equal ones the greater digest stands). Rows with a null snapshot or null key part are left out. The
    lowest snapshot has no changes. Only keys and digests are shuffled, one row per record, snapshot and task.
    """
    snaps = successors(df, snap, delivery)
    rows = df.select(F.col(snap).alias("snap_no"), F.col(delivery).alias("delivery"), *keys, F.col(order).alias("ord"), digest.alias("digest")).dropna(subset=["snap_no", *keys])
    kept = rows.join(snaps, (F.col("snap_no") == F.col("s_no")) & F.col("delivery").eqNullSafe(F.col("last_delivery")))
    state = kept.groupBy("snap_no", "next_no", "has_before", *keys).agg(F.max(F.struct("ord", "digest")).alias("x")).select("snap_no", "next_no", "has_before", *keys, F.col("x.digest").alias("digest"))
    new = state.where("has_before").select(F.col("snap_no").alias("at"), *keys, F.col("digest").alias("new"), F.lit(True).alias("in_new"))
    old = state.where("next_no is not null").select(F.col("next_no").alias("at"), *keys, F.col("digest").alias("old"), F.lit(True).alias("in_old"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same_body(F.col("new"), F.col("old")), "changed")
    return new.join(old, ["at", *keys], "full").select(F.col("at").alias("snap_no"), *keys, change.alias("change")).where("change is not null")


def block_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of ``block_snapshots``: a record is (source, chunk_id or else marker_id), a body the hash of its content."""
    named = snapshots.withColumn("id", F.coalesce("chunk_id", "marker_id"))
    digest = F.coalesce(body_hash(F.col("content")), clean_hash(F.col("body_hash")))
    return snapshot_changes(named, ["source", "id"], "snap_no", "delivery", "loaded_at", digest)
